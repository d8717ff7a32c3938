"""Problem 8: sentence boundaries in any language and script.

Runs of end marks are candidates. Rules decide the clear ones: those in the
middle of a number, name, address or open quotation are out, as is an ellipsis
before a lower-case word; other runs that end in "!", "?" or a CJK, Arabic or
Indic end mark, without a closing quote or bracket, are boundaries. The rest,
full stops above all, are classified by a maximum-entropy model on neighbouring
tokens, case, length, digits and script. It is trained without
hand-made labels: candidates at the end of a paragraph are certain boundaries,
the rest are unlabelled. As a share c of the boundaries ends a paragraph, the
model's probability of "ends a paragraph" is c times that of "is a boundary"
(Elkan and Noto, 2008).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vsearch.runtime import ship

#: The model is fitted on the candidates of at most TRAIN_DOCS documents, at most TRAIN_ROWS of them, chosen by hash; all documents are split.
TRAIN_DOCS = 4_000
TRAIN_ROWS = 120_000
#: A token is a feature by itself if it stands at so many candidates of the sample.
LEAST_SEEN = 25

# Marks, quotes, and abbreviations that don't end sentences.
MARKS = ".!?…。！？．｡؟۔।॥"
OPENERS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》"}
CLOSERS = "\"'”’“»)]」』）】》"
ABBREVIATIONS = frozenset(
    "dr mr mrs ms prof st sr sra jr rev gen col capt lt sgt hon vs cf e.g i.e eg ie fig figs no nos vol pp approx incl resp dept est ca al ed eds op inc ltd "
    "abb nr bzw usw bspw ggf vgl evtl inkl str hr fr frl bzgl sog tel "
    "mme mlle mm env art chap "
    "ej ud uds sra srta dra pág págs núm aprox "
    "см рис стр табл гл им тыс млн руб ул т.е т.д т.п "
    "डॉ श्री".split()
)
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())

_PARAGRAPH = re.compile(r"\r?\n[^\S\n]*\n\s*")
_EMOJI = "[\U0001f000-\U0001faff☀-➿⬀-⯿\ufe0f\u200d]"
_CANDIDATE = re.compile(
    rf"[{re.escape(MARKS)}]+(?:[ \xa0\u202f]?»|[\"'”’“)\]」』）】》])*(?:[ \n\xa0]?{_EMOJI}+)?|(?<=[ก-๛])[ \u00a0]+(?=[ก-๛])"
)
_AFTER = re.compile(r"\s*([\"“„«「『(\[（【¿¡']*)\s*(\w+|\S|\Z)")
_ADDRESS = re.compile(r"(?:(?<=[A-Za-z0-9+.-])://|www\.)[!-~]*")
_WIDE_CHARS = "぀-ヿ㐀-鿿豈-﫿가-힯"
_WIDE = re.compile(f"[{_WIDE_CHARS}]")
#: What a token can't hold, so that no two tokens before candidates have text in common and whole ones can be looked at.
_BREAK = re.compile(rf"[\s\"“”„«»「」『』()\[\]（）【】¿¡!?…。！？．｡؟۔।॥]|(?<=[{_WIDE_CHARS}])\.|\.(?=[{_WIDE_CHARS}])")


def _script(ch: str) -> str:
    if not ch:
        return "-"
    o = ord(ch)
    for name, a, b in (("latin", 0x41, 0x24F), ("cyrillic", 0x400, 0x52F), ("arabic", 0x600, 0x77F), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("wide", 0x3040, 0x9FFF)):
        if a <= o <= b:
            return name
    return "other"


def _kind(tok: str) -> str:
    c = tok[:1]
    if not c:
        return "none"
    if c.isupper():
        return "upper"
    if c.islower():
        return "lower"
    if c.isdigit():
        return "digit"
    return "letter" if c.isalpha() else "sign"


def _brackets(p: str) -> list[tuple[int, int]]:
    """Stretches (opening, closing) of quotations and brackets that close in the paragraph; nested ones lie in their outer one."""
    stack: list[tuple[int, str]] = []
    out: list[tuple[int, int]] = []
    straight = [i for i, c in enumerate(p) if c == '"'] if '"' in p else []
    out.extend((a, b) for a, b in zip(straight[::2], straight[1::2]))
    waiting: Counter[str] = Counter()  # closing marks of those on the stack
    for m in re.finditer(r"[“”„«»「」『』()\[\]（）【】《》]", p):
        c, i = m.group(), m.start()
        if waiting[c]:
            while True:  # those left open inside are dropped
                o, closing = stack.pop()
                waiting.subtract(closing)
                if c in closing:
                    out.append((o, i))
                    break
        elif c in OPENERS:
            stack.append((i, OPENERS[c]))
            waiting.update(OPENERS[c])
    return sorted(out)


class Candidate:
    """end: end of the sentence if this is a boundary, in the paragraph; sure: True, False or None (to classify)."""

    __slots__ = ("end", "features", "sure")

    def __init__(self, end: int, sure: bool | None, features: tuple[str, ...]):
        self.end, self.sure, self.features = end, sure, features


def candidates(p: str, following: str) -> list[Candidate]:
    """Of a stripped paragraph; ``following`` is the next one. Its own end comes last, with the features it would have inside."""
    out: list[Candidate] = []
    pairs = _brackets(p)
    opening = {c: o for o, c in pairs}
    breaks = [m.end() for m in _BREAK.finditer(p)]
    addresses = [m.span() for m in _ADDRESS.finditer(p)]
    k, reach = 0, -1  # the furthest closing of the pairs that open before the candidate
    opened = -1
    n = len(p)
    started = 0
    for m in _CANDIDATE.finditer(p):
        a, b = m.span()
        if p[a] in " \u00a0":
            if a > reach:
                while k < len(pairs) and pairs[k][0] < a:
                    if pairs[k][1] > reach:
                        opened, reach = pairs[k]
                    k += 1
                if a > reach:
                    out.append(Candidate(a, True, ()))
                    started = b
            continue
        text = p[a:b]
        marks = len(text) - len(text.lstrip(MARKS))
        e = a + marks
        while e < b and (p[e] in CLOSERS or p[e] in " \u00a0\u202f"):
            # an opening quote isn't the sentence's
            if p[e] == "“" and opening.get(e, a) >= a:
                break
            if p[e] == '"' and e not in opening:
                break
            if p[e] == "'" and p[e + 1 : e + 2].isalpha():
                break
            if p[e] in " \u00a0\u202f" and p[e + 1 : e + 2] != "»":
                break
            e += 1
        closers = p[a + marks : e].strip()
        if e < b and re.match(rf"[ \n\xa0]?{_EMOJI}", p[e:b]):
            e = b
        while k < len(pairs) and pairs[k][0] < a:
            if pairs[k][1] > reach:
                opened, reach = pairs[k]
            k += 1
        if reach >= e:
            continue  # inside something that closes later
        last = e >= n
        k_break = bisect_right(breaks, a)
        token = breaks[k_break - 1] if k_break else 0
        rest, r = (following, 0) if last else (p, e)
        nxt = _AFTER.match(rest, r)
        spaced = last or rest[r : r + 1].isspace()
        quote, tok = nxt.group(1), nxt.group(2)
        kind = _kind(tok)
        mark = "…" if marks > 1 and set(p[a : a + marks]) == {"."} else p[a + marks - 1]
        sure: bool | None = None
        if last:
            sure = True
        elif kind == "sign" and not quote and tok in ",;:%/*+=-–—_)]}，、；：" and not closers.endswith("\x00"):
            sure = False
        elif mark in ".．" and not spaced and not closers and not _WIDE.match(rest, r):
            # no space: only between a word and a capital
            dotted = p.rfind(".", token, a) >= 0  # of a chain of dots, only the last token is looked at
            plain = not dotted and (a - token > 2 and p[token:a].isalpha() and p[token + 1 : a].islower() or token == a and p[a - 1 : a] in ("»", ")", "]", "”"))
            if not (plain and (kind == "upper" or quote)):
                sure = False
        elif mark in "!?" and not spaced and not closers and token < a and (not quote or rest[r] == "'") and not _WIDE.match(rest, r):
            # inside a name or address; the space may be missing before a capital
            at = bisect_right(addresses, (a, n)) - 1
            if kind in ("lower", "digit") or at >= 0 and a < addresses[at][1]:
                sure = False
        features: tuple[str, ...] = ()
        if sure is not False:
            before = p[token:a]
            low = before.lower()
            word = tok.lower() if not _WIDE.match(tok) else tok[0]
            length = min(len(low), 6)
            one = len(low) == 1 and low.isalpha()
            closed = bool(closers.strip("'"))
            lead = closed and opened <= started + 1 and reach >= 0 and reach < e and reach >= a
            shape = "one" if one else "inner" if "." in low else "number" if low[-1:].isdigit() else "empty" if not low else "word"
            features = (
                "bias", f"mark={mark}", f"shape={shape}", f"shape={shape},mark={mark}", f"next={kind}", f"next={kind},mark={mark}", f"shape={shape},next={kind}",
                f"length={length},mark={mark}", f"script={_script(before[-1:])}", f"closed={closed},next={kind}", f"lead={lead},next={kind}",
                f"listed={low in ABBREVIATIONS},mark={mark}", f"month={shape == 'number' and word in MONTHS}", f"before={low}", f"after={word}", f"closed={closed},after={word}",
                f"one={one and before.isupper()}",
            )
            if sure is None and mark in "!?。！？｡؟۔।॥" and not closers:
                sure = True
            if mark == "…" and kind == "lower" and not last:
                sure = False
        if sure is not False and not last:
            out.append(Candidate(e, sure, features))
            if sure:
                started = e
                while started < n and p[started].isspace():
                    started += 1
        elif last:
            out.append(Candidate(e, True, features))
    if not out or out[-1].end < n:
        out.append(Candidate(n, True, ()))
    return out


#: What the model is drawn to where the sample says little; log-odds against those of an average candidate.
PRIOR = {"listed=True,mark=.": -4.0, "one=True": -4.0, "month=True": -4.0, "lead=True,next=lower": -4.0, "lead=True,next=letter": -4.0, "shape=one": -1.5, "shape=inner,next=lower": -1.0}


class Model:
    def __init__(self, weights: dict[str, float], threshold: float):
        self.weights, self.threshold = weights, threshold

    def boundary(self, features: tuple[str, ...]) -> bool:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features]) > self.threshold


def fit(rows: list[tuple[bool, list[str]]], rounds: int = 300, pull: float = 24.0) -> Model:
    """Maximum-entropy model of "ends a paragraph", and the threshold at half the share c of boundaries that do.

    ``pull`` is the weight of the prior, in candidates; the bias has none.
    """
    seen = Counter(f for _, fs in rows for f in fs)
    names = [f for f, c in seen.items() if c >= LEAST_SEEN or not f.startswith(("before=", "after=", "closed=True,after=", "closed=False,after="))]
    names += [f for f in PRIOR if f not in seen]
    at = {f: i for i, f in enumerate(names)}
    prior = np.array([PRIOR.get(f, 0.0) for f in names])
    y = np.array([float(label) for label, _ in rows])
    if not len(y) or not y.any() or y.all():
        return Model(dict(PRIOR), -1.0)
    flat = [(r, at[f]) for r, (_, fs) in enumerate(rows) for f in fs if f in at]
    row, col = np.array(flat).T
    w = prior.copy()
    w[at["bias"]] = np.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    hold = np.full_like(w, pull / len(y))
    hold[at["bias"]] = 0
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.bincount(row, w[col], minlength=len(y))))
        g = np.bincount(col, (p - y)[row], minlength=len(w)) / len(y) + hold * (w - prior)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    p = 1 / (1 + np.exp(-np.bincount(row, w[col], minlength=len(y))))
    half = p[y == 1].mean() / 2
    return Model(dict(zip(names, w.tolist())), float(np.log(half / (1 - half))))


def paragraphs(text: str) -> list[tuple[int, str]]:
    """(start, stripped paragraph) of those that hold anything."""
    out, at = [], 0
    for m in [*_PARAGRAPH.finditer(text), None]:
        end = m.start() if m else len(text)
        raw = text[at:end]
        p = raw.strip()
        if p:
            out.append((at + len(raw) - len(raw.lstrip()), p))
        at = m.end() if m else end
    return out


def ends(text: str, model: Model) -> list[tuple[int, int]]:
    """(start, end) of every sentence, in order."""
    out = []
    ps = paragraphs(text)
    for i, (at, p) in enumerate(ps):
        following = ps[i + 1][1] if i + 1 < len(ps) else ""
        start = 0
        for c in candidates(p, following):
            if c.sure or model.boundary(c.features):
                while start < c.end and p[start].isspace():
                    start += 1
                if c.end > start:
                    out.append((at + start, at + c.end))
                start = c.end
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, feats = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ps = paragraphs(text)
            for k, (at, p) in enumerate(ps):
                following = ps[k + 1][1] if k + 1 < len(ps) else ""
                for c in candidates(p, following):
                    if c.features and (following or c.end < len(p)):
                        ids.append(i)
                        labels.append(c.end >= len(p))
                        feats.append(list(c.features))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.bool_()), pa.array(feats, pa.list_(pa.string()))], names=["id", "label", "features"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, train_rows: int = TRAIN_ROWS) -> Model:
    """The model for ``docs``, from the documents of least hash: only their candidates are brought to the driver, not their texts."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    hashed = F.xxhash64("id")
    most = rows.select(hashed.alias("h")).orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
    found = rows.filter(hashed <= F.lit(most)).mapInArrow(_examples, "id long, label boolean, features array<string>")
    table = found.orderBy(hashed, "label", "features").limit(train_rows).toArrow()
    return fit(list(zip(table["label"].to_pylist(), table["features"].to_pylist())))


def _split(batches: Iterator[pa.RecordBatch], model: Model, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(5)]
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for n, (a, b) in enumerate(ends(text, model)):
                for c, v in zip(cols, (i, n, a, b, text[a:b] if with_text else None)):
                    c.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "sentence_no", "start_pos", "end_pos", "sentence"])


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, with_text: bool = True) -> DataFrame:
    """(id, sentence_no, start_pos, end_pos, sentence) for every sentence of every document, in order.

    ``start_pos`` and ``end_pos`` count characters before the sentence's first
    and up to its last one. Null ids and texts, empty and blank texts give no
    rows; a document without any mark is one sentence a paragraph; repeated
    rows give their sentences again. The model is trained on the documents
    themselves unless given. One narrow pass; nothing is shuffled.
    """
    ship(docs.sparkSession)
    model = model or train(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col)).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return rows.mapInArrow(lambda it: _split(it, model, with_text), "id long, sentence_no int, start_pos long, end_pos long, sentence string")
