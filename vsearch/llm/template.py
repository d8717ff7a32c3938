"""Problem 5, the collection: clean text with the template of each host's pages taken out.

Template deduction by equivalence classes (Arasu and Garcia-Molina, 2003): the
tokens of a host that occur equally often on each of its pages form a class. A
class that is large, frequent, ordered alike on all pages and nested with the
others is part of the template; what stands between its tokens are the slots.

Copies of a page share all their tokens, and those that differ by small edits
nearly all, without these being a template. So a page only speaks for a class
if text that isn't of the class stands between its tokens, and enough of it;
and pages in which that text is the same, or nearly, speak once.
"""

from __future__ import annotations

import re
from bisect import bisect, insort
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vsearch.llm import markup
from vsearch.llm.entries import TERM, entry_texts
from vsearch.runtime import broadcast_if_small, stage

#: A class must be on this share of a host's pages, and on LEAST_PAGES, with as many different texts in its slots. A host thus has at most 1/SHARE times the tokens of an average page in its template.
SHARE = 0.05
LEAST_PAGES = 3
LEAST_TOKENS = 2
#: At least this share of a page's characters isn't template.
LEAST_REST = 0.2
#: Terms in a row that tell whether two slots hold nearly the same.
SHINGLE = 3
#: Texts without any of these hold no construct.
MARKS = r"[<&\[{'=\\$`*_~#>|]|-{3}"


def _token(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def _lines(page: markup.Page) -> Iterator[tuple[int, int, str]]:
    """(start, end, source) of each line of text in ``page.rest`` that isn't blank."""
    for m in re.finditer(r"^.*\S.*$", page.rest, re.M):
        yield m.start(), m.end(), page.source(m.group().strip())


def _sketch(line: str) -> tuple[int, int]:
    """Least and greatest hash of the line's runs of terms."""
    t = TERM.findall(line.lower())
    runs = [" ".join(t[i : i + SHINGLE]) for i in range(max(1, len(t) - SHINGLE + 1))] if t else [line]
    hashes = [_token(r) for r in runs]
    return min(hashes), max(hashes)


def page_tokens(page: markup.Page) -> list[dict]:
    """The tokens of a page: markup constructs and whole lines of text.

    Each has its hash ``h``, its count ``n``, the places of its ``first`` and
    ``last``, its ``kind`` (0: a line, else 1 and more, as in markup.KINDS); of
    a line also its characters and the ends ``lo``, ``hi`` of its hashes.
    """
    kind = {k: i + 1 for i, k in enumerate(markup.KINDS)}
    places = [(a, kind[k], f"{k}:{tok}") for a, _, k, tok in page.found]
    places += [(a, kind[piece.kind], f"{piece.kind}:{piece.name}") for a, piece in page.places()]
    places += [(a, 0, line) for a, _, line in _lines(page)]
    seen: dict[int, dict] = {}
    for at, k, tok in sorted(places):
        h = _token(tok if k else "line:" + tok)
        t = seen.get(h)
        if t is None:
            lo, hi = (None, None) if k else _sketch(tok)
            seen[h] = {"h": h, "n": 1, "first": at, "last": at, "kind": k, "chars": 0 if k else len(tok), "lo": lo, "hi": hi}
        else:
            t["n"] += 1
            t["last"] = at
    return list(seen.values())


_I64, _I32 = pa.int64(), pa.int32()
_TOKENS = pa.list_(pa.struct([("h", _I64), ("n", _I32), ("first", _I32), ("last", _I32), ("kind", _I32), ("chars", _I32), ("lo", _I64), ("hi", _I64)]))
_PAGES = "id long, host string, tokens array<struct<h:long,n:int,first:int,last:int,kind:int,chars:int,lo:long,hi:long>>"


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hosts, toks = [], [], []
        for i, host, text in zip(*(c.to_pylist() for c in batch.columns)):
            page = markup.Page(text)
            if page.kinds:
                ids.append(i)
                hosts.append(host)
                toks.append(page_tokens(page))
        yield pa.RecordBatch.from_arrays([pa.array(ids, _I64), pa.array(hosts, pa.string()), pa.array(toks, _TOKENS)], names=["id", "host", "tokens"])


def votes(tokens: list[dict], classes: dict[int, tuple[int, int]]) -> list[dict]:
    """What a page says of each class on it. ``classes``: of a token its class and the number of pages that has.

    A class is judged by the lines that belong to no class, or to one of fewer
    pages: ``speaks`` is whether they are enough and one stands between the
    tokens of the class; ``lo`` and ``hi`` are the ends of their hashes.
    """
    whole = sum(t["chars"] * t["n"] for t in tokens)
    of: dict[int, list[dict]] = {}
    support: dict[int, int] = {}
    rest: dict[int, list[dict]] = {0: []}
    for t in tokens:
        c, n = classes.get(t["h"], (None, 0))
        if c is not None:
            of.setdefault(c, []).append(t)
            support[c] = n
        if t["chars"]:
            rest.setdefault(n, []).append(t)
    out = []
    places: list[int] = []
    chars, lo, hi = 0, None, None
    at = sorted(rest)
    for c in sorted(of, key=lambda c: (support[c], c)):
        while at and at[0] < support[c]:
            for t in rest[at.pop(0)]:
                insort(places, t["first"])
                chars += t["chars"] * t["n"]
                lo = t["lo"] if lo is None else min(lo, t["lo"])
                hi = t["hi"] if hi is None else max(hi, t["hi"])
        mine = sorted(of[c], key=lambda t: (t["first"], t["h"]))
        first, last = mine[0]["first"], max(t["last"] for t in mine)
        speaks = chars >= LEAST_REST * whole and bisect(places, first) < bisect(places, last)
        order = xxhash.xxh3_64_intdigest(b"".join(t["h"].to_bytes(8, "little", signed=True) for t in mine)) - (1 << 63)
        out.append({"class": c, "order": order, "speaks": speaks, "lo": lo, "hi": hi})
    return out


_VOTES = pa.schema([("class", _I64), ("order", _I64), ("speaks", pa.bool_()), ("lo", _I64), ("hi", _I64)])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for tokens, marks in zip(*(c.to_pylist() for c in batch.columns)):
            rows += votes(tokens, {m["h"]: (m["class"], m["on_pages"]) for m in marks})
        yield pa.RecordBatch.from_pylist(rows, schema=_VOTES)


def deduce(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, templates) of texts (id, host, text), ids distinct, which are read once.

    ``pages`` has (id, host, tokens) of every text with markup; ``templates``
    has (id, template) of those with tokens of valid classes, as an array of
    (h, class, on_pages). Nothing is gathered by host: a host with most pages
    has its tokens counted before the shuffle, and tokens are grouped by page.
    """
    pages = stage(texts.select("id", "host", "text").mapInArrow(_pages, _PAGES), "pages")
    least = pages.groupBy("host").agg(F.greatest(F.lit(LEAST_PAGES), F.ceil(F.count("*") * SHARE)).alias("least"))
    toks = pages.select("id", "host", F.inline("tokens"))
    # the occurrence vector, as two hashes that don't depend on the order of pages
    vectors = toks.groupBy("host", "h").agg(
        F.count("*").alias("on_pages"), F.bit_xor(F.xxhash64("id", "n")).alias("v1"), F.bit_xor(F.xxhash64("n", "id", F.lit(1))).alias("v2")
    )
    frequent = vectors.join(broadcast_if_small(least), "host").filter("on_pages >= least").select("host", "h", "on_pages", "least", F.xxhash64("host", "v1", "v2", "on_pages").alias("class"))
    frequent = stage(frequent, "frequent")
    large = frequent.groupBy("class").agg(F.count("*").alias("size")).filter(F.col("size") >= LEAST_TOKENS).select("class")
    members = stage(frequent.join(broadcast_if_small(large), "class", "left_semi"), "classes")
    marks = F.collect_list(F.struct("h", "class", "on_pages")).alias("marks")
    marked = stage(toks.select("id", "host", "h").join(broadcast_if_small(members.drop("least")), ["host", "h"]).groupBy("id").agg(marks), "marks")
    said = pages.select("id", "tokens").join(broadcast_if_small(marked), "id").select("tokens", "marks").mapInArrow(_votes, "class long, order long, speaks boolean, lo long, hi long")
    speaks = F.col("speaks")
    agreed = (
        said.groupBy("class")
        .agg((F.min("order") == F.max("order")).alias("same"), F.least(F.count_distinct(F.when(speaks, F.col("lo"))), F.count_distinct(F.when(speaks, F.col("hi")))).alias("texts"))
        .filter("same")
    )
    valid = agreed.join(members.select("class", "least").distinct(), "class").filter("texts >= least").select("class")
    known = marked.select("id", F.inline("marks")).join(broadcast_if_small(stage(valid, "valid")), "class", "left_semi")
    return pages, stage(known.groupBy("id").agg(F.collect_list(F.struct("h", "class", "on_pages")).alias("template")), "templates")


def nested(intervals: list[tuple[int, int, int]]) -> set[int]:
    """Classes, from (first, last, class) on a page, whose intervals don't cross those of an accepted wider one."""
    kept: list[tuple[int, int]] = []
    out: set[int] = set()
    for a, b, c in sorted(intervals, key=lambda x: (x[0] - x[1], x)):
        if all(not (p < a < q < b or a < p < b < q) for p, q in kept):
            kept.append((a, b))
            out.add(c)
    return out


def template_tokens(tokens: list[dict], template: list[dict]) -> set[int]:
    """Those of a page's tokens that are template: of nested classes, and of the most common of these only as many as leave LEAST_REST of the text."""
    of = {x["h"]: x for x in template}
    spans: dict[int, list[int]] = {}
    chars: dict[int, int] = {}
    whole = 0
    for t in tokens:
        whole += t["chars"] * t["n"]
        if t["h"] in of:
            c = of[t["h"]]["class"]
            s = spans.setdefault(c, [t["first"], t["last"]])
            s[0], s[1] = min(s[0], t["first"]), max(s[1], t["last"])
            chars[c] = chars.get(c, 0) + t["chars"] * t["n"]
    good = nested([(a, b, c) for c, (a, b) in spans.items()])
    room, kept = (1 - LEAST_REST) * whole, set()
    for _, c in sorted({(-x["on_pages"], x["class"]) for x in template if x["class"] in good}):
        if chars[c] <= room:
            room -= chars[c]
            kept.add(c)
    return {h for h, x in of.items() if x["class"] in kept}


def extract(text: str, template: list[dict]) -> tuple[list[str], str, list[str], int]:
    """(kinds, clean text, slots, template tokens found). Lines of the template are taken out; the slots are the texts between its tokens."""
    page = markup.Page(text)
    if not page.kinds:
        return [], text, [], 0
    tokens = page_tokens(page) if template else []
    known = template_tokens(tokens, template) if template else set()
    if not known:
        return page.kinds, page.render(page.rest), [], 0
    hits = sum(t["n"] for t in tokens if t["h"] in known)
    lines = [(a, b) for a, b, line in _lines(page) if _token("line:" + line) in known]
    cuts = lines + [(a, b) for a, b, kind, tok in page.found if _token(f"{kind}:{tok}") in known]
    slots, at = [], 0
    for a, b in sorted(cuts):
        if a > at:
            slots.append(page.rest[at:a])
        at = max(at, b)
    slots.append(page.rest[at:])
    keep = [page.rest[a:b] for a, b in zip([0, *(b for _, b in lines)], [*(a for a, _ in lines), len(page.rest)])]
    plain = (re.sub("\ue000(\\d+)\ue001", lambda m: page.pieces[int(m.group(1))].clean, s).translate(page.back).strip() for s in slots)
    return page.kinds, page.render("".join(keep)), [s for s in plain if s], hits


_CLEAN = pa.schema([("id", pa.int64()), ("kinds", pa.list_(pa.string())), ("text", pa.string()), ("slots", pa.list_(pa.string())), ("template_tokens", pa.int32())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in range(5)]
        for i, text, template in zip(*(c.to_pylist() for c in batch.columns)):
            for c, v in zip(rows, (i, *extract(text, template or []))):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _CLEAN)], schema=_CLEAN)


def _sources(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    texts = entry_texts(df.withColumn("_host", F.coalesce(F.col(host_col).cast("string"), F.lit(""))), id_col, text_col, keep=("_host",)).withColumnRenamed("_host", "host")
    return texts.select(F.col("id").cast("long").alias("id"), "text", "host")


def markup_kinds(df: DataFrame, id_col: str = "seq", text_col: str = "text", host_col: str = "coll_name") -> DataFrame:
    """(id, kinds) of every text with markup, each id once, from the tokens of its host's template and those of its slots.

    The constructs that a renderer would act on are the tokens of the
    deduction. A template's token has its kind for all pages of the host; the
    others are the page's own. Null ids and texts and texts without markup give
    no rows; a null host is a host of its own.
    """
    pages, found = deduce(_sources(df, id_col, text_col, host_col).filter(F.col("text").rlike(MARKS)))
    rows = pages.select("id", "tokens").join(broadcast_if_small(found), "id", "left")
    common = F.coalesce(F.transform("template", lambda x: x["h"]), F.array().cast("array<long>"))
    shared = F.transform(F.filter("tokens", lambda t: F.array_contains(common, t["h"])), lambda t: t["kind"])
    own = F.transform(F.filter("tokens", lambda t: ~F.array_contains(common, t["h"])), lambda t: t["kind"])
    names = F.array(*[F.lit(k) for k in markup.KINDS])
    there = F.array_sort(F.filter(F.array_union(shared, own), lambda k: k > 0))
    return rows.select("id", F.transform(there, lambda k: F.element_at(names, k)).alias("kinds"))


def clean_texts(df: DataFrame, id_col: str = "seq", text_col: str = "text", host_col: str = "coll_name") -> DataFrame:
    """(id, kinds, text, slots, template_tokens) of every text, each id once.

    ``kinds`` are those of the constructs that a renderer would act on;
    ``text`` is the clean text without the host's template lines, ``slots`` the
    texts between template tokens. A text without markup, blank texts included,
    comes out as it is, with no kinds; null ids and texts are left out. A null
    host is a host of its own. A page keeps at least LEAST_REST of its lines'
    characters; copies of a page, exact or nearly, keep all that only they
    share. Texts without any markup character are not sent to Python.
    """
    texts = stage(_sources(df, id_col, text_col, host_col), "texts")
    marked = texts.filter(F.col("text").rlike(MARKS))
    rows = marked.join(broadcast_if_small(deduce(marked)[1]), "id", "left").select("id", "text", "template")
    out = rows.mapInArrow(_extract, "id long, kinds array<string>, text string, slots array<string>, template_tokens int")
    none = F.array().cast("array<string>")
    return out.unionByName(texts.filter(~F.col("text").rlike(MARKS)).select("id", none.alias("kinds"), "text", none.alias("slots"), F.lit(0).alias("template_tokens")))
