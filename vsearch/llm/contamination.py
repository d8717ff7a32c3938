"""Problem 6: evaluation texts inside training texts.

The items' terms form a generalised suffix automaton. A document's terms are
streamed through it; the state and the length reached at each term tell the
longest stretch of any item that ends there. Many items make several automata,
built by the executors and run side by side over each document.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vsearch.llm.entries import TERM, terms
from vsearch.runtime import ship, stage

#: Terms in a row that count as a leak; of an item with fewer, all.
RUN = 12
#: Characters of items put into one automaton, about; an item is never split.
AUTOMATON_CHARS = 1_000_000
#: Bytes of automata broadcast at once; the documents are read once for so many. The result is the same for any number.
SCAN_BYTES = 128 << 20


class SuffixAutomaton:
    """Over sequences of terms; knows for every state which items it shows to have leaked."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN):
        self.run = run
        self.codes: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        seqs = [(i, [self.codes.setdefault(t, len(self.codes)) for t in ts]) for i, ts in items if ts]
        for _, seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        n = len(self.link)
        # the ancestor-or-self that stands for the last `run` terms, if the state is that long
        self.gram = [-1] * n
        whole: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items_of: list[set[int]] = [set() for _ in range(n)]
        order = sorted(range(1, n), key=self.length.__getitem__)
        for s in order:
            if self.length[s] >= run:
                p = self.link[s]
                self.gram[s] = s if self.length[p] < run else self.gram[p]
        for i, seq in seqs:
            s = 0
            for c in seq:
                s = self.next[s][c]
                if self.gram[s] >= 0:
                    items_of[self.gram[s]].add(i)
            if len(seq) < run:
                while self.length[self.link[s]] >= len(seq):
                    s = self.link[s]
                whole[s].append((len(seq), i))
        self.items = [tuple(sorted(x)) for x in items_of]
        # short items that end with a state: its own need the reached length, those of its ancestors don't
        self.short: list[tuple[tuple[int, int], ...]] = [()] * n
        for s in order:
            self.short[s] = tuple(whole[s]) + self.short[self.link[s]]
        # compact: most states have one way on, `one` its term (-2: several, in `many`) and `to` its end
        self.one, self.to, self.many = array("i", [-1]) * n, array("i", [-1]) * n, {}
        for s, ways in enumerate(self.next):
            if len(ways) == 1:
                ((self.one[s], self.to[s]),) = ways.items()
            elif ways:
                self.one[s], self.many[s] = -2, ways
        self.gram, self.link, self.length = array("i", self.gram), array("i", self.link), array("i", self.length)
        del self.next

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def scan(self, toks: list[str]) -> tuple[set[int], list[tuple[int, int]]]:
        """Items leaked into a sequence of terms, and the leaking stretches as (first term, end term), merged."""
        found: set[int] = set()
        spans: list[tuple[int, int]] = []
        codes, one, to, many, link, length = self.codes, self.one, self.to, self.many, self.link, self.length
        s = reached = 0
        for at, t in enumerate(toks):
            c = codes.get(t)
            if c is None:
                s = reached = 0
                continue
            while True:
                o = one[s]
                s2 = to[s] if o == c else many[s].get(c, -1) if o == -2 else -1
                if s2 >= 0 or not s:
                    break
                s = link[s]
                reached = length[s]
            if s2 < 0:
                reached = 0
                continue
            s = s2
            reached += 1
            take = 0
            if reached >= self.run:
                found.update(self.items[self.gram[s]])
                take = reached
            for n, i in self.short[s]:
                if n <= reached:
                    found.add(i)
                    take = max(take, n)
            if take:
                first = at + 1 - take
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, at + 1))
        return found, spans


def _places(text: str) -> list[tuple[int, int]]:
    """Character ranges, in the text as stored, of its terms."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in TERM.finditer(low)]
    # how many characters a lower case has doesn't depend on its neighbours
    origin = [k for k, ch in enumerate(text) for _ in ch.lower()]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in TERM.finditer(low)]


def united(spans: list[tuple]) -> list[tuple]:
    """Spans (from, up to, ...), those that overlap or touch as one; further pairs of values are united alike."""
    out: list[tuple] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            out[-1] = tuple(min(x, y) if i % 2 == 0 else max(x, y) for i, (x, y) in enumerate(zip(out[-1], s)))
        else:
            out.append(s)
    return out


_SPAN = ("first", "end", "start_pos", "end_pos")
_SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in _SPAN]))
_HITS = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", _SPANS), ("n_terms", pa.int64())])
_SPAN_SQL = "struct<first:long,end:long,start_pos:long,end_pos:long>"


def _scan(batches: Iterator[pa.RecordBatch], automata) -> Iterator[pa.RecordBatch]:
    machines = [pickle.loads(a) for a in automata.value]
    for batch in batches:
        rows = []
        for i, text, mark in zip(*(c.to_pylist() for c in batch.columns)):
            toks = terms(text)
            items, spans = set(), []
            for m in machines:
                found, where = m.scan(toks)
                items |= found
                spans += where
            if items:
                at = _places(text)
                where = [dict(zip(_SPAN, (s, e, at[s][0], at[e - 1][1]))) for s, e in united(spans)]
                rows.append({"id": i, "text_hash": mark, "items": sorted(items), "spans": where, "n_terms": len(toks)})
        yield pa.RecordBatch.from_pylist(rows, schema=_HITS)


_FOUND = pa.schema(
    [("id", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start_pos", pa.int64()), ("end_pos", pa.int64())]))), ("covered", pa.float64())]
)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, items, spans, n in zip(*(c.to_pylist() for c in batch.columns)):
            whole = united([tuple(s[k] for k in _SPAN) for s in spans])
            rows.append({"id": i, "items": sorted(set(items)), "spans": [{"start_pos": a, "end_pos": b} for _, _, a, b in whole], "covered": sum(e - s for s, e, _, _ in whole) / n})
        yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)


def automata(items: DataFrame, run: int = RUN) -> DataFrame:
    """(part, size, automaton) of items (item, t), built by the executors, one for each AUTOMATON_CHARS of their text."""
    chars = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-chars // AUTOMATON_CHARS))

    def build(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["item"].to_pylist(), t["t"].to_pylist()))
        made = pickle.dumps(SuffixAutomaton([(i, terms(text)) for i, text in rows], run), protocol=5)
        return pa.table({"part": pa.array([t["part"][0].as_py()], pa.int64()), "size": pa.array([len(made)], pa.int64()), "automaton": pa.array([made], pa.binary())})

    return items.withColumn("part", F.pmod(F.xxhash64("item", "t"), F.lit(parts))).groupBy("part").applyInArrow(build, "part long, size long, automaton binary")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = RUN) -> DataFrame:
    """(id, items, spans, covered) of every document that an item leaked into.

    An item leaked if the document holds ``run`` consecutive terms of it, or
    all its terms in a row if it has fewer. ``spans`` are the stretches of the
    text (from, up to, in characters) shared with items, apart and in order;
    ``covered`` is their share of the document's terms. Null ids and texts and
    texts without terms, of documents or items, take no part; items with equal
    texts are all reported. A repeated row of a document counts once; an id
    with different texts has a row for each.

    Documents are read once for each SCAN_BYTES of automata, and only what was
    found in them is shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    known = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("t")).filter(F.col("item").isNotNull() & F.col("t").isNotNull())
    made = stage(automata(known, run), "automata")
    scans: list[list[int]] = [[]]
    room = SCAN_BYTES
    for part, size in made.select("part", "size").orderBy("part").collect():  # a row for each automaton
        if scans[-1] and size > room:
            scans.append([])
            room = SCAN_BYTES
        scans[-1].append(part)
        room -= size
    found = None
    for parts in scans:
        sent = spark.sparkContext.broadcast([r[0] for r in made.filter(F.col("part").isin(parts)).select("automaton").collect()])
        one = rows.mapInArrow(lambda it, sent=sent: _scan(it, sent), f"id long, text_hash long, items array<long>, spans array<{_SPAN_SQL}>, n_terms long")
        found = one if found is None else found.unionByName(one)
    whole = found.groupBy("id", "text_hash").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"), F.min("n_terms").alias("n_terms"))
    return whole.select("id", "items", "spans", "n_terms").mapInArrow(_merge, "id long, items array<long>, spans array<struct<start_pos:long,end_pos:long>>, covered double")


def without_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_covered: float = 0.5) -> DataFrame:
    """(id, action, text) of every document in ``found``: its text without the leaked stretches.

    A document covered beyond ``most_covered`` is dropped: action ``drop`` and
    a null text; else the action is ``cut``. ``found`` has a row a document, as
    :func:`leaks` gives for distinct ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("whole")).join(found, "id")
    kept = F.expr(
        """aggregate(spans, named_struct('at', 0L, 'out', ''),
             (s, x) -> named_struct('at', greatest(s.at, x.end_pos),
                                    'out', concat(s.out, substring(whole, cast(s.at + 1 AS int), cast(greatest(x.start_pos - s.at, 0) AS int)))),
             s -> concat(s.out, substring(whole, cast(s.at + 1 AS int))))"""
    )
    drop = F.col("covered") > most_covered
    return rows.select("id", F.when(drop, "drop").otherwise("cut").alias("action"), F.when(~drop, kept).alias("text"))
