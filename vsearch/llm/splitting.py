"""Problem 1: cut oversized texts at natural boundaries.

A text is seen as a tree: sections by heading rank, blocks between blank
lines, list items, lines, sentences, words. Nodes are opened only while they
are larger than the limit; the pieces of the children are then merged with
their neighbours, level by level, as long as they fit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vsearch.runtime import broadcast_if_small, ship

#: Fixed: the characters next to which a text may be cut.
BREAKS = " \t\n\u00a0\u3000。！？"

_HEADING = re.compile(
    r"^(?:(#{1,6})[ \t]|(={2,6})[^=\n]+={2,6}[ \t]*$|\\((?:sub){0,2})section\*?\{|<[hH]([1-6])[ >])", re.M
)
_FENCE = re.compile(r"^(```|~~~)[^\n]*\n.*?^\1[^\n]*(?:\n|\Z)", re.M | re.S)
_LEVELS = (
    re.compile(r"\n[ \t]*\n\s*"),  # blocks
    re.compile(r"\n(?=[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t])"),  # list items
    re.compile(r"\n+"),  # lines
    re.compile(r"[.!?…।؟]+[\"'”’»)\]]*[ \t\u00a0\u3000]+|[。！？]+[」』”’）]*"),  # sentences
    re.compile(f"[{BREAKS}]"),  # words
)


def _headings(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _HEADING.finditer(text):
        if m.start() and text[m.start() - 1] not in BREAKS:
            continue
        hashes, equals, subs, html = m.groups()
        rank = len(hashes) if hashes else len(equals) if equals else int(html) if html else 1 + len(subs or "") // 3
        found.append((m.start(), rank))
    return found


class _Packer:
    """Packs one text; spans are (start, end, forced) and tile the text."""

    def __init__(self, text: str, size: int, overlap: int):
        self.text, self.size, self.limit = text, size, size - overlap
        self.headings = _headings(text)
        self.at = [p for p, _ in self.headings]
        self.fences = [m.span() for m in _FENCE.finditer(text)]

    def _inside_fence(self, p: int) -> bool:
        i = bisect_right(self.fences, (p, len(self.text) + 1)) - 1
        return i >= 0 and self.fences[i][0] < p < self.fences[i][1]

    def _section_cuts(self, s: int, e: int) -> list[int]:
        """Starts of the topmost sections strictly inside (s, e)."""
        inner = [h for h in self.headings[bisect_right(self.at, s) : bisect_left(self.at, e)] if not self._inside_fence(h[0])]
        top = min((r for _, r in inner), default=0)
        return [p for p, r in inner if r == top]

    def _cuts(self, s: int, e: int, level: int) -> list[int]:
        # a cut inside a match that holds several breaks comes after its last one
        cuts = [m.end() for m in _LEVELS[level].finditer(self.text, s, e) if m.end() < e]
        cuts = [p for p in cuts if self.text[p - 1] in BREAKS or self.text[p] in BREAKS]
        return [p for p in cuts if not self._inside_fence(p)] if level < 2 and self.fences else cuts

    def pack(self, s: int, e: int, level: int = -1) -> list[tuple[int, int, bool]]:
        if e - s <= self.limit:
            return [(s, e, False)]
        while True:
            if level == len(_LEVELS):
                forced = len(self.text[s:e].strip(BREAKS)) > self.size
                return [(p, min(p + self.limit, e), forced) for p in range(s, e, self.limit)]
            cuts = self._section_cuts(s, e) if level < 0 else self._cuts(s, e, level)
            if cuts:
                break
            level += 1
        # sections nest, so the same level is tried again inside a section
        deeper = level if level < 0 else level + 1
        parts: list[tuple[int, int, bool]] = []
        for a, b in zip([s, *cuts], [*cuts, e]):
            parts.extend(self.pack(a, b, deeper) if b - a > self.limit else [(a, b, False)])
        return self.merge(parts, self.limit)

    def merge(self, parts: list[tuple[int, int, bool]], first: int) -> list[tuple[int, int, bool]]:
        out: list[tuple[int, int, bool]] = []
        for a, b, forced in parts:
            room = first if len(out) == 1 else self.limit
            if out and b - out[-1][0] <= room:
                out[-1] = (out[-1][0], b, out[-1][2] or forced)
            else:
                out.append((a, b, forced))
        return out


def split_text(text: str, size: int, overlap: int) -> list[tuple[int, int, int, bool]]:
    """(piece start, new content start, end, forced) of every piece, in order.

    A text of at most ``size`` characters is one piece, an empty one none. Piece i is
    ``text[start:end]``; it begins with the last ``overlap`` characters before
    its new content, and all new contents joined are the text.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    if len(text) <= size:
        return [(0, 0, len(text), False)] if text else []
    p = _Packer(text, size, overlap)
    spans = p.merge(p.pack(0, len(text)), size)
    return [(max(0, a - overlap), a, b, forced) for a, b, forced in spans]


_PIECES = "id long, piece_no int, n_pieces int, start_pos long, end_pos long, overlap_len int, piece_kind string, piece string"


def _split_batches(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(8)]
        ids, texts, sizes, overlaps = (c.to_pylist() for c in batch.columns)
        for i, text, size, overlap in zip(ids, texts, sizes, overlaps):
            pieces = split_text(text, size, overlap)
            for n, (start, new, end, forced) in enumerate(pieces):
                row = (i, n, len(pieces), start, end, new - start, "forced" if forced else "natural", text[start:end] if with_text else None)
                for c, v in zip(cols, row):
                    c.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
        names = [x.split()[0] for x in _PIECES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def split_oversized(df: DataFrame, id_col: str = "id", text_col: str = "text", size_col: str = "chunk_size", overlap_col: str = "overlap", with_text: bool = True) -> DataFrame:
    """Pieces of every text longer than the size in its row.

    One narrow pass without a shuffle; short texts never leave the JVM. Rows
    whose text or size is null, or whose text fits, give no piece. A null
    overlap is 0; an overlap not below the size is an error. ``piece_kind`` is
    ``forced`` for a piece made by cutting inside a run of characters, longer
    than the size, without a break. Other columns of ``df``, whatever their
    names, are not looked at. ``piece`` is null unless ``with_text``.
    """
    ship(df.sparkSession)
    rows = df.select(
        F.col(id_col).cast("long"), F.col(text_col), F.col(size_col).cast("int"), F.coalesce(F.col(overlap_col).cast("int"), F.lit(0))
    ).filter(F.length(text_col) > F.col(size_col))
    return rows.mapInArrow(lambda it: _split_batches(it, with_text), _PIECES)


def with_specs(entries: DataFrame, specs: DataFrame) -> DataFrame:
    """Entries with the chunk size and overlap of their collection; those without a spec drop out."""
    s = specs.select(F.col("coll_name").alias("_coll"), "chunk_size", "overlap")
    return entries.drop("chunk_size", "overlap", "_coll").join(broadcast_if_small(s, 10_000), F.col("coll_name") == F.col("_coll")).drop("_coll")
