"""The single-file collection format: reading it as a DataFrame, and writing it.

Little-endian. Header of 64 bytes: magic, byte-order mark, version, dimension,
count. Then a bitmap of active documents, lowest bit first; a length and a
JSON array of {doc_id, text, metadata}; the vectors as float32, row by row.
A record whose slot isn't its place in the file has it as a further member, ``slot``.
"""

from __future__ import annotations

import json
import os
import struct
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from typing import Any, BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vsearch.operators.numbering import dense_number
from vsearch.runtime import drop_stage, ship, stage
from vsearch.types import DOCS, StoreError

# Fixed values of the format.
MAGIC = b"SV01"
BYTE_ORDER = 0x04030201
VERSION = 1
HEADER_BYTES = 64
_FIELDS = struct.Struct("<4sIHxxII")

#: A local file beyond so many bytes is read by many tasks.
WHOLE_BYTES = 16 << 20
#: Bytes of records that a task reads, about; bytes of vectors that it holds at once.
BLOCK_BYTES = 4 << 20
#: Bytes that the driver holds at once when it writes a file, about.
WRITE_BYTES = 16 << 20


@dataclass
class Header:
    dimension: int
    count: int


def pack_header(h: Header) -> bytes:
    return _FIELDS.pack(MAGIC, BYTE_ORDER, VERSION, h.dimension, h.count).ljust(HEADER_BYTES, b"\0")


def unpack_header(raw: bytes) -> Header:
    if len(raw) < HEADER_BYTES:
        raise StoreError("the header is cut off")
    magic, order, version, dim, count = _FIELDS.unpack_from(raw)
    for ok, what in ((magic == MAGIC, "magic"), (order == BYTE_ORDER, "byte order"), (version == VERSION, "version"), (dim > 0, "dimension")):
        if not ok:
            raise StoreError(f"wrong {what} in the header")
    return Header(dim, count)


def pack_bitmap(active: np.ndarray) -> bytes:
    return np.packbits(np.asarray(active, bool), bitorder="little").tobytes()


def unpack_bitmap(raw: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=count).astype(bool)


def decode(raw: bytes) -> pd.DataFrame:
    """All rows of a file, deleted ones too, in slot order."""
    h = unpack_header(raw)
    at = HEADER_BYTES
    bits = (h.count + 7) // 8
    if len(raw) < at + bits + 4:
        raise StoreError("the bitmap is cut off")
    active = unpack_bitmap(raw[at : at + bits], h.count)
    at += bits
    (length,) = struct.unpack_from("<I", raw, at)
    at += 4
    if len(raw) < at + length:
        raise StoreError("the metadata is cut off")
    try:
        records = json.loads(raw[at : at + length].decode("utf-8"))
    except ValueError as e:
        raise StoreError(f"the metadata can't be read: {e}") from e
    at += length
    if len(records) != h.count:
        raise StoreError("the metadata has another number of records than the header")
    if len(raw) < at + 4 * h.count * h.dimension:
        raise StoreError("the vectors are cut off")
    vectors = np.frombuffer(raw, "<f4", h.count * h.dimension, at).reshape(h.count, h.dimension)
    return pd.DataFrame(
        {
            "slot": np.array([r.get("slot", n) for n, r in enumerate(records)], np.int64),
            "doc_id": [r["doc_id"] for r in records],
            "text": [r.get("text") for r in records],
            "vector": list(vectors),
            "metadata": [json.dumps(r.get("metadata") or {}, ensure_ascii=False) for r in records],
            "active": active,
        }
    )


def _record(place: int, slot: int, doc_id: str, text: str | None, metadata: str | None) -> bytes:
    record = {"doc_id": doc_id, "text": text, "metadata": json.loads(metadata) if metadata else {}} | ({} if slot == place else {"slot": slot})
    return json.dumps(record, ensure_ascii=False).encode("utf-8")


def encode(rows: pd.DataFrame, dimension: int) -> bytes:
    vectors = np.asarray(list(rows["vector"]), "<f4").reshape(len(rows), dimension)
    block = b"[" + b", ".join(_record(n, int(s), *r) for n, (s, *r) in enumerate(zip(rows["slot"], rows["doc_id"], rows["text"], rows["metadata"]))) + b"]"
    return b"".join([pack_header(Header(dimension, len(rows))), pack_bitmap(rows["active"].to_numpy(bool)), struct.pack("<I", len(block)), block, vectors.tobytes()])


# --- reading ------------------------------------------------------------------------------------

_STEP = np.zeros(256, np.int8)
_STEP[[ord(c) for c in "{["]] = 1
_STEP[[ord(c) for c in "}]"]] = -1


@dataclass(frozen=True)
class Layout:
    """Where the blocks of a file begin, and what tells whether it is still the same file."""

    path: str
    size: int
    changed: int
    dimension: int
    count: int
    records: int
    vectors: int


def layout(path: str) -> Layout:
    with open(path, "rb") as f:
        h = unpack_header(f.read(HEADER_BYTES))
        at = HEADER_BYTES + (h.count + 7) // 8
        f.seek(at)
        raw = f.read(4)
        if len(raw) < 4:
            raise StoreError("the bitmap is cut off")
        s = os.fstat(f.fileno())
        end = at + 4 + struct.unpack("<I", raw)[0]
        if s.st_size < end:
            raise StoreError("the metadata is cut off")
        if s.st_size < end + 4 * h.count * h.dimension:
            raise StoreError("the vectors are cut off")
        return Layout(path, s.st_size, s.st_mtime_ns, h.dimension, h.count, at + 4, end)


def _opened(a: Layout) -> BinaryIO:
    f = open(a.path, "rb")
    s = os.fstat(f.fileno())
    if (s.st_size, s.st_mtime_ns) != (a.size, a.changed):
        f.close()
        raise StoreError(f"{a.path} has changed since it was opened")
    return f


def _read(f: BinaryIO, start: int, end: int) -> bytes:
    f.seek(start)
    return f.read(end - start)


def _brackets(a: Layout, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of bytes of the records: the brackets, their places, which stand after an odd number of quotes, and all quotes' number."""
    with _opened(a) as f:
        before = start
        while before > a.records and _read(f, before - 1, before) == b"\\":
            before -= 1
        raw = _read(f, start, end)
    if (start - before) % 2:  # the first one is escaped
        raw = b"_" + raw[1:]
    b = np.frombuffer(raw.replace(b"\\\\", b"__").replace(b'\\"', b"__"), np.uint8)
    quotes, places = np.flatnonzero(b == ord('"')), np.flatnonzero(_STEP[b])
    return b[places], places, np.searchsorted(quotes, places) & 1, len(quotes)


def _sides(block: tuple[Layout, int, int]) -> tuple[int, int, int]:
    """Whether a block's quotes are odd; by how much it deepens if it begins outside a string, and if inside one."""
    kinds, _, odd, quotes = _brackets(*block)
    steps = _STEP[kinds].astype(np.int64)
    return quotes & 1, int(steps[odd == 0].sum()), int(steps[odd == 1].sum())


def _begins(block: tuple[Layout, int, int, int, int]) -> tuple[int, int]:
    """How many records begin in a block of known beginning, and where the first one does."""
    a, start, end, inside, depth = block
    kinds, places, odd, _ = _brackets(a, start, end)
    kinds, places = kinds[odd == inside], places[odd == inside]
    steps = _STEP[kinds].astype(np.int64)
    found = places[(kinds == ord("{")) & (depth + np.cumsum(steps) - steps == 1)]
    return len(found), start + int(found[0]) if len(found) else -1


def extents(a: Layout, block_bytes: int, run: Callable[[Callable, list], list]) -> list[tuple[Layout, int, int, int, int]]:
    """(layout, start, end, first place, number) of whole records, about a block each. ``run`` maps a function over blocks.

    Whether a block begins inside a string, and how deep, follows from the blocks before it: each is scanned for both cases first.
    """
    cuts = [*range(a.records, a.vectors, block_bytes), a.vectors]
    blocks = [(a, start, end) for start, end in zip(cuts, cuts[1:])]
    inside = depth = 0
    known = []
    for block, (odd, *deeper) in zip(blocks, run(_sides, blocks)):
        known.append((*block, inside, depth))
        depth += deeper[inside]
        inside ^= odd
    if inside or depth or not blocks:
        raise StoreError("the metadata can't be read: it doesn't end")
    begun = [(n, at) for n, at in run(_begins, known) if n]
    if sum(n for n, _ in begun) != a.count:
        raise StoreError("the metadata has another number of records than the header")
    with _opened(a) as f:
        if _read(f, a.records, begun[0][1] if begun else a.vectors).split() not in ([[b"["]] if begun else [[b"[]"], [b"[", b"]"]]):
            raise StoreError("the metadata can't be read: it is no array of records")
    firsts = np.cumsum([0, *(n for n, _ in begun)]).tolist()
    ends = [*(at for _, at in begun[1:]), a.vectors]
    return [(a, at, end, first, n) for (n, at), end, first in zip(begun, ends, firsts)]


def rows_of(extent: tuple[Layout, int, int, int, int]) -> Iterator[pa.RecordBatch]:
    a, start, end, first, n = extent
    with _opened(a) as f:
        raw = _read(f, start, end).rstrip()
        try:
            if raw[-1:] != (b"]" if end == a.vectors else b","):
                raise ValueError("records aren't apart")
            records = json.loads(b"[%b]" % raw[:-1])
        except ValueError as e:
            raise StoreError(f"the metadata can't be read: {e}") from e
        if len(records) != n:
            raise StoreError("the metadata has another number of records than the header")
        bits = HEADER_BYTES + first // 8
        active = unpack_bitmap(_read(f, bits, HEADER_BYTES + (first + n + 7) // 8), first % 8 + n)[first % 8 :]
        most = max(1, min(10_000, BLOCK_BYTES // (4 * a.dimension)))
        for i in range(0, n, most):
            own = records[i : i + most]
            at = a.vectors + 4 * a.dimension * (first + i)
            vectors = np.frombuffer(_read(f, at, at + 4 * a.dimension * len(own)), "<f4")
            columns = [
                pa.array([r.get("slot", first + i + k) for k, r in enumerate(own)], pa.int64()),
                pa.array([r["doc_id"] for r in own], pa.string()),
                pa.array([r.get("text") for r in own], pa.string()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * a.dimension, pa.int32()), pa.array(vectors, pa.float32())),
                pa.array([json.dumps(r.get("metadata") or {}, ensure_ascii=False) for r in own], pa.string()),
                pa.array(active[i : i + most]),
            ]
            yield pa.RecordBatch.from_arrays(columns, DOCS.names)


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for raw in b["content"]:
            yield decode(bytes(raw))


def _decoded_parts(batches: Iterator[pa.RecordBatch], parts: list) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for n in b.column(0).to_pylist():
            yield from rows_of(parts[n])


def read_sv(spark: SparkSession, path: str) -> DataFrame:
    """A file, or each file matching a pattern, as rows of ``types.DOCS``.

    Small files are decoded whole. Where a local one (on a disk that all executors share) is larger, all are read in
    stretches of whole records, which two scans by many tasks find first; no task holds more than a stretch.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    found = [(r["path"], r["length"]) for r in files.select("path", "length").collect()]
    if all(n <= WHOLE_BYTES for _, n in found) or not all(p.startswith("file:") for p, _ in found):
        return files.select("content").mapInPandas(_decoded, DOCS)

    def run(f: Callable[[Any], Any], blocks: list) -> list:
        return spark.sparkContext.parallelize(blocks, max(1, min(len(blocks), 1_000))).map(f).collect()

    parts = [x for p, _ in sorted(found) for x in extents(layout("/" + p.removeprefix("file:").lstrip("/")), BLOCK_BYTES, run)]
    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(partial(_decoded_parts, parts=parts), DOCS)


# --- writing ------------------------------------------------------------------------------------

_BLOCKS = "first long, rows long, active binary, records binary, vectors binary"


def _encoded(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows at consecutive places as the bytes of each block of the file."""
    most = max(1, BLOCK_BYTES // (4 * dimension))
    for b in batches:
        at = b.column("_place").to_numpy()
        for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
            for i in range(0, len(run), most):
                part = b.slice(run[i], len(run[i : i + most]))
                rows = zip(*(part.column(c).to_pylist() for c in ("_place", "slot", "doc_id", "text", "metadata")))
                vectors = pc.list_flatten(part.column("vector")).to_numpy(zero_copy_only=False).astype("<f4")
                active = pack_bitmap(part.column("active").to_numpy(zero_copy_only=False))
                block = [int(at[run[i]]), part.num_rows, active, b", ".join(_record(*r) for r in rows), vectors.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in block], ["first", "rows", "active", "records", "vectors"])


def write_sv(docs: DataFrame, path: str, dimension: int | None = None) -> None:
    """Write a collection as one local file; meant for export, as a single file takes a single writer. The file appears whole or not at all.

    Executors encode blocks of rows; the driver puts them one behind the
    other in the order of slots, a bounded number of bytes at a time.
    """
    rows = dense_number(docs.select(*DOCS.names), ["slot"], "_place")
    if dimension is None:
        first = rows.select(F.size("vector")).first()
        if first is None:
            raise StoreError("an empty collection needs a dimension")
        dimension = first[0]
    odd = rows.filter(F.col("vector").isNull() | (F.size("vector") != dimension)).select("doc_id").first()
    if odd or dimension < 1:
        raise StoreError(f"the vector of {odd[0]!r} isn't of {dimension} elements" if odd else "vectors need elements")
    blocks = stage(rows.mapInArrow(partial(_encoded, dimension=dimension), _BLOCKS), "blocks")
    known = sorted(tuple(r) for r in blocks.select("first", "rows", "active", F.octet_length("records"), F.octet_length("vectors")).collect())
    count = sum(k[1] for k in known)
    if count >= 1 << 32:
        raise StoreError("the rows are too many for this format, whose count has 32 bits")
    length = 2 + sum(k[3] for k in known) + 2 * max(0, len(known) - 1)
    if length >= 1 << 32:
        raise StoreError("the records are too many for this format, whose length has 32 bits")
    active = np.concatenate([unpack_bitmap(k[2], k[1]) for k in known] or [np.zeros(0, bool)])
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
        try:
            f.write(pack_header(Header(dimension, count)) + pack_bitmap(active) + struct.pack("<I", length) + b"[")
            for n, raw in enumerate(_in_order(blocks, "records", [(k[0], k[3]) for k in known])):
                f.write((b", " if n else b"") + raw)
            f.write(b"]")
            for raw in _in_order(blocks, "vectors", [(k[0], k[4]) for k in known]):
                f.write(raw)
            f.flush()
            os.fsync(f.fileno())
            os.replace(f.name, path)
        except BaseException:
            os.unlink(f.name)
            raise
    drop_stage(blocks)
    drop_stage(rows)


def _in_order(blocks: DataFrame, column: str, sizes: list[tuple[int, int]]) -> Iterator[bytes]:
    """A column of all blocks in order; ``sizes``: the place and bytes of each."""
    i = 0
    while i < len(sizes):
        j, held = i + 1, sizes[i][1]
        while j < len(sizes) and held + sizes[j][1] <= WRITE_BYTES:
            held += sizes[j][1]
            j += 1
        got = dict(blocks.filter(F.col("first").between(sizes[i][0], sizes[j - 1][0])).select("first", column).collect())
        for first, _ in sizes[i:j]:
            yield bytes(got.pop(first))
        i = j
