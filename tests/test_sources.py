import io
import json
import os
import sys
import types
import zipfile

import numpy as np
import pandas as pd
import oracle
import pytest
from pyspark.sql import functions as F

from vsearch.runtime import shared_dir, stage
from vsearch.sources import sv
from vsearch.sources.files import decode_pdf, parse_file, read_files
from vsearch.sources.log import LogWriter, parse_lines, read_log
from vsearch.streaming import ingest
from vsearch.types import SourceError, StoreError


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("häl\nlo", encoding="utf-8")
    (tmp_path / "sub" / "b.MD").write_text("# x")
    (tmp_path / "c.csv").write_text("a,b\n1,2")
    (tmp_path / "latin.txt").write_bytes(b"caf\xe9")
    (tmp_path / "d.exe").write_text("no")
    (tmp_path / "bad.pdf").write_text("no pdf")
    got = {r["path"].rsplit("/", 1)[1]: r for r in read_files(spark, str(tmp_path)).collect()}
    assert {k: r["text"] for k, r in got.items()} == {"a.txt": "häl\nlo", "b.MD": "# x", "c.csv": "a,b\n1,2", "latin.txt": "café", "bad.pdf": None}
    assert got["bad.pdf"]["error"]
    assert parse_file(str(tmp_path / "latin.txt")) == "café"
    for bad in ("d.exe", "none.txt", "bad.pdf"):
        with pytest.raises(SourceError):
            parse_file(str(tmp_path / bad))


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">{body}</w:document>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    p = lambda *runs: "<w:p><w:pPr/>" + "".join(f"<w:r><w:rPr/>{r}</w:r>" for r in runs) + "</w:p>"
    table = "<w:tbl><w:tr><w:tc>" + p("<w:t>cell</w:t>") + "</w:tc></w:tr></w:tbl>"
    body = "<w:body>" + p("<w:t>First </w:t>", "<w:t>line &amp; more</w:t>") + p() + p("<w:t> </w:t>") + table + p("<w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>ü</w:t>") + "</w:body>"
    (tmp_path / "a.docx").write_bytes(docx(body))
    (tmp_path / "b.docx").write_bytes(docx(""))
    (tmp_path / "c.docx").write_bytes(b"PK no zip")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"] is None) for r in read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("First line & more\na\tb\nü", True), "b.docx": (None, False), "c.docx": (None, False)}


def test_pdf(monkeypatch):
    """With a stand-in for the library, which isn't installed here."""

    class Page:
        def __init__(self, text):
            self.get_text = lambda: text

    class Doc(list):
        __enter__, __exit__ = (lambda self: self), (lambda self, *a: None)

    def opened(stream, filetype):
        assert (stream, filetype) == (b"%PDF", "pdf")
        return Doc([Page("one\n"), Page(" \n"), Page("two")])

    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=opened))
    assert decode_pdf(b"%PDF") == "one\n\n\ntwo"


@pytest.fixture
def rows():
    return pd.DataFrame(
        {
            "slot": range(9), "doc_id": [f"d{i}" for i in range(9)], "text": [f"text ü {i}" for i in range(9)], "vector": [np.array([i, 0.5], np.float32) for i in range(9)],
            "metadata": [json.dumps({"i": i, "tags": ["x"]}) for i in range(9)], "active": [i not in (0, 7, 8) for i in range(9)],
        }
    )


def test_sv_round_trip(spark, rows, tmp_path):
    raw = sv.encode(rows, 2)
    # magic, byte order, version, dimension and count at their places
    assert raw[:4] == b"SV01" and raw[4:8] == bytes([1, 2, 3, 4]) and raw[8:10] == b"\1\0" and raw[12:16] == b"\2\0\0\0" and raw[16:20] == b"\x09\0\0\0"
    assert raw[64:66] == bytes([0b01111110, 0])
    back = sv.decode(raw)
    assert list(back["active"]) == list(rows["active"]) and list(back["text"]) == list(rows["text"]) and np.array_equal(np.stack(back["vector"]), np.stack(rows["vector"]))
    (tmp_path / "x.sv").write_bytes(raw)
    df = sv.read_sv(spark, str(tmp_path / "x.sv"))
    sv.write_sv(df, str(tmp_path / "y.sv"))
    assert (tmp_path / "y.sv").read_bytes() == raw


@pytest.mark.parametrize("change", [lambda r: b"XXXX" + r[4:], lambda r: r[:4] + b"\0\0\0\0" + r[8:], lambda r: r[:8] + b"\2\0" + r[10:], lambda r: r[:12] + b"\0\0\0\0" + r[16:], lambda r: r[:-1], lambda r: r[:80], lambda r: r[:40], lambda r: r[:65]])
def test_sv_rejects(rows, change):
    with pytest.raises(StoreError):
        sv.decode(change(sv.encode(rows, 2)))


def test_sv_empty(spark, rows, tmp_path):
    assert len(sv.decode(sv.encode(rows[:0], 3))) == 0
    with pytest.raises(StoreError):
        sv.write_sv(spark.createDataFrame([], "slot long, doc_id string, text string, vector array<float>, metadata string, active boolean"), str(tmp_path / "z.sv"))


def test_sv_keeps_slots_with_gaps(spark, rows, tmp_path):
    rows["slot"] = [0, 1, 5, 6, 7, 1_000_003, 1_000_004, 2_000_006, 1 << 40]
    docs = spark.createDataFrame(rows.sample(frac=1, random_state=1).assign(vector=lambda d: d["vector"].map(np.ndarray.tolist)), "slot long, doc_id string, text string, vector array<float>, metadata string, active boolean")
    sv.write_sv(docs, str(tmp_path / "x.sv"))
    assert (tmp_path / "x.sv").read_bytes() == sv.encode(rows, 2)
    got = sv.read_sv(spark, str(tmp_path / "x.sv")).orderBy("slot").collect()
    assert [(r["slot"], r["doc_id"], r["text"], r["metadata"], r["active"]) for r in got] == list(rows[["slot", "doc_id", "text", "metadata", "active"]].itertuples(index=False, name=None))
    assert [r["vector"] for r in got] == [list(v) for v in rows["vector"]]


def test_sv_roundtrip_of_a_table_with_gaps(spark, sf_dir, tmp_path):
    from vsearch.queries import oracle_sql, queries

    one = spark.read.parquet(f"{sf_dir}/snapshot_docs.parquet")
    shifted = one.withColumns({"slot": one["slot"] + 1_000_003, "doc_id": F.concat("doc_id", F.lit("~1"))})
    one.union(shifted).write.parquet(str(tmp_path / "snapshot_docs.parquet"))
    oracle.check(spark, str(tmp_path), queries()["sv_roundtrip"], oracle_sql()["sv_roundtrip"])


def test_sv_write_leaves_its_source_and_no_more(spark, rows, tmp_path):
    schema = "slot long, doc_id string, text string, vector array<float>, metadata string, active boolean"
    docs = stage(spark.createDataFrame(rows.assign(vector=lambda d: d["vector"].map(np.ndarray.tolist)), schema), "source")
    at = f"{shared_dir(spark).removeprefix('file://')}/stage"
    before = sorted(os.listdir(at))
    sv.write_sv(docs, str(tmp_path / "x.sv"))
    assert (tmp_path / "x.sv").read_bytes() == sv.encode(rows, 2) and docs.count() == 9 and sorted(os.listdir(at)) == before
    sv.write_sv(docs.filter("false"), str(tmp_path / "y.sv"), 2)
    assert (tmp_path / "y.sv").read_bytes() == sv.encode(rows[:0], 2)
    with pytest.raises(StoreError):
        sv.write_sv(docs, str(tmp_path / "z.sv"), 3)
    assert sorted(os.listdir(tmp_path)) == ["x.sv", "y.sv"]


@pytest.fixture
def hard():
    """Records whose texts and metadata look like the block around them."""
    texts = ['}, {"doc_id": "x", "text": "', "\\", '\\"', '\\\\\\"{[', "]}]}", '"', '""', "日本 {", None, "", "a\nb\t}", "\\" * 9]
    meta = ['{"refs": [{"doc_id": "a"}, {"doc_id": "b", "text": "{"}]}', "{}", '{"k": {"k": {"k": [[], {}, "]"]}}}', json.dumps({'"{': '\\"}'})]
    n = 60
    return pd.DataFrame(
        {
            "slot": [i + 1000 * (i > 40) for i in range(n)], "doc_id": [f'd"{{{i}\\' for i in range(n)], "text": [texts[i % 12] for i in range(n)], "vector": [np.array([i, -i, 0.5], np.float32) for i in range(n)],
            "metadata": [meta[i // 3 % 4] for i in range(n)], "active": [i % 7 != 3 for i in range(n)],
        }
    )


def serial(f, blocks):
    return [f(b) for b in blocks]


def plain(frame):
    return [(r.slot, r.doc_id, r.text, list(r.vector), r.metadata, bool(r.active)) for r in frame.itertuples()]


def test_sv_stretches_are_what_the_whole_is(hard, tmp_path):
    raw = sv.encode(hard, 3)
    want = plain(sv.decode(raw))
    assert want == [(s, d, t, v, json.dumps(json.loads(m), ensure_ascii=False), a) for s, d, t, v, m, a in plain(hard)]
    (tmp_path / "x.sv").write_bytes(raw)
    for size in (1, 2, 3, 7, 64, 101, 1000, 1 << 20):
        parts = sv.extents(sv.layout(str(tmp_path / "x.sv")), size, serial)
        assert len(parts) == 60 if size < 8 else len(parts) <= 60 and (size < 1000 or len(parts) < 12)
        assert plain(pd.concat([b.to_pandas() for p in parts for b in sv.rows_of(p)])) == want


@pytest.mark.parametrize("records", [b"[]", b" [ \n]", b"[ ]"])
def test_sv_stretches_of_no_rows(records, tmp_path):
    (tmp_path / "x.sv").write_bytes(sv.pack_header(sv.Header(3, 0)) + len(records).to_bytes(4, "little") + records)
    assert sv.extents(sv.layout(str(tmp_path / "x.sv")), 2, serial) == []


@pytest.mark.parametrize(
    "change",
    [lambda r: b"XXXX" + r[4:], lambda r: r[:12] + b"\0\0\0\0" + r[16:], lambda r: r[:16] + b"\x3b" + r[17:], lambda r: r[:-1], lambda r: r[:80], lambda r: r[:40], lambda r: r[:70]]
    + [lambda r, a=a, b=b: r.replace(a, b) for a, b in ((b'"text": null', b'"text"; null'), (b'}, {"doc_id": "d\\"{7', b'}; {"doc_id": "d\\"{7'), (b'[{"doc_id": "d', b'x{"doc_id": "d'), ("日本".encode(), b"\xff" * 6), (b"}]\0", b"}x\0"))],
)
def test_sv_stretches_reject(hard, change, tmp_path):
    raw = sv.encode(hard, 3)
    assert change(raw) != raw
    (tmp_path / "x.sv").write_bytes(change(raw))
    for size in (5, 200, 1 << 20):
        with pytest.raises(StoreError):
            for p in sv.extents(sv.layout(str(tmp_path / "x.sv")), size, serial):
                list(sv.rows_of(p))


def test_sv_file_that_changes(hard, tmp_path):
    (tmp_path / "x.sv").write_bytes(sv.encode(hard, 3))
    parts = sv.extents(sv.layout(str(tmp_path / "x.sv")), 200, serial)
    (tmp_path / "x.sv").write_bytes(sv.encode(hard[:50], 3))
    with pytest.raises(StoreError, match="changed"):
        list(sv.rows_of(parts[0]))


def test_sv_large_file_is_many_tasks(spark, tmp_path):
    """One task, and so the memory for the whole file at once, isn't enough for a large one."""
    n = 60_000
    vectors = np.arange(n * 4, dtype=np.float32).reshape(n, 4)
    rows = pd.DataFrame({"slot": range(n), "doc_id": [f"d{i}" for i in range(n)], "text": ['"{' * 120] * n, "vector": list(vectors), "metadata": "{}", "active": np.arange(n) % 3 > 0})
    (tmp_path / "a large one.sv").write_bytes(sv.encode(rows, 4))
    df = sv.read_sv(spark, str(tmp_path / "a large*.sv"))
    assert df.rdd.getNumPartitions() > 1
    got = df.orderBy("slot").toPandas()
    assert np.array_equal(np.stack(got["vector"]), vectors) and all((got[c] == rows[c]).all() for c in ("slot", "doc_id", "text", "metadata", "active"))
    sv.write_sv(df, str(tmp_path / "y.sv"))
    assert (tmp_path / "y.sv").read_bytes() == (tmp_path / "a large one.sv").read_bytes()
    (tmp_path / "a large small.sv").write_bytes(sv.encode(rows[:5], 4))
    assert sv.read_sv(spark, str(tmp_path / "a large*.sv")).count() == n + 5


LINES = [
    '{"op": "insert", "doc_id": "a", "text": "x", "vector": [1.0, 2.5], "metadata": {"k": [1, null]}}',
    '  {"op": "delete", "doc_id": "b"}  ',
    '{"op": "insert", "doc_id": "c"',
    "",
    "   ",
    '{"op": "delete", "doc_id": "d"}{"op": "delete", "doc_id": "e"}',
    '{"operation": "delete", "doc_id": "f"}',
    '{"op": "delete"}',
    "[1]",
    "null",
    None,
]


def test_log_lines(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "line_no long, line string")
    got = parse_lines(df).orderBy("seq").collect()
    assert [(r["seq"], r["op"], r["doc_id"]) for r in got] == [(0, "insert", "a"), (1, "delete", "b")]
    assert got[0]["vector"] == [1.0, 2.5] and json.loads(got[0]["metadata"]) == {"k": [1, None]}


def test_log_writer(spark, tmp_path):
    log = LogWriter(str(tmp_path / "log"))
    assert not log.has_entries() and log.size() == 0
    log.append([{"op": "insert", "doc_id": "a", "text": "line\nbreak", "vector": [1.0], "metadata": {}}, {"op": "delete", "doc_id": "a"}])
    log.append([{"op": "update", "doc_id": "b", "text": "t"}])
    got = log.read(spark).orderBy("seq").collect()
    assert [(r["op"], r["doc_id"], r["text"]) for r in got] == [("insert", "a", "line\nbreak"), ("delete", "a", None), ("update", "b", "t")]
    with pytest.raises(ValueError):
        log.append([{"op": "insert"}])
    log.truncate()
    assert not log.has_entries()


def test_log_segments(spark, tmp_path, monkeypatch):
    log = LogWriter(str(tmp_path / "log"))
    for i in range(12):
        log.append([{"op": "delete", "doc_id": f"d{i}"}])
    assert len(os.listdir(log.path)) == 1
    again = LogWriter(log.path)
    with open(log._file(1), "ab") as f:
        f.write(b'{"op": "delete", "doc')  # a crash while writing
    again.append([{"op": "delete", "doc_id": "e"}])
    again.append([{"op": "delete", "doc_id": "f"}, {"op": "delete", "doc_id": "g"}])
    again.append([])
    assert [r["doc_id"] for r in again.read(spark).orderBy("seq").collect()] == [*(f"d{i}" for i in range(12)), "e", "f", "g"]
    since = again.next_number()
    again.append([{"op": "delete", "doc_id": "h"}])
    assert [r["doc_id"] for r in again.read(spark, since).collect()] == ["h"] and again.has_entries(since) and not again.has_entries(since + 1)
    again.truncate(since)
    assert again.read(spark).count() == 1 and LogWriter(log.path).next_number() == since + 1
    monkeypatch.setattr("vsearch.sources.log.SEGMENT_BYTES", 10)
    again.append([{"op": "delete", "doc_id": "i"}])
    again.append([{"op": "delete", "doc_id": "j"}])
    assert [r["doc_id"] for r in again.read(spark).orderBy("seq").collect()] == ["h", "i", "j"]


def test_a_large_log_is_read_in_blocks_and_in_order(spark, tmp_path):
    with open(tmp_path / "x.log", "w") as f:
        for i in range(20_000):
            f.write(json.dumps({"op": "delete", "doc_id": f"d{i}", "text": "t" * (i % 7)}) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = read_log(spark, str(tmp_path))
        got = rows.orderBy("seq").select("seq", "doc_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in got] == [(i, f"d{i}") for i in range(20_000)]


def test_stream(spark, tmp_path):
    from vsearch.store import Store

    incoming = LogWriter(str(tmp_path / "in"))
    incoming.append([{"op": "insert", "doc_id": "a", "text": "1", "vector": [1.0], "metadata": {}}, {"op": "insert", "doc_id": "b", "text": "2", "vector": [1.0], "metadata": {}}])
    store = Store(spark, str(tmp_path / "store"))
    store.create(1)

    def run():
        q = ingest.ingest(ingest.log_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "check"))
        q.awaitTermination(60)
        assert q.exception() is None
        return sorted((r["doc_id"], r["text"], r["active"]) for r in store.load().collect())

    assert run() == [("a", "1", True), ("b", "2", True)]
    incoming.append([{"op": "update", "doc_id": "a", "text": "3", "vector": [1.0], "metadata": {}}, {"op": "delete", "doc_id": "b"}])
    assert run() == [("a", "3", True), ("b", "2", False)]
    version = store.meta().version
    assert run() == [("a", "3", True), ("b", "2", False)] and store.meta().version == version


def test_stream_windows(spark, sf_dir):
    df = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/wal_entries.parquet").schema).option("pathGlobFilter", "wal_entries.parquet").parquet(sf_dir)
    q = ingest.op_counts(df, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("op_counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = ingest.op_counts(spark.read.parquet(f"{sf_dir}/wal_entries.parquet").filter("logged_at IS NOT NULL"))
    assert sorted(spark.sql("SELECT * FROM op_counts WHERE start IS NOT NULL").collect()) == sorted(batch.collect())
