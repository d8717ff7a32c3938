import json
import os

import numpy as np
import pytest

from vsearch import cli
from vsearch.client import Collection
from vsearch.embed import HashingEmbedder, ModelEmbedder, embed_documents
from vsearch.store import Store
from vsearch.types import EmbedError, RequestError, StoreError, VectorError


@pytest.fixture
def col(spark):
    c = Collection(spark, embedder=HashingEmbedder(16))
    c.add("d1", "machine learning in python", {"lang": "en"})
    c.add("d2", "high performance rust code", {"lang": "en"}, vector=np.eye(16)[0])
    return c


def test_collection(col):
    assert len(col) == 2 and "d1" in col and "x" not in col and col.dimension == 16
    assert col["d1"]["text"] == "machine learning in python" and col.get("x") is None
    with pytest.raises(KeyError):
        col["x"]
    assert [d["doc_id"] for d in col] == ["d1", "d2"]
    assert col.search("machine learning in python", 1)[0].doc_id == "d1"
    assert col.search(list(np.eye(16)[0]), 1)[0].to_dict() == {"doc_id": "d2", "text": "high performance rust code", "score": 1.0, "metadata": {"lang": "en"}}
    assert [h[0].doc_id for h in col.search_batch(["machine learning in python", list(np.eye(16)[0])], 1)] == ["d1", "d2"]
    assert col.search_batch([]) == []
    assert col.hybrid_search("rust", 1)[0].doc_id == "d2"
    assert col.keyword_search("rust")[0].doc_id == "d2"
    assert col.search("rust", filters={"lang": "fr"}) == []
    assert "Collection(" in repr(col) and col.info()["active_count"] == 2


def test_changes(col):
    for bad in (lambda: col.add("d1", "again"), lambda: col.update("x", "?"), lambda: col.delete("x"), lambda: col.add("y", "t", vector=[1.0]), lambda: col.add("y", "t", vector=[[1.0] * 16]), lambda: col.add("y", "t", {"o": object()}), lambda: col.commit()):
        with pytest.raises(StoreError):
            bad()
    assert col.insert("d3", "third") is True
    assert col.delete("d1") is True and col.delete("d1") is False
    assert "d1" not in col and col.has_document("d1") and len(col) == 2
    assert col.get_metadata("d1") == {"lang": "en"} and len(col.get_vector("d1")) == 16 and col.get_metadata("x") is None and col.get_vector("x") is None
    assert col.records().columns == ["slot", "doc_id", "text", "metadata"] and col.records(True).count() == 2
    with pytest.raises(StoreError):
        col.add("d1", "deleted ids are taken too")
    col.update("d1", "back again")
    assert col["d1"]["text"] == "back again" and col["d1"]["metadata"] == {}
    col.delete("d2")
    col.upsert("d2", "at the end")
    col.upsert("d3", "in place")
    assert [d["doc_id"] for d in col] == ["d1", "d3", "d2"]
    col.delete("d3")
    assert col.compact() == 1 and col.compact() == 0 and [d["doc_id"] for d in col] == ["d1", "d2"]


def test_add_many_is_all_or_none(col):
    assert col.add_many([]) == []
    assert col.add_many([{"doc_id": "m1", "text": "one"}, {"doc_id": "m2", "text": "two", "metadata": {"k": 1}}]) == ["m1", "m2"]
    for bad in ([{"doc_id": "m3"}], [{"doc_id": "m3", "text": "x"}, {"doc_id": "m1", "text": "x"}], [{"doc_id": "m3", "text": "x"}, {"doc_id": "m3", "text": "x"}]):
        with pytest.raises(StoreError):
            col.add_many(bad)
    assert "m3" not in col and len(col) == 4


def test_requests(col):
    for bad in (lambda: col.search(" "), lambda: col.search("x", 0), lambda: col.hybrid_search(""), lambda: col.search([1.0])):
        with pytest.raises(RequestError):
            bad()
    with pytest.raises(VectorError):
        Collection(col.spark, metric="dot")
    with pytest.raises(VectorError):
        Collection(col.spark, index_type="tree")


def test_compact_does_not_change_a_search(col):
    col.add_many([{"doc_id": f"n{i}", "text": f"text number {i}"} for i in range(8)])
    col.delete("n3")
    before = col.search("text number 5", 5)
    col.compact()
    assert col.search("text number 5", 5) == before


def test_cells_follow_changes(spark):
    c = Collection(spark, embedder=HashingEmbedder(8), index_type="cells", cells=2)
    assert c.search("nothing there") == []
    c.add_many([{"doc_id": f"d{i}", "text": f"word{i} other{i}"} for i in range(20)])
    assert c.search("word7 other7", 1)[0].doc_id == "d7"
    c.update("d7", "something else")
    c.add("new", "word7 other7")
    assert c.search("word7 other7", 1)[0].doc_id == "new"


def test_store_and_recovery(spark, tmp_path):
    path, e = str(tmp_path / "db"), HashingEmbedder(4)
    c = Collection(spark, path, e)
    c.add("a", "first", {"n": 1})
    c.add("b", "second")
    # before any commit, the log alone brings everything back
    assert sorted(d["doc_id"] for d in Collection(spark, path, e)) == ["a", "b"]
    c = Collection.load(path, spark, e)
    assert c.commit() >= 1 and not c.store.log.has_entries()
    c.add("x", "third")
    c.delete("a")
    c.update("b", "changed")
    again = Collection.load(path, spark, e)
    assert {d["doc_id"]: d["text"] for d in again} == {"b": "changed", "x": "third"} and again.dimension == 4
    assert again.has_document("a") and not again.store.log.has_entries()
    # a delete and a later upsert survive a crash
    again.upsert("a", "returned")
    assert Collection.load(path, spark, e)["a"]["text"] == "returned"
    again.save(str(tmp_path / "copy"))
    assert len(Collection.load(str(tmp_path / "copy"), spark, e)) == 3 and again.store.path == path
    with pytest.raises(StoreError):
        Collection.load(str(tmp_path / "none"), spark)


def test_save_loses_nothing(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "db"), HashingEmbedder(4))
    c.add("a", "first")
    c.save()
    assert c.store.meta().version >= 1 and not c.store.has_log()
    c.add("b", "second")
    c.save(str(tmp_path / "x" / ".." / "db"))  # onto itself
    assert sorted(d["doc_id"] for d in Collection.load(str(tmp_path / "db"), spark, HashingEmbedder(4))) == ["a", "b"]
    other = Collection(spark, str(tmp_path / "other"), HashingEmbedder(4), metric="l2")
    other.add("z", "another")
    other.commit()
    opened = other.store.load()
    other.add("y", "logged only")
    c.save(other.store.path)  # over another collection, whose old version stays until it is vacuumed
    assert [r["doc_id"] for r in opened.collect()] == ["z"]
    again = Collection.load(other.store.path, spark, HashingEmbedder(4))
    assert sorted(d["doc_id"] for d in again) == ["a", "b"] and again.metric == "cosine"
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "letter.txt").write_text("dear")
    with pytest.raises(StoreError):
        c.save(str(tmp_path / "mine"))
    assert (tmp_path / "mine" / "letter.txt").read_text() == "dear" and len(c) == 2
    with pytest.raises(StoreError):
        Collection(spark, embedder=HashingEmbedder(4)).save()


def test_an_entry_is_applied_once_even_if_the_log_stays(spark, tmp_path, monkeypatch):
    """A crash between the pointer's move and the log's end."""
    e = HashingEmbedder(4)
    c = Collection(spark, str(tmp_path / "db"), e)
    c.add("a", "first")
    c.delete("a")
    monkeypatch.setattr("vsearch.sources.log.LogWriter.truncate", lambda *a: None)
    c.commit()
    assert c.store.log.has_entries() and not c.store.has_log()
    assert "a" not in Collection.load(str(tmp_path / "db"), spark, e) and c.info()["file_exists"] and not c.info()["wal_exists"]


def test_graph_index(spark, tmp_path):
    e = HashingEmbedder(128)
    c = Collection(spark, str(tmp_path / "db"), embedder=e, index_type="hnsw", m=4, ef_construction=20)
    assert c.search("nothing there") == []
    c.add_many([{"doc_id": f"d{i}", "text": f"word{i} other{i}", "metadata": {"n": i % 2}} for i in range(150)])
    assert c.search("word7 other7", 1)[0].doc_id == "d7" and c.search("word7 other7", 1, {"n": 0})[0].doc_id != "d7"
    c.delete("d7")
    c.add("new", "word7 other7")
    assert [h.doc_id for h in c.search("word7 other7", 1)] == ["new"] and c.hybrid_search("word9 other9", 1)[0].doc_id == "d9"
    c.commit()
    assert Collection.load(str(tmp_path / "db"), spark, e).index_type == "hnsw" and len(c.index()) == 151


def test_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    with pytest.raises(StoreError):
        s.meta()
    s.create(2)
    with pytest.raises(StoreError):
        s.create(2)
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "t")).create(0)
    rows = spark.createDataFrame([(0, "a", "t", [1.0, 2.0], "{}", True)], s.load().schema)
    opened = None
    for _ in range(3):
        s.commit(rows)
        opened = opened or s.load()
    assert opened.count() == 1 and s.meta().version == 3
    assert len(s.vacuum(1)) == 2 and s.load().count() == 1


def test_add_frame(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "db"), HashingEmbedder(8))
    c.add_frame(spark.createDataFrame([("b", "two"), ("a", "one")], "doc_id string, text string"))
    assert [d["doc_id"] for d in c] == ["a", "b"]
    with pytest.raises(StoreError):
        c.add_frame(spark.createDataFrame([("a", "one")], "doc_id string, text string"))


def test_embedders(spark):
    e = HashingEmbedder(8)
    assert np.array_equal(e.embed("a b"), e.embed("B a")) and np.linalg.norm(e.embed("x y z")) == pytest.approx(1)
    for bad in ("", " "):
        with pytest.raises(EmbedError):
            e.embed(bad)
    for bad in ([], "text", ["ok", " "], ["ok", None]):
        with pytest.raises(EmbedError):
            e.embed_batch(bad)
    df = spark.createDataFrame([("a",), (" ",), (None,)], "text string")
    assert [r["vector"] is None for r in embed_documents(df, e).collect()] == [False, True, True]
    m = ModelEmbedder()
    assert not m.is_loaded
    with pytest.raises(EmbedError):
        m.embed("x")


def test_command_line(spark, tmp_path, capsys):
    db, src = str(tmp_path / "db"), tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_text("alpha beta " * 100)
    (src / "sub" / "a.md").write_text("gamma delta")
    (src / "empty.txt").write_text(" ")

    def run(*args):
        code = cli.main(list(args))
        return code, capsys.readouterr().out

    assert run()[0] == 1
    assert run("info", db)[0] == 1
    assert run("init", db, "-d", "384")[0] == 0 and run("init", db)[0] == 1 and run("init", db, "-f")[0] == 0
    assert run("ingest", str(tmp_path / "none"), "--db", db)[0] == 1
    code, out = run("ingest", str(src), "--db", db, "--chunk-size", "500", "--overlap", "50")
    assert code == 0 and "4 chunks" in out
    code, out = run("search", "gamma delta", "--db", db, "-k", "1")
    hit = json.loads(out)[0]
    assert code == 0 and hit["doc_id"] == "sub/a_chunk_0" and hit["metadata"]["file_name"] == "a.md" and hit["metadata"]["source_doc"] == "sub/a"
    assert json.loads(run("search", "alpha", "--db", db, "--hybrid", "--alpha", "0.2", "--pretty")[1])
    info = json.loads(run("info", db, "--json")[1])
    assert info["total_count"] == 4 and info["dimension"] == 384 and os.path.isdir(info["path"])
    assert "active_count: 4" in run("info", db)[1]
    assert "removed 0" in run("compact", "--db", db)[1]
