"""Command line: init, ingest, search, info, compact."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vsearch.client import Collection
from vsearch.operators.chunking import chunk_documents
from vsearch.sources.files import read_files
from vsearch.store import Store
from vsearch.types import VsearchError


def _init(spark: SparkSession, a: argparse.Namespace) -> int:
    store = Store(spark, a.db)
    if store.exists() and not a.force:
        print(f"{a.db} exists; use --force to overwrite it", file=sys.stderr)
        return 1
    store.create(a.dimension, overwrite=a.force)
    print(f"created {a.db}")
    return 0


def _ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    if not os.path.exists(a.path):
        print(f"no such file or folder: {a.path}", file=sys.stderr)
        return 1
    col = Collection(spark, a.db)
    files = read_files(spark, a.path)
    for r in files.filter("error IS NOT NULL").select("path", "error").toLocalIterator():
        print(f"skipped {r['path']}: {r['error']}", file=sys.stderr)
    root = os.path.abspath(a.path if os.path.isdir(a.path) else os.path.dirname(a.path))
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + "".join("\\" + c if not c.isalnum() else c for c in root.rstrip("/")) + "/", "")
    meta = F.to_json(F.struct(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path").alias("source_path")))
    docs = files.filter("error IS NULL").select(F.regexp_replace(rel, r"(?<=.)\.[^./]*$", "").alias("doc_id"), "text", meta.alias("metadata"))
    chunks = chunk_documents(docs, a.chunk_size, a.chunk_overlap)
    n = chunks.count()
    if n:
        col.add_frame(chunks.select("doc_id", "text", "metadata"))
        col.commit()
    print(f"ingested {n} chunks")
    return 0


def _search(spark: SparkSession, a: argparse.Namespace) -> int:
    col = Collection.load(a.db, spark)
    hits = col.hybrid_search(a.query, a.top_k, a.alpha) if a.hybrid else col.search(a.query, a.top_k)
    print(json.dumps([h.to_dict() for h in hits], ensure_ascii=False, indent=2 if a.pretty else None))
    return 0


def _info(spark: SparkSession, a: argparse.Namespace) -> int:
    info = Collection.load(a.db, spark).info()
    print(json.dumps(info) if a.json else "\n".join(f"{k}: {v}" for k, v in info.items()))
    return 0


def _compact(spark: SparkSession, a: argparse.Namespace) -> int:
    col = Collection.load(a.db, spark)
    gone = col.compact()
    if gone:
        col.commit()
    print(f"removed {gone} documents")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vsearch", description="Collections of documents with vectors.")
    sub = p.add_subparsers(dest="command")
    c = sub.add_parser("init", help="create a collection")
    c.add_argument("db")
    c.add_argument("-d", "--dimension", type=int, default=384)
    c.add_argument("-f", "--force", action="store_true")
    c.set_defaults(run=_init)
    c = sub.add_parser("ingest", help="add the texts of a file or folder")
    c.add_argument("path")
    c.add_argument("--db", required=True)
    c.add_argument("--chunk-size", type=int, default=500)
    c.add_argument("--chunk-overlap", "--overlap", type=int, default=50)
    c.set_defaults(run=_ingest)
    c = sub.add_parser("search", help="search a collection")
    c.add_argument("query")
    c.add_argument("--db", required=True)
    c.add_argument("-k", "--top-k", type=int, default=5)
    c.add_argument("--hybrid", action="store_true")
    c.add_argument("--alpha", type=float, default=0.5)
    c.add_argument("--pretty", action="store_true")
    c.set_defaults(run=_search)
    c = sub.add_parser("info", help="describe a collection")
    c.add_argument("db")
    c.add_argument("--json", action="store_true")
    c.set_defaults(run=_info)
    c = sub.add_parser("compact", help="drop deleted documents")
    c.add_argument("--db", required=True)
    c.set_defaults(run=_compact)
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if not a.command:
        p.print_help()
        return 1
    spark = SparkSession.builder.appName("vsearch").getOrCreate()
    try:
        return a.run(spark, a)
    except VsearchError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
