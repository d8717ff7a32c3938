import json

import pytest
from pyspark.sql import functions as F

from vsearch.functions.filters import compile_filters, parsed
from vsearch.types import RequestError

META = {
    "d1": {"height": 12, "kiln": "north", "glaze": ["ash"], "fired": True},
    "d2": {"height": 40, "kiln": "south", "glaze": ["salt"], "at": {"shelf": 3}},
    "d3": {"height": 77.25, "kiln": "west", "glaze": ["salt", "ash"]},
    "d4": {"height": "40", "kiln": None, "it's": 1},
    "d5": {},
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, json.dumps(v)) for k, v in META.items()] + [("null", None), ("broken", '{"height": 1'), ("list", "[1]")]
    return spark.createDataFrame(rows, "doc_id string, metadata string").withColumn("m", parsed(F.col("metadata")))


def hits(docs, filters):
    return "".join(sorted(r[0][1] for r in docs.filter(compile_filters(filters, F.col("m"))).select("doc_id").collect() if r[0][0] == "d"))


@pytest.mark.parametrize(
    "filters,want",
    [
        ({}, "12345"),
        (None, "12345"),
        ({"kiln": "north"}, "1"),
        ({"kiln": {"$eq": "south"}}, "2"),
        ({"height": 40}, "2"),
        ({"height": "40"}, "4"),
        ({"height": 40.0}, "2"),
        ({"fired": 1}, "1"),
        ({"fired": True}, "1"),
        ({"kiln": None}, "4"),
        ({"kiln": {"$ne": "north"}}, "234"),
        ({"kiln": {"$ne": None}}, "123"),
        ({"height": {"$gt": 12}}, "23"),
        ({"height": {"$gte": 12}}, "123"),
        ({"height": {"$lt": 40}}, "1"),
        ({"height": {"$lte": 40}}, "12"),
        ({"height": {"$gt": "3"}}, "4"),
        ({"height": {"$gt": None}}, ""),
        ({"height": {"$gt": 15, "$lt": 60}}, "2"),
        ({"kiln": {"$in": ["north", "west"]}}, "13"),
        ({"kiln": {"$in": ("north", None)}}, "14"),
        ({"kiln": {"$in": []}}, ""),
        ({"kiln": {"$in": "north"}}, ""),
        ({"kiln": {"$nin": ["north", "west"]}}, "24"),
        ({"kiln": {"$nin": "north"}}, "1234"),
        ({"glaze": ["ash"]}, "1"),
        ({"at": {"shelf": 3}}, "2"),
        ({"glaze": {}}, "123"),
        ({"it's": 1}, "4"),
        ({"kiln": "north", "height": 12}, "1"),
        ({"kiln": "north", "height": 40}, ""),
        ({"nosuch": {"$ne": 1}}, ""),
    ],
)
def test_filters(docs, filters, want):
    assert hits(docs, filters) == want


def test_unknown_operator(docs):
    with pytest.raises(RequestError):
        compile_filters({"a": {"$regex": "x"}}, F.col("m"))
