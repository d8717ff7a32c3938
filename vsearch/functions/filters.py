"""Metadata filters: a dict of conditions becomes one Column over a VARIANT.

A condition holds only if its key is present, whatever its operator. Numbers
and booleans compare as numbers, strings as strings; different types are never
equal and have no order. NULL metadata, or JSON that can't be read, is empty.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from vsearch.types import RequestError

OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin")


def parsed(metadata: Column) -> Column:
    """JSON text as a VARIANT; NULL if it is broken."""
    return F.try_parse_json(metadata)


def _member(meta: Column, key: str) -> Column:
    """The member of a top-level key, whatever its characters."""
    if "'" not in key and "\\" not in key:
        return F.try_variant_get(meta, f"$['{key}']", "variant")
    return F.try_element_at(F.try_variant_get(meta, "$", "map<string,variant>"), F.lit(key))


class _Value:
    def __init__(self, meta: Column, key: str):
        self.raw = _member(meta, key)
        self.kind = F.schema_of_variant(self.raw)

    present = property(lambda self: self.raw.isNotNull())

    def number(self) -> Column:
        as_number = F.when(self.kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(self.raw, "$", "double"))
        return as_number.when(self.kind == "BOOLEAN", F.try_variant_get(self.raw, "$", "boolean").cast("double"))

    def string(self) -> Column:
        return F.when(self.kind == "STRING", F.try_variant_get(self.raw, "$", "string"))

    def equals(self, target: Any) -> Column:
        if target is None:
            same = F.is_variant_null(self.raw)
        elif isinstance(target, (bool, int, float)):
            same = self.number() == F.lit(float(target))
        elif isinstance(target, str):
            same = self.string() == F.lit(target)
        elif isinstance(target, (list, tuple, Mapping)):
            same = F.when(self.kind.rlike("^(ARRAY|OBJECT)"), F.to_json(self.raw)) == F.lit(json.dumps(target, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
        else:
            raise RequestError(f"can't compare metadata with {type(target).__name__}")
        return F.coalesce(same, F.lit(False))

    def ordered(self, op: str, target: Any) -> Column:
        if isinstance(target, (bool, int, float)):
            mine, other = self.number(), F.lit(float(target))
        elif isinstance(target, str):
            mine, other = self.string(), F.lit(target)
        else:
            return F.lit(False)
        holds = {"$gt": mine > other, "$gte": mine >= other, "$lt": mine < other, "$lte": mine <= other}[op]
        return F.coalesce(holds, F.lit(False))

    def among(self, target: Any) -> Column:
        return reduce(lambda a, b: a | b, [self.equals(t) for t in target], F.lit(False))

    def holds(self, op: str, target: Any) -> Column:
        collection = isinstance(target, (list, tuple, set, frozenset))
        if op == "$eq":
            return self.equals(target)
        if op == "$ne":
            return ~self.equals(target)
        if op == "$in":
            return self.among(target) if collection else F.lit(False)
        if op == "$nin":
            return ~self.among(target) if collection else F.lit(True)
        return self.ordered(op, target)


def compile_filters(filters: Mapping[str, Any] | None, meta: Column) -> Column:
    """Condition for ``filters`` on the VARIANT ``meta``.

    ``{"k": v}`` is equality; ``{"k": {"$gt": 1, "$lt": 5}}`` needs all; an
    empty dict only asks for the key. A dict without operators is compared as a
    whole; an unknown ``$`` operator is an error. No filters: always true.
    """
    tests = [F.lit(True)]
    for key, condition in (filters or {}).items():
        v = _Value(meta, key)
        tests.append(v.present)
        if isinstance(condition, Mapping):
            unknown = [op for op in condition if op not in OPERATORS]
            if any(str(op).startswith("$") for op in unknown):
                raise RequestError(f"unknown operator {unknown[0]}")
            if unknown:
                tests.append(v.equals(condition))
            else:
                tests.extend(v.holds(op, target) for op, target in condition.items())
        else:
            tests.append(v.equals(condition))
    return reduce(lambda a, b: a & b, tests)
