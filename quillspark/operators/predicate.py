"""Metadata predicates: a small dictionary language compiled to one Column."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {"$eq": lambda a, b: a == b, "$gte": lambda a, b: a >= b, "$lte": lambda a, b: a <= b}


class WhereError(ValueError):
    """A predicate that can't be compiled."""


def variant_value(attributes: str) -> Callable[[str, str], Column]:
    """Typed access to keys of a VARIANT column; a value of another type reads as null."""

    def get(key: str, kind: str) -> Column:
        path = "$['" + key.replace("'", "\\'") + "']"
        v = F.try_variant_get(attributes, path, "variant")
        number = F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)")
        if kind == "exists":
            return v.isNotNull()
        if kind == "double":
            return F.when(number | (F.schema_of_variant(v) == "BOOLEAN"), F.coalesce(F.try_variant_get(attributes, path, "double"), F.try_variant_get(attributes, path, "boolean").cast("double")))
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(attributes, path, "string"))

    return get


def column_value(types: dict[str, str]) -> Callable[[str, str], Column]:
    """The same access over plain columns; types maps each to its Spark type name. Unknown keys don't exist."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")

    def get(key: str, kind: str) -> Column:
        known = types.get(key)
        if known is None:
            return F.lit(False) if kind == "exists" else F.lit(None).cast(kind)
        if kind == "exists":
            return F.col(key).isNotNull()
        fits = known.startswith(numeric) if kind == "double" else known == "string"
        return F.col(key).cast(kind) if fits else F.lit(None).cast(kind)

    return get


def compile_where(where: dict[str, Any] | None, get: Callable[[str, str], Column]) -> Column:
    """Column of a predicate. Empty: true. Comparing unlike types is false, and so is a missing key with an operator.

    Plain equality with None holds where the key is missing. Unknown operators raise before anything runs.
    """
    if not where:
        return F.lit(True)
    tests = []
    for key, wanted in where.items():
        if key == "$and":
            if not isinstance(wanted, list):
                raise WhereError("$and takes a list")
            tests += [compile_where(w, get) for w in wanted]
        elif key.startswith("$"):
            raise WhereError(f"unknown operator {key}")
        elif isinstance(wanted, dict):
            for op in wanted:
                if op not in OPERATORS:
                    raise WhereError(f"unknown operator {op}")
            tests += [get(key, "exists"), *(_compare(key, op, value, get) for op, value in wanted.items())]
        elif wanted is None:
            tests.append(~get(key, "exists"))
        else:
            tests.append(_compare(key, "$eq", wanted, get))
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def _compare(key: str, op: str, value: Any, get: Callable[[str, str], Column]) -> Column:
    if isinstance(value, str):
        return OPERATORS[op](get(key, "string"), F.lit(value))
    if isinstance(value, (bool, int, float)):
        return OPERATORS[op](get(key, "double"), F.lit(float(value)))
    return F.lit(False)
