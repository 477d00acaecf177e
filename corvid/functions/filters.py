"""Metadata filters compiled to one predicate.

A filter maps a key to a value or to {operator: operand}; everything given must
hold. Missing keys read as null. Numbers compare as numbers, also with strings
that hold one. Where a column's type is known and the operand is of its kind,
the comparison is bare, so that it reaches the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, floor
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, FractionalType, IntegralType, MapType, StringType, StructType

Lookup = Callable[[str], Column]


def _number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def _equal(c: Column, value: Any) -> Column:
    if value is None:
        return c.isNull()
    if isinstance(value, bool):
        word = F.lower(c.cast("string"))
        return F.coalesce((word == str(value).lower()) | (_number(c) == float(value)), F.lit(False))
    if isinstance(value, (int, float)):
        word = F.lower(c.cast("string"))
        truth = (word == "true") if value == 1 else (word == "false") if value == 0 else F.lit(False)
        return F.coalesce(_number(c) == float(value), F.lit(False)) | F.coalesce(truth, F.lit(False))
    return F.coalesce(c.cast("string") == F.lit(str(value)), F.lit(False))


def _any_of(c: Column, values: Any) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | _equal(c, v)
    return out


def _order(compare: Callable[[Column, Column], Column]) -> Callable[[Column, Any], Column]:
    def test(c: Column, operand: Any) -> Column:
        try:
            limit = float(operand)
        except (TypeError, ValueError):
            return F.lit(False)
        x = _number(c)
        # NaN would sort above everything; here no comparison with it holds
        return F.coalesce(compare(x, F.lit(limit)) & ~F.isnan(x), F.lit(False)) if limit == limit else F.lit(False)

    return test


OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": _equal,
    "$ne": lambda c, v: ~_equal(c, v),
    "$in": _any_of,
    "$nin": lambda c, v: ~_any_of(c, v),
    "$gt": _order(lambda x, y: x > y),
    "$gte": _order(lambda x, y: x >= y),
    "$lt": _order(lambda x, y: x < y),
    "$lte": _order(lambda x, y: x <= y),
}


def _of_kind(kind: DataType, value: Any) -> bool:
    """Whether a bare comparison of such a column with the value means the same."""
    if isinstance(value, bool):
        return isinstance(kind, BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, (IntegralType, FractionalType)) and value == value and abs(value) < 2**53
    return isinstance(value, str) and isinstance(kind, StringType)


def _bare(c: Column, kind: DataType, op: str, operand: Any) -> Column | None:
    """The comparison as Parquet readers know it, if types allow."""
    whole = isinstance(kind, IntegralType)
    fitting = lambda v: v if not whole or isinstance(v, bool) else int(v)
    possible = lambda v: not (whole and v != int(v))
    if op in ("$eq", "$ne") and _of_kind(kind, operand):
        if not possible(operand):
            return F.lit(op == "$ne")
        return c == F.lit(fitting(operand)) if op == "$eq" else ~c.eqNullSafe(F.lit(fitting(operand)))
    if op in ("$in", "$nin") and not isinstance(operand, str) and all(_of_kind(kind, v) for v in operand):
        values = [fitting(v) for v in operand if possible(v)]
        return c.isin(values) if op == "$in" else c.isNull() | ~c.isin(values)
    if op in ("$gt", "$gte", "$lt", "$lte") and isinstance(kind, (IntegralType, FractionalType)) and not isinstance(operand, bool) and _of_kind(kind, operand):
        v = operand if not whole else floor(operand) if op in ("$gt", "$lte") else ceil(operand)
        test = {"$gt": c > v, "$gte": c >= v, "$lt": c < v, "$lte": c <= v}[op]
        return test if whole else test & ~F.isnan(c)
    return None


def _typed(schema: StructType, key: str) -> tuple[Column, DataType | None]:
    """A column of the table, else the entry of its metadata, else null."""
    if key in schema.fieldNames():
        return F.col(key), schema[key].dataType
    if "metadata" in schema.fieldNames() and isinstance(schema["metadata"].dataType, MapType):
        return F.try_element_at(F.col("metadata"), F.lit(key)), None
    return F.lit(None).cast("string"), None


def compile_filter(where: dict[str, Any] | None, lookup: str | Lookup | StructType = "metadata") -> Column:
    """The predicate of a filter. lookup: a table's schema, whose columns come
    first, then the entries of its metadata; the name of a map column; or a
    function from a key to its column. Only with a schema are types known and
    comparisons pushed into the scan. Unknown operators raise ValueError at once."""
    out = F.lit(True)
    for key, condition in (where or {}).items():
        for op, operand in (condition if isinstance(condition, dict) else {"$eq": condition}).items():
            if op not in OPERATORS:
                raise ValueError(f"unknown filter operator {op!r}; known: {', '.join(OPERATORS)}")
            kind = None
            if isinstance(lookup, StructType):
                c, kind = _typed(lookup, key)
            else:
                c = F.try_element_at(F.col(lookup), F.lit(key)) if isinstance(lookup, str) else lookup(key)
            test = _bare(c, kind, op, operand) if kind is not None else None
            out = out & (OPERATORS[op](c, operand) if test is None else test)
    return out
