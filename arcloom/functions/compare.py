"""The language's two-valued comparisons as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def family(kind: T.DataType) -> str:
    """What a type compares as."""
    if isinstance(kind, T.NullType):
        return "null"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return kind.simpleString()


def as_text(x: Column, kind: T.DataType) -> Column:
    """A value as text; a whole double has no fraction."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))
    return F.to_json(x) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else x.cast("string")


def compared(op: str, a: Column, b: Column, a_type: T.DataType, b_type: T.DataType, b_known: bool = False) -> Column:
    """``a op b``, always true or false: null equals null and is less than anything else.

    Values of different families compare as text. ``b_known`` says that b can't be null; the shorter forms are those
    that Parquet's filters take.
    """
    if family(a_type) != family(b_type) and "null" not in (family(a_type), family(b_type)):
        a, b = as_text(a, a_type), as_text(b, b_type)
    elif "null" in (family(a_type), family(b_type)):
        kind = b_type if family(a_type) == "null" else a_type
        kind = T.StringType() if family(kind) == "null" else kind
        a, b = (a.cast(kind) if family(a_type) == "null" else a), (b.cast(kind) if family(b_type) == "null" else b)
    match op:
        case "=":
            return a.eqNullSafe(b)
        case "<>":
            return ~a.eqNullSafe(b)
        case "<":
            return (F.coalesce(a < b, F.lit(False)) if not b_known else (a < b)) | (a.isNull() if b_known else a.isNull() & b.isNotNull())
        case "<=":
            return ((a <= b) if b_known else F.coalesce(a <= b, F.lit(False))) | a.isNull()
        case ">":
            return F.coalesce(a > b, F.lit(False)) | (F.lit(False) if b_known else b.isNull() & a.isNotNull())
        case ">=":
            return F.coalesce(a >= b, F.lit(False)) | (F.lit(False) if b_known else b.isNull())
    raise ValueError(op)


def truth(x: Column, kind: T.DataType) -> Column:
    """Null, false, zero and the empty string are false; everything else is true."""
    match family(kind):
        case "boolean":
            return F.coalesce(x, F.lit(False))
        case "number":
            return F.coalesce(x != 0, F.lit(False))
        case "string":
            return F.coalesce(x != "", F.lit(False))
        case "null":
            return F.lit(False)
    return x.isNotNull()
