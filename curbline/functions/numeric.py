"""Numeric and cast expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_RADIUS_M = 6_371_000.0


def ratio(num, den) -> Column:
    """Null when the denominator is zero or null."""
    return F.try_divide(_col(num).cast("double"), _col(den))


def ratio_or_zero(num, den) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def half_even(c, digits: int = 0) -> Column:
    """Rounding used by the dashboards (ties to even)."""
    return F.bround(_col(c), digits)


def clamp01(c) -> Column:
    return F.least(F.greatest(_col(c), F.lit(0.0)), F.lit(1.0))


def safe_bool(c) -> Column:
    """Only the words true and false; ``yes``, ``1`` and the like give null."""
    word = F.lower(F.trim(_col(c)))
    return F.when(word == "true", True).when(word == "false", False)


def safe_ts(c) -> Column:
    return _col(c).try_cast("timestamp")


def finite(c) -> Column:
    """NaN and both infinities become null."""
    v = _col(c)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def finite_value(c: Column, kind: T.DataType) -> Column:
    """:func:`finite` at any depth of arrays, structs and map values."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite(c)
    if not _has_floats(kind):
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: finite_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: finite_value(x, kind.valueType))
    fields = F.struct(*[finite_value(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.when(c.isNotNull(), fields)


def _has_floats(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_floats(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_floats(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_floats(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def clean_nan(df: DataFrame) -> DataFrame:
    """Apply :func:`finite` to every float of every column, nested ones included."""
    return df.select(*[finite_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def fill_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to double; what cannot be read counts as zero."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in cols})


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres."""
    p1, p2 = F.radians(_num(lat1)), F.radians(_num(lat2))
    dp, dl = p2 - p1, F.radians(_num(lon2)) - F.radians(_num(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def _num(c) -> Column:
    return F.lit(c) if isinstance(c, (int, float)) else _col(c)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
