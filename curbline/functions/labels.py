"""Label normalisers. Consumers differ on purpose; do not merge them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_NEIGHBORHOOD = "Unknown / missing neighborhood"


def norm_upper(c) -> Column:
    """Serving tables: trimmed upper case, null stays null."""
    return F.upper(F.trim(_col(c)))


def norm_unknown(c) -> Column:
    """Dashboard pages: null becomes ``Unknown``; a blank label stays blank."""
    return F.trim(F.coalesce(_col(c).cast("string"), F.lit("Unknown")))


def norm_missing(c) -> Column:
    """Neighbourhood page: null and blank share one explicit label."""
    cleaned = F.trim(F.coalesce(_col(c).cast("string"), F.lit("")))
    return F.when(cleaned == "", F.lit(MISSING_NEIGHBORHOOD)).otherwise(cleaned)


def norm_none(c) -> Column:
    """Model weighting and slices: null becomes its own group ``None``."""
    return F.coalesce(_col(c).cast("string"), F.lit("None"))


def priority_band(score) -> Column:
    """high from 0.9, medium from 0.7, otherwise low (a null score is low)."""
    s = _col(score)
    return F.when(s >= 0.9, "high").when(s >= 0.7, "medium").otherwise("low")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
