"""The row at a place of a long order, without sorting it.

A pass counts the rows of each of CELLS cells of the value's range, in order; the cell
that holds the place is the next pass's range. A cell of FEW rows is ordered, rows of
one value go on by their id. Each pass sends a row a cell to the driver; two or three
passes end it, as a cell is a small part of what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a pass, and rows that are ordered at once.
CELLS, FEW = 1 << 14, 10_000
_NULL, _LOW, _FINITE, _HIGH, _NAN = range(5)  # in rising order


def _kind(score: str) -> Column:
    x = F.col(score).cast("double")
    return (
        F.when(x.isNull(), _NULL).when(F.isnan(x), _NAN)
        .when(x == float("inf"), _HIGH).when(x == float("-inf"), _LOW).otherwise(_FINITE)
    )


def _id(key: str) -> Column:
    return F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)))


@dataclass(frozen=True)
class Border:
    """The row at a place: what kind of score, the score (finite ones), the id."""

    kind: int
    score: float | None
    id: int

    def reached(self, score: str, key: str) -> Column:
        """Rows at this place or before it, best first, ties by id."""
        kind, x, k = _kind(score), F.col(score).cast("double"), _id(key)
        if self.kind != _FINITE:
            return (kind > self.kind) | ((kind == self.kind) & (k <= self.id))
        same = (x > self.score) | ((x == self.score) & (k <= self.id))
        return (kind > _FINITE) | ((kind == _FINITE) & same)


def _by_score(df: DataFrame, score: str, low: float, high: float) -> list[tuple]:
    """Kind, rows, least and most of each cell, best first."""
    x = F.col(score).cast("double")
    cell = F.least(F.floor((x - low) / F.lit(high - low) * CELLS), F.lit(CELLS - 1)) if high > low else F.lit(0)
    cells = df.groupBy(_kind(score).alias("kind"), F.when(_kind(score) == _FINITE, cell).alias("cell")).agg(
        F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")
    )
    return [tuple(r) for r in cells.orderBy(F.desc("kind"), F.desc("cell")).select("kind", "n", "low", "high").collect()]


def _id_at(df: DataFrame, key: str, place: int) -> int:
    """The id at a place of the rising ids."""
    k = _id(key)
    while True:
        n, low, high = df.agg(F.count("*"), F.min(k), F.max(k)).first()
        if n <= FEW or low == high:
            return df.select(k.alias("k")).orderBy("k").offset(place - 1).limit(1).first()[0] if low != high else low
        step = (high - low) // CELLS + 1
        cell = F.floor(k.cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)")).cast("decimal(38,0)") / F.lit(step).cast("decimal(38,0)")
        for r in df.groupBy(F.floor(cell).alias("c")).agg(F.count("*").alias("n"), F.min(k).alias("low"), F.max(k).alias("high")).orderBy("c").collect():
            if place <= r["n"]:
                df = df.where(k.between(r["low"], r["high"]))
                break
            place -= r["n"]


def borders(df: DataFrame, score: str, key: str, places: list[int]) -> list[Border | None]:
    """The rows at 1-based places of the order best score first (nulls last), then id; None beyond the end."""
    x = F.col(score).cast("double")
    finite = F.when(_kind(score) == _FINITE, x)
    low, high = df.agg(F.min(finite), F.max(finite)).first()
    first = _by_score(df, score, low or 0.0, high or 0.0)
    out: list[Border | None] = []
    for place in places:
        part, cells, found = df, first, None
        while found is None:
            for kind, n, low, high in cells:
                if place <= n:
                    break
                place -= n
            else:
                break  # beyond the end
            if kind != _FINITE or low == high:
                ties = part.where(_kind(score) == kind) if kind != _FINITE else part.where(x == low)
                found = Border(kind, low if kind == _FINITE else None, _id_at(ties, key, place))
            else:
                part = part.where(x.between(low, high))
                if n <= FEW:
                    row = part.select(x.alias("x"), _id(key).alias("k")).orderBy(F.desc("x"), "k").offset(place - 1).limit(1).first()
                    found = Border(_FINITE, row["x"], row["k"])
                else:
                    cells = _by_score(part, score, low, high)
        out.append(found)
    return out
