"""Which polygon a place lies in, from a cover of cells instead of a test against every edge.

Each polygon is laid on a grid of its own width, a power of two that gives it about as
many rows of cells as the root of its points. A cell that no edge enters lies inside or
outside as a whole, which one look along the middle of its row decides; outside cells
are not kept. A place in an inside cell needs no test. For a place in a cell that an
edge enters the usual ray is cast, but only against the edges that meet the row of the
cell, since no other edge can cross a ray along it; so the answer is that of the full
test to the last bit. The rows hold each edge about once, whatever the polygon's size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.session import cut

#: The fewest and the most rows of cells of a polygon.
FEWEST, MOST = 4, 256
#: A cell that an edge misses by less than this share of its width counts as entered, so that rounding never decides.
SLACK = 1 / 1024
BOX = ["min_lat", "max_lat", "min_lon", "max_lon"]


@dataclass(frozen=True)
class Cover:
    """``cells``: _polygon, width, gy, gx, whole, name; ``rows``: _polygon, gy, edges and the polygon's box; the widths in use."""

    cells: DataFrame
    rows: DataFrame
    widths: list[float]


def _crossing(e: Column, lat: Column) -> Column:
    return (e["bx"] - e["ax"]) * (lat - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]


def _spans(e: Column, lat: Column) -> Column:
    return (e["ay"] > lat) != (e["by"] > lat)


def _edges(polygons: DataFrame) -> DataFrame:
    """One row (_polygon, width, e) per edge of any ring."""
    ring = F.col("ring")
    ends = F.transform(
        F.sequence(F.lit(0), F.size(ring) - 2),
        lambda i: F.struct(
            F.get(F.get(ring, i), F.lit(0)).alias("ax"), F.get(F.get(ring, i), F.lit(1)).alias("ay"),
            F.get(F.get(ring, i + 1), F.lit(0)).alias("bx"), F.get(F.get(ring, i + 1), F.lit(1)).alias("by"),
        ),
    )
    return (
        polygons.select("_polygon", "width", F.explode("rings").alias("ring"))
        .where(F.size("ring") > 1)
        .select("_polygon", "width", F.explode(ends).alias("e"))
        .where("e.ax + e.ay + e.bx + e.by IS NOT NULL")
    )


def _entered(e: Column) -> Column:
    """Columns of the cells of row ``gy`` that an edge enters."""
    w, south = F.col("width"), F.col("gy") * F.col("width")
    low, high = F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])
    at = [_crossing(e, F.greatest(low, south)), _crossing(e, F.least(high, south + w))]
    level = e["ay"] == e["by"]
    left = F.when(level, F.least(e["ax"], e["bx"])).otherwise(F.least(*at))
    right = F.when(level, F.greatest(e["ax"], e["bx"])).otherwise(F.greatest(*at))
    return F.sequence(F.floor(left / w - SLACK), F.floor(right / w + SLACK))


def _inner() -> Column:
    """Columns of the cells of row ``gy`` whose middle lies inside."""
    w, middle = F.col("width"), (F.col("gy") + 0.5) * F.col("width")
    xs = F.array_sort(F.transform(F.filter("edges", lambda e: _spans(e, middle)), lambda e: _crossing(e, middle)))
    runs = F.transform(
        F.filter(F.transform(xs, lambda x, i: F.struct(x.alias("x"), F.get(xs, i + 1).alias("to"), i.alias("i"))), lambda r: (r["i"] % 2 == 0) & r["to"].isNotNull()),
        lambda r: F.struct(F.ceil(r["x"] / w - 0.5).alias("a"), F.floor(r["to"] / w - 0.5).alias("b")),
    )
    return F.flatten(F.transform(F.filter(runs, lambda r: r["a"] <= r["b"]), lambda r: F.sequence(r["a"], r["b"])))


def cover(polygons: DataFrame) -> Cover:
    """The cover of the polygons of :func:`curbline.operators.geo.ref_neighborhoods`.

    Polygons without points are left out. Where a ring is not closed, all cells of the
    polygon's box are tested, as no edge shows where the inside ends.
    """
    points = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r))
    extent = F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon"), F.lit(1e-6))
    across = F.least(F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2(F.sqrt(points)))), F.lit(float(FEWEST))), F.lit(float(MOST)))
    known = cut(
        polygons.where(F.col("min_lat").isNotNull() & F.col("min_lon").isNotNull())
        .withColumn("_polygon", F.monotonically_increasing_id())
        .withColumn("width", F.pow(F.lit(2.0), F.ceil(F.log2(extent))) / across)
    )
    widths = [r[0] for r in known.select("width").distinct().collect()]  # powers of two between 2^-28 and 2^7
    low, high = F.least("e.ay", "e.by"), F.greatest("e.ay", "e.by")
    banded = _edges(known).withColumn("gy", F.explode(F.sequence(F.floor(low / F.col("width")), F.floor(high / F.col("width")))))
    edges = banded.groupBy("_polygon", "gy").agg(F.collect_list("e").alias("edges"))
    rows = cut(edges.join(known.select("_polygon", "neighborhood_name", "width", "rings_closed", *BOX), "_polygon"))
    box = F.sequence(F.floor(F.col("min_lon") / F.col("width")), F.floor(F.col("max_lon") / F.col("width")))
    entered = F.when(F.col("rings_closed"), F.array_distinct(F.flatten(F.transform("edges", _entered)))).otherwise(box)
    cells = (
        rows.select("_polygon", "neighborhood_name", "width", "gy", entered.alias("entered"), _inner().alias("inner"))
        .withColumn("inner", F.array_except("inner", "entered"))
        .select(
            "_polygon", "neighborhood_name", "width", "gy",
            F.inline(F.concat(
                F.transform("entered", lambda x: F.struct(x.alias("gx"), F.lit(False).alias("whole"))),
                F.transform("inner", lambda x: F.struct(x.alias("gx"), F.lit(True).alias("whole"))),
            )),
        )
    )
    return Cover(cut(cells), rows.select("_polygon", "gy", "edges", *BOX), widths)


def located(points: DataFrame, over: Cover) -> DataFrame:
    """Distinct places ``latitude, longitude`` with each cell they lie in: _polygon, neighborhood_name, gy, whole."""
    places = (
        points.select("latitude", "longitude")
        .where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .distinct()
        .withColumn("width", F.explode(F.array(*[F.lit(w) for w in over.widths]).cast("array<double>")))
        .withColumns({"gy": F.floor(F.col("latitude") / F.col("width")), "gx": F.floor(F.col("longitude") / F.col("width"))})
    )
    return places.join(over.cells, ["width", "gy", "gx"]).select("latitude", "longitude", "_polygon", "neighborhood_name", "gy", "whole")


def tag(points: DataFrame, over: Cover) -> DataFrame:
    """Points with ``polygon_name``, the first by name of the polygons around them; null outside all, or without a place."""
    lat, lon = F.col("latitude"), F.col("longitude")
    cells = cut(located(points, over))
    crossed = F.size(F.filter("edges", lambda e: _spans(e, lat) & (lon < _crossing(e, lat))))
    tested = (
        cells.where("NOT whole").join(over.rows, ["_polygon", "gy"])
        .where(lat.between(F.col("min_lat"), F.col("max_lat")) & lon.between(F.col("min_lon"), F.col("max_lon")))
        .where(crossed % 2 == 1)
    )
    named = [df.select("latitude", "longitude", "neighborhood_name") for df in (cells.where("whole"), tested)]
    tagged = named[0].unionByName(named[1]).groupBy("latitude", "longitude").agg(F.min("neighborhood_name").alias("polygon_name"))
    return points.join(tagged, ["latitude", "longitude"], "left")
