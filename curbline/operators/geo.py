"""Places: near-me filter, map points, reference polygons and tagging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions.labels import norm_upper
from curbline.functions.numeric import haversine
from curbline.operators.features import METRES_PER_DEGREE
from curbline.session import cut


def within(df: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Rows at most ``radius_m`` away. A latitude band, which the scan can use,
    comes before the exact distance."""
    band = radius_m / METRES_PER_DEGREE * 1.001
    return df.where(
        F.col("latitude").between(lat - band, lat + band)
        & F.col("longitude").isNotNull()
        & (haversine(lat, lon, "latitude", "longitude") <= radius_m)
    )


def near(df: DataFrame, lat=None, lon=None, radius_m=None) -> DataFrame:
    """Rows near a point; the whole frame when the input is not usable or
    nothing is near."""
    try:
        lat, lon, radius_m = float(lat), float(lon), float(radius_m)
    except (TypeError, ValueError):
        return df
    if not radius_m:
        return df
    found = within(df, lat, lon, radius_m)  # keeps the band, so the scan skips row groups
    return df if found.isEmpty() else found


def map_points(df: DataFrame, cols: list[str], order: list[Column], cap: int = 2000) -> DataFrame:
    """Rows with both coordinates, at most ``cap`` markers in the given order."""
    pinned = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return pinned.orderBy(*order).limit(cap).select(*cols)


def ref_neighborhoods(features: DataFrame) -> DataFrame:
    """Reference polygons from (name, geometry JSON).

    Rows without a name are dropped; a name of only blanks stays, as ''. The
    outer rings become arrays with their bounding box. Rings that are not
    closed are flagged, not repaired.
    """
    name = F.coalesce("name", F.lit(""))
    polygon = F.from_json("geometry", "type string, coordinates array<array<array<double>>>")
    multi = F.from_json("geometry", "type string, coordinates array<array<array<array<double>>>>")
    kind = F.get_json_object("geometry", "$.type")
    rings = F.when(kind == "Polygon", polygon["coordinates"]).when(
        kind == "MultiPolygon", F.flatten(multi["coordinates"])
    )
    points = F.flatten("rings")
    return (
        features.where(name != "")
        .select(norm_upper(name).alias("neighborhood_name"), "geometry", rings.alias("rings"))
        .withColumns(
            {
                "min_lon": F.array_min(F.transform(points, lambda p: p[0])),
                "max_lon": F.array_max(F.transform(points, lambda p: p[0])),
                "min_lat": F.array_min(F.transform(points, lambda p: p[1])),
                "max_lat": F.array_max(F.transform(points, lambda p: p[1])),
                "rings_closed": F.forall("rings", lambda r: F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)),
            }
        )
    )


def inside(lat: Column, lon: Column, rings: Column) -> Column:
    """Even-odd ray casting over all rings, so holes are left out."""

    def crossings(ring: Column) -> Column:
        edges = F.arrays_zip(
            F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"),
            F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"),
        )

        def crosses(e: Column) -> Column:
            ax, ay, bx, by = e["a"][0], e["a"][1], e["b"][0], e["b"][1]
            spans = (ay > lat) != (by > lat)
            return spans & (lon < (bx - ax) * (lat - ay) / (by - ay) + ax)

        return F.size(F.filter(edges, crosses))

    total = F.aggregate(rings, F.lit(0), lambda acc, r: acc + crossings(r))
    return total % 2 == 1


def tag_polygon(points: DataFrame, polygons: DataFrame, cell: float | None = None) -> DataFrame:
    """Name of the polygon around each point, null outside all of them.

    A polygon is filed, without its rings, under the few grid cells its bounding
    box touches, in a grid as coarse as the box is large; a point looks in its
    cell of each grid in use. ``cell`` sets one width in degrees for all. Rings
    are fetched for the places inside a box only, and the test runs once per
    distinct place.
    """
    extent = F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon"), F.lit(1e-6))
    known = cut(polygons.withColumns({
        "_polygon": F.monotonically_increasing_id(),
        "width": F.pow(F.lit(2.0), F.ceil(F.log2(extent))) if cell is None else F.lit(cell),
    }))
    widths = [r[0] for r in known.select("width").distinct().collect()]  # powers of two between 1e-6 and 360 degrees

    def at(c: str) -> Column:
        return F.floor(F.col(c) / F.col("width"))

    filed = (
        known.select("_polygon", "width", "min_lat", "max_lat", "min_lon", "max_lon")
        .withColumn("gy", F.explode(F.sequence(at("min_lat"), at("max_lat"))))
        .withColumn("gx", F.explode(F.sequence(at("min_lon"), at("max_lon"))))
    )
    places = (
        points.select("latitude", "longitude")
        .where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .distinct()
        .withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths]).cast("array<double>")))
        .withColumns({"gy": at("latitude"), "gx": at("longitude")})
    )
    boxed = places.join(filed, ["width", "gy", "gx"]).where(
        F.col("latitude").between(F.col("min_lat"), F.col("max_lat"))
        & F.col("longitude").between(F.col("min_lon"), F.col("max_lon"))
    )
    tagged = (
        boxed.select("latitude", "longitude", "_polygon")
        .join(known.select("_polygon", "neighborhood_name", "rings"), "_polygon")
        .where(inside(F.col("latitude"), F.col("longitude"), F.col("rings")))
        .groupBy("latitude", "longitude")
        .agg(F.min("neighborhood_name").alias("polygon_name"))
    )
    return points.join(tagged, ["latitude", "longitude"], "left")
