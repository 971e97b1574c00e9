"""Which places lie within a radius, without testing every place of a crowded spot.

Places are filed under grid cells about as wide as the radius. A cell with more than
``MANY`` places is crowded and halved both ways, again and again, until its parts are
not. A circle asks a crowded spot by its parts: a part that lies inside answers as a
whole, under one key, and only the places of the parts that the circle cuts are
tested one by one. Cells that are not crowded, which is all of them in ordinary data,
are tested place by place and cost nothing more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions.numeric import EARTH_RADIUS_M, haversine
from curbline.session import cut

METRES_PER_DEGREE = EARTH_RADIUS_M * 3.141592653589793 / 180
#: A cell with more places is halved, DEEPEST times at most.
MANY, DEEPEST = 64, 12
#: Whole cells must clear the circle by this share of the radius, so that rounding never decides.
MARGIN = 1e-7


class Grid:
    """Cells of ``metres`` at level 0; level k halves them k times. Columns close at 180 degrees."""

    def __init__(self, metres: float):
        self.metres = metres
        self.dlat = metres / METRES_PER_DEGREE
        self.around = max(int(360 / self.dlat), 1)
        self.dlon = 360 / self.around

    def row(self, lat: Column, level: int = 0) -> Column:
        return F.floor(lat / F.lit(self.dlat) * F.lit(2.0**level))

    def column(self, lon: Column, level: int = 0) -> Column:
        """Not closed: left and right of 180 degrees differ."""
        return F.floor(lon / F.lit(self.dlon) * F.lit(2.0**level))

    def closed(self, column: Column, level: int = 0) -> Column:
        return F.pmod(column, F.lit(self.around << level))

    def filed(self, places: DataFrame, level: int = 0) -> DataFrame:
        """Places with ``gy, gx`` of their cell."""
        return places.withColumns({"gy": self.row(F.col("lat"), level), "gx": self.closed(self.column(F.col("lon"), level), level)})

    def asked(self, places: DataFrame) -> DataFrame:
        """Places with ``gy, ux, gx`` of every cell that the box of their circle meets."""
        lat, lon = F.col("lat"), F.col("lon")
        reach = F.lit(self.dlat * 1.001) / F.cos(F.radians(F.least(F.abs(lat) + self.dlat, F.lit(89.9))))
        return (
            places.withColumn("gy", F.explode(F.sequence(self.row(lat - self.dlat), self.row(lat + self.dlat))))
            .withColumn("ux", F.explode(F.sequence(self.column(lon - reach), self.column(lon + reach))))
            .withColumn("gx", self.closed(F.col("ux")))
        )

    def place(self, level: int) -> tuple[Column, Column]:
        """Whether the circle around (lat, lon) holds the whole cell (gy, ux), and whether it may meet it."""
        high, wide = self.dlat / 2**level, self.dlon / 2**level
        south, west = F.col("gy") * F.lit(high), F.col("ux") * F.lit(wide)
        corners = [haversine("lat", "lon", y, x) for y in (south, south + high) for x in (west, west + wide)]
        whole = F.greatest(*corners) <= self.metres * (1 - MARGIN)
        near_lat = F.least(F.greatest(F.col("lat"), south), south + high)
        near_lon = F.least(F.greatest(F.col("lon"), west), west + wide)
        polar = F.abs("lat") > 85  # parallels bend too much there
        return whole, polar | (haversine("lat", "lon", near_lat, near_lon) <= self.metres * 1.01)


def cell_key(level: int) -> Column:
    return F.concat_ws(":", F.lit("cell"), F.lit(str(level)), F.col("gy").cast("string"), F.col("gx").cast("string"))


class Quadtree:
    """The crowded cells of distinct places ``lat, lon``, level by level, and the places in them."""

    def __init__(self, places: DataFrame, metres: float, many: int = MANY, deepest: int = DEEPEST):
        self.grid, self.places = Grid(metres), places
        self.crowded: list[DataFrame] = []  # gy, gx of each level
        self.inside: list[DataFrame] = []  # places of crowded parents, with gy, gx at the level
        here = places
        for level in range(deepest):
            filed = self.grid.filed(here, level)
            if level:
                filed = cut(filed)
            found = cut(filed.groupBy("gy", "gx").agg(F.count("*").alias("_n")).where(F.col("_n") > many).select("gy", "gx"))
            if level:
                self.inside.append(filed)
            if found.isEmpty():
                break
            self.crowded.append(found)
            here = filed.join(found, ["gy", "gx"], "left_semi").select("lat", "lon")
        else:  # as deep as it goes
            if self.crowded:
                self.inside.append(cut(self.grid.filed(here, deepest)))

    def keys_of_places(self) -> DataFrame | None:
        """``lat, lon, k``: the key of each cell that answers for the place as a whole; None if no cell is crowded."""
        if not self.crowded:
            return None
        top = self.grid.filed(self.places).join(self.crowded[0], ["gy", "gx"], "left_semi")
        rows = [top.select("lat", "lon", cell_key(0).alias("k"))]
        rows += [filed.select("lat", "lon", cell_key(level).alias("k")) for level, filed in enumerate(self.inside, 1)]
        return reduce(DataFrame.unionByName, rows)

    def near(self) -> tuple[DataFrame, DataFrame | None]:
        """What lies within the radius of each place: single places ``lat, lon, near_lat, near_lon``, and whole cells ``lat, lon, k``."""
        grid, asked = self.grid, self.grid.asked(self.places)

        def tested(asks: DataFrame, filed: DataFrame) -> DataFrame:
            others = filed.select(F.col("lat").alias("near_lat"), F.col("lon").alias("near_lon"), "gy", "gx")
            return (
                asks.join(others, ["gy", "gx"])
                .where(haversine("lat", "lon", "near_lat", "near_lon") <= grid.metres)
                .select("lat", "lon", "near_lat", "near_lon")
            )

        if not self.crowded:
            return tested(asked, grid.filed(self.places)), None
        plain = grid.filed(self.places).join(self.crowded[0], ["gy", "gx"], "left_anti")
        singles, cells = [tested(asked, plain)], []
        front = cut(asked.join(self.crowded[0], ["gy", "gx"], "left_semi"))
        for level in range(len(self.crowded) + 1):
            whole, meets = grid.place(level)
            placed = front.withColumn("_whole", whole).where(F.col("_whole") | meets)
            cells.append(placed.where("_whole").select("lat", "lon", cell_key(level).alias("k")))
            cut_ = placed.where("NOT _whole").drop("_whole")
            if level < len(self.crowded):
                crowded = cut_ if not level else cut_.join(self.crowded[level], ["gy", "gx"], "left_semi")
                if level:
                    singles.append(tested(cut_.join(self.crowded[level], ["gy", "gx"], "left_anti"), self.inside[level - 1]))
                halves = F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))
                front = cut(
                    crowded.withColumn("_y", F.explode(halves)).withColumn("_x", F.explode(halves))
                    .select("lat", "lon", (F.col("gy") * 2 + F.col("_y")).alias("gy"), (F.col("ux") * 2 + F.col("_x")).alias("ux"))
                    .withColumn("gx", grid.closed(F.col("ux"), level + 1))
                    .join(self.inside[level].select("gy", "gx").distinct(), ["gy", "gx"], "left_semi")
                )
            else:
                singles.append(tested(cut_, self.inside[level - 1]))
        return reduce(DataFrame.unionByName, singles), reduce(DataFrame.unionByName, cells)
