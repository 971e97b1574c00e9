"""Workload features of a case at the moment it was opened.

All three counts have one shape: how many spans of the same key contain an
instant. A span opens just after a report and ends with its window or its
closing. Opens and ends become +1 / -1 steps on a time line and the answer is
a running sum, so no pair of cases is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curbline.functions import clock
from curbline.functions.numeric import haversine
from curbline.operators.quadtree import MANY, METRES_PER_DEGREE, Grid, Quadtree  # noqa: F401
from curbline.session import cut

ID = "case_enquiry_id"
DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
HOT_ROWS = 1_000_000  # a window over this many narrow rows is a small task
SMALL_ROWS = 100_000  # key tables up to this size are broadcast


def count_open(
    line: DataFrame, keys: list[str], carry: list[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Spans open at each question of a time line.

    line: keys, at (microseconds), d (+1, -1, or 0 for a question), ask, carry.
    A key's running sum is one window. Keys with more than ``hot_rows`` entries
    are cut at the hour instead: each (key, hour) sums its own steps and the
    totals of the earlier hours are added, so a hot key is spread over as many
    tasks as it has hours. The line is stored once for all its readers.
    """
    line = cut(line.select(*keys, "at", "d", "ask", *carry))
    hot = cut(line.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).drop("_n"))
    n_hot = hot.count()
    if not n_hot:
        return _running(line, keys).select(*keys, *carry, F.col("n_in").alias("n"))

    marked = hot.withColumn("_hot", F.lit(True))
    if n_hot <= SMALL_ROWS:
        marked = F.broadcast(marked)
    slot = [*keys, "hour"]
    line = line.join(marked, keys, "left").withColumn(
        "hour", F.when(F.col("_hot"), F.expr(f"at div {HOUR_US}")).otherwise(-1)
    )
    before = W.partitionBy(*keys).orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    earlier = (
        line.where("_hot")
        .groupBy(*slot)
        .agg(F.sum("d").alias("d"))
        .withColumn("n_before", F.coalesce(F.sum("d").over(before), F.lit(0)))
        .where("n_before <> 0")
        .drop("d")
    )
    return _running(line, slot).join(earlier, slot, "left").select(
        *keys, *carry, (F.col("n_in") + F.coalesce("n_before", F.lit(0))).alias("n")
    )


def _running(line: DataFrame, by: list[str]) -> DataFrame:
    # RANGE frame: steps at the same instant count, whatever their order
    inside = W.partitionBy(*by).orderBy("at").rangeBetween(W.unboundedPreceding, 0)
    return line.withColumn("n_in", F.sum("d").over(inside)).where("ask")


def near_places(places: DataFrame, metres: float) -> DataFrame:
    """Pairs of distinct places at most ``metres`` apart, each with itself.

    ``places`` (lat, lon) must be distinct. One side is filed under its grid
    cell, the other under every cell its search box meets.
    """
    grid = Grid(metres)
    near = grid.filed(places).select(F.col("lat").alias("near_lat"), F.col("lon").alias("near_lon"), "gy", "gx")
    return (
        grid.asked(places).join(near, ["gy", "gx"])
        .where(haversine("lat", "lon", "near_lat", "near_lon") <= metres)
        .select("lat", "lon", "near_lat", "near_lon")
    )


def near_keys(places: DataFrame, metres: float, many: int = MANY) -> tuple[DataFrame, DataFrame | None]:
    """Keys ``lat, lon, k`` to ask for what lies within the radius of each place, and the cells' keys each place answers to.

    A key is a place or, in crowded spots, a cell with all its places; the keys of
    one place share no place. The second frame is None when no spot is crowded.
    """
    tree = Quadtree(places, metres, many)
    singles, cells = tree.near()
    asks = singles.select("lat", "lon", _place_key(F.col("near_lat"), F.col("near_lon")).alias("k"))
    return (asks if cells is None else asks.unionByName(cells)), tree.keys_of_places()


def _window_end(days: int) -> Column:
    return F.col("at") + F.lit(days * DAY_US + 1)


def _mark(key: list[Column], at: Column, d: int, id_: Column | None = None) -> Column:
    """One entry of a time line; a question carries its case id."""
    case = F.lit(None).cast("bigint") if id_ is None else id_
    return F.struct(
        *key, at.alias("at"), F.lit(d).alias("d"), F.lit(id_ is not None).alias("ask"), case.alias(ID)
    )


def _span(key: list[Column], end: Column) -> list[Column]:
    """Open just after ``at``, close at ``end``; nothing when it ends before."""
    last = F.greatest(end, F.col("at") + 1)
    return [_mark(key, F.col("at") + 1, 1), _mark(key, last, -1)]


def _pinned(cases: DataFrame) -> DataFrame:
    return cases.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        ID,
        (F.col("latitude") + 0.0).alias("lat"),
        (F.col("longitude") + 0.0).alias("lon"),
        F.unix_micros("open_dt").alias("at"),
    )


def place_repeats(cases: DataFrame, days: int = 90, metres: float = 30.0) -> DataFrame:
    """Space-time self-join, counted per pair of places: how often a case at
    (lat, lon) had an earlier one at (near_lat, near_lon) within ``days``."""
    pinned = _pinned(cases)
    pairs = near_places(pinned.select("lat", "lon").distinct(), metres)
    none = F.lit(None).cast("double")
    here = [F.col("lat").alias("near_lat"), F.col("lon").alias("near_lon"), none.alias("lat"), none.alias("lon")]
    steps = pinned.select(F.inline(F.array(*_span(here, _window_end(days)))))
    asks = pinned.join(pairs, ["lat", "lon"]).select(
        "near_lat", "near_lon", "lat", "lon", "at", F.lit(0).alias("d"), F.lit(True).alias("ask"), ID
    )
    counted = count_open(steps.unionByName(asks), ["near_lat", "near_lon"], ["lat", "lon"])
    return (
        counted.groupBy("lat", "lon", "near_lat", "near_lon")
        .agg(F.sum("n").alias("n_pairs"))
        .where("n_pairs > 0")
    )


# The three counts and the kind of key each belongs to.
COUNTS = {
    "neighborhood": "neigh_open_14d",
    "department": "dept_pressure_30d",
    "place": "prev_repeat_90d_30m",
}


def workload_counts(
    cases: DataFrame,
    kinds=tuple(COUNTS),
    open_days: int = 14,
    dept_days: int = 30,
    repeat_days: int = 90,
    metres: float = 30.0,
    many: int = MANY,
) -> DataFrame:
    """``neigh_open_14d``, ``dept_pressure_30d`` and ``prev_repeat_90d_30m`` per
    case, from one time line over (kind, key).

    neighborhood: opened in the 14 days before and still open then; department:
    opened in the 30 days before; place: opened within 30 m in the 90 days
    before, asked place by place and in spots of more than ``many`` places by whole
    cells. The case itself and cases of the same instant do not count. Cases
    with no count at all may be missing.
    """
    def key(kind: str, k: Column) -> list[Column]:
        return [F.lit(kind).alias("kind"), k.alias("k")]

    rows = cases.select(
        ID, "neighborhood", "department",
        _place_key(F.col("latitude") + 0.0, F.col("longitude") + 0.0).alias("place"),
        F.unix_micros("open_dt").alias("at"), F.unix_micros("closed_dt").alias("closed"),
    )
    hood, dept, place = (key(k, F.col(k)) for k in COUNTS)
    entries = []
    if "neighborhood" in kinds:  # least skips the null of a case still open
        entries += _span(hood, F.least(_window_end(open_days), F.col("closed")))
        entries.append(_mark(hood, F.col("at"), 0, F.col(ID)))
    if "department" in kinds:
        entries += _span(dept, _window_end(dept_days))
        entries.append(_mark(dept, F.col("at"), 0, F.col(ID)))
    if "place" in kinds:
        entries += _span(place, _window_end(repeat_days))
    line = rows.select(F.inline(F.array(*entries))).where(F.col("k").isNotNull())
    if "place" in kinds:
        pinned = _pinned(cases)
        keys, cells = near_keys(cut(pinned.select("lat", "lon").distinct()), metres, many)
        if cells is not None:
            spans = _span(key("place", F.col("k")), _window_end(repeat_days))
            line = line.unionByName(pinned.join(cells, ["lat", "lon"]).select(F.inline(F.array(*spans))))
        asks = pinned.join(keys, ["lat", "lon"])
        line = line.unionByName(
            asks.select(*key("place", F.col("k")), "at", F.lit(0).alias("d"), F.lit(True).alias("ask"), ID)
        )
    return (
        count_open(line, ["kind", "k"], [ID])
        .groupBy(ID)
        .agg(
            *[
                F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(COUNTS[k])
                for k in kinds
            ]
        )
    )


def _place_key(lat: Column, lon: Column) -> Column:
    """Null when a coordinate is missing."""
    return F.concat(lat.cast("string"), F.lit(","), lon.cast("string"))


def _counted(cases: DataFrame, kind: str, out: str, **settings) -> DataFrame:
    counts = workload_counts(cases, (kind,), **settings)
    return cases.select(ID).join(counts, ID, "left").select(
        ID, F.coalesce(out, F.lit(0)).alias(out)
    )


def neigh_open_14d(cases: DataFrame) -> DataFrame:
    return _counted(cases, "neighborhood", "neigh_open_14d")


def dept_pressure(cases: DataFrame) -> DataFrame:
    return _counted(cases, "department", "dept_pressure_30d")


def prev_repeat(cases: DataFrame, days: int = 90, metres: float = 30.0) -> DataFrame:
    return _counted(cases, "place", "prev_repeat_90d_30m", repeat_days=days, metres=metres)


def calendar_features(cases: DataFrame, tz: str = clock.CITY_TZ) -> DataFrame:
    """Local hour, day of week (1 = Sunday) and month of the opening."""
    local = clock.local_time("open_dt", tz)
    return cases.withColumns(
        {
            "hour_of_day": F.hour(local),
            "day_of_week": F.dayofweek(local),
            "month": F.month(local),
        }
    )


def _featured(cases: DataFrame, context: DataFrame) -> DataFrame:
    counts = workload_counts(context)
    return calendar_features(cases.join(counts, ID, "left")).withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in COUNTS.values()}
    )


FEATURES = [
    "neighborhood", "reason", "department", "hour_of_day", "day_of_week", "month",
    "neigh_open_14d", "prev_repeat_90d_30m", "dept_pressure_30d",
]


def train_features(cases: DataFrame) -> DataFrame:
    """Features of every case with the label ``y_priority``: 1 when on time so far."""
    label = F.when(F.col("on_time") == "ONTIME", 1).otherwise(0).alias("y_priority")
    return _featured(cases, cases).select(ID, label, *FEATURES)


def open_features(cases: DataFrame) -> DataFrame:
    """Features of open cases with coordinates; the counts still see all cases."""
    is_open = cases.where(F.col("case_status") == "Open")
    return _featured(is_open, cases).select(ID, *FEATURES, "latitude", "longitude")
