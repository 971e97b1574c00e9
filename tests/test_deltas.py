"""Serving tables from signed changes equal the rebuilt ones, and only changed keys are written."""

import datetime as dt
import random

import pytest

from curbline.operators import deltas, fairness, maintain, metrics
from curbline.schemas import CASE_SCHEMA
from curbline.session import fresh_path
from curbline.sources import commits

START = dt.datetime(2024, 1, 1)
AS_OF = "2024-05-10 00:00:00"


def case(rng, key, stamp):
    opened = None if rng.random() < 0.1 else START + dt.timedelta(hours=rng.randrange(2400))
    closed = opened and rng.random() < 0.6 and opened + dt.timedelta(seconds=rng.randrange(10**6), microseconds=rng.randrange(10**6))
    row = dict.fromkeys(CASE_SCHEMA.fieldNames()) | {
        "_id": key * 10, "case_enquiry_id": key, "open_dt": opened, "closed_dt": closed or None,
        "case_status": rng.choice(["Open", "Closed", None]), "on_time": rng.choice(["ONTIME", "OVERDUE", "true", None]),
        "neighborhood": rng.choice(["A", "B", None]), "department": rng.choice(["X", "Y"]), "reason": "r", "type": "t",
        "source": rng.choice(["app", None]), "sla_target_dt": opened if rng.random() < 0.5 else None, "_ingested_at": stamp,
    }
    return tuple(row.values())


def batch(spark, rng, keys, stamp):
    return spark.createDataFrame([case(rng, k, stamp) for k in keys], CASE_SCHEMA)


def sorted_rows(df, digits=6):
    return sorted((tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


KINDS = {
    "dashboard": (deltas.dashboard, metrics.dashboard_daily, lambda t: t),
    "daily": (deltas.daily, metrics.daily_metrics, lambda t: t),
    "slices": (deltas.slices, lambda c: fairness.slice_metrics(c, AS_OF), lambda t: deltas.slice_rates(t, AS_OF)),
}


@pytest.mark.parametrize("kind", KINDS)
def test_upserts_with_updates_late_rows_and_no_ops(spark, kind):
    make, rebuilt, shown = KINDS[kind]
    rng, rollup = random.Random(7), make()
    cases, path = fresh_path(spark, "cases"), fresh_path(spark, "serving")
    days = [dt.datetime(2024, 5, d) for d in (1, 2, 3, 4)]
    maintain.create_months(batch(spark, rng, range(60), days[1]), cases)
    deltas.create(spark, cases, path, rollup)
    again = random.Random(1)
    batches = [
        batch(spark, rng, range(50, 70), days[2]),  # updates and inserts
        batch(spark, rng, range(0, 20), days[0]),  # late: older than what is there, nothing changes
        batch(spark, again, range(90, 95), days[3]),
        batch(spark, random.Random(1), range(90, 95), days[3]),  # the same rows once more
    ]
    for number, new in enumerate(batches):
        before = commits.manifest(spark, path)
        maintain.upsert_months(spark, cases, new)
        after = deltas.refresh(spark, cases, path, rollup, most=2)
        table = commits.read(spark, cases)
        assert sorted_rows(shown(deltas.read(spark, path, rollup))) == sorted_rows(rebuilt(table).select(shown(deltas.read(spark, path, rollup)).columns))
        if number in (1, 3):  # rows were rewritten, no key changed, so no file was written
            assert after.folders == before.folders and after.version == before.version + 1
    version = commits.manifest(spark, path).version
    assert deltas.refresh(spark, cases, path, rollup).version == version  # nothing to do


def test_only_changed_keys_are_written_and_a_crash_counts_nothing_twice(spark, monkeypatch):
    rng, rollup = random.Random(3), deltas.dashboard()
    cases, path = fresh_path(spark, "cases"), fresh_path(spark, "serving")
    maintain.create_months(batch(spark, rng, range(200), dt.datetime(2024, 5, 1)), cases)
    base = deltas.create(spark, cases, path, rollup)
    maintain.upsert_months(spark, cases, batch(spark, rng, [3], dt.datetime(2024, 5, 2)))
    with monkeypatch.context() as m:
        m.setattr(commits, "commit", lambda *a, **b: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            deltas.refresh(spark, cases, path, rollup)
    assert commits.manifest(spark, path) == base
    new = deltas.refresh(spark, cases, path, rollup)
    came = {m: [f for f in some if f not in base.folders.get(m, [])] for m, some in new.folders.items()}
    written = sum(spark.read.parquet(f"{path}/{f}").count() for some in came.values() for f in some)
    assert written <= 2  # the key the case left and the one it went to
    assert sorted_rows(deltas.read(spark, path, rollup)) == sorted_rows(metrics.dashboard_daily(commits.read(spark, cases)))


def test_folders_stay_few_and_a_lost_version_is_summed_anew(spark):
    rng, rollup = random.Random(5), deltas.daily()
    cases, path = fresh_path(spark, "cases"), fresh_path(spark, "serving")
    maintain.create_months(batch(spark, rng, range(30), dt.datetime(2024, 5, 1)), cases)
    deltas.create(spark, cases, path, rollup)
    for day in range(2, 7):
        maintain.upsert_months(spark, cases, batch(spark, rng, range(30), dt.datetime(2024, 5, day)))
        got = deltas.refresh(spark, cases, path, rollup, most=2)
        assert max(map(len, got.folders.values())) <= 2
    maintain.upsert_months(spark, cases, batch(spark, rng, range(40), dt.datetime(2024, 5, 8)))
    commits.vacuum(spark, cases)
    deltas.refresh(spark, cases, path, rollup)
    assert sorted_rows(deltas.read(spark, path, rollup)) == sorted_rows(metrics.daily_metrics(commits.read(spark, cases)))


def test_empty_tables(spark):
    rollup, none = deltas.daily(), spark.createDataFrame([], CASE_SCHEMA)
    cases, path = fresh_path(spark, "cases"), fresh_path(spark, "serving")
    maintain.create_months(none, cases)
    deltas.create(spark, cases, path, rollup)
    assert deltas.read(spark, path, rollup).count() == 0
    maintain.upsert_months(spark, cases, batch(spark, random.Random(2), range(5), dt.datetime(2024, 5, 1)))
    deltas.refresh(spark, cases, path, rollup)
    assert deltas.read(spark, path, rollup).agg({"total_cases": "sum"}).first()[0] == 5
