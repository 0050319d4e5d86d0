from datetime import timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.plans import runs
from tests import rows as R


def state_of(spark, *rows):
    return spark.createDataFrame([(r, s, R.at(t), R.at(t)) for r, s, t in rows], S.INGEST_STATE)


def test_register_takes_defaults_and_refuses_duplicates(spark):
    registry = R.runs(spark, "r1")
    new = spark.createDataFrame(
        [("r1", "db", R.at(0), R.at(9)), ("r2", "db", R.at(5), R.at(9)), ("r2", "db", R.at(0), R.at(9)), ("r3", None, R.at(0), R.at(9))],
        "test_run string, database_name string, start_time timestamp, end_time timestamp",
    )
    registry, refused = runs.register_runs(registry, new)
    got = R.rows_of(registry, "test_run", "agg_grace_interval")
    assert got == [("r1", timedelta(minutes=70)), ("r2", timedelta(minutes=70))]
    assert registry.where("test_run = 'r2'").first().start_time == R.at(0).replace(tzinfo=None)
    assert R.rows_of(refused, "test_run") == [("r1",), ("r2",), ("r3",)]


def test_active_runs_cases(spark):
    closes = 3600 + 70 * 60
    registry = R.runs(spark, "finished", "grace", "no_state", "behind").unionByName(R.runs(spark, "future", start=10**6, end=2 * 10**6))
    registry = registry.withColumn("end_time", F.when(F.col("test_run") == "grace", F.col("end_time") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("end_time")))
    state = state_of(spark, ("finished", "contention", closes), ("finished", "insights", closes + 1), ("grace", "contention", closes),
                     ("behind", "contention", closes), ("behind", "txn_stats", 100))
    active = runs.active_runs(registry, state, R.at(closes + 60))
    assert R.rows_of(active, "test_run") == [("behind",), ("grace",), ("no_state",)]


def test_slices_follow_the_earliest_limit(spark):
    registry = R.runs(spark, "r", end=100)
    none = state_of(spark)

    def spans(state, now, **kw):
        got = runs.due_slices(registry, state, R.at(now), **kw)
        to = lambda c: (F.unix_micros(c) / 1e6 - R.T0.timestamp()).alias(c)
        return {r[0]: (r[1], r[2]) for r in got.select("stream", to("from_ts"), to("to_ts")).collect()}

    assert spans(none, 1000)["contention"] == (0, 30)
    assert spans(none, 20)["contention"] == (0, 15)
    assert spans(none, 5) == {} and spans(none, 4) == {}
    assert spans(state_of(spark, ("r", "contention", 90), ("r", "txn_stats", 90)), 1000)["contention"] == (90, 100)
    assert spans(state_of(spark, ("r", "txn_stats", 90)), 1000)["txn_stats"] == (90, 120)
    done = state_of(spark, ("r", "contention", 100), ("r", "stmt_stats", 100 + 4200))
    assert set(spans(done, 10**5)) == {"insights", "txn_stats"}
    assert spans(none, 10**5, slice_seconds=None)["stmt_stats"] == (0, 100 + 4200)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 90), min_size=1, max_size=6))
def test_slices_are_adjacent_and_within_limits(spark, steps):
    registry = R.runs(spark, "r", end=150)
    state, now, seen = state_of(spark), 0, []
    for step in steps:
        now += step
        for r in runs.due_slices(registry, state, R.at(now), ["contention"]).collect():
            lo, hi = (t.replace(tzinfo=R.T0.tzinfo) for t in (r.from_ts, r.to_ts))
            assert lo < hi <= min(R.at(now - 5), R.at(150)) and hi - lo <= timedelta(seconds=30)
            assert lo == (seen[-1][1] if seen else R.at(0))
            seen.append((lo, hi))
            state = spark.createDataFrame([("r", "contention", hi, hi)], S.INGEST_STATE)


def test_set_watermarks_and_lag(spark):
    state = state_of(spark, ("r", "contention", 10), ("q", "contention", 5))
    marks = spark.createDataFrame([("r", "contention", R.at(40)), ("r", "insights", R.at(30))], "test_run string, stream string, watermark_ts timestamp")
    got = runs.set_watermarks(state, marks, R.at(50)).select("test_run", "stream", (F.unix_micros("watermark_ts") / 1e6 - R.T0.timestamp()).alias("w"))
    assert R.rows_of(got) == [("q", "contention", 5.0), ("r", "contention", 40.0), ("r", "insights", 30.0)]
    lag = runs.watermark_lag(marks.withColumnRenamed("watermark_ts", "to_ts"), R.at(50))
    assert R.rows_of(lag, "stream", "lag_seconds") == [("contention", 10.0), ("insights", 20.0)]


def test_hour_windows(spark):
    registry = R.runs(spark, "fresh", "marked", "young", start=600, end=2 * 3600)
    marks = spark.createDataFrame(
        [("fresh", None), ("marked", R.at(3700)), ("young", R.at(3 * 3600 - 4000))], "test_run string, last_agg_copy_time timestamp"
    )
    windows = runs.hour_windows(registry.join(marks, "test_run"), F.expr("INTERVAL '1' HOUR"), R.at(2 * 3600 + 900))
    sec = lambda c: (F.unix_micros(c) / 1e6 - R.T0.timestamp()).alias(c)
    # ends: min(now - 10 s, end + 10 min) = end + 10 min, cut to the hour; a mark in the same hour keeps the end itself
    assert R.rows_of(windows.select("test_run", sec("from_ts"), sec("to_ts"))) == [
        ("fresh", 0.0, 7200.0), ("marked", 3600.0, 7200.0), ("young", 3600.0, 7200.0)
    ]
    early = runs.hour_windows(registry.join(marks, "test_run"), F.expr("INTERVAL '1' HOUR"), R.at(3600 + 4100))
    assert R.rows_of(early, "test_run") == [("fresh",)]
    older = registry.join(marks, "test_run").withColumn("last_copy_time", F.lit(R.at(2 * 3600)))
    assert runs.older_active_runs(older.withColumn("last_agg_copy_time", F.col("end_time")), R.at(9000)).count() == 0
    assert R.rows_of(runs.older_active_runs(older, R.at(9000)), "test_run") == [("fresh",), ("marked",), ("young",)]
