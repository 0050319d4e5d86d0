"""Operators against brute force on small random data."""

import math
import random
from datetime import timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.operators import joins, merging, ranking, sampling
from tests import rows as R


def test_first_per_group_cuts_groups_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id as v")
    got = ranking.first_per_group(df, ["k"], [F.col("v").desc()])
    assert R.rows_of(got) == [(0, 999), (1, 997), (2, 998)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_exact_percentiles(spark):
    rng = random.Random(1)
    data = [("hot", rng.randint(0, 5000)) for _ in range(2000)] + [("one", 7), ("two", 1), ("two", 9000), ("none", None)]
    got = ranking.exact_percentiles(spark.createDataFrame(data, "g string, v bigint"), ["g"], "v", (50, 90, 99, 100), coarse=64)
    for r in got.collect():
        values = sorted(v for g, v in data if g == r.g and v is not None)
        for p in (50, 90, 99, 100):
            assert r[f"p{p}"] == values[max(1, math.ceil(len(values) * p / 100)) - 1], (r, p)
    assert got.count() == 3


def test_interval_join_is_half_open(spark):
    rng = random.Random(2)
    events = [(rng.choice("xy"), R.at(rng.randint(-4000, 12000)), i) for i in range(300)]
    events += [("x", R.at(0), 900), ("x", R.at(7200), 901)]
    spans = [("x", R.at(0), R.at(7200), "a"), ("x", R.at(7200), R.at(7260), "b"), ("y", R.at(-4000), R.at(100), "c"), ("y", R.at(5), R.at(5), "d")]
    got = joins.interval_join(
        spark.createDataFrame(events, "k string, ts timestamp, id int"),
        spark.createDataFrame(spans, "k string, lo timestamp, hi timestamp, name string"),
        "ts", "lo", "hi", [("k", "k")],
    )
    want = sorted(((i, n) for k, t, i in events for sk, lo, hi, n in spans if k == sk and lo <= t < hi), key=repr)
    assert R.rows_of(got, "id", "name") == want


def test_latest_at_or_before(spark):
    rng = random.Random(3)
    points = [(rng.choice("abc"), R.at(rng.randint(0, 200) * 900)) for _ in range(150)]
    probes = [(i, rng.choice("abcd"), R.at(rng.randint(-1000, 200000))) for i in range(400)]
    got = joins.latest_at_or_before(
        spark.createDataFrame(probes, "id int, k string, b timestamp"),
        spark.createDataFrame(points, "k string, p timestamp"),
        ["k"], "b", "p", "found",
    )
    want = []
    for i, k, b in probes:
        found = [p for pk, p in points if pk == k and p <= b]
        if found:
            want.append((i, max(found).replace(tzinfo=None)))
    assert R.rows_of(got.select("id", F.col("found").cast("timestamp_ntz"))) == sorted(want, key=repr)


def test_prefix_join_takes_prefixes_of_any_length(spark):
    long = "0123456789" * 4
    ids = spark.createDataFrame([("abcd1",), ("ABce2",), ("ab",), ("xyz",), (long,), (long + "f",), (None,)], "id string")
    texts = ["abc", "ab", "a", "x" * 40, long[:9], long[:37], long, long + "f", "", None]
    prefixes = spark.createDataFrame([(1, p) for p in texts], "n int, p string")
    got = joins.prefix_join(ids.withColumn("n", F.lit(1)), prefixes, "id", "p", ["n"])
    known = [r.id for r in ids.collect() if r.id]
    want = [(p, i) for p in texts if p for i in known if i.lower().startswith(p)]
    assert R.rows_of(got, "p", "id") == sorted(want, key=repr)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_insert_ignore_and_upsert(spark):
    target = spark.createDataFrame([("a", 1, "old", "x"), ("b", 1, "old", "x")], "k string, n int, v string, keep string")
    source = spark.createDataFrame(
        [("a", 2, None, "y"), ("c", 3, "new", "y"), ("c", 4, "newer", "z")], "k string, n int, v string, keep string"
    )
    fresh = merging.insert_ignore(source, target, {"k": F.col("k")}, [F.col("n")])
    assert R.rows_of(fresh, "k", "n") == [("c", 3)]
    merged = merging.upsert(source, target, ["k"], ["v"], [F.col("n").desc()])
    assert R.rows_of(merged, "k", "v", "keep") == [("a", None, "x"), ("b", "old", "x"), ("c", "newer", "z")]


def test_offset_slice_against_sorting(spark):
    rng = random.Random(4)
    keys = [rng.randint(0, 10**6) for _ in range(3000)] + [500000] * 400
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for offset in (0, 1, 1499, 1700, 3390, 3399, 3400):
        got = [r.k for r in sampling.offset_slice(df, "k", offset, 16, parts=8, small=50).collect()]
        assert got == sorted(keys)[offset : offset + 16], offset


def test_random_sample_is_stable_and_uniform(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    one = sorted(r.k for r in sampling.random_sample(df, "k", 100, 5).collect())
    two = sorted(r.k for r in sampling.random_sample(df.repartition(7), "k", 100, 5).collect())
    assert one == two and len(set(one)) == 100
    assert 700 < sum(one) / 100 < 1300
    assert one != sorted(r.k for r in sampling.random_sample(df, "k", 100, 6).collect())


def test_keyed_updates_stay_in_their_ranges(spark):
    df = spark.createDataFrame(
        [(i, R.at(0).replace(tzinfo=None), "old", 100, 200.0) for i in range(200)], "k int, ts timestamp_ntz, status string, seats bigint, price double"
    )
    keys = spark.range(0, 200, 2).selectExpr("cast(id as int) as k")
    draw = sampling.keyed_draw("k", 3)
    out = sampling.update_keyed(
        df, keys, "k",
        {
            "ts": sampling.shifted_minutes(F.col("ts"), draw),
            "status": sampling.picked_status(("on_time", "delayed", "cancelled"), draw, 2),
            "seats": sampling.scaled_seats(F.col("seats"), draw, 3),
            "price": sampling.scaled_price(F.col("price"), draw, 4),
        },
    )
    assert out.columns == df.columns
    rows = out.collect()
    assert len(rows) == 200
    base = R.at(0).replace(tzinfo=None)
    shifts = set()
    for r in rows:
        if r.k % 2:
            assert (r.ts, r.status, r.seats, r.price) == (base, "old", 100, 200.0)
        else:
            shift = (r.ts - base) / timedelta(minutes=1)
            assert shift == int(shift) and 5 <= abs(shift) <= 60
            shifts.add(shift > 0)
            assert r.status in ("on_time", "delayed", "cancelled")
            assert 97 <= r.seats <= 108 and 190 <= r.price <= 210
    assert shifts == {True, False}
    assert {r.status for r in rows if r.k % 2 == 0} == {"on_time", "delayed", "cancelled"}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 20)), min_size=1, max_size=30))
def test_percentile_property(spark, data):
    got = ranking.exact_percentiles(spark.createDataFrame(data, "g string, v bigint"), ["g"], "v", (1, 50, 100), coarse=4)
    for r in got.collect():
        values = sorted(v for g, v in data if g == r.g)
        for p in (1, 50, 100):
            assert r[f"p{p}"] == values[max(1, math.ceil(len(values) * p / 100)) - 1]


def test_a_short_prefix_meets_its_matches_only(spark):
    """Two characters among long ones: the join's output is the matches, and the ids are scanned once."""
    ids = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit(1).alias("n"))
    texts = [r.id for r in ids.limit(50).collect()]
    prefixes = [t[:8] for t in texts] + [texts[0][:2], "zz", "", texts[1]]
    probes = spark.createDataFrame([(1, p) for p in prefixes], "n int, p string")
    all_ids = [r.id for r in ids.collect()]
    want = sorted((i, p) for i in all_ids for p in prefixes if p and i.startswith(p))
    got = joins.prefix_join(ids, probes, "id", "p", ["n"])
    assert sorted((r.id, r.p) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # the generator is over 3 lengths, whatever the number of prefixes; no residual filter follows the join
    assert plan.count("Range (0, 4000") == 1 and "StartsWith" not in plan
