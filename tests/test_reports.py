import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.functions import patterns as P
from runlens.plans import index_report, metrics, reports
from tests import rows as R


def meta(query="SELECT 1", db="db", scan=False, **kw):
    return json.dumps({"db": db, "query": query, "querySummary": query[:10], "fullScan": scan, **kw})


def test_slow_statements_filters_and_order(spark):
    stats = R.stmt_stats(
        spark,
        [
            dict(metadata=meta("fast"), statistics=R.statement_doc(cnt=1000, run=0.001, svc=0.5)),
            dict(metadata=meta("slow"), statistics=R.statement_doc(cnt=1, run=0.636424, svc=0.7)),
            dict(metadata=meta("sys", db="system"), statistics=R.statement_doc(run=9)),
            dict(metadata=meta("job"), app_name="$ internal-x", statistics=R.statement_doc(run=9)),
            dict(metadata=meta("old"), aggregated_ts=R.at(-4 * 3600), statistics=R.statement_doc(run=9)),
            dict(metadata='{"query": "no db"}', statistics='{"statistics": {"cnt": 4E+1, "runLat": {"mean": 2E-3}}}'),
            dict(metadata=meta("no stats"), statistics="{}"),
        ],
    )
    got = reports.slow_by_mean(stats, R.at(0)).collect()
    assert [(r.query, r.execs, r.mean_run_ms) for r in got] == [
        ("slow", 1, 636.42), ("no db", 40, 2.0), ("fast", 1000, 1.0), ("no stats", None, None)
    ]
    assert [r.query for r in reports.slow_by_total(stats, R.at(0), k=2).collect()] == ["fast", "slow"]
    plan = reports.slow_by_mean(stats, R.at(0))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=20" in plan


def test_full_scans(spark):
    stats = R.stmt_stats(
        spark,
        [
            dict(metadata=meta("a", scan=True), statistics=R.statement_doc(cnt=10, read=5.04), index_recommendations=["x"]),
            dict(metadata=meta("b", scan=True), statistics=R.statement_doc(cnt=100, read=1)),
            dict(metadata=meta("c"), statistics=R.statement_doc(cnt=10**6, read=5)),
        ],
    )
    got = reports.full_scans(stats, R.at(0)).collect()
    assert [(r.query, r.mean_rows_read, r.total_rows_read) for r in got] == [("b", 1.0, 100.0), ("a", 5.0, 50.0)]


def test_insight_reports(spark):
    rows = [
        dict(causes=["HighContention"], contention=timedelta(milliseconds=m) if m else None, retries=m, start_time=R.at(-m)) for m in (0, 2, 5)
    ] + [dict(status="Failed", error_code="40001"), dict(app_name="$ internal"), dict(start_time=R.at(-4 * 3600))]
    ins = R.insights(spark, rows)
    got = reports.flagged_insights(ins, R.at(0)).collect()
    assert [(r.causes, r.occurrences, r.total_contention_ms, r.max_retries) for r in got] == [(["HighContention"], 3, 7.0, 5), ([], 1, None, 0)]
    assert [r.error_code for r in reports.failed_executions(ins, R.at(0)).collect()] == ["40001"]


def test_waiting_statements_count_like_the_plain_join(spark):
    events = R.contention(spark, [dict(waiting_stmt_fingerprint_id=R.fp(f)) for f in (1, 1, 1, 2, 3)])
    stats = R.stmt_stats(spark, [dict(fingerprint_id=R.fp(f), plan_hash=R.fp(p), metadata=meta(q)) for f, p, q in ((1, 0, "b"), (1, 1, "a"), (2, 0, "c"))])
    got = reports.top_waiting(events, stats, R.at(0))
    assert R.rows_of(got) == [(R.fp(1), 6, 30.0, "a"), (R.fp(2), 1, 5.0, "c"), (R.fp(3), 1, 5.0, None)]
    once = reports.top_waiting(events, stats, R.at(0), dedupe_fingerprints=True)
    assert R.rows_of(once)[0] == (R.fp(1), 3, 15.0, "a")


def test_hot_objects_and_blockers(spark):
    events = R.contention(
        spark,
        [dict(index_name="i", contention_duration=timedelta(milliseconds=m), waiting_txn_fingerprint_id=R.fp(m % 2)) for m in (1, 2, 4)]
        + [dict(contention_duration=timedelta(milliseconds=3))],
    )
    got = reports.hot_objects(events, R.at(0)).collect()
    assert [(r.index_name, r.events, r.total_contention_ms, r.max_contention_ms) for r in got] == [("i", 3, 7.0, 4.0), ("(primary or n/a)", 1, 3.0, 3.0)]
    assert R.rows_of(reports.top_blocking(events, R.at(0))) == [(R.fp(1), 4, 10.0, 3)]


def test_failed_transactions(spark):
    stmts = R.stmt_stats(
        spark,
        [dict(transaction_fingerprint_id=R.fp(t), fingerprint_id=R.fp(s), statistics=R.statement_doc(cnt=10, fails=f)) for t, s, f in ((1, 1, 0), (2, 1, 3), (2, 2, 1), (3, 1, 20))],
    )
    txns = R.txn_stats(spark, [dict(fingerprint_id=R.fp(t)) for t in (1, 2, 3, 4)])
    got = R.rows_of(reports.failed_transactions(txns, stmts, R.at(0)), "txn_fingerprint_id", "num_stmt", "stmt_execs", "failed_stmt_execs", "failure_rate", F.col("failed_txn_ratio").cast("double"))
    assert got == [
        (R.fp(1), 2, 10, 0, "NEVER", 0.0), (R.fp(2), 2, 20, 4, "SOMETIMES", 0.4), (R.fp(3), 2, 10, 20, "ALWAYS", 2.0)
    ]


@pytest.mark.parametrize(
    "text, table, leaf",
    [
        ("INSERT INTO public.t VALUES (_)", "public.t", "t"),
        ('upsert  into "My T"(a)', '"my t"', "my t"),
        ("MERGE\nINTO a.b.c USING x", "a.b.c", "c"),
        ("UPDATE t SET a = _", "t", "t"),
        ('DELETE FROM db."S".t4 WHERE _', 'db."s".t4', "t4"),
        ("WITH x AS (SELECT 1) INSERT INTO z SELECT * FROM x", "z", "z"),
        ("SELECT 1", None, None),
    ],
)
def test_written_table(spark, text, table, leaf):
    df = spark.createDataFrame([(text,)], "q string").select(P.written_table(F.col("q")).alias("t"))
    assert tuple(df.select("t", P.leaf_name(F.col("t"))).first()) == (table, leaf)


def test_write_hotspots(spark):
    doc = R.statement_doc(cnt=4, written=2.5)
    stats = R.stmt_stats(
        spark,
        [dict(metadata=meta(q), statistics=doc, plan_hash=R.fp(i)) for i, q in enumerate(["UPDATE a SET x", "update A set x", "DELETE FROM system.x", "INSERT INTO b", "SELECT 1"])]
        + [dict(metadata=meta("UPDATE never"), statistics=R.statement_doc(written=0)), dict(metadata=json.dumps({"querySummary": "UPDATE c"}), statistics=doc)],
    )
    got = [tuple(r) for r in reports.write_hotspots(stats, R.at(0)).collect()]
    assert got == [("a", "a", 20), ("b", "b", 10), ("c", "c", 10)]


def test_index_report(spark):
    recs = ["creation : CREATE INDEX ON db1.public.t (a)", "creation : CREATE INDEX on public.t (b)", "creation : CREATE INDEX ON t (c)", "drop it"]
    stats = R.stmt_stats(
        spark,
        [
            dict(index_recommendations=recs, statistics=R.statement_doc(sampled=100, svc=0.5, read=2e6, written=1, contention=0.2), metadata=meta("q" * 300, scan=True)),
            dict(index_recommendations=recs[:1], fingerprint_id=R.fp(9), statistics=R.statement_doc(sampled=50, svc=1, contention=0.0)),
            dict(index_recommendations=recs, fingerprint_id=R.fp(8), statistics=R.statement_doc(sampled=49)),
            dict(index_recommendations=recs, aggregated_ts=R.at(-25 * 3600), statistics=R.statement_doc(sampled=99)),
            dict(index_recommendations=None, fingerprint_id=R.fp(7), statistics=R.statement_doc(sampled=99)),
        ],
    )
    tables = spark.createDataFrame([(1, "db1", "public", "t"), (2, "db1", "other", "t")], S.CATALOG_SCHEMAS["tables"])
    indexes = spark.createDataFrame([(1, 1, "pk"), (1, 2, "ia"), (2, 1, "pk2")], S.CATALOG_SCHEMAS["table_indexes"])
    usage = spark.createDataFrame([(1, 2, 7, None)], S.CATALOG_SCHEMAS["index_usage_statistics"])
    out = index_report.index_opportunities(stats, tables, indexes, usage, R.at(0)).collect()
    by = {(r.full_path, json.loads(r.existing_index_usage)[0]["index_name"]): r for r in out}
    # a bare table name matches the table in every schema
    assert set(by) == {("db1.public.t", "ia"), ("public.t", "ia"), ("t", "ia"), ("t", "pk2")}
    full = by["db1.public.t", "ia"]
    assert (full.database_name, full.schema_name, full.table_name) == ("db1", "public", "t")
    assert full.total_executions == 150 and full.total_latency_sec == 100 and full.related_fingerprints == [R.fp(3), R.fp(9)]
    assert full.weighted_avg_latency_sec == pytest.approx(100 / 150) and full.workload_profile == "READ_HEAVY" and full.involves_full_scan
    assert [len(q) for q in full.sample_queries] == [8, 200]
    assert json.loads(full.existing_index_usage) == [
        {"index_name": "ia", "index_id": 2, "total_reads": 7, "last_read": None},
        {"index_name": "pk", "index_id": 1, "total_reads": 0, "last_read": None},
    ]
    rows_read = (100 * 2e6 + 50 * 1) / 1e6
    assert float(full.impact_score) == pytest.approx(100 * 0.5 + 20 * 0.3 + rows_read * 0.1 + 20 * 0.5 * 0.1)
    assert out[0] == full


def test_horizon_capacity_and_comparison(spark):
    events = R.contention(spark, [dict(collection_ts=R.at(t)) for t in (0, 50, 90)])
    horizon = reports.data_horizon({"contention": events, "insights": R.insights(spark, [])})
    rows = {r.source: r for r in horizon.collect()}
    assert rows["transaction_contention_events"].rows == 3 and rows["transaction_contention_events"].span == timedelta(seconds=90)
    assert rows["cluster_execution_insights"].rows == 0 and rows["cluster_execution_insights"].span is None
    caps = spark.createDataFrame([("transaction_contention_events", 3)], "source string, capacity bigint")
    assert R.rows_of(reports.capacity_use(horizon, caps), "used", "evicting") == [(1.0, True)]
    stats = R.stmt_stats(
        spark,
        [
            dict(test_run="a", statistics=R.statement_doc(cnt=1, run=1.0)), dict(test_run="a", aggregated_ts=R.at(1), statistics=R.statement_doc(cnt=3, run=2.0)),
            dict(test_run="b", statistics=R.statement_doc(cnt=2, run=1.0)), dict(test_run="b", fingerprint_id=R.fp(8)), dict(test_run="c", fingerprint_id=R.fp(7)),
        ],
        run=True,
    )
    got = R.rows_of(reports.compare_runs(stats, "a", "b"), "fingerprint_id", "base_execs", "other_execs", "base_mean_run", "run_change")
    assert got == [(R.fp(3), 4, 2, 1.75, -0.75), (R.fp(8), None, 10, None, None)]
    top = reports.slow_performers(stats, "a", "app").collect()
    assert [(r.avg_ms, r.query) for r in top] == [(2000.0, "SELECT 1")]


# ------------------------------------------------------------------------ alerts

def samples(spark, rows):
    base = dict(stream="contention", test_run="r", rows=0, errors=0, duration_ms=10, lag_seconds=0.0, backfilled=0)
    return R.frame(spark, metrics.METRICS, [{**base, **r} for r in rows])


def brute(rows, rule, step, gauge, holds):
    """Evaluate a rule step by step in plain Python: {series: [start times]}."""
    series = {}
    for r in rows:
        series.setdefault(tuple(r.get(k, {"stream": "contention", "test_run": "r"}[k]) for k in rule.series), []).append(r)
    out = set()
    for key, rs in series.items():
        rs = sorted(rs, key=lambda r: r["ts"])
        sec = lambda r: (r["ts"] - R.T0).total_seconds()
        first, last = -(-sec(rs[0]) // step), -(-sec(rs[-1]) // step)
        run = was = 0
        for n in range(int(first), int(last) + 1):
            t = n * step
            window = [r[rule.value] for r in rs if t - rule.range_seconds < sec(r) <= t]
            ok = (bool(window) and window[-1] > 180) if gauge else holds(sum(window))
            run = run + 1 if ok else 0
            firing = (run - 1) * step >= rule.for_seconds if ok else False
            if firing and not was:
                out.add((*key, R.at(t).replace(tzinfo=None)))
            was = firing
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    "rule, gauge, holds",
    [
        (metrics.INGEST_ERRORS, False, lambda v: v > 0),
        (metrics.LAG_HIGH, True, None),
        (metrics.NOT_INGESTING, False, lambda v: v == 0),
        (metrics.BACKFILL_STUCK, False, lambda v: v == 0),
    ],
)
def test_alerts_against_stepwise_evaluation(spark, rule, gauge, holds):
    import random

    rng = random.Random(7)
    rows = []
    t = 0
    for _ in range(300):
        # quiet stretches cross midnight, where the evaluation is cut into days
        t += rng.choice((15, 30, 60, 400, 1500))
        burst = (t // 4000) % 3
        rows.append(dict(ts=R.at(t + rng.random()), stream=rng.choice(("contention", "insights")), test_run="r", rows=0 if burst else 5,
                         errors=1 if burst == 1 else 0, lag_seconds=200.0 if burst == 2 else 10.0, backfilled=1 if burst == 1 else 0))
    got = metrics.alerts(samples(spark, rows), rule, 15)
    # the step grid counts from the epoch; T0 is a full hour
    assert R.rows_of(got.select(*rule.series, F.col("fired_at").cast("timestamp_ntz"))) == brute(rows, rule, 15, gauge, holds)
    assert got.count() > 0


@pytest.mark.parametrize("rule", metrics.RULES)
def test_a_silent_series_generates_no_steps(spark, rule):
    """90 days without a sample: the same alerts as stepwise, from the samples alone; a missing name is a series."""
    day = 86_400
    rows = [dict(ts=R.at(t), test_run=run, rows=0, errors=1, lag_seconds=500.0, backfilled=0)
            for run in ("r", None) for t in (5, 20, 40, 900, 90 * day, 90 * day + 15)]
    m = samples(spark, rows)
    until = F.lit(R.at(91 * day))
    got = metrics.alerts(m, rule, 15, until)
    state = metrics.evaluate(m, rule, 15, until).where("firing AND NOT _before")
    steps = state.select(*rule.series, F.timestamp_micros(F.col("step") * 15_000_000).alias("fired_at"))
    want = R.rows_of(steps)
    if "test_run" in rule.series:
        named = steps.where("test_run = 'r'")
        want = R.rows_of(named) + R.rows_of(named.withColumn("test_run", F.lit(None)))
    assert R.rows_of(got.select(*rule.series, "fired_at")) == sorted(want, key=repr)
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_metric_totals(spark):
    m = samples(spark, [dict(ts=R.at(1), rows=5, duration_ms=7, backfilled=2), dict(ts=R.at(2), rows=1, errors=1, duration_ms=None)])
    assert R.rows_of(metrics.stream_totals(m)) == [("contention", 6, 1, 1, 7)]
    assert R.rows_of(metrics.backfilled_per_run(m)) == [("r", 2)]
    hist = {r.le_ms: r.batches for r in metrics.duration_histogram(m, (5, 10)).collect()}
    assert hist == {5: 0, 10: 1, None: 1}


def test_sketches_of_hours_answer_any_period(spark):
    """Merged hours are within the stated errors of the exact figures, over all hours and over some."""
    import random

    from runlens.plans import sketches

    rng = random.Random(3)
    rows = [(R.at(rng.randrange(0, 40_000)), rng.choice("ab"), int(rng.lognormvariate(5, 2)), rng.randrange(3000)) for _ in range(30_000)]
    rows += [(R.at(10), "c", None, None), (R.at(20), "d", 7, 1)]
    df = spark.createDataFrame(rows, "ts timestamp, op string, v long, user long")
    hours = sketches.hourly(df, ["op"], "ts", "v", "user").cache()
    assert hours.count() < 30
    for lo, hi in ((0, 1 << 40), (7200, 14_400)):
        some = hours.where(F.col("hour").between(F.lit(R.at(lo)), F.lit(R.at(min(hi, 86_400))) - F.expr("INTERVAL 1 SECOND")))
        for r in sketches.summary(some, ["op"]).collect():
            mine = sorted(v for ts, op, v, _ in rows if op == r.op and v is not None and R.at(lo) <= ts < R.at(min(hi, 86_400)))
            users = {u for ts, op, v, u in rows if op == r.op and u is not None and R.at(lo) <= ts < R.at(min(hi, 86_400))}
            assert r.n == len(mine) and r.max == max(mine, default=None)
            assert abs(r.members - len(users)) <= max(1, sketches.COUNT_ERROR * len(users))
            for p in (50, 90, 95, 99):
                at = r[f"p{p}"]
                if mine:
                    below, upto = sum(v < at for v in mine), sum(v <= at for v in mine)
                    assert below <= len(mine) * (p / 100 + sketches.RANK_ERROR) and upto >= len(mine) * (p / 100 - sketches.RANK_ERROR)
                else:
                    assert at is None
