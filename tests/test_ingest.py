from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import schemas as S
from runlens.plans import backfill, ingest, retention
from runlens.plans.runs import whole_run_slices
from runlens.sources import tables
from runlens.sources.store import Store
from tests import rows as R


def test_statistics_have_no_database_filter_and_runs_overlap(spark):
    slices = whole_run_slices(R.runs(spark, "a", end=3600).unionByName(R.runs(spark, "b", start=1800, end=3600, database="x")))
    live = ingest.new_contention(R.contention(spark, [{"collection_ts": R.at(t)} for t in (0, 1800, 3599, 3600)]), slices)
    assert R.rows_of(live.groupBy("test_run").count()) == [("a", 3)]
    stats = ingest.tag_with_runs(R.stmt_stats(spark, [{"aggregated_ts": R.at(t)} for t in (0, 3600, 7200, 7800)]), slices, "stmt_stats")
    # aggregates are read for 70 minutes after the end
    assert R.rows_of(stats.groupBy("test_run").count()) == [("a", 3), ("b", 2)]
    with pytest.raises(ValueError):
        ingest.tag_with_runs(stats, slices, "nonsense")


def test_insight_key_folds_a_missing_error(spark):
    tagged = R.insights(
        spark,
        [
            {"test_run": "r", "stmt_id": "1", "start_time": R.at(2)},
            {"test_run": "r", "stmt_id": "2", "start_time": R.at(1)},
            {"test_run": "r", "stmt_id": "3", "start_time": R.at(1), "last_error_redactable": "E"},
            {"test_run": "q", "stmt_id": "4"},
            {"test_run": "r", "stmt_id": "5", "status": "Failed"},
        ],
        run=True,
    )
    assert R.rows_of(ingest.new_insights(tagged, None), "stmt_id") == [("2",), ("3",), ("4",), ("5",)]
    known = R.insights(spark, [{"test_run": "r", "stmt_id": "0"}], run=True)
    assert R.rows_of(ingest.new_insights(tagged, known), "stmt_id") == [("3",), ("4",), ("5",)]


def test_backfill_replaces_placeholders_only(spark):
    target = R.contention(
        spark,
        [
            {"test_run": "r", "waiting_txn_id": "b_open", "blocking_txn_fingerprint_id": R.Z},
            {"test_run": "r", "waiting_txn_id": "both_open", "blocking_txn_fingerprint_id": R.Z, "waiting_txn_fingerprint_id": R.Z},
            {"test_run": "r", "waiting_txn_id": "good"},
            {"test_run": "r", "waiting_txn_id": "w_open", "waiting_txn_fingerprint_id": R.Z},
            {"test_run": "r", "waiting_txn_id": "old", "collection_ts": R.at(-9000), "waiting_txn_fingerprint_id": R.Z},
        ],
        run=True,
    )
    later = {"blocking_txn_fingerprint_id": R.fp(11), "waiting_txn_fingerprint_id": R.fp(12)}
    source = R.contention(
        spark,
        [
            {"waiting_txn_id": "b_open", **later},
            {"waiting_txn_id": "both_open", **later, "waiting_txn_fingerprint_id": R.Z},
            {"waiting_txn_id": "good", **later},
            {"waiting_txn_id": "w_open", **later, "blocking_txn_fingerprint_id": R.Z},
            {"waiting_txn_id": "w_open", **later, "blocking_txn_fingerprint_id": R.Z},
            {"waiting_txn_id": "old", **later, "collection_ts": R.at(-9000)},
        ],
    )
    columns = ("waiting_txn_id", "blocking_txn_fingerprint_id", "waiting_txn_fingerprint_id", "changed")
    one = backfill.backfilled(target, source, R.at(60))
    assert R.rows_of(one, *columns) == [
        ("b_open", R.fp(11), R.fp(2), True),
        ("both_open", R.fp(11), R.Z, True),
        ("good", R.fp(1), R.fp(2), False),
        ("old", R.fp(1), R.Z, False),
        ("w_open", R.fp(1), R.fp(12), True),
    ]
    both = backfill.backfilled(target, source, R.at(60), both_columns=True)
    assert R.rows_of(both, *columns) == [
        ("b_open", R.fp(11), R.fp(12), True),
        ("both_open", R.fp(11), R.Z, True),
        ("good", R.fp(1), R.fp(2), False),
        ("old", R.fp(1), R.Z, False),
        ("w_open", R.Z, R.fp(12), True),
    ]
    assert R.rows_of(backfill.backfilled_rows(one)) == [("r", 3)]
    assert backfill.backfill_candidates(source, R.at(60)).count() == 5


def test_normalised_recommendations(spark):
    row = [(["a", None], [{"x": 1}], 5, None)]
    df = spark.createDataFrame(row, "texts array<string>, docs array<struct<x:int>>, one int, none array<string>")
    got = df.select(*[ingest.normalised_recommendations(f.name, f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert tuple(got) == (["a", None], ['{"x":1}'], ["5"], None)
    assert df.select(ingest.normalised_recommendations("one", T.IntegerType())).schema.fields[0].dataType == T.ArrayType(T.StringType(), True)


def test_counts_and_summary(spark):
    registry = R.runs(spark, "a", "b")
    events = R.contention(spark, [{"test_run": "a"}, {"test_run": "a", "collection_ts": R.at(3600)}], run=True)
    counts = ingest.load_counts({"contention": events}, whole_run_slices(registry))
    assert R.rows_of(counts) == [("a", "contention", 1)]
    summary = ingest.load_summary(counts, registry)
    assert R.rows_of(summary) == [("a", 1, 0, 0, 0), ("b", 0, 0, 0, 0)]
    assert ingest.summary_json(summary).first()[0] == '{"test_run":"a","contention":1,"insights":0,"statements":0,"transactions":0}'
    with_time = ingest.load_summary(counts, registry, F.lit("now"))
    assert with_time.columns[:2] == ["test_run", "run_time"]


def test_retention_and_integrity(spark):
    events = R.contention(spark, [{"test_run": "a", "collection_ts": R.at(-86400 * d)} for d in (0, 89, 90, 91)], run=True)
    assert retention.unexpired(events, "contention", R.at(0)).count() == 2
    assert retention.unexpired(events, "txn_id_map", R.at(0)) is events
    tables_ = {"runs": R.runs(spark, "a", "b"), "contention": events, "ingest_state": spark.createDataFrame([("a", "contention", R.at(0), R.at(0))], S.INGEST_STATE)}
    left = retention.without_runs(tables_, R.runs(spark, "a"))
    assert {k: d.count() for k, d in left.items()} == {"runs": 1, "contention": 0, "ingest_state": 1}
    assert retention.orphans(events, R.runs(spark, "b")).count() == 4
    double = R.insights(spark, [{"test_run": "a"}, {"test_run": "a"}, {"test_run": "b"}], run=True)
    assert R.rows_of(retention.duplicate_keys(double, "insights"), "test_run", "last_error_redactable", "rows") == [("a", "<<NULL>>", 2)]
    nulls = retention.null_counts(R.contention(spark, [{}, {"table_name": None}]), retention.required_columns("contention"))
    assert {r[0]: r[1] for r in nulls.collect() if r[1]} == {"contending_key": 2, "table_name": 1}
    assert "index_name" not in retention.required_columns("contention")
    assert set(retention.empty_tables(spark)) == {"runs", "ingest_state", *S.ALL_STREAMS, "txn_id_map"}


def test_sources_read_by_name_with_bytes_or_text(spark, tmp_path):
    df = R.contention(spark, [{"collection_ts": R.at(t), "database_name": d} for t, d in ((0, "db"), (10, "db"), (5, "no"))])
    shuffled = tables.binary_fingerprints(df, "contention").select(*reversed(df.columns))
    shuffled.write.parquet(f"{tmp_path}/c")
    got = tables.read_stream_table(spark, "contention", f"{tmp_path}/c", R.at(0), R.at(10), "db")
    assert got.columns == S.CONTENTION.names
    assert R.rows_of(got, "blocking_txn_fingerprint_id", "contention_duration") == [(R.fp(1), timedelta(milliseconds=5))]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(collection_ts" in plan and "EqualTo(database_name,db)" in plan
    R.insights(spark, [{}, {"query": "SELECT _"}]).transform(lambda d: tables.binary_fingerprints(d, "insights")).write.parquet(f"{tmp_path}/i")
    assert tables.read_stream_table(spark, "insights", f"{tmp_path}/i").count() == 1
    with pytest.raises(ValueError):
        tables.read_stream_table(spark, "nonsense", f"{tmp_path}/i")
    est = spark.createDataFrame([("flights", 10)], S.CATALOG_SCHEMAS["table_row_statistics"])
    assert tables.row_estimate(est, "flights") == 10 and tables.row_estimate(est, "x") is None


def test_jdbc_options(monkeypatch):
    parts = tables.jdbc_options("t", host="h", database="d", user="u", time_column="ts", lower=R.at(0), upper=R.at(9), partitions=4)
    assert parts["url"] == "jdbc:postgresql://h:26257/d" and parts["partitionColumn"] == "ts" and parts["numPartitions"] == "4"
    monkeypatch.setenv("DATABASE_URL", "postgresql://h/d")
    assert tables.jdbc_options("t")["url"] == "jdbc:postgresql://h/d"
    monkeypatch.delenv("DATABASE_URL")
    with pytest.raises(ValueError):
        tables.jdbc_options("t")


def test_store_registry_expiry_and_reset(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    assert store.register(R.runs(spark, "run one/1", "b")).count() == 0
    assert R.rows_of(store.register(R.runs(spark, "b")), "test_run") == [("b",)]
    for n, day in enumerate((0, 100)):
        store.write_batch("contention", R.contention(spark, [{"test_run": "run one/1", "collection_ts": R.at(-86400 * day)}], run=True), n)
    assert store.read("contention").count() == 2
    assert store.expire(R.at(0)) == 1
    assert R.rows_of(store.read("contention", True), "test_run", "batch_id") == [("run one/1", 0)]
    store.delete_run("run one/1")
    assert store.read("contention").count() == 0 and R.rows_of(store.runs(), "test_run") == [("b",)]
    store.reset()
    assert store.runs().count() == 0
