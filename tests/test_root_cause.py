import json

from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.plans import root_cause as rc
from runlens.sources.store import Store
from tests import rows as R

TXN, STMT1, STMT2 = "1c0d24389254fc7a", "2ab0c15b7b14e792", "67a10dfb99638ead"
RUN = "load_test"
MESSAGE = (
    "Error occurred: restart transaction: TransactionRetryWithProtoRefreshError: WriteTooOldError: write for key "
    '/Table/107/1/"\\x05\\xa6"/0 at timestamp 1771539694.711113000,0 too old; must write at or above '
    '1771539694.715943000,1: "sql txn" meta={id=103453f8 key=/Table/107/1/"\\x05"/0 iso=Serializable '
    "ts=1771539694.715943000,1 seq=1} lock=true stat=PENDING"
)


def conflict(prefix, key, seconds, kind="WriteTooOldError"):
    escaped = key.replace("\\", "\\\\").replace('"', '\\"')
    ts = f"{R.T0.timestamp() + seconds:.6f}000"
    return (
        f"TransactionRetryWithProtoRefreshError: {kind}: conflicting txn: meta={{id=ffff key={escaped} ts={ts},1}} "
        f'"sql txn" meta={{id={prefix} seq=1}}'
    )


def parsed_one(spark, text):
    df = spark.createDataFrame([(1, text, RUN, None, None, "same_app")], S.EXCEPTIONS)
    r = rc.parse_exceptions(df, "timestamp_ntz").first()
    return r.retry_error_type, r.contention_key, r.conflict_ts, r.txn_id_prefix


def test_parse(spark):
    assert parsed_one(spark, MESSAGE) == ("WriteTooOldError", None, None, "103453f8")
    text = conflict("ABCD12", '/T/"a\\b"/0', 1.5)
    assert parsed_one(spark, text) == ("WriteTooOldError", '/T/"a\\b"/0', R.at(1.5).replace(tzinfo=None), "abcd12")
    assert parsed_one(spark, 'x \\"sql txn\\" meta={id=0f key=1}')[3] == "0f"
    assert parsed_one(spark, "nothing here") == (None, None, None, None)
    assert parsed_one(spark, None) == (None, None, None, None)


def world(spark, **over):
    meta = lambda q, s: json.dumps({"db": "schedules", "query": q, "querySummary": s, "fullScan": True})
    base = {
        "contention": R.contention(spark, [], run=True),
        "insights": R.insights(
            spark,
            [dict(test_run=RUN, txn_id="103453f8-0000", txn_fingerprint_id=TXN, stmt_fingerprint_id=STMT2, status="Failed",
                  last_error_redactable="WriteTooOldError: x", app_name="Transactions", database_name="schedules", start_time=R.at(100))],
            run=True,
        ),
        "txn_id_map": spark.createDataFrame([(RUN, "103453f8-0000", TXN)], "test_run string, txn_id string, txn_fingerprint_id string"),
        "txn_stats": R.txn_stats(
            spark, [dict(test_run=RUN, fingerprint_id=TXN, app_name="Transactions", metadata=json.dumps({"stmtFingerprintIDs": [STMT1, STMT2]}))], run=True
        ),
        "stmt_stats": R.stmt_stats(
            spark,
            [
                dict(test_run=RUN, fingerprint_id=STMT1, transaction_fingerprint_id=TXN, app_name="Transactions", metadata=meta("SELECT * FROM airports WHERE city = _", "SELECT * FROM airports")),
                dict(test_run=RUN, fingerprint_id=STMT2, transaction_fingerprint_id=TXN, app_name="Transactions", metadata=meta("UPDATE airports SET country = _ WHERE city = _", "UPDATE airports SET country = _")),
                dict(test_run=RUN, fingerprint_id=STMT2, transaction_fingerprint_id=TXN, app_name="Transactions", aggregated_ts=R.at(1), metadata="{}"),
            ],
            run=True,
        ),
    }
    return {**base, **over}


def test_waiting_transaction_with_failed_second_statement(spark):
    out = rc.inspect_one(spark, MESSAGE, RUN, world(spark), "Transactions", "public")
    assert tuple(out.columns) == rc.RESULT_COLUMNS and len(out.columns) == 23
    rows = out.collect()
    assert [(r.ord, r.role, r.status, r.database_name, r.schema_name, r.table_name, r.contention) for r in rows] == [
        (1, "waiting", None, None, None, None, False),
        (2, "waiting", "failed", "schedules", "public", None, False),
    ]
    assert rows[1].collection_ts == R.at(100).replace(tzinfo=None)
    rep = rc.report(out).collect()
    assert len(rep[0]) == 17
    assert [r.sql_statement for r in rep] == ["SELECT * FROM airports WHERE city = _", "UPDATE airports SET country = _ WHERE city = _"]
    assert [r.fullscan for r in rep] == [True, True] and rep[1].txn_fingerprint_id == TXN


def stage_of(spark, tables, text, app=None, schema=None, option="same_app"):
    df = spark.createDataFrame([(1, text, RUN, app, schema, option)], S.EXCEPTIONS)
    parsed = rc.parse_exceptions(df)
    got = rc.failed_statements(parsed, tables["contention"], tables["insights"], tables["txn_id_map"]).collect()
    return (got[0].stage, got[0]) if got else None


def test_three_stages(spark):
    t = world(spark)
    assert stage_of(spark, t, MESSAGE)[0] == 2
    assert stage_of(spark, t, MESSAGE, app="Other") is None
    other = MESSAGE.replace("WriteTooOldError", "ReadWithinUncertaintyIntervalError")
    stage, row = stage_of(spark, t, other)
    assert stage == 3 and row.stmt_fingerprint_id == STMT2 and row.blocking_txn_fingerprint_id is None
    # `_` in an error type is a wildcard of LIKE
    assert stage_of(spark, t, MESSAGE.replace("WriteTooOldError", "Write_ooOldError"))[0] == 2
    shown = world(spark, insights=t["insights"].withColumn("query", F.lit("SHOW TABLES")))
    assert stage_of(spark, shown, other) is None
    assert stage_of(spark, t, MESSAGE.replace("103453f8", "103453f9")) is None


def test_stage_one_matches_key_prefix_and_minute(spark):
    key = '/Table/1/"x"/0'
    rows = [
        dict(test_run=RUN, waiting_txn_id="103453f8-0000", contending_pretty_key=key, collection_ts=R.at(t), blocking_txn_fingerprint_id=R.fp(b),
             waiting_txn_fingerprint_id=TXN, waiting_stmt_fingerprint_id=STMT2, table_name="airports")
        for t, b in ((99.9, 1), (130, 2), (120, 3), (160, 4), (160.1, 5))
    ]
    t = world(spark, contention=R.contention(spark, rows, run=True))
    stage, row = stage_of(spark, t, conflict("103453f8", key, 100))
    assert stage == 1 and row.blocking_txn_fingerprint_id == R.fp(3) and row.app_name == "Transactions"
    assert stage_of(spark, t, conflict("103453f8", key, 160))[1].blocking_txn_fingerprint_id == R.fp(4)
    assert stage_of(spark, t, conflict("103453f8", key, 161))[0] == 2
    assert stage_of(spark, t, conflict("103453f8", key, 100), schema="private")[0] == 2
    assert stage_of(spark, t, conflict("103453f8", "/other", 100))[0] == 2
    unknown = world(spark, contention=t["contention"], insights=R.insights(spark, [], run=True))
    assert stage_of(spark, unknown, conflict("1034", key, 100), app="given")[1].app_name == "given"


def picks(spark, option, txn_rows, within=False, blocking=R.fp(1), waiting=R.fp(2)):
    failed = spark.createDataFrame(
        [(1, RUN, R.at(0), blocking, waiting, "app", option)],
        "exception_id bigint, test_run string, collection_ts timestamp, blocking_txn_fingerprint_id string, waiting_txn_fingerprint_id string, app_name string, option string",
    )
    stats = R.txn_stats(spark, [{"test_run": RUN, **r} for r in txn_rows], run=True)
    got = rc.pick_transactions(failed, stats, within)
    return R.rows_of(got.select("role", "app_name", (F.unix_micros("aggregated_ts") / 1e6 - R.T0.timestamp()).cast("int")))


def test_roles_and_application_rules(spark):
    rows = [
        dict(fingerprint_id=R.fp(f), app_name=a, aggregated_ts=R.at(t))
        for f, a, t in ((1, "app", -3600), (1, "app", 7200), (1, "app", 7201), (1, "x", 3600), (1, "y", 3600), (2, "app", -7200), (2, "x", 0), (9, "app", 0))
    ]
    assert picks(spark, "same_app", rows) == [("blocking", "app", 7200), ("waiting", "app", -7200)]
    assert picks(spark, "diff_app", rows) == [("blocking", "x", 3600), ("waiting", "app", -7200)]
    assert picks(spark, "any_app", rows) == [("blocking", "app", 7200), ("waiting", "app", -7200)]
    assert picks(spark, "unknown", rows) == [("waiting", "app", -7200)]
    assert picks(spark, "diff_app", rows, blocking=R.fp(1), waiting=R.fp(1)) == [("both", "x", 3600)]
    assert picks(spark, "same_app", rows, blocking=None) == [("waiting", "app", -7200)]


def test_newer_row_of_another_run_hides_the_pick(spark):
    rows = [dict(fingerprint_id=R.fp(2), aggregated_ts=R.at(-7200)), dict(fingerprint_id=R.fp(2), aggregated_ts=R.at(-3600), test_run="other")]
    assert picks(spark, "same_app", rows) == []
    assert picks(spark, "same_app", rows, within=True) == [("waiting", "app", -7200)]
    shared = rows + [dict(fingerprint_id=R.fp(2), aggregated_ts=R.at(-3600))]
    assert picks(spark, "same_app", shared) == [("waiting", "app", -3600)]


def test_like_wildcard_in_table_name_and_missing_summary(spark):
    key = "/k"
    event = dict(test_run=RUN, waiting_txn_id="103453f8", contending_pretty_key=key, collection_ts=R.at(0), blocking_txn_fingerprint_id=TXN,
                 waiting_txn_fingerprint_id=TXN, waiting_stmt_fingerprint_id=STMT1, table_name="air_orts")
    t = world(spark, contention=R.contention(spark, [event], run=True))
    out = rc.inspect_one(spark, conflict("103453f8", key, 0), RUN, t, "Transactions").collect()
    assert [(r.ord, r.role, r.status, r.contention) for r in out] == [(1, "both", "failed", True), (2, "both", None, True)]
    bare = t["stmt_stats"].withColumn("metadata", F.lit('{"query": "airports", "querySummary": null}'))
    out = rc.inspect_one(spark, conflict("103453f8", key, 0), RUN, {**t, "stmt_stats": bare}, "Transactions").collect()
    assert [r.contention for r in out] == [False, False]


class Kept(Store):
    def __init__(self, spark, root, tables):
        super().__init__(spark, root)
        self.given = tables

    def tables(self, now=None):
        return self.given


def test_results_per_caller(spark, tmp_path):
    store = Kept(spark, str(tmp_path), world(spark))
    for caller in ("7", "007"):
        assert [r.stmt_order for r in rc.answer_caller(store, caller, MESSAGE, RUN).collect()] == [1, 2]
        assert store.caller("caller_failed_statement", caller).count() == 1
    rc.answer_caller(store, "7", "no such error", RUN)
    assert [rc.caller_report(store, c).count() for c in ("7", "007")] == [0, 2]
    assert [store.caller("caller_failed_statement", c).count() for c in ("7", "007")] == [0, 1]


def test_scans_are_pruned_to_the_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for table, df in world(spark).items():
        store.write_batch(table, df, 0)
    plan = rc.inspect_one(spark, MESSAGE, RUN, store.tables())._jdf.queryExecution().executedPlan().toString()
    filters = [p for p in plan.split("PartitionFilters: ")[1:] if "test_run" in p.split("PushedFilters")[0]]
    stored = [p for p in filters if str(tmp_path) in plan]
    assert stored and all(RUN in p.split("PushedFilters")[0] for p in stored)
