"""From retry-error texts to the statements of the transactions involved.

Many exceptions are resolved in one job. Input columns: exception_id,
exception_str, test_run, app_name, schema_name (both optional, NULL means any)
and option (same_app, diff_app or any_app: which application the blocking
transaction may belong to).

Every step works on the distinct questions and not on the exceptions: many
exceptions ask about the same fingerprint, so the statistics are searched once
per different question and the answers are joined back by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.functions import patterns as P
from runlens.functions.values import same, statement_metadata, transaction_metadata
from runlens.operators.joins import latest_at_or_before, prefix_join
from runlens.operators.ranking import first_per_group
from runlens.session import materialise, shared_folder

CONFLICT_WINDOW_SECONDS = 60
LATEST_TXN_HOURS = 2

FAILED_COLUMNS = (
    "collection_ts",
    "blocking_txn_fingerprint_id",
    "waiting_txn_fingerprint_id",
    "database_name",
    "app_name",
    "schema_name",
    "table_name",
    "index_name",
    "contention_type",
    "stmt_fingerprint_id",
)


def parse_exceptions(exceptions: DataFrame, time_type: str = "timestamp") -> DataFrame:
    """Add retry_error_type, contention_key, conflict_ts and txn_id_prefix."""
    text = F.col("exception_str")
    return exceptions.withColumns(
        {
            "retry_error_type": P.first_group(text, P.RETRY_ERROR_TYPE),
            "contention_key": P.unescaped(P.first_group(text, P.CONFLICT_KEY)),
            "conflict_ts": P.epoch_timestamp(P.first_group(text, P.CONFLICT_TIME)).cast(time_type),
            "txn_id_prefix": F.lower(P.first_group(text, P.TXN_ID_PREFIX)),
        }
    )


# ------------------------------------------------------------------ three stages

def by_contention_event(parsed: DataFrame, contention: DataFrame, insights: DataFrame) -> DataFrame:
    """Stage 1: the earliest contention event on the same key within a minute.

    The hash join is on (run, key, id prefix), so a key on which most of the
    events collide is still spread by transaction id.
    """
    x = parsed.where(
        F.col("txn_id_prefix").isNotNull() & F.col("contention_key").isNotNull() & F.col("conflict_ts").isNotNull()
    ).select(
        "exception_id",
        "test_run",
        F.col("contention_key").alias("contending_pretty_key"),
        "txn_id_prefix",
        "conflict_ts",
        F.col("app_name").alias("in_app"),
        F.col("schema_name").alias("in_schema"),
    )
    span = F.expr(f"make_dt_interval(0, 0, 0, {CONFLICT_WINDOW_SECONDS})")
    hit = (
        prefix_join(contention, x, "waiting_txn_id", "txn_id_prefix", ["test_run", "contending_pretty_key"])
        .where(F.col("collection_ts").between(F.col("conflict_ts"), F.col("conflict_ts") + span))
        .where(F.col("in_schema").isNull() | (F.col("schema_name") == F.col("in_schema")))
    )
    first = first_per_group(
        hit, ["exception_id"], [F.col(c) for c in ("collection_ts", "waiting_txn_id", "blocking_txn_id")]
    )
    # insights of other statements do not take part
    asked = ["test_run", "txn_fingerprint_id", "stmt_fingerprint_id"]
    wanted = first.select(
        "test_run",
        F.col("waiting_txn_fingerprint_id").alias("txn_fingerprint_id"),
        F.col("waiting_stmt_fingerprint_id").alias("stmt_fingerprint_id"),
    ).distinct()
    return with_application(first, insights.join(wanted, asked, "left_semi"))


def with_application(events: DataFrame, insights: DataFrame) -> DataFrame:
    """Contention events of exceptions with the application: of the matching insights only that of the first matters."""
    asked = ["test_run", "txn_fingerprint_id", "stmt_fingerprint_id"]
    apps = first_per_group(
        insights.select(*asked, "app_name", "start_time", "stmt_id"),
        asked,
        [F.col("start_time"), F.col("stmt_id"), F.col("app_name")],
    ).select(
        "test_run",
        F.col("txn_fingerprint_id").alias("waiting_txn_fingerprint_id"),
        F.col("stmt_fingerprint_id").alias("waiting_stmt_fingerprint_id"),
        F.col("app_name").alias("insight_app"),
    )
    return events.join(
        apps, ["test_run", "waiting_txn_fingerprint_id", "waiting_stmt_fingerprint_id"], "left"
    ).select(
        "exception_id",
        "collection_ts",
        "blocking_txn_fingerprint_id",
        "waiting_txn_fingerprint_id",
        "database_name",
        F.coalesce("insight_app", "in_app").alias("app_name"),
        "schema_name",
        "table_name",
        "index_name",
        "contention_type",
        F.col("waiting_stmt_fingerprint_id").alias("stmt_fingerprint_id"),
    )


def involved_transactions(parsed: DataFrame, txn_id_map: DataFrame) -> DataFrame:
    """Fingerprints of the transactions whose id starts with the prefix, once per exception and fingerprint."""
    asked = parsed.where(F.col("txn_id_prefix").isNotNull()).select("test_run", "txn_id_prefix").distinct()
    ids = txn_id_map.select("test_run", "txn_id", "txn_fingerprint_id")
    found = prefix_join(ids, asked, "txn_id", "txn_id_prefix", ["test_run"]).drop("txn_id").distinct()
    x = parsed.select(
        "exception_id", "test_run", "txn_id_prefix", "retry_error_type", F.col("app_name").alias("in_app"), "schema_name"
    )
    return x.join(found, ["test_run", "txn_id_prefix"]).drop("txn_id_prefix")


def _answered(
    involved: DataFrame, candidates: DataFrame, asks: list[str], condition: Column, newest: bool
) -> DataFrame:
    """First candidate insight per exception, found once per distinct question.

    A question that names an application joins on it as well, so a transaction
    with most of the failures is spread over its applications; the rest is left
    to the splitting of skewed joins at run time.
    """
    q = involved.select("test_run", "txn_fingerprint_id", *asks).distinct()
    on = ["test_run", "txn_fingerprint_id"]
    named = q.where("in_app IS NOT NULL").withColumn("insight_app", F.col("in_app"))
    met = named.join(candidates, [*on, "insight_app"]).unionByName(q.where("in_app IS NULL").join(candidates, on))
    direction = F.col("start_time").desc() if newest else F.col("start_time").asc()
    tie = [F.col("stmt_fingerprint_id"), F.col("insight_app"), F.col("database_name")]
    found = first_per_group(
        met.where(condition),
        ["test_run", "txn_fingerprint_id", *asks],
        [direction, *tie],
    )
    left, right = involved.alias("l"), found.alias("r")
    match = (F.col("l.test_run") == F.col("r.test_run")) & (
        F.col("l.txn_fingerprint_id") == F.col("r.txn_fingerprint_id")
    )
    for a in asks:
        match &= F.col(f"l.{a}").eqNullSafe(F.col(f"r.{a}"))
    rows = left.join(right, match).select(
        "l.exception_id",
        "l.schema_name",
        "r.txn_fingerprint_id",
        "r.start_time",
        "r.stmt_fingerprint_id",
        "r.insight_app",
        "r.database_name",
    )
    none = F.lit(None).cast("string")
    return first_per_group(rows, ["exception_id"], [direction, F.col("txn_fingerprint_id"), *tie]).select(
        "exception_id",
        F.col("start_time").alias("collection_ts"),
        none.alias("blocking_txn_fingerprint_id"),
        F.col("txn_fingerprint_id").alias("waiting_txn_fingerprint_id"),
        "database_name",
        F.col("insight_app").alias("app_name"),
        "schema_name",
        none.alias("table_name"),
        none.alias("index_name"),
        none.alias("contention_type"),
        "stmt_fingerprint_id",
    )


def _any_or_same_app() -> Column:
    return F.col("in_app").isNull() | (F.col("insight_app") == F.col("in_app"))


def _slim_insights(insights: DataFrame) -> DataFrame:
    return insights.withColumn("insight_app", F.col("app_name"))


def by_failed_insight(involved: DataFrame, insights: DataFrame) -> DataFrame:
    """Stage 2: the earliest failed execution with the same kind of error."""
    columns = ["test_run", "txn_fingerprint_id", "insight_app", "last_error_redactable"]
    candidates = first_per_group(
        _slim_insights(insights)
        .where((F.col("status") == "Failed") & F.col("last_error_redactable").isNotNull())
        .select(*columns, "start_time", "stmt_fingerprint_id", "database_name"),
        columns,
        [F.col("start_time"), F.col("stmt_fingerprint_id"), F.col("database_name")],
    )
    pattern = F.concat(F.lit("%"), F.col("retry_error_type"), F.lit("%"))
    condition = P.like(F.col("last_error_redactable"), pattern) & _any_or_same_app()
    asked = involved.where(F.col("retry_error_type").isNotNull())
    return _answered(asked, candidates, ["retry_error_type", "in_app"], condition, newest=False)


def by_any_insight(involved: DataFrame, insights: DataFrame) -> DataFrame:
    """Stage 3: the latest execution of the transaction other than SHOW."""
    columns = ["test_run", "txn_fingerprint_id", "insight_app"]
    candidates = first_per_group(
        _slim_insights(insights)
        .where(~F.col("query").like("SHOW%"))
        .select(*columns, "start_time", "stmt_fingerprint_id", "database_name"),
        columns,
        [F.col("start_time").desc(), F.col("stmt_fingerprint_id"), F.col("database_name")],
    )
    return _answered(involved, candidates, ["in_app"], _any_or_same_app(), newest=True)


def failed_statements(
    parsed: DataFrame, contention: DataFrame, insights: DataFrame, txn_id_map: DataFrame
) -> DataFrame:
    """The failed statement of each exception, from the first stage that has one."""
    involved = involved_transactions(parsed, txn_id_map)
    insights = _as_time_of(insights, contention)
    stages = [
        by_contention_event(parsed, contention, insights),
        by_failed_insight(involved, insights),
        by_any_insight(involved, insights),
    ]
    numbered = [df.withColumn("stage", F.lit(n)) for n, df in enumerate(stages, start=1)]
    union = numbered[0].unionByName(numbered[1]).unionByName(numbered[2])
    return first_per_group(union, ["exception_id"], [F.col("stage")])


def _as_time_of(insights: DataFrame, contention: DataFrame) -> DataFrame:
    dtype = contention.schema["collection_ts"].dataType
    if insights.schema["start_time"].dataType == dtype:
        return insights
    return insights.withColumn("start_time", F.col("start_time").cast(dtype))


# ------------------------------------------------- transactions and statements

def transaction_roles(failed: DataFrame) -> DataFrame:
    """One row per exception and role, with the fingerprint and app rule to use.

    Expects ``option`` and ``test_run`` of the exception beside the failed
    statement's columns.
    """
    b, w = F.col("blocking_txn_fingerprint_id"), F.col("waiting_txn_fingerprint_id")
    role = lambda name, fp, rule: F.struct(
        F.lit(name).alias("role"), fp.alias("fingerprint_id"), rule.alias("rule")
    )
    legs = F.when(same(b, w), F.array(role("both", w, F.col("option")))).otherwise(
        F.array(role("blocking", b, F.col("option")), role("waiting", w, F.lit("same_app")))
    )
    return (
        failed.withColumn("leg", F.explode(legs))
        .select(
            "exception_id",
            "test_run",
            "collection_ts",
            F.col("app_name").alias("failed_app"),
            "leg.role",
            "leg.fingerprint_id",
            "leg.rule",
        )
        .where(F.col("fingerprint_id").isNotNull())
    )


def _app_rule(app: Column) -> Column:
    """The application rule; without a known failed application only any_app holds."""
    rule, mine = F.col("rule"), F.col("failed_app")
    return F.coalesce(
        F.when(rule == "same_app", app == mine)
        .when(rule == "diff_app", app != mine)
        .when(rule == "any_app", app.isNotNull()),
        F.lit(False),
    )


def pick_transactions(
    failed: DataFrame, txn_stats: DataFrame, within_run: bool = False, own_stats: DataFrame | None = None
) -> DataFrame:
    """The latest statistics row per exception and role.

    The row is the latest over all runs up to two hours after the failure, and
    counts only if it belongs to the exception's run: a newer row of another
    run hides it. ``within_run`` looks at the exception's run alone.
    ``own_stats`` is ``txn_stats`` cut to the runs of the exceptions.

    Exceptions that ask the same (fingerprint, rule, application, bound) are
    one question. Where any application will do, the newest stamp is looked up
    without it.
    """
    legs = transaction_roles(failed).withColumn(
        "bound", F.col("collection_ts") + F.expr(f"make_dt_interval(0, {LATEST_TXN_HOURS}, 0, 0)")
    )
    asks = ["test_run", "fingerprint_id", "rule", "failed_app", "bound"]
    questions = legs.select(*asks).where("bound IS NOT NULL").distinct()
    columns = ["test_run", "fingerprint_id", "app_name", "aggregated_ts"]
    slim = txn_stats.select(*columns).where("app_name IS NOT NULL")
    own = slim if own_stats is None else own_stats.select(*columns).where("app_name IS NOT NULL")
    if within_run:
        slim = own
    keys = [*(["test_run"] if within_run else []), "fingerprint_id"]
    known = questions.where("failed_app IS NOT NULL")

    def latest(asked: DataFrame, by: list[str]) -> DataFrame:
        return latest_at_or_before(asked, slim, by, "bound", "aggregated_ts", "aggregated_ts")

    any_app = latest(questions.where("rule = 'any_app'"), keys)
    same_app = latest(known.where("rule = 'same_app'").withColumn("app_name", F.col("failed_app")), [*keys, "app_name"])
    others = known.where("rule = 'diff_app'").join(slim.select(*keys, "app_name").distinct(), keys)
    diff_app = latest(others.where("app_name <> failed_app").select(*asks, "app_name"), [*keys, "app_name"])
    newest = diff_app.groupBy(*asks).agg(F.max("aggregated_ts").alias("aggregated_ts"))
    stamped = any_app.unionByName(same_app.select(*asks, "aggregated_ts")).unionByName(newest)
    # of the run's own rows with that stamp the first application counts
    answers = (
        stamped.join(own, ["test_run", "fingerprint_id", "aggregated_ts"])
        .where(_app_rule(F.col("app_name")))
        .groupBy(*asks, "aggregated_ts")
        .agg(F.min("app_name").alias("app_name"))
    )
    one, two = legs.alias("l"), answers.alias("a")
    match = F.col("l.failed_app").eqNullSafe(F.col("a.failed_app"))
    for c in ("test_run", "fingerprint_id", "rule", "bound"):
        match &= F.col(f"l.{c}") == F.col(f"a.{c}")
    return one.join(two, match).select(
        "l.exception_id", "l.role", "l.test_run", "l.fingerprint_id", "a.app_name", "a.aggregated_ts"
    )


TXN_KEY = ["test_run", "fingerprint_id", "app_name", "aggregated_ts"]


def statement_order(picks: DataFrame, txn_stats: DataFrame) -> DataFrame:
    """The statements of each picked transaction row, numbered from 1."""
    rows = picks.select(*TXN_KEY).distinct()
    ids = transaction_metadata()["stmtFingerprintIDs"]
    return (
        txn_stats.select(*TXN_KEY, "metadata")
        .join(rows, TXN_KEY, "left_semi")
        .select(*TXN_KEY, F.posexplode(ids).alias("pos", "stmt_hex"))
        .select(*TXN_KEY, (F.col("pos") + 1).cast("bigint").alias("ord"), F.lower("stmt_hex").alias("stmt_fingerprint_id"))
    )


def statement_versions(ordered: DataFrame, stmt_stats: DataFrame) -> DataFrame:
    """The latest statistics stamp of each statement up to its transaction's.

    Adds ``stmt_ts`` and ``plan_hash``. Statements without statistics drop out.
    """
    slim = stmt_stats.select(
        "test_run",
        F.col("transaction_fingerprint_id").alias("fingerprint_id"),
        F.col("fingerprint_id").alias("stmt_fingerprint_id"),
        "app_name",
        F.col("aggregated_ts").alias("stmt_ts"),
        "plan_hash",
    )
    keys = ["test_run", "fingerprint_id", "stmt_fingerprint_id", "app_name"]
    at = latest_at_or_before(ordered, slim, keys, "aggregated_ts", "stmt_ts", "stmt_ts")
    plans = slim.groupBy(*keys, "stmt_ts").agg(F.min("plan_hash").alias("plan_hash"))
    return at.join(plans, [*keys, "stmt_ts"])


RESULT_COLUMNS = (
    "test_run",
    "ord",
    "role",
    "status",
    "collection_ts",
    "aggregated_ts",
    "app_name",
    "database_name",
    "schema_name",
    "table_name",
    "index_name",
    "txn_metadata",
    "txn_statistics",
    "contention_type",
    "contention",
    "fingerprint_id",
    "transaction_fingerprint_id",
    "plan_hash",
    "stmt_metadata",
    "stmt_statistics",
    "sampled_plan",
    "aggregation_interval",
    "index_recommendations",
)


def inspect_contention(exceptions: DataFrame, contention: DataFrame, insights: DataFrame, txn_id_map: DataFrame,
                       txn_stats: DataFrame, stmt_stats: DataFrame, **kwargs) -> DataFrame:
    """All statements of the waiting and blocking transactions, per exception.

    ``within_run`` as in :func:`pick_transactions`; ``ordered`` sorts the result;
    ``scratch`` is a folder that all executors share (default: the session's
    ``spark.checkpoint.dir``). The names of the exceptions' test runs come to the
    driver and go into every scan as a filter on the partitions; only the search
    for the newest transaction row looks at all runs.
    """
    return _inspect(exceptions, contention, insights, txn_id_map, txn_stats, stmt_stats, **kwargs)[1]


def _inspect(
    exceptions: DataFrame,
    contention: DataFrame,
    insights: DataFrame,
    txn_id_map: DataFrame,
    txn_stats: DataFrame,
    stmt_stats: DataFrame,
    within_run: bool = False,
    ordered: bool = True,
    scratch: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    folder = scratch or shared_folder(exceptions.sparkSession)
    dtype = contention.schema["collection_ts"].dataType.simpleString()
    # Three narrow results feed several branches each and are written once: the
    # parsed arguments (the texts end here), the failed statements, the picks.
    parsed = materialise(parse_exceptions(exceptions, dtype).drop("exception_str"), "parsed", folder)
    names = [r[0] for r in parsed.select("test_run").where("test_run IS NOT NULL").distinct().collect()]
    own = lambda df: df.where(F.col("test_run").isin(names))
    contention, insights, txn_id_map, stmt_stats = (own(t) for t in (contention, insights, txn_id_map, stmt_stats))
    failed = materialise(
        with_arguments(failed_statements(parsed, contention, insights, txn_id_map), parsed), "failed", folder
    )
    picks = materialise(pick_transactions(failed, txn_stats, within_run, own(txn_stats)), "picks", folder)
    versions = statement_versions(statement_order(picks, own(txn_stats)), stmt_stats)
    result = assemble(failed, picks, versions, own(txn_stats), stmt_stats)
    if ordered:
        result = result.orderBy("exception_id", "transaction_fingerprint_id", "ord", "role")
    return failed, result


def with_arguments(failed: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Add each exception's run and app option to its failed statement."""
    return failed.join(exceptions.select("exception_id", "test_run", "option"), "exception_id")


def assemble(
    failed: DataFrame, picks: DataFrame, versions: DataFrame, txn_stats: DataFrame, stmt_stats: DataFrame
) -> DataFrame:
    """Fetch the documents by full key and mark the failed statement."""
    txn = txn_stats.join(picks.select(*TXN_KEY).distinct(), TXN_KEY, "left_semi").select(
        *TXN_KEY, F.col("metadata").alias("txn_metadata"), F.col("statistics").alias("txn_statistics")
    )
    st_key = ["test_run", "fingerprint_id", "stmt_fingerprint_id", "app_name", "stmt_ts", "plan_hash"]
    st = stmt_stats.select(
        "test_run",
        F.col("transaction_fingerprint_id").alias("fingerprint_id"),
        F.col("fingerprint_id").alias("stmt_fingerprint_id"),
        "app_name",
        F.col("aggregated_ts").alias("stmt_ts"),
        "plan_hash",
        F.col("metadata").alias("stmt_metadata"),
        F.col("statistics").alias("stmt_statistics"),
        "sampled_plan",
        "aggregation_interval",
        "index_recommendations",
    )
    documents = versions.join(st, st_key).join(txn, TXN_KEY)
    f = failed.select(
        "exception_id",
        F.col("waiting_txn_fingerprint_id").alias("f_txn"),
        F.col("stmt_fingerprint_id").alias("f_stmt"),
        *[F.col(c).alias(f"f_{c}") for c in FAILED_COLUMNS if c not in ("app_name", "stmt_fingerprint_id")],
    )
    rows = picks.join(f, "exception_id").join(documents, TXN_KEY)
    is_failed = same(F.col("fingerprint_id"), F.col("f_txn")) & same(
        F.col("stmt_fingerprint_id"), F.col("f_stmt")
    )
    shown = lambda c: F.when(is_failed, F.col(f"f_{c}")).alias(c)
    summary = statement_metadata("stmt_metadata")["querySummary"]
    touches = P.like(summary, F.concat(F.lit("%"), F.col("f_table_name"), F.lit("%")))
    return rows.select(
        "exception_id",
        "test_run",
        "ord",
        "role",
        F.when(is_failed, F.lit("failed")).alias("status"),
        shown("collection_ts"),
        "aggregated_ts",
        "app_name",
        shown("database_name"),
        shown("schema_name"),
        shown("table_name"),
        shown("index_name"),
        "txn_metadata",
        "txn_statistics",
        shown("contention_type"),
        F.coalesce(touches, F.lit(False)).alias("contention"),
        F.col("stmt_fingerprint_id").alias("fingerprint_id"),
        F.col("fingerprint_id").alias("transaction_fingerprint_id"),
        "plan_hash",
        "stmt_metadata",
        "stmt_statistics",
        "sampled_plan",
        "aggregation_interval",
        "index_recommendations",
    )


def inspect_one(spark, exception_str: str, test_run: str, tables: dict[str, DataFrame], app_name: str | None = None,
                schema_name: str | None = None, option: str = "same_app", **kwargs) -> DataFrame:
    """The one-message form: the 23 result columns, ordered by transaction and statement."""
    return inspect_parts(spark, exception_str, test_run, tables, app_name, schema_name, option, **kwargs)["result"]


def inspect_parts(spark, exception_str: str, test_run: str, tables: dict[str, DataFrame], app_name: str | None = None,
                  schema_name: str | None = None, option: str = "same_app", **kwargs) -> dict[str, DataFrame]:
    """``result`` and ``failed``, the statement that failed, of one message."""
    one = spark.createDataFrame([(0, exception_str, test_run, app_name, schema_name, option)], S.EXCEPTIONS)
    names = ("contention", "insights", "txn_id_map", "txn_stats", "stmt_stats")
    failed, result = _inspect(one, *(tables[n] for n in names), **kwargs)
    return {"failed": failed.select("test_run", *FAILED_COLUMNS), "result": result.select(*RESULT_COLUMNS)}


# ------------------------------------------------------------- results per caller

def report(result: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The 17 readable columns of a result; ``extra`` columns come first."""
    meta = statement_metadata("stmt_metadata")
    return result.select(
        *extra,
        "test_run",
        "collection_ts",
        "database_name",
        "schema_name",
        "table_name",
        "index_name",
        "contention_type",
        "app_name",
        F.col("transaction_fingerprint_id").alias("txn_fingerprint_id"),
        F.col("role").alias("tnx_type"),
        "contention",
        F.col("fingerprint_id").alias("stmt_fingerprint_id"),
        meta["fullScan"].alias("fullscan"),
        "index_recommendations",
        F.col("ord").alias("stmt_order"),
        "status",
        meta["query"].alias("sql_statement"),
    )


def answer_caller(store, caller_id: str, exception_str: str, test_run: str, **kwargs) -> DataFrame:
    """Resolve one message and keep result and failed statement under the caller's id; returns the report."""
    tables = store.tables()
    parts = inspect_parts(store.spark, exception_str, test_run, tables, **kwargs)
    store.write_caller("caller_failed_statement", caller_id, parts["failed"])
    store.write_caller("caller_contention_results", caller_id, parts["result"])
    return caller_report(store, caller_id)


def caller_report(store, caller_id: str) -> DataFrame:
    """The readable report of one caller's stored result; one folder is read."""
    stored = store.caller("caller_contention_results", caller_id)
    return report(stored).orderBy("test_run", "txn_fingerprint_id", "stmt_order")
