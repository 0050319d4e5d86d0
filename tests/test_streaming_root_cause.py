"""The streamed first stage against the one over tables."""

import random

from pyspark.sql import functions as F

from runlens import schemas as S
from runlens.plans import root_cause as rc
from runlens.streaming import root_cause as streamed
from tests import rows as R


def error(k: int, run: str, key: str, prefix: str, second: int, schema: str | None):
    text = (
        "restart transaction: TransactionRetryWithProtoRefreshError: WriteTooOldError: write for key too old"
        f" conflicting txn: meta={{id={prefix} key={key} iso=Serializable ts={int(R.at(second).timestamp())}.000000000,1 seq=1}}"
        f': "sql txn" meta={{id={prefix} seq=1}} lock=true'
    )
    return dict(exception_id=k, exception_str=text, test_run=run, app_name="mine" if k % 2 else None, schema_name=schema, option="any_app")


def test_streamed_stage_equals_the_batch(spark, tmp_path):
    """Files arrive in several batches, errors before and after their events; once all has passed the answers are the same."""
    rng = random.Random(4)
    events, errors = [], []
    for k in range(200):
        second, n = rng.randrange(0, 1500), rng.randrange(12)
        txn = f"{n:08x}-0000"
        events.append(dict(collection_ts=R.at(second + rng.random()), waiting_txn_id=txn, blocking_txn_id=f"b{k}", test_run=rng.choice(("r1", "r2")),
                           contending_pretty_key=f"/Table/{n % 3}", schema_name=rng.choice(("public", "archive")),
                           waiting_txn_fingerprint_id=R.fp(n), waiting_stmt_fingerprint_id=R.fp(100 + n)))
        errors.append(error(k, rng.choice(("r1", "r2")), f"/Table/{n % 3}", f"{n:08x}"[: rng.choice((8, 2))], second - rng.randrange(0, 70),
                            rng.choice((None, "public"))))
    parsed = rc.parse_exceptions(R.frame(spark, S.EXCEPTIONS, errors[:1])).first()
    assert parsed.contention_key and parsed.txn_id_prefix and parsed.conflict_ts
    insights = R.insights(
        spark,
        [{"test_run": "r1", "txn_fingerprint_id": R.fp(n), "stmt_fingerprint_id": R.fp(100 + n), "start_time": R.at(n), "app_name": f"app{n}"} for n in range(6)],
        run=True,
    )
    events.sort(key=lambda r: r["collection_ts"])
    late = [dict(events[-1], collection_ts=R.at(9000), waiting_txn_id="zz")]  # time goes on
    later = [error(999, "r3", "/Table/9", "ffffffff", 9000, None)]
    for n in range(5):
        R.contention(spark, events[40 * n : 40 * n + 40] + (late if n == 4 else []), run=True).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    for n in range(2):
        R.frame(spark, S.EXCEPTIONS, errors[n::2] + (later if n == 1 else [])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/errors")
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("events", "errors")}
    streams = {n: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}") for n, df in tables.items()}
    got = streamed.by_contention_event(streams["errors"], streams["events"], insights, "30 minutes")
    query = got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    want = rc.by_contention_event(rc.parse_exceptions(tables["errors"]), tables["events"], insights)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.columns == want.columns and want.count() > 20
    assert R.rows_of(out) == R.rows_of(want)
    assert want.where(F.col("app_name").startswith("app")).count() > 0
