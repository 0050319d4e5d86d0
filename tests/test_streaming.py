from datetime import timedelta

import pytest

from runlens.sources.store import Store
from runlens.sources.tables import binary_fingerprints, read_stream_table, stream_table
from runlens.streaming.ingest import Ingest
from tests import rows as R


def landed(tmp_path, df, stream, part):
    """Write one file of a source folder."""
    path = f"{tmp_path}/{stream}"
    binary_fingerprints(df, stream).coalesce(1).write.mode("append").parquet(path)
    return path


def ingest_at(spark, store, registry, seconds, **kw):
    return Ingest(store, lambda: registry, clock=lambda: R.at(seconds), **kw)


def content(store, table):
    return R.rows_of(store.read(table).drop("contention_duration", "aggregation_interval", "contention"))


def test_stream_equals_batch_and_rerun_changes_nothing(spark, tmp_path):
    registry = R.runs(spark, "r1", "r2", end=600)
    events = [
        {"collection_ts": R.at(t), "waiting_txn_id": f"w{t}", "database_name": "db" if t % 3 else "elsewhere"}
        for t in range(-5, 700, 7)
    ]
    path = landed(tmp_path, R.contention(spark, events), "contention", 0)
    streamed, batched, sliced = (Store(spark, f"{tmp_path}/{n}") for n in ("streamed", "batched", "sliced"))
    job = ingest_at(spark, streamed, registry, 5000)
    for _ in range(2):  # availableNow twice = once
        q = job.start("contention", stream_table(spark, "contention", path), f"{tmp_path}/cp", every=None)
        q.awaitTermination()
    ingest_at(spark, batched, registry, 5000).run_once("contention", read_stream_table(spark, "contention", path))
    for now in (100, 250, 300, 5000, 5001):
        ingest_at(spark, sliced, registry, now).run_once("contention", read_stream_table(spark, "contention", path))
    want = content(batched, "contention")
    assert len(want) == 2 * len([e for e in events if R.at(0) <= e["collection_ts"] < R.at(600) and e["database_name"] == "db"])
    assert content(streamed, "contention") == want
    assert content(sliced, "contention") == want


def test_future_rows_wait_and_late_rows_are_never_read(spark, tmp_path):
    registry = R.runs(spark, "r1", end=600)
    store = Store(spark, f"{tmp_path}/store")
    cp = f"{tmp_path}/cp"
    first = [{"collection_ts": R.at(t), "waiting_txn_id": f"w{t}"} for t in (10, 20, 400)]
    path = landed(tmp_path, R.contention(spark, first), "contention", 0)

    def run(now):
        q = ingest_at(spark, store, registry, now).start("contention", stream_table(spark, "contention", path), cp, every=None)
        q.awaitTermination()
        return [r[0] for r in R.rows_of(store.read("contention"), "waiting_txn_id")]

    assert run(105) == ["w10", "w20"]
    late = [{"collection_ts": R.at(t), "waiting_txn_id": f"w{t}"} for t in (50, 99, 100, 101)]
    landed(tmp_path, R.contention(spark, late), "contention", 1)
    # 50 and 99 are behind the watermark of 100; 400 was kept and is due now
    assert run(1000) == ["w10", "w100", "w101", "w20", "w400"]


def test_replayed_batch_keeps_its_slices(spark, tmp_path):
    registry = R.runs(spark, "r1", end=600)
    store = Store(spark, f"{tmp_path}/store")
    src = R.contention(spark, [{"collection_ts": R.at(t), "waiting_txn_id": f"w{t}"} for t in (10, 200)])
    ingest_at(spark, store, registry, 105).process("contention", src, 0, keep=True)
    # the same batch again, later: same rows, nothing twice, the later row still waits
    ingest_at(spark, store, registry, 900).process("contention", src, 0, keep=True)
    assert R.rows_of(store.read("contention"), "waiting_txn_id") == [("w10",)]
    ingest_at(spark, store, registry, 900).process("contention", src.limit(0), 1, keep=True)
    assert R.rows_of(store.read("contention"), "waiting_txn_id") == [("w10",), ("w200",)]
    assert store.last_batch("contention") == 1


def test_insights_first_wins_across_batches(spark, tmp_path):
    registry = R.runs(spark, "r1", end=600)
    store = Store(spark, f"{tmp_path}/store")
    src = R.insights(
        spark,
        [
            {"start_time": R.at(5), "stmt_id": "a", "txn_id": "t1"},
            {"start_time": R.at(3), "stmt_id": "b", "txn_id": "t2"},
            {"start_time": R.at(4), "stmt_id": "c", "txn_id": "t3", "query": "SELECT _"},
            {"start_time": R.at(200), "stmt_id": "d", "txn_id": "t2"},
            {"start_time": R.at(201), "stmt_id": "e", "txn_id": "t4", "last_error_redactable": "E"},
        ],
    )
    ingest_at(spark, store, registry, 105).run_once("insights", src)
    assert R.rows_of(store.read("insights"), "stmt_id") == [("b",)]
    ingest_at(spark, store, registry, 900).run_once("insights", src)
    assert R.rows_of(store.read("insights"), "stmt_id") == [("b",), ("e",)]
    assert R.rows_of(store.read("txn_id_map"), "txn_id") == [("t1",), ("t2",), ("t4",)]


def test_statistics_upsert_in_store(spark, tmp_path):
    registry = R.runs(spark, "r1", "r2", end=600)
    store = Store(spark, f"{tmp_path}/store")
    old = R.stmt_stats(spark, [{"metadata": "{}", "aggregation_interval": timedelta(minutes=10)}, {"app_name": "other"}])
    job = ingest_at(spark, store, registry, 900)
    job.run_once("stmt_stats", old)
    new = R.stmt_stats(spark, [{"metadata": '{"query": "new"}', "sampled_plan": "p"}, {"plan_hash": R.fp(9)}])
    later = ingest_at(spark, store, registry, 1900, agg_mode="hour_aligned")
    for _ in range(2):  # a replay changes nothing
        later.process("stmt_stats", new, 1, keep=False)
        for run in ("r1", "r2"):
            got = R.rows_of(store.read("stmt_stats", runs=[run]), "app_name", "plan_hash", "metadata", "sampled_plan", "aggregation_interval")
            assert [(a, p, s, i) for a, p, m, s, i in got] == [
                ("app", R.fp(0), "p", timedelta(minutes=10)),
                ("app", R.fp(9), None, timedelta(hours=1)),
                ("other", R.fp(0), None, timedelta(hours=1)),
            ]
            assert got[0][2] == '{"query": "new"}'
    assert store.last_batch("stmt_stats") == 1


def test_backfill_in_stream_and_metrics(spark, tmp_path):
    registry = R.runs(spark, "r1", end=600)
    store = Store(spark, f"{tmp_path}/store")
    src = R.contention(
        spark,
        [
            {"collection_ts": R.at(10), "waiting_txn_id": "w1", "blocking_txn_fingerprint_id": R.Z},
            {"collection_ts": R.at(20), "waiting_txn_id": "w2", "waiting_txn_fingerprint_id": R.Z},
            {"collection_ts": R.at(30), "waiting_txn_id": "w3"},
        ],
    )
    fresh = R.contention(spark, [{"collection_ts": R.at(10), "waiting_txn_id": "w1", "blocking_txn_fingerprint_id": R.fp(77)}])
    job = ingest_at(spark, store, registry, 900, backfill_every=1)
    job.run_once("contention", src, backfill_source=lambda: fresh)
    got = R.rows_of(store.read("contention"), "waiting_txn_id", "blocking_txn_fingerprint_id", "waiting_txn_fingerprint_id")
    assert got == [("w1", R.fp(77), R.fp(2)), ("w2", R.fp(1), R.Z), ("w3", R.fp(1), R.fp(2))]
    m = store.metrics().collect()
    assert [(r.stream, r.test_run, r.rows, r.errors, r.backfilled, r.lag_seconds) for r in m] == [
        ("contention", "r1", 3, 0, 1, 300.0)
    ]


def test_failed_batch_is_counted_and_raised(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")

    def broken():
        raise RuntimeError("registry is gone")

    job = Ingest(store, broken, clock=lambda: R.at(900))
    with pytest.raises(RuntimeError):
        job.run_once("contention", R.contention(spark, [{}]))
    assert [(r.stream, r.errors) for r in store.metrics().collect()] == [("contention", 1)]
    assert store.state().count() == 0
    with pytest.raises(ValueError):
        job.run_once("nonsense", R.contention(spark, [{}]))


def test_all_streams_and_delete_run(spark, tmp_path):
    registry = R.runs(spark, "r1", "r2", end=600)
    store = Store(spark, f"{tmp_path}/store")
    job = ingest_at(spark, store, registry, 900)
    job.run_once("contention", R.contention(spark, [{}]))
    job.run_once("insights", R.insights(spark, [{}]))
    job.run_once("stmt_stats", R.stmt_stats(spark, [{}]))
    job.run_once("txn_stats", R.txn_stats(spark, [{}]))
    assert {t: d.count() for t, d in store.tables().items()} == {
        "contention": 2, "insights": 2, "stmt_stats": 2, "txn_stats": 2, "txn_id_map": 2,
    }
    marks = {(r.test_run, r.stream): r.watermark_ts for r in store.state().collect()}
    assert len(marks) == 8
    store.delete_run("r1")
    assert all(d.where("test_run = 'r1'").count() == 0 and d.count() == 1 for d in store.tables().values())


def test_hour_aligned_statistics_take_refreshed_buckets(spark, tmp_path):
    registry = R.runs(spark, "r1", start=600, end=7200)
    versions = [R.stmt_stats(spark, [{"metadata": m}, {"aggregated_ts": R.at(3600), "metadata": m}]) for m in ('{"query": "1"}', '{"query": "2"}')]
    got = {}
    for mode in ("slice", "hour_aligned"):
        store = Store(spark, f"{tmp_path}/{mode}")
        for now, source in zip((2000, 3000), versions):
            ingest_at(spark, store, registry, now, agg_mode=mode).run_once("stmt_stats", source)
        got[mode] = R.rows_of(store.read("stmt_stats"), "metadata")
    # the bucket that began before the run is outside every plain slice
    assert got == {"slice": [], "hour_aligned": [('{"query": "2"}',)]}
    with pytest.raises(ValueError):
        ingest_at(spark, store, registry, 1, agg_mode="nonsense")


class Failing(Store):
    """A store that fails once, at its n-th write of a batch."""

    def __init__(self, spark, root, fails_at):
        super().__init__(spark, root)
        self.left = fails_at

    def _count(self, write, *args, **kw):
        self.left -= 1
        if self.left == 0:
            raise OSError("disk is gone")
        return write(*args, **kw)

    def write(self, *args):
        return self._count(super().write, *args)

    def hold(self, *args):
        return self._count(super().hold, *args)

    def change(self, *args, **kw):
        return self._count(super().change, *args, **kw)


@pytest.mark.parametrize("fails_at", [1, 2, 3, 4, 5, 6, 7, 8, 9])
def test_a_failed_batch_loses_and_repeats_nothing(spark, tmp_path, fails_at):
    registry = R.runs(spark, "r1", end=600)
    store = Failing(spark, f"{tmp_path}/store", fails_at)
    src = R.insights(spark, [{"start_time": R.at(t), "txn_id": f"t{t}", "stmt_fingerprint_id": R.fp(t)} for t in (5, 6, 7)])
    with pytest.raises(OSError):
        ingest_at(spark, store, registry, 105).run_once("insights", src)
    assert store.state().count() == 0 and store.read("insights").count() == 0 and store.read("txn_id_map").count() == 0
    assert ingest_at(spark, store, registry, 905).run_once("insights", src) == 0
    assert ingest_at(spark, store, registry, 905).run_once("insights", src) == 1
    assert R.rows_of(store.read("insights"), "txn_id") == [("t5",), ("t6",), ("t7",)]
    assert R.rows_of(store.read("txn_id_map"), "txn_id") == [("t5",), ("t6",), ("t7",)]


@pytest.mark.parametrize("fails_at", [1, 2, 3])
def test_a_failed_stream_loses_and_repeats_nothing(spark, tmp_path, fails_at):
    registry = R.runs(spark, "r1", end=600)
    store = Failing(spark, f"{tmp_path}/store", fails_at)
    path = landed(tmp_path, R.contention(spark, [{"collection_ts": R.at(t), "waiting_txn_id": f"w{t}"} for t in (10, 20, 400)]), "contention", 0)
    source = lambda: stream_table(spark, "contention", path)
    with pytest.raises(Exception, match="disk is gone"):
        ingest_at(spark, store, registry, 105).start("contention", source(), f"{tmp_path}/cp", every=None).awaitTermination()
    for now in (905, 906):
        ingest_at(spark, store, registry, now).start("contention", source(), f"{tmp_path}/cp", every=None).awaitTermination()
    ingest_at(spark, store, registry, 905).process("contention", R.contention(spark, []), 1, keep=True)
    assert R.rows_of(store.read("contention"), "waiting_txn_id") == [("w10",), ("w20",), ("w400",)]


@pytest.mark.parametrize("fails_at", [1, 2, 3])
def test_versions_of_a_bucket_in_one_batch(spark, tmp_path, fails_at):
    """The newest version wins, also over what is stored, and keys stay unique."""
    registry = R.runs(spark, "r1", end=7200)
    store = Failing(spark, f"{tmp_path}/store", 99)
    versions = [{"statistics": R.statement_doc(cnt=n), "aggregated_ts": R.at(t)} for t in (1, 2) for n in (7, 70, 9)]
    ingest_at(spark, store, registry, 905).run_once("stmt_stats", R.stmt_stats(spark, versions[:3]))
    store.left = fails_at
    job = ingest_at(spark, store, registry, 7200, agg_mode="hour_aligned")
    later = R.stmt_stats(spark, [*versions, {"statistics": R.statement_doc(cnt=71), "aggregated_ts": R.at(1)}])
    with pytest.raises(OSError):
        job.run_once("stmt_stats", later)
    job.run_once("stmt_stats", later)
    got = R.rows_of(store.read("stmt_stats").selectExpr("aggregated_ts", "get_json_object(statistics, '$.statistics.cnt') as cnt"), "cnt")
    assert got == [("70",), ("71",)]
    counted = [r.rows for r in store.metrics().collect() if not r.errors]
    assert sorted(counted) == [1, 2]


def test_idle_batches_leave_zero_rows(spark, tmp_path):
    registry = R.runs(spark, "r1", end=600)
    store = Store(spark, f"{tmp_path}/store")
    src = R.contention(spark, [{"collection_ts": R.at(10)}])
    for now in (105, 105, 105):
        ingest_at(spark, store, registry, now).run_once("contention", src)
    assert sorted((r.test_run, r.rows, r.lag_seconds) for r in store.metrics().collect()) == [("r1", 0, 5.0), ("r1", 0, 5.0), ("r1", 1, 5.0)]


def test_a_run_registered_late_is_read_from_its_start(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    path = landed(tmp_path, R.contention(spark, [{"collection_ts": R.at(t), "waiting_txn_id": f"w{t}"} for t in (10, 20, 400)]), "contention", 0)
    early, both = R.runs(spark, "r1", end=600), R.runs(spark, "r1", "r2", end=600)

    def run(registry, now, cp, **kw):
        q = ingest_at(spark, store, registry, now).start(
            "contention", stream_table(spark, "contention", path), f"{tmp_path}/{cp}", every=None, **kw
        )
        q.awaitTermination()

    run(early, 105, "cp")
    landed(tmp_path, R.contention(spark, [{"collection_ts": R.at(500), "waiting_txn_id": "w500"}]), "contention", 1)
    with pytest.raises(Exception, match="registered after"):
        run(both, 905, "cp")
    run(both, 905, "cp", replay_source=lambda: read_stream_table(spark, "contention", path))
    got = R.rows_of(store.read("contention"), "test_run", "waiting_txn_id")
    assert got == [(r, w) for r in ("r1", "r2") for w in ("w10", "w20", "w400", "w500")]


def test_retention_reaches_every_table(spark, tmp_path):
    registry = R.runs(spark, "old", end=600)
    store = Store(spark, f"{tmp_path}/store")
    store.register(registry.unionByName(R.runs(spark, "new", start=86400 * 60, end=86400 * 60 + 600)))
    ingest_at(spark, store, registry, 905).run_once("contention", R.contention(spark, [{}]))
    for caller in ("7", "007"):
        store.write_caller("caller_contention_results", caller, R.txn_stats(spark, [{"test_run": "old"}, {"test_run": "new", "aggregated_ts": R.at(86400 * 60)}], run=True))
        store.write_caller("caller_failed_statement", caller, R.contention(spark, [{}]))
    store.delete_run("new")
    assert [store.caller("caller_contention_results", c).count() for c in ("7", "007")] == [1, 1]
    later = R.at(86400 * 91)
    assert store.tables(later)["contention"].count() == 0
    assert store.expire(later) == 1
    assert store.runs().count() == 0 and store.state().count() == 0 and store.read("contention").count() == 0
    assert all(store.caller(t, c).count() == 0 for t in ("caller_contention_results", "caller_failed_statement") for c in ("7", "007"))


def test_compaction_bounds_the_folders_and_keeps_the_rows(spark, tmp_path):
    registry = R.runs(spark, "r1", "r2", end=3600)
    store = Store(spark, f"{tmp_path}/store")
    src = R.contention(spark, [{"collection_ts": R.at(t), "waiting_txn_id": f"w{t}"} for t in range(0, 120, 10)])
    for n in range(8):
        ingest_at(spark, store, registry, 20 + 15 * n).run_once("contention", src)
    numbers = lambda: sorted(p.number for p in store.commits.latest("contention").of("contention", ["r1"]))
    before, was = R.rows_of(store.read("contention"), "test_run", "waiting_txn_id"), len(numbers())
    assert store.compact("contention", batches=3) > 0 and store.compact("contention", batches=3) == 0
    assert R.rows_of(store.read("contention"), "test_run", "waiting_txn_id") == before
    assert numbers() == [0, 3, 6, 7] and was == 8
    ingest_at(spark, store, registry, 4000).run_once("contention", src)
    assert len(R.rows_of(store.read("contention"))) == 24


def test_statistics_are_typed_when_they_are_written(spark, tmp_path):
    """Reports over the typed columns equal those over the documents and read no JSON; upserts keep them in step."""
    from runlens.plans import reports

    registry = R.runs(spark, "r1", end=7200)
    store = Store(spark, f"{tmp_path}/s")
    rows = [{"fingerprint_id": R.fp(k), "statistics": R.statement_doc(cnt=10 + k, run=0.01 * k)} for k in range(5)]
    ingest_at(spark, store, registry, 905).run_once("stmt_stats", R.stmt_stats(spark, rows))
    newer = R.stmt_stats(spark, [{"fingerprint_id": R.fp(1), "statistics": R.statement_doc(cnt=99, run=0.5)}])
    ingest_at(spark, store, registry, 1905, agg_mode="hour_aligned").run_once("stmt_stats", newer)
    typed, plain = store.read("stmt_stats", typed=True), store.read("stmt_stats")
    assert "statistics" not in typed.columns and "s" not in plain.columns
    for report in (reports.slow_by_mean, reports.slow_by_total, reports.write_hotspots):
        got = report(typed, R.at(1000))
        assert R.rows_of(got) == R.rows_of(report(plain, R.at(1000)))
        assert "from_json" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert reports.slow_by_mean(typed, R.at(1000), k=1).first()["execs"] == 99
    filtered = typed.where("s.statistics.cnt > 50")
    assert "PushedFilters: [IsNotNull(s.statistics.cnt), GreaterThan(s.statistics.cnt" in filtered._jdf.queryExecution().executedPlan().toString()
