"""What readers see of a store: whole batches, parts chosen by time, run and key bucket."""

from datetime import timedelta

import pytest

from runlens.operators.merging import KEY_BUCKETS
from runlens.plans import ingest as plans
from runlens.sources.commits import Commit, Conflict, Part
from runlens.sources.store import Store, micros
from runlens.streaming.ingest import INDEX_PARTS, Ingest
from tests import rows as R
from tests.test_streaming import Failing, ingest_at


def waits(spark, *seconds, **more):
    return R.contention(spark, [{"collection_ts": R.at(t), "waiting_txn_id": f"w{t}", **more} for t in seconds])


def ids(store, run=None):
    df = store.read("contention", runs=None if run is None else [run])
    return [r[0] for r in R.rows_of(df, "waiting_txn_id")]


def registry(spark, *spans):
    """Runs (name, start, end)."""
    out = None
    for name, start, end in spans:
        df = R.runs(spark, name, start=start, end=end)
        out = df if out is None else out.unionByName(df)
    return out


# ------------------------------------------------------------------- whole batches

@pytest.mark.parametrize("fails_at", [2, 3, 4, 5, 6, 7])
def test_no_row_of_a_batch_is_seen_before_its_commit(spark, tmp_path, fails_at):
    """The first writes of the batch succeed; tables, waiting rows and watermarks stay as they were."""
    runs = R.runs(spark, "r1", end=600)
    store = Failing(spark, f"{tmp_path}/s", 99)
    first = R.insights(spark, [{"start_time": R.at(5), "txn_id": "t5"}])
    ingest_at(spark, store, runs, 105).run_once("insights", first)
    more = R.insights(spark, [{"start_time": R.at(t), "txn_id": f"t{t}", "stmt_fingerprint_id": R.fp(t)} for t in (200, 300)])
    before = store.commits.latest("insights")
    store.left = fails_at
    job = ingest_at(spark, store, runs, 905)
    with pytest.raises(OSError):
        job.run_once("insights", more)
    assert store.commits.latest("insights") == before
    assert R.rows_of(store.read("insights"), "txn_id") == R.rows_of(store.read("txn_id_map"), "txn_id") == [("t5",)]
    job.run_once("insights", more)
    want = [("t200",), ("t300",), ("t5",)]
    assert R.rows_of(store.read("insights"), "txn_id") == R.rows_of(store.read("txn_id_map"), "txn_id") == want


def test_a_reader_keeps_what_it_began_with(spark, tmp_path):
    """A part that is replaced stays readable; what was never committed is swept up."""
    runs = R.runs(spark, "r1", end=7200)
    store = Failing(spark, f"{tmp_path}/s", 99)
    ingest_at(spark, store, runs, 905).run_once("stmt_stats", R.stmt_stats(spark, [{"metadata": "{}"}]))
    begun = store.read("stmt_stats")
    job = ingest_at(spark, store, runs, 1905, agg_mode="hour_aligned")
    new = R.stmt_stats(spark, [{"metadata": '{"query": "new"}'}])
    store.left = 3  # the new part is written, its commit fails
    with pytest.raises(OSError):
        job.run_once("stmt_stats", new)
    assert store.vacuum(older_than=-10) == 1
    job.run_once("stmt_stats", new)
    assert R.rows_of(begun, "metadata") == [("{}",)]
    assert R.rows_of(store.read("stmt_stats"), "metadata") == [('{"query": "new"}',)]
    store.removed_after = -10
    store.change("stmt_stats")
    assert store.commits.latest("stmt_stats").garbage == () and store.vacuum(older_than=-10) == 1
    assert R.rows_of(store.read("stmt_stats"), "metadata") == [('{"query": "new"}',)]


def test_rows_and_watermarks_of_one_moment(spark, tmp_path):
    runs = R.runs(spark, "r1", end=600)
    store = Store(spark, f"{tmp_path}/s")
    src = waits(spark, 10, 200)
    for now in (105, 905):
        ingest_at(spark, store, runs, now).run_once("contention", src)
    latest = store.commits.latest("contention")
    older = store.commits.read("contention", latest.number - 1)
    assert store.read("contention", commit=older).count() == 1 and store.read("contention", commit=latest).count() == 2
    assert older.marks["r1"][0] == micros(R.at(100)) and latest.marks["r1"][0] == micros(R.at(600))


def test_two_writers(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    part = Part("contention", "a", "r", 0, 1, 5, 9)
    store.change("contention", [part])
    with pytest.raises(Conflict, match="exists"):
        store.commits.put("contention", Commit(number=0))
    # a commit between reading and writing is built upon, unless it took away what is replaced
    other = Part("contention", "b", "r", 1, 1, 5, 9)
    store.change("contention", [other], batch=0)
    store.change("contention", gone=[part])
    assert store.commits.latest("contention").parts == (other,)
    with pytest.raises(Conflict, match="replaced"):
        store.change("contention", gone=[part])
    with pytest.raises(Conflict, match="committed"):
        store.change("contention", batch=0)
    for n in range(1, 30):
        store.change("contention", batch=n)
    assert len(store.commits.numbers("contention")) == 20 and store.last_batch("contention") == 29


# -------------------------------------------------------------- runs and waiting rows

def test_planned_runs_need_no_replay(spark, tmp_path):
    """Runs registered before they start, with the stream or after it has begun."""
    store = Store(spark, f"{tmp_path}/s")
    first = registry(spark, ("early", 0, 600), ("planned", 1000, 2000))
    later = registry(spark, ("early", 0, 600), ("planned", 1000, 2000), ("next", 1500, 1800))
    for n, (runs, now, rows) in enumerate(
        [(first, 300, (10, 290)), (first, 1200, (320, 1100, 1190)), (later, 1400, (1390, 1700)), (later, 2500, (1600, 1990))]
    ):
        ingest_at(spark, store, runs, now).process("contention", waits(spark, *rows), n, keep=True)
    assert ids(store, "early") == ["w10", "w290", "w320"]
    assert ids(store, "planned") == sorted(["w1100", "w1190", "w1390", "w1600", "w1700", "w1990"])
    assert ids(store, "next") == ["w1600", "w1700"]


def test_a_late_run_is_read_again_until_it_has_caught_up(spark, tmp_path):
    """With short slices every slice up to the time of registration comes from the replay source."""
    store = Store(spark, f"{tmp_path}/s")
    both = registry(spark, ("r1", 0, 600), ("r2", 0, 600))
    everything = waits(spark, 10, 40, 70, 100)
    ingest_at(spark, store, registry(spark, ("r1", 0, 600)), 115).process("contention", everything, 0, keep=True)
    for n in range(1, 8):
        job = ingest_at(spark, store, both, 600 + n, slice_seconds=30)
        rows = waits(spark, 130) if n == 1 else waits(spark)
        job.process("contention", rows, n, keep=True, replay_source=lambda: everything)
    assert ids(store, "r1") == ids(store, "r2") == ["w10", "w100", "w130", "w40", "w70"]
    job = ingest_at(spark, store, both, 900, slice_seconds=30)
    job.process("contention", waits(spark), 8, keep=True)  # caught up: no replay source needed


def test_waiting_rows_are_written_once(spark, tmp_path):
    """What a batch writes does not depend on how many rows wait; parts go when no run needs them."""
    runs = registry(spark, ("r1", 0, 600), ("far", 7200, 9000))
    store = Store(spark, f"{tmp_path}/s")
    ingest_at(spark, store, runs, 100).process("contention", waits(spark, 10, *range(7300, 7500), 8000), 0, keep=True)
    waiting = lambda: store.commits.latest("contention").of("pending_contention")
    held = set(waiting())
    assert sum(p.rows for p in held) == 201
    for n, now in enumerate((200, 300, 700), 1):
        ingest_at(spark, store, runs, now).process("contention", waits(spark, now - 50), n, keep=True)
        assert set(waiting()) == held
    written = {p.write for p in waiting()}
    ingest_at(spark, store, runs, 7405).process("contention", waits(spark, 7405), 4, keep=True)
    assert len(ids(store, "far")) == 100 and {p.write for p in waiting()} > written
    ingest_at(spark, store, runs, 9500).process("contention", waits(spark), 5, keep=True)
    assert len(ids(store, "far")) == 202 and waiting() == []


# ------------------------------------------------------------------------- key index

def test_indexed_inserts_equal_the_anti_join(spark, tmp_path):
    """Batches through the index leave the rows of one batch compared with the whole table; NULL keys never meet."""
    runs = R.runs(spark, "r1", "r2", end=6000)
    store = Store(spark, f"{tmp_path}/s")
    rows = [
        {"start_time": R.at(10 * k), "stmt_id": f"s{k}", "txn_id": f"t{k % 7}", "stmt_fingerprint_id": R.fp(k % 5),
         "last_error_redactable": None if k % 2 else "E", "app_name": None if k == 8 else f"a{k % 2}"}
        for k in range(40)
    ]
    src = R.insights(spark, rows)
    for now in range(105, 600, 100):
        ingest_at(spark, store, runs, now).run_once("insights", src)
    slices = spark.createDataFrame(
        [(r, "insights", "db", R.at(0), R.at(500)) for r in ("r1", "r2")],
        "test_run string, stream string, database_name string, from_ts timestamp, to_ts timestamp",
    )
    tagged = plans.visible_insights(src, slices)
    want = R.rows_of(plans.new_insights(tagged, None), "test_run", "stmt_id")
    assert R.rows_of(store.read("insights"), "test_run", "stmt_id") == want
    assert R.rows_of(store.read("txn_id_map"), "test_run", "txn_id") == R.rows_of(plans.new_txn_ids(tagged, None), "test_run", "txn_id")


def test_a_batch_reads_the_buckets_it_touches(spark, tmp_path, monkeypatch):
    runs = R.runs(spark, "r1", end=60_000)
    store = Store(spark, f"{tmp_path}/s")
    many = R.insights(spark, [{"start_time": R.at(5), "txn_id": f"t{k}", "stmt_fingerprint_id": R.fp(k)} for k in range(2000)])
    ingest_at(spark, store, runs, 105).run_once("insights", many)
    index = store.commits.latest("insights").of("txn_id_map_keys")
    assert len(index) == KEY_BUCKETS and sum(p.rows for p in index) == 2000
    seen = []
    plain = Store.read_parts
    monkeypatch.setattr(Store, "read_parts", lambda self, table, parts: seen.append((table, list(parts))) or plain(self, table, seen[-1][1]))
    for n in range(1, INDEX_PARTS + 2):
        one = R.insights(spark, [{"start_time": R.at(100 + 100 * n), "txn_id": "t7", "stmt_fingerprint_id": R.fp(n % 3)},
                                 {"start_time": R.at(101 + 100 * n), "txn_id": "t7", "status": f"s{n}"}])
        seen.clear()
        ingest_at(spark, store, runs, 200 + 100 * n).run_once("insights", one)
        files = [p for table, parts in seen if table.endswith("_keys") for p in parts]
        buckets = {(p.table, p.number) for p in files}
        assert len({t for t, _ in buckets}) == 2 and len(buckets) <= 4
    assert store.read("insights").count() == 2000 + INDEX_PARTS + 1 and store.read("txn_id_map").count() == 2000
    held = {}
    for p in store.commits.latest("insights").of("insights_keys"):
        held[p.number] = held.get(p.number, 0) + 1
    assert max(held.values()) <= INDEX_PARTS


# ---------------------------------------------------------------------- spans of time

def test_merges_and_retention_go_by_the_spans_of_parts(spark, tmp_path, monkeypatch):
    runs = R.runs(spark, "r1", end=86_400)
    store = Store(spark, f"{tmp_path}/s")
    for hour in range(6):
        src = R.stmt_stats(spark, [{"aggregated_ts": R.at(3600 * hour), "fingerprint_id": R.fp(k)} for k in range(3)])
        ingest_at(spark, store, runs, 3600 * hour + 1800).run_once("stmt_stats", src)
    seen = []
    plain = Store.read_parts
    monkeypatch.setattr(Store, "read_parts", lambda self, table, parts: seen.append(list(parts)) or plain(self, table, seen[-1]))
    again = R.stmt_stats(spark, [{"aggregated_ts": R.at(3600 * 5), "fingerprint_id": R.fp(1), "metadata": "{}"}])
    ingest_at(spark, store, runs, 3600 * 5 + 3000, agg_mode="hour_aligned").run_once("stmt_stats", again)
    assert [{p.number for p in parts} for parts in seen] == [{5}, {5}]
    assert R.rows_of(store.read("stmt_stats", since=R.at(3600 * 5)).where("metadata = '{}'"), "fingerprint_id") == [(R.fp(1),)]
    seen.clear()
    assert store.read("stmt_stats", since=R.at(3600 * 2), until=R.at(3600 * 4)).count() == 6
    assert {p.number for p in seen[0]} == {2, 3}
    seen.clear()
    assert store.expire(R.at(3600 * 3 + 1) + timedelta(days=90)) == 4 and seen == []
    assert store.read("stmt_stats").count() == 6


def test_backfill_reads_recent_parts_only(spark, tmp_path):
    runs = R.runs(spark, "r1", end=86_400)
    store = Store(spark, f"{tmp_path}/s")
    job = Ingest(store, lambda: runs, clock=lambda: R.at(0))
    for hour in range(5):
        job.clock = lambda h=hour: R.at(3600 * h + 1800)
        rows = [{"collection_ts": R.at(3600 * hour + 60), "waiting_txn_id": f"w{hour}", "blocking_txn_fingerprint_id": R.Z}]
        job.run_once("contention", R.contention(spark, rows))
    fixes = R.contention(spark, [{"collection_ts": R.at(3600 * h + 60), "waiting_txn_id": f"w{h}", "blocking_txn_fingerprint_id": R.fp(90 + h)} for h in range(5)])
    before = {p.number: p.write for p in store.commits.latest("contention").of("contention")}
    assert job.backfill(fixes, R.at(3600 * 5)) == {"r1": 2}
    after = {p.number: p.write for p in store.commits.latest("contention").of("contention")}
    assert {n for n in after if after[n] != before[n]} == {3, 4}
    assert R.rows_of(store.read("contention"), "waiting_txn_id", "blocking_txn_fingerprint_id")[2:] == [
        ("w2", R.Z), ("w3", R.fp(93)), ("w4", R.fp(94)),
    ]
