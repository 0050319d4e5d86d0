"""Continuous ingest: Structured Streaming micro-batches over the batch plans.

What a batch may read is decided by the ingest state and not by Spark's event
time watermark: rows behind the slice were never going to be read, rows ahead
of it must stay for a later batch. So a batch

1. plans its slices and the state after it,
2. takes the waiting and the new rows that fall into the slices and writes them merged,
3. writes the new rows that a registered run will need later to the waiting rows, once,
4. commits: rows, waiting rows and watermarks come into force together, with one file.

Before the commit no reader sees anything of a batch, so one that failed is simply repeated; a batch that Spark
repeats after its commit does nothing. Waiting rows lie in parts by time slot: a batch reads the parts that its
slices meet, and a part goes once no run can need it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens import schemas as S
from runlens.functions.values import instant
from runlens.operators.joins import interval_join, time_slot
from runlens.operators.merging import not_in_index
from runlens.plans import backfill, ingest, runs
from runlens.plans.metrics import METRICS
from runlens.sources.commits import Commit, Part
from runlens.sources.store import Store, micros

BACKFILL_EVERY = 20
SLOT_SECONDS = 3600  # of waiting rows
INDEX_PARTS = 16  # parts of an index bucket before they are joined


@dataclass
class Batch:
    """One attempt at a batch. parts: live ones, with what the attempt has written; added, gone: its changes; spare:
    what it has written and replaced itself."""

    stream: str
    number: int
    label: str
    base: Commit
    parts: list[Part] = field(default_factory=list)
    added: list[Part] = field(default_factory=list)
    gone: list[Part] = field(default_factory=list)
    spare: list[Part] = field(default_factory=list)

    def apply(self, added: Iterable[Part], gone: Iterable[Part] = ()) -> None:
        added, gone = list(added), set(gone)
        self.parts = [p for p in self.parts if p not in gone] + added
        for p in gone:
            (self.spare if p in self.added else self.gone).append(p)
        self.added = [p for p in self.added if p not in gone] + added

    def of(self, table: str, names: Iterable[str] | None = None) -> list[Part]:
        names = None if names is None else set(names)
        return [p for p in self.parts if p.table == table and (names is None or p.test_run in names)]


class Ingest:
    """Ingest of the four streams into a store.

    ``registry`` returns the registered runs. ``slice_seconds`` limits a batch
    to short slices; by default a batch takes all that is due, with the same
    rows in the end. ``agg_mode="hour_aligned"`` lets the slices of the
    statistics begin at the full hour, so that a bucket which was refreshed
    since the last batch, or began before the run, is read and updated.
    """

    def __init__(
        self,
        store: Store,
        registry: Callable[[], DataFrame],
        clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
        slice_seconds: int | None = None,
        safety_delay: int = runs.SAFETY_DELAY_SECONDS,
        backfill_every: int = BACKFILL_EVERY,
        backfill_hours: int = backfill.WINDOW_HOURS,
        agg_mode: str = "slice",
    ):
        if agg_mode not in ("slice", "hour_aligned"):
            raise ValueError(f"unknown agg_mode {agg_mode!r}")
        self.agg_mode = agg_mode
        self.store = store
        self.registry = registry
        self.clock = clock
        self.slice_seconds = slice_seconds
        self.safety_delay = safety_delay
        self.backfill_every = backfill_every
        self.backfill_hours = backfill_hours

    # --------------------------------------------------------------- entry points

    def start(
        self,
        stream: str,
        source: DataFrame,
        checkpoint: str,
        every: str | None = "15 seconds",
        backfill_source: Callable[[], DataFrame] | None = None,
        replay_source: Callable[[], DataFrame] | None = None,
    ) -> StreamingQuery:
        """One streaming query per stream, so that a failure stays in its stream.

        ``every=None`` reads what is there and ends. ``replay_source`` gives the
        same source as a table; it is read for a run that is registered after
        rows of its time have passed, since the stream keeps no rows of unknown
        runs. Without it such a run is an error, which ends the query. Runs that are
        registered before they start need none.
        """
        writer = source.writeStream.foreachBatch(
            lambda df, n: self.process(
                stream, df, n, keep=True, backfill_source=backfill_source, replay_source=replay_source
            )
        ).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
        return writer.queryName(f"ingest_{stream}").start()

    def run_once(
        self, stream: str, source: DataFrame, backfill_source: Callable[[], DataFrame] | None = None
    ) -> int:
        """One batch over a source that can be read again; returns its number."""
        batch_id = self.store.last_batch(stream) + 1 if stream in S.ALL_STREAMS else 0
        self.process(stream, source, batch_id, keep=False, backfill_source=backfill_source)
        return batch_id

    # ------------------------------------------------------------------- a batch

    def process(
        self,
        stream: str,
        source: DataFrame,
        batch_id: int,
        keep: bool,
        backfill_source: Callable[[], DataFrame] | None = None,
        replay_source: Callable[[], DataFrame] | None = None,
    ) -> None:
        if stream not in S.ALL_STREAMS:
            raise ValueError(f"unknown stream {stream!r}")
        began, now = time.monotonic(), self.clock()
        base = self.store.commits.latest(stream)
        if batch_id <= base.batch:
            return
        batch = Batch(stream, batch_id, self.store.label(batch_id), base, list(base.parts))
        try:
            registry = self.registry()
            plan, marks = self._planned(stream, base, registry, now)
            known, seen = dict(base.known), base.seen
            rows = source
            if keep:
                known = self._known(base, registry)
                seen = self._seen(base, source, stream)
                due = [p for p in batch.of(f"pending_{stream}") if any(p.meets(lo, hi) for _, _, lo, hi in plan)]
                if due:
                    waiting = self.store.read_parts(f"pending_{stream}", due)
                    rows = source.unionByName(waiting.select(*S.STREAM_SCHEMAS[stream].names))
            late = {run for run, _, lo, _ in plan if keep and known.get(run) is not None and lo <= known[run]}
            tagged = self._tagged(stream, rows, [p for p in plan if p[0] not in late])
            if late:
                if replay_source is None:
                    raise ValueError(
                        f"registered after {stream} had begun, give replay_source to read their rows again: {sorted(late)}"
                    )
                tagged = tagged.unionByName(self._tagged(stream, replay_source(), [p for p in plan if p[0] in late]))
            written = self._merge(batch, tagged, plan)
            if keep:
                self._wait(batch, source, registry, marks)
            changed = None
            if (
                stream == "contention"
                and backfill_source is not None
                and self.backfill_every
                and (batch_id + 1) % self.backfill_every == 0
            ):
                changed = self._backfill(batch, backfill_source(), now, False)
            self._record(stream, batch_id, plan, marks, written, now, time.monotonic() - began, changed)
            self.store.change(
                stream, batch.added, batch.gone, batch=batch_id, known=known, seen=seen,
                marks=lambda newest: {r: marks[r] for r in marks if r in newest.marks or r not in base.marks},
            )
            for part in batch.spare:
                self.store.remove(self.store.folder(part))
        except Exception:
            self._record_error(stream, now)
            raise
        finally:
            self.store.release(batch.label)

    def _planned(
        self, stream: str, base: Commit, registry: DataFrame, now: datetime
    ) -> tuple[list[tuple[str, str, int, int]], dict[str, tuple[int, int]]]:
        """The slices (run, database, from, to) of this batch, and the watermarks after it.

        One entry per active run, on the driver: they choose the parts that are read.
        """
        state = self.store.state()
        active = runs.active_runs(registry, state, now)
        slices = runs.due_slices(active, state, now, [stream], self.slice_seconds, self.safety_delay)
        stamp = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        found = slices.select("test_run", "database_name", stamp("from_ts"), stamp("to_ts")).collect()
        marks = dict(base.marks) | {r[0]: (r[3], micros(now)) for r in found}
        hour = 3_600_000_000
        whole = self.agg_mode == "hour_aligned" and stream in S.AGG_STREAMS
        return [(r[0], r[1], r[2] - r[2] % hour if whole else r[2], r[3]) for r in found], marks

    def _known(self, base: Commit, registry: DataFrame) -> dict[str, int | None]:
        """Runs whose rows are kept from this batch on, with the time up to which rows of theirs may have gone by.

        A run that is registered before its first row passes needs nothing read again, also if the stream has begun.
        """
        known = dict(base.known)
        for run, start in registry.select("test_run", F.unix_micros(F.col("start_time").cast("timestamp"))).collect():
            if run not in known:
                known[run] = base.seen if base.seen is not None and start <= base.seen else None
        return known

    def _seen(self, base: Commit, source: DataFrame, stream: str) -> int | None:
        """The greatest event time up to this batch."""
        newest = source.agg(F.unix_micros(F.max(F.col(S.EVENT_TIME[stream]).cast("timestamp")))).first()[0]
        return max((t for t in (base.seen, newest) if t is not None), default=None)

    def _tagged(self, stream: str, rows: DataFrame, plan: list[tuple[str, str, int, int]]) -> DataFrame:
        """Rows of the slices, once per run; the span of all slices goes to the scan."""
        flat = self.store.spark.createDataFrame(
            [(run, stream, db, lo, hi) for run, db, lo, hi in plan], "test_run string, stream string, database_name string, lo long, hi long"
        )
        slices = flat.select(
            "test_run", "stream", "database_name", F.timestamp_micros("lo").alias("from_ts"), F.timestamp_micros("hi").alias("to_ts")
        )
        if plan:
            ts = F.col(S.EVENT_TIME[stream])
            dtype = rows.schema[S.EVENT_TIME[stream]].dataType
            at = lambda m: F.timestamp_micros(F.lit(m)).cast(dtype)
            near = rows.where((ts >= at(min(p[2] for p in plan))) & (ts < at(max(p[3] for p in plan))))
        else:
            near = rows.limit(0)
        if stream == "insights":
            return ingest.visible_insights(near, slices)
        return ingest.tag_with_runs(near, slices, stream)

    def _merge(self, batch: Batch, tagged: DataFrame, plan: list[tuple[str, str, int, int]]) -> dict[str, int]:
        """Write the batch's rows; returns the number of rows per run, updated and mapped ones too."""
        names = {p[0] for p in plan}
        if not names:
            return {}
        if batch.stream in S.AGG_STREAMS:
            return self._merge_statistics(batch, tagged, names)
        numbered = lambda df: df.withColumn("batch_id", F.lit(batch.number).cast("bigint"))
        if batch.stream == "contention":
            added = self.store.write("contention", numbered(tagged), batch.label)
            batch.apply(added)
        else:
            added = []
            for table, fresh in (("insights", ingest.indexed_insights(tagged)), ("txn_id_map", ingest.indexed_txn_ids(tagged))):
                added += self._insert(batch, table, fresh)
        counts: dict[str, int] = {}
        for p in added:
            counts[p.test_run] = counts.get(p.test_run, 0) + p.rows
        return counts

    def _insert(self, batch: Batch, table: str, fresh: DataFrame) -> list[Part]:
        """Append the rows whose key is new. Of the key index only the buckets are read that the batch's keys fall into."""
        store, index = self.store, f"{table}_keys"
        fresh = store.hold(fresh, batch.label, table)
        touched = {tuple(r) for r in fresh.where("bucket IS NOT NULL").select("test_run", "bucket").distinct().collect()}
        held = [p for p in batch.of(index) if (p.test_run, p.number) in touched]
        new = not_in_index(fresh, store.read_parts(index, held)) if held else fresh
        new = store.hold(new, batch.label, f"{table}-new")
        added = store.write(table, new.withColumn("batch_id", F.lit(batch.number).cast("bigint")), batch.label)
        keys = new.where("bucket IS NOT NULL").select("test_run", "bucket", "digest_1", "digest_2")
        # a bucket of many small parts is written as one
        several: dict[tuple[str | None, int], list[Part]] = {}
        for p in held:
            several.setdefault((p.test_run, p.number), []).append(p)
        joined = [p for parts in several.values() if len(parts) >= INDEX_PARTS for p in parts]
        if joined:
            keys = keys.unionByName(store.read_parts(index, joined).select(*keys.columns))
        batch.apply(added)
        batch.apply(store.write(index, keys, batch.label), joined)
        return added

    def _merge_statistics(self, batch: Batch, tagged: DataFrame, names: set[str]) -> dict[str, int]:
        """Upsert: one row per key of the batch, the newest version.

        Stored parts whose span of time the batch does not meet are neither listed nor read.
        """
        store, stream = self.store, batch.stream
        keys, ts = list(S.KEYS[stream]), F.unix_micros(F.col(S.EVENT_TIME[stream]).cast("timestamp"))
        # the deduplicated batch is held: it is read for the span, the keys, the merge and the count
        fresh = store.hold(ingest.newest_statistics(tagged, stream), batch.label, "rows")
        counted = fresh.groupBy("test_run").agg(F.count(F.lit(1)), F.min(ts), F.max(ts)).collect()
        if not counted:
            return {}
        lo, hi = min(r[2] for r in counted), max(r[3] for r in counted) + 1
        near = [p for p in batch.of(stream, names) if p.meets(lo, hi)]
        hit: list[Part] = []
        if near:
            stored = store.read_parts(stream, near).select("write", "batch_id", *keys)
            found = stored.join(fresh.select(*keys), keys, "left_semi").select("test_run", "batch_id", "write").distinct()
            where = {tuple(r) for r in found.collect()}
            hit = [p for p in near if (p.test_run, p.number, p.write) in where]
        numbered = fresh.withColumn("batch_id", F.lit(batch.number).cast("bigint"))
        if hit:
            numbered = ingest.merged_statistics(numbered, store.read_parts(stream, hit).drop("write", "m", "s"), stream)
        batch.apply(store.write(stream, numbered, batch.label), hit)
        return {r[0]: r[1] for r in counted}

    def _wait(self, batch: Batch, source: DataFrame, registry: DataFrame, marks: dict[str, tuple[int, int]]) -> None:
        """Keep the new rows between what a run has read and the end of what it may read; drop waiting parts that
        no run can need. Rows that wait already are not written again."""
        stream, table = batch.stream, f"pending_{batch.stream}"
        stamp = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        whole = runs.whole_run_slices(registry, [stream]).select("test_run", "database_name", stamp("from_ts"), stamp("to_ts"))
        spans: dict[str | None, tuple[int, int]] = {}  # one per database, so that a row is kept once
        for run, database, lo, hi in whole.collect():
            lo = max(lo, marks[run][0]) if run in marks else lo
            if lo < hi:
                key = database if stream in S.LIVE_STREAMS else None
                was = spans.get(key, (lo, hi))
                spans[key] = (min(was[0], lo), max(was[1], hi))
        passed = [p for p in batch.of(table) if not any(p.meets(lo, hi) for lo, hi in spans.values())]
        added: list[Part] = []
        if spans:
            flat = self.store.spark.createDataFrame([(d, lo, hi) for d, (lo, hi) in spans.items()], "database_name string, lo long, hi long")
            ends = [F.timestamp_micros("lo").alias("from_ts"), F.timestamp_micros("hi").alias("to_ts")]
            ts = S.EVENT_TIME[stream]
            if stream in S.LIVE_STREAMS:
                kept = interval_join(source, flat.select("database_name", *ends), ts, "from_ts", "to_ts", [("database_name", "database_name")])
            else:
                kept = interval_join(source, flat.select(*ends), ts, "from_ts", "to_ts")
            kept = kept.select(*S.STREAM_SCHEMAS[stream].names, time_slot(F.col(ts), SLOT_SECONDS).alias("slot"))
            added = self.store.write(table, kept, batch.label)
        batch.apply(added, passed)

    # ------------------------------------------------------------------ backfill

    def backfill(self, source: DataFrame, now: datetime, both_columns: bool = False) -> dict[str, int]:
        """Replace placeholder fingerprints in what is committed; returns changed rows per run.

        ``both_columns`` as in ``plans.backfill.backfilled``.
        """
        base = self.store.commits.latest("contention")
        batch = Batch("contention", base.batch, self.store.label("backfill"), base, list(base.parts))
        try:
            changed = self._backfill(batch, source, now, both_columns)
            if batch.added:
                self.store.change("contention", batch.added, batch.gone)
        finally:
            self.store.release(batch.label)
        return changed

    def _backfill(self, batch: Batch, source: DataFrame, now: datetime, both_columns: bool) -> dict[str, int]:
        """Only parts within the window are read and only those with a changed row are rewritten."""
        store, hours = self.store, self.backfill_hours
        since = micros(now) - hours * 3_600_000_000
        recent = [p for p in batch.of("contention") if p.hi is not None and p.hi >= since]
        if not recent:
            return {}
        done = backfill.backfilled(store.read_parts("contention", recent), source, now, hours, both_columns).where("changed")
        counted = done.groupBy("test_run", "batch_id", "write").agg(F.count(F.lit(1))).collect()
        where = {(r[0], r[1], r[2]): r[3] for r in counted}
        hit = [p for p in recent if (p.test_run, p.number, p.write) in where]
        if not hit:
            return {}
        new = backfill.backfilled(store.read_parts("contention", hit), source, now, hours, both_columns).drop("changed", "write")
        batch.apply(store.write("contention", new, f"{batch.label}-fixed"), hit)
        out: dict[str, int] = {}
        for (run, _, _), n in where.items():
            out[run] = out.get(run, 0) + n
        return out

    # ------------------------------------------------------------------- metrics

    def _record(self, stream, batch_id, plan, marks, written, now, took, changed) -> None:
        """One metrics row per run that is active or has been read, also where nothing was due."""
        at, fixed = micros(now), changed or {}
        lags = {run: (at - mark) / 1_000_000 for run, (mark, _) in marks.items()}
        names = sorted(set(lags) | {p[0] for p in plan} | set(fixed), key=str)
        rows = [(at, stream, n, written.get(n, 0), 0, int(took * 1000), lags.get(n), fixed.get(n, 0)) for n in names]
        flat = self.store.spark.createDataFrame(
            rows, "at long, stream string, test_run string, rows long, errors long, duration_ms long, lag_seconds double, backfilled long"
        )
        self.store.write_metrics(flat.withColumn("ts", F.timestamp_micros("at")), stream, batch_id)

    def _record_error(self, stream: str, now: datetime) -> None:
        at = now.astimezone(timezone.utc) if now.tzinfo else now
        row = self.store.spark.createDataFrame([(at, stream, None, 0, 1, None, None, 0)], METRICS)
        self.store.write_metrics(row, stream, f"error-{at:%Y%m%dT%H%M%S%f}")
