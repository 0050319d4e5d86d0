"""The tables segmented by test run, as Parquet.

Layout: ``<root>/<table>/write=<label>/test_run=<run>/batch_id=<n>/``. Every write has a label of its own and is
never changed; the commits (``runlens.sources.commits``) say which parts are live. So readers see whole batches
only, a failed write leaves nothing behind but files that ``vacuum`` removes, and a part that is replaced stays
readable for those who have begun to read it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Collection, Iterable
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import schemas as S
from runlens.functions.values import days, instant, typed_statistics
from runlens.operators.merging import KEY_DIGEST
from runlens.plans.metrics import METRICS
from runlens.plans.retention import unexpired
from runlens.plans.runs import register_runs
from runlens.sources.commits import Commit, Commits, Part

COMPACTED_BATCHES = 5760
REMOVED_AFTER_SECONDS = 3600  # how long a replaced part stays readable
CALLER_TABLES = ("caller_contention_results", "caller_failed_statement")
INDEXED = ("insights", "txn_id_map")
#: The stream whose commits list a table's parts.
STREAM_OF = (
    {s: s for s in S.ALL_STREAMS}
    | {"txn_id_map": "insights"}
    | {f"{t}_keys": "insights" for t in INDEXED}
    | {f"pending_{s}": s for s in S.ALL_STREAMS}
)


def partitions(table: str) -> tuple[str, ...]:
    """Partition columns below ``write``; the last one is the part's number."""
    if table.startswith("pending_"):
        return ("slot",)
    return ("test_run", "bucket") if table.endswith("_keys") else ("test_run", "batch_id")


def time_column(table: str) -> str | None:
    return S.EVENT_TIME.get(table.removeprefix("pending_"))


def typed_fields(table: str) -> list[T.StructField]:
    """The typed documents that the statistics tables hold beside the texts."""
    if table not in S.AGG_STREAMS:
        return []
    metadata = S.TRANSACTION_METADATA if table == "txn_stats" else S.STATEMENT_METADATA
    return [T.StructField(n, T.StructType.fromDDL(d)) for n, d in (("m", metadata), ("s", S.STATISTICS))]


def table_schema(table: str) -> T.StructType:
    """Columns of a table with its typed documents and partition columns, ``write`` in front of these."""
    types = {"test_run": T.StringType(), "batch_id": T.LongType(), "bucket": T.LongType(), "slot": T.LongType()}
    if table.endswith("_keys"):
        base = KEY_DIGEST
    elif table == "txn_id_map":
        base = S.TXN_ID_MAP
    else:
        base = S.STREAM_SCHEMAS[table.removeprefix("pending_")]
    more = [T.StructField("write", T.StringType()), *(T.StructField(c, types[c]) for c in partitions(table))]
    return T.StructType([*base.fields, *typed_fields(table), *more])


def micros(ts: datetime) -> int:
    """Microseconds since the epoch; a time without zone counts as UTC."""
    at = ts if ts.tzinfo else ts.replace(tzinfo=timezone.utc)
    span = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (span.days * 86_400 + span.seconds) * 1_000_000 + span.microseconds


class Store:
    def __init__(self, spark: SparkSession, root: str, removed_after: int = REMOVED_AFTER_SECONDS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.removed_after = removed_after
        self.commits = Commits(spark, f"{self.root}/_commits")

    # ---------------------------------------------------------------- file paths

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def remove(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    def numbers(self, path: str) -> list[int]:
        """The batch numbers of ``batch_id=<n>`` folders that are complete."""
        p, fs = self._fs(path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        found = [int(n.split("=", 1)[1]) for n in names if n.startswith("batch_id=")]
        return sorted(n for n in found if self.exists(f"{path}/batch_id={n}/_SUCCESS"))

    def _partition(self, column: str, value: str) -> str:
        """The folder name Spark gives to a partition value."""
        names = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return names.getPartitionPathString(column, value)

    def folder(self, part: Part) -> str:
        values = [part.number] if part.test_run is None else [part.test_run, part.number]
        names = [self._partition(c, str(v)) for c, v in zip(partitions(part.table), values, strict=True)]
        return self.path(part.table, f"write={part.write}", *names)

    # -------------------------------------------------------------------- tables

    def read_parts(self, table: str, parts: Iterable[Part]) -> DataFrame:
        """The rows of some parts, with the partition columns; only their folders are listed."""
        schema, paths = table_schema(table), [self.folder(p) for p in parts]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path(table)).parquet(*paths)

    def read(
        self,
        table: str,
        with_batch: bool = False,
        runs: Collection[str] | None = None,
        since: datetime | None = None,
        until: datetime | None = None,
        commit: Commit | None = None,
        typed: bool = False,
    ) -> DataFrame:
        """The committed rows of a table, as of now or of a commit.

        ``runs`` and a span of time [since, until) choose the parts by what the commit knows of them, and cut the rows.
        ``typed``: statistics with the typed columns ``m`` and ``s`` that were made when they were written, in
        place of the documents; the reports take either.
        """
        commit = commit or self.commits.latest(STREAM_OF[table])
        lo = None if since is None and until is None else (micros(since) if since else -(1 << 63))
        hi = None if lo is None else (micros(until) if until else 1 << 63)
        df = self.read_parts(table, commit.of(table, runs, lo, hi))
        ts = time_column(table)
        if since is not None:
            df = df.where(F.col(ts) >= instant(since))
        if until is not None:
            df = df.where(F.col(ts) < instant(until))
        hidden = ("write", *partitions(table), *(("metadata", "statistics") if typed else ("m", "s")))
        names = ["test_run", *[n for n in table_schema(table).names if n not in hidden]]
        return df.select(*names, *(["batch_id"] if with_batch else []))

    def tables(self, now: datetime | None = None) -> dict[str, DataFrame]:
        """The ingested tables; with ``now`` without rows past their retention time."""
        latest = {s: self.commits.latest(s) for s in S.ALL_STREAMS}
        out = {t: self.read(t, commit=latest[STREAM_OF[t]]) for t in (*S.ALL_STREAMS, "txn_id_map")}
        return out if now is None else {t: unexpired(df, t, now) for t, df in out.items()}

    def write(self, table: str, df: DataFrame, label: str) -> list[Part]:
        """Write rows with their partition columns under a fresh label: parts that no reader sees before they are committed."""
        columns, ts = partitions(table), time_column(table)
        names = [n for n in table_schema(table).names if n != "write"]
        path = self.path(table, f"write={label}")
        if table in S.AGG_STREAMS:
            df = typed_statistics(df.drop("m", "s"), table)
        df.select(*names).write.partitionBy(*columns).parquet(path)
        stamp = F.unix_micros(F.col(ts).cast("timestamp")) if ts else F.lit(None).cast("bigint")
        written = self.spark.read.schema(table_schema(table)).option("basePath", self.path(table)).parquet(path)
        found = (
            written.groupBy(*columns)
            .agg(F.count(F.lit(1)).alias("rows"), F.min(stamp).alias("lo"), F.max(stamp).alias("hi"))
            .collect()
        )
        if not found:
            self.remove(path)
        return [
            Part(table, label, r["test_run"] if "test_run" in columns else None, r[columns[-1]], r["rows"], r["lo"], r["hi"])
            for r in found
        ]

    def write_batch(self, table: str, df: DataFrame, batch_id: int) -> None:
        """Append rows to a table and commit them, outside of ingest."""
        parts = self.write(table, df.withColumn("batch_id", F.lit(batch_id).cast("bigint")), self.label(batch_id))
        self.change(STREAM_OF[table], parts)

    @staticmethod
    def label(name: str | int) -> str:
        return f"{name}-{uuid.uuid4().hex[:12]}"

    def change(self, stream: str, added: Iterable[Part] = (), gone: Iterable[Part] = (), **values) -> Commit:
        """Commit parts that come and go; parts that went long enough ago are removed from disk."""
        now = int(time.time())
        new = self.commits.change(stream, added, gone, now, **values)
        old = [p for p, at in new.garbage if at <= now - self.removed_after]
        if old:
            for p in old:
                self.remove(self.folder(p))
            dropped = set(old)
            self.commits.change(stream, garbage=lambda base: tuple(g for g in base.garbage if g[0] not in dropped))
        return new

    def vacuum(self, older_than: int = 86_400) -> int:
        """Remove writes that were never committed or have no part left, once they are that many seconds old."""
        removed, limit = 0, (time.time() - older_than) * 1000
        for table, stream in STREAM_OF.items():
            commit = self.commits.latest(stream)
            held = {p.write for p in commit.parts if p.table == table} | {p.write for p, _ in commit.garbage if p.table == table}
            root, fs = self._fs(self.path(table))
            for s in fs.listStatus(root) if fs.exists(root) else []:
                name = s.getPath().getName()
                if name.startswith("write=") and name.removeprefix("write=") not in held and s.getModificationTime() <= limit:
                    self.remove(self.path(table, name))
                    removed += 1
        return removed

    def hold(self, df: DataFrame, label: str, name: str) -> DataFrame:
        """Write ``df`` to the folder of an attempt, which goes when the attempt is over, and read it from there."""
        path = self.path("_aside", label, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, label: str) -> None:
        self.remove(self.path("_aside", label))

    def aside(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` to the store's staging folder, once per name, and read it from there."""
        path = self.path("_aside", name)
        if not self.exists(f"{path}/_SUCCESS"):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def compact(self, table: str, batches: int = COMPACTED_BATCHES) -> int:
        """Join the parts of closed batches; returns the number of parts that went.

        Of each ``batches`` consecutive batch numbers (a day of the usual ones), once all are committed, each run
        keeps one part under the first number. One commit puts it in the place of the others.
        """
        stream = STREAM_OF[table]
        commit = self.commits.latest(stream)
        groups: dict[tuple[str, int], list[Part]] = {}
        for p in commit.of(table):
            first = p.number - p.number % batches
            if first + batches - 1 < commit.batch:
                groups.setdefault((p.test_run, first), []).append(p)
        gone = [p for parts in groups.values() if len(parts) > 1 for p in parts]
        if not gone:
            return 0
        first = F.col("batch_id") - F.col("batch_id") % batches
        joined = self.read_parts(table, gone).withColumn("batch_id", first).hint("rebalance", "test_run", "batch_id")
        added = self.write(table, joined, self.label("compact"))
        self.change(stream, added, gone)
        return len(gone) - len(added)

    # -------------------------------------------------------------- run registry

    def runs(self) -> DataFrame:
        done = self.numbers(self.path("_runs"))
        if not done:
            return self.spark.createDataFrame([], S.RUNS)
        return self.spark.read.schema(S.RUNS).parquet(self.path("_runs", f"batch_id={done[-1]}"))

    def register(self, new: DataFrame) -> DataFrame:
        """Add runs to the registry; returns those that were refused."""
        done = self.numbers(self.path("_runs"))
        registry, refused = register_runs(self.runs(), new)
        registry.coalesce(1).write.mode("overwrite").parquet(
            self.path("_runs", f"batch_id={done[-1] + 1 if done else 0}")
        )
        return refused

    # ----------------------------------------------------------------- clean-up

    def expire(self, now: datetime, keep_days: int = S.RETENTION_DAYS) -> int:
        """Drop what is past its retention time, in every table that has one.

        Of the ingested tables whole parts go, once all their rows are past it, which
        the commits know without a look at the rows; ``unexpired`` hides the rest. Expired
        runs go with their parts, as when they are deleted. State and callers' results lose
        the rows. Returns the number of dropped parts.
        """
        limit = instant(now) - days(keep_days)
        until = micros(now) - keep_days * 86_400_000_000
        dropped = 0
        for stream in S.ALL_STREAMS:
            commit = self.commits.latest(stream)
            gone = [p for p in commit.of(stream) if p.hi is not None and p.hi <= until]
            kept = lambda base: {r: m for r, m in base.marks.items() if m[1] > until}
            if gone or len(kept(commit)) < len(commit.marks):
                self.change(stream, gone=gone, marks=kept)
            dropped += len(gone)
        for row in self.runs().where(F.col(S.TTL_COLUMN["runs"]) <= limit).collect():
            self.delete_run(row["test_run"])
        for table in CALLER_TABLES:
            self._filter_callers(table, F.col(S.TTL_COLUMN[table]) <= limit)
        return dropped

    def _filter_folder(self, df: DataFrame, path: str, gone: Column) -> None:
        """Take the rows out of a folder for which ``gone`` holds (NULL: they stay)."""
        gone = F.coalesce(gone, F.lit(False))
        if not df.where(gone).isEmpty():
            name = "filter-" + path.removeprefix(self.root).strip("/").replace("/", "-")
            left = self.aside(df.where(~gone), name)
            left.write.mode("overwrite").parquet(path)
            self.remove(self.path("_aside", name))

    # ---------------------------------------------------------- callers' results

    def write_caller(self, table: str, caller_id: str, df: DataFrame) -> None:
        """Put a caller's rows in place of those before, also when there are none."""
        df.write.mode("overwrite").parquet(self.path(table, f"caller_id={quote(caller_id, safe='')}"))

    def caller(self, table: str, caller_id: str) -> DataFrame:
        """One caller's rows. The folder is read by its name: ids ``7`` and ``007`` stay apart."""
        return self.spark.read.parquet(self.path(table, f"caller_id={quote(caller_id, safe='')}"))

    def _filter_callers(self, table: str, gone: Column) -> None:
        p, fs = self._fs(self.path(table))
        if fs.exists(p):
            for s in fs.listStatus(p):
                path = self.path(table, s.getPath().getName())
                self._filter_folder(self.spark.read.parquet(path), path, gone)

    def reset(self) -> None:
        """Remove all tables, the registry and the state."""
        for table in (*STREAM_OF, "_commits", "_runs", "_metrics", "_aside", *CALLER_TABLES):
            self.remove(self.path(table))

    def delete_run(self, test_run: str) -> None:
        """Drop a run, its parts in the tables that follow it and its rows in callers'
        results, from disk too; its ingest state stays until it expires."""
        for stream in S.ALL_STREAMS:
            gone = [p for p in self.commits.latest(stream).parts if p.test_run == test_run]
            if gone:
                self.change(stream, gone=gone)
                for p in gone:
                    self.remove(self.folder(p))
        self._filter_callers("caller_contention_results", F.col("test_run") == test_run)
        done = self.numbers(self.path("_runs"))
        if done:
            left = self.runs().where(F.col("test_run") != test_run)
            left.coalesce(1).write.mode("overwrite").parquet(self.path("_runs", f"batch_id={done[-1] + 1}"))

    # --------------------------------------------------------------- ingest state

    def last_batch(self, stream: str) -> int:
        """The latest committed batch, -1 before the first."""
        return self.commits.latest(stream).batch

    def state(self) -> DataFrame:
        """Watermarks of all streams after their latest batches."""
        rows = []
        for stream in S.ALL_STREAMS:
            rows += [(run, stream, *marks) for run, marks in self.commits.latest(stream).marks.items()]
        plain = self.spark.createDataFrame(rows, "test_run string, stream string, mark long, updated long")
        return plain.select(
            "test_run", "stream", F.timestamp_micros("mark").alias("watermark_ts"), F.timestamp_micros("updated").alias("updated_at")
        )

    # ------------------------------------------------------------------- metrics

    def write_metrics(self, df: DataFrame, stream: str, batch_id: int | str) -> None:
        folder = self.path("_metrics", f"source={stream}", f"batch_id={batch_id}")
        df.select(*METRICS.names).coalesce(1).write.mode("overwrite").parquet(folder)

    def metrics(self) -> DataFrame:
        path = self.path("_metrics")
        if not self.exists(path):
            return self.spark.createDataFrame([], METRICS)
        return self.spark.read.schema(METRICS).option("recursiveFileLookup", "true").parquet(path)
