"""Exact ranked search with range-maximum tables over posting lists.

Documents stand in slices of about ``SLICE`` bytes of text, each an inverted index of its own, numbered by ascending
id. For the terms of a block of queries a slice gets range-maximum sparse tables over its posting lists: the largest
impact of a term in any interval of documents, and where it lies, in two look-ups. A query then starts from one
interval, all documents of the slice, and goes on best first:

* the bound of an interval is the sum over terms of weight x largest impact in it;
* the interval of the highest bound is split at its maximum-impact document, the one where its heaviest term peaks; this
  document is scored in full, and the two rests come back with bounds of their own;
* intervals that can no longer enter the k best are dropped. What a task has found in its earlier slices counts.

Many intervals are split at once in one numpy step. Term counts are those of the whole table, so the merge of
all slices is exact.

Scores are whole numbers. N: documents with a term; L: their terms with repeats; n: those of one document; df: documents with
the term; tf: its places in the document. w = floor(1000 ln((2N+2) / (2df+1))), m = 25 + (75 n N) div L, and a document scores the
sum of w * ((10^9 tf) div (1000 tf + 8 m)) over the terms of the query, repeats included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.packed import by_group, pack, unpack
from llm.scratch import keep
from llm.words import PUNCTUATION, words

SLICE = 16_000_000
BLOCK = 1_000  # queries searched together
WIDTH = 256  # intervals split in one step
HELD = 200_000  # queries whose best documents a task remembers before it hands them on
_STEP = (1 << 32) + 1  # between the numbers of a task's slices; the first is the task's own number
_SLICES = "slice long, n long, size long, terms array<long>, dfs array<long>, docs binary, postings binary"


def _slice(number: int, ids: list[np.ndarray], sizes: list[np.ndarray], rows: list[np.ndarray], terms: list[np.ndarray]) -> pa.RecordBatch:
    """One slice: documents by ascending id, postings by term and document."""
    every, size = np.concatenate(ids), np.concatenate(sizes)
    first = np.cumsum([0] + [len(i) for i in ids[:-1]])
    row = np.concatenate([r + f for r, f in zip(rows, first, strict=True)])
    term = np.concatenate(terms)
    there = size > 0
    order = np.argsort(every[there], kind="stable")
    place = np.zeros(len(every), np.int64)
    place[np.flatnonzero(there)[order]] = np.arange(len(order))
    row = place[row]
    at = np.lexsort((row, term))
    row, term = row[at], term[at]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    begin = np.flatnonzero(new)
    tf = np.diff(np.append(begin, len(row)))
    row, term = row[begin], term[begin]
    distinct, start = np.unique(term, return_index=True)
    dfs = np.diff(np.append(start, len(term)))
    cells = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a.view(np.int64)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number]),
            pa.array([int(there.sum())]),
            pa.array([int(size.sum())]),
            cells(distinct),
            cells(dfs.astype(np.int64)),
            pa.array([pack(every[there][order], size[there][order])], pa.binary()),
            pa.array([pack(row.astype(np.int32), tf.astype(np.int32))], pa.binary()),
        ],
        ["slice", "n", "size", "terms", "dfs", "docs", "postings"],
    )


def _slices(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId(), 0
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for w in words(batch.column(1), lower=True, breaks=PUNCTUATION):
                for part, value in zip(parts, (keys[w.first : w.last], np.diff(w.begin), w.row, w.hash), strict=True):
                    part.append(value)
                held += len(w.data)
                if held >= limit:
                    yield _slice(number, *parts)
                    number, held, parts = number + _STEP, 0, [[], [], [], []]
        if parts[0]:
            yield _slice(number, *parts)

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for w in words(batch.column(1), lower=True, breaks=PUNCTUATION):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[w.first : w.last][w.row]), pa.array(w.hash.view(np.int64))], ["item", "term"]
            )


def _weight(n: int):
    """floor(1000 ln((2N+2) / (2df+1))) of a column of frequencies."""
    return F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * n + 2)) / (F.lit(2.0) * F.col("df") + 1))).cast("long")


class Peaks:
    """Range-maximum sparse table: for any range of a sequence, where its (first) maximum lies."""

    def __init__(self, values: np.ndarray, longest: int):
        self.values = values
        self.levels = [np.arange(len(values), dtype=np.int32)]
        width = 1
        while 2 * width <= longest:
            low = self.levels[-1]
            a, b = low[: len(low) - width], low[width:]
            self.levels.append(np.where(values[a] >= values[b], a, b))
            width *= 2
        self.offset = np.cumsum([0] + [len(x) for x in self.levels])[:-1]
        self.flat = np.concatenate(self.levels)

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of the maximum of each non-empty range [lo, hi)."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        a = self.flat[self.offset[level] + lo]
        b = self.flat[self.offset[level] + hi - (1 << level)]
        return np.where(self.values[a] >= self.values[b], a, b)


class Best:
    """The k best (score, id) so far; of equal scores the smaller id is better."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]

    def may_enter(self, bounds: np.ndarray, least_ids: np.ndarray) -> np.ndarray:
        """Which intervals can hold a document that is better than the last one kept."""
        if len(self.ids) < self.k:
            return bounds > 0
        last = self.scores[-1]
        return (bounds > last) | ((bounds == last) & (least_ids <= self.ids[-1]) & (bounds > 0))


class Index:
    """Posting lists of one slice for some terms, with their range-maximum tables."""

    def __init__(self, docs: bytes, terms: np.ndarray, dfs: np.ndarray, postings: bytes, wanted: np.ndarray, n: int, size: int):
        self.ids, lengths = unpack(docs, np.int64, np.int64)
        row, tf = unpack(postings, np.int32, np.int32)
        held = np.isin(terms, wanted, assume_unique=True)
        use = np.repeat(held, dfs)
        self.terms = terms[held]
        self.begin = np.concatenate([[0], np.cumsum(dfs[held])])
        self.row = row[use].astype(np.int64)
        tf = tf[use].astype(np.int64)
        m = 25 + (75 * lengths[self.row] * n) // size
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
        self.peaks = Peaks(self.impact, int(dfs[held].max(initial=0)))
        # term by term and document by document, so that one search finds a document in a given list
        self.key = np.repeat(np.arange(len(self.terms)), dfs[held]) * len(self.ids) + self.row

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best, width: int = WIDTH) -> int:
        """Bring ``best`` up to date with this slice; returns how many documents were scored."""
        at = np.searchsorted(self.terms, terms)
        held = (at < len(self.terms)) & (weights > 0)
        held[held] = self.terms[at[held]] == terms[held]
        at, weight = at[held], weights[held]
        if not len(at):
            return 0
        docs = len(self.ids)
        low, high = np.array([0]), np.array([docs])
        lo, hi = self.begin[at][None, :], self.begin[at + 1][None, :]
        bound, split = self._bound(lo, hi, weight)
        scored = 0
        while len(bound):
            take = np.argpartition(-bound, width)[:width] if len(bound) > width else np.arange(len(bound))
            here, left, right = split[take], low[take], high[take]
            key = at[None, :] * docs + here[:, None]
            place = np.searchsorted(self.key, key)
            hit = place < hi[take]
            hit[hit] = self.key[place[hit]] == key[hit]
            value = np.where(hit, self.impact[np.where(hit, place, 0)], 0)
            best.add(value @ weight, self.ids[here])
            scored += len(take)
            parts_lo = np.concatenate([lo[take], place + hit])
            parts_hi = np.concatenate([place, hi[take]])
            parts_low, parts_high = np.concatenate([left, here + 1]), np.concatenate([here, right])
            some = parts_low < parts_high
            parts_lo, parts_hi, parts_low, parts_high = parts_lo[some], parts_hi[some], parts_low[some], parts_high[some]
            more, where = self._bound(parts_lo, parts_hi, weight)
            rest = np.ones(len(bound), bool)
            rest[take] = False
            low, high = np.concatenate([low[rest], parts_low]), np.concatenate([high[rest], parts_high])
            lo, hi = np.concatenate([lo[rest], parts_lo]), np.concatenate([hi[rest], parts_hi])
            bound, split = np.concatenate([bound[rest], more]), np.concatenate([split[rest], where])
            stay = best.may_enter(bound, self.ids[np.minimum(low, docs - 1)])
            low, high, lo, hi, bound, split = (x[stay] for x in (low, high, lo, hi, bound, split))
        return scored

    def _bound(self, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bound of each interval (ranges of postings, a row each) and the document to split it at."""
        some = lo < hi
        peak = np.zeros(lo.shape, np.int64)
        peak[some] = self.peaks.find(lo[some], hi[some])
        most = np.where(some, self.impact[peak] if len(self.impact) else 0, 0) * weight
        top = most.argmax(axis=1)
        split = self.row[peak[np.arange(len(lo)), top]] if len(self.row) else np.zeros(len(lo), np.int64)
        return most.sum(axis=1), split


def _search(k: int, n: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Best] = {}
        held = None

        def out() -> pa.RecordBatch:
            items = np.repeat(np.array(list(found), np.int64), [len(b.ids) for b in found.values()])
            ids, scores = (np.concatenate([getattr(b, x) for b in found.values()]) for x in ("ids", "scores"))
            return pa.RecordBatch.from_arrays([pa.array(items), pa.array(ids), pa.array(scores)], ["item", "id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                terms, second = (batch[c][row].values.to_numpy().view(np.uint64) for c in ("terms", "dfs"))
                if batch["block"][row].as_py() < 0:
                    held = (batch["docs"][row].as_py(), terms, second.view(np.int64), batch["postings"][row].as_py())
                    continue
                (items,) = unpack(batch["docs"][row].as_py(), np.int64)
                weights = second.view(np.int64)
                index = Index(*held, np.unique(terms), n, size)
                for item, part in by_group(items):
                    best = found.setdefault(item, Best(k))
                    index.search(terms[part], weights[part], best)
                if len(found) >= HELD:
                    yield out()
                    found = {}
        if found:
            yield out()

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of queries in the form of a slice: terms, weights, and the item of each in ``docs``."""
    for batch in batches:
        parts = []
        for entries in batch["entries"]:
            item, term, weight = (entries.values.field(c).to_numpy() for c in ("item", "term", "weight"))
            order = np.lexsort((term, item))
            parts.append((pack(item[order]), term[order], weight[order]))
        yield pa.RecordBatch.from_arrays(
            [
                batch["block"],
                pa.array([t for _, t, _ in parts], pa.list_(pa.int64())),
                pa.array([w for _, _, w in parts], pa.list_(pa.int64())),
                pa.array([i for i, _, _ in parts], pa.binary()),
            ],
            ["block", "terms", "dfs", "docs"],
        )


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
         limit: int = SLICE) -> DataFrame:
    """``(item, rank, id, score)``: the k best rows of ``docs`` for each item; only scores above 0 rank.

    A term is a run of ASCII letters and digits and of all other characters beyond ASCII, A-Z folded. Null and empty texts hold no
    terms: such documents are never found and do not count, such items find nothing. Rows with a null id, on
    either side, take no part. Documents that repeat an id rank as often as they stand there; items that repeat an id
    are one item with the terms of all. Of equal scores the smaller id comes first. Other columns are not read.
    """
    pick = lambda df, key: df.select(
        F.col(key).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    ).filter("id is not null")
    slices = keep(pick(docs, id_col).mapInArrow(_slices(limit), _SLICES), "slices")
    total = slices.agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("slices")).first()
    n, size, count = total["n"] or 0, max(total["size"] or 0, 1), max(total["slices"], 1)
    asked = pick(items, item_col).mapInArrow(_asked, "item long, term long").groupBy("item", "term").agg(F.count("*").alias("times"))
    asked = keep(asked, "asked")
    pairs = slices.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    wanted = asked.select("term").distinct()
    frequent = pairs.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = asked.join(frequent, "term").select("item", "term", (F.col("times") * _weight(n)).alias("weight"))
    blocks = max(1, -(-asked.select("item").distinct().count() // BLOCK))
    queries = (
        weighed.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
        .groupBy("block")
        .agg(F.collect_list(F.struct("item", "term", "weight")).alias("entries"))
        .mapInArrow(_blocks, "block int, terms array<long>, dfs array<long>, docs binary")
    )
    queries = keep(queries, "queries")
    # every slice meets every block of queries; the blocks are copied once for each task that searches
    tasks = min(count, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    task = F.pmod("slice", F.lit(tasks)).cast("int").alias("task")
    copies = queries.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    numbers = slices.select("slice", task, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    streamed = slices.select("slice", F.lit(-1).alias("block"), "terms", "dfs", "docs", "postings").unionByName(
        numbers.join(copies, ["task", "block"]).select("slice", "block", "terms", "dfs", "docs", F.lit(None).cast("binary").alias("postings"))
    )
    found = (
        streamed.repartitionById(tasks, task)
        .sortWithinPartitions("slice", "block")
        .mapInArrow(_search(k, n, size), "item long, id long, score long")
    )
    best = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= k) & (F.col("score") > 0))
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
