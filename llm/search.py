"""Exact top-k search by BM25: inverted index per shard with block-max pruning.

Documents are dealt to shards of bounded size by a hash. A task has some shards and reads the queries once, in blocks
that share their terms. One shard after the other is indexed and meets all blocks; the k best scores of a query so far
are its threshold in the next shard. Documents of a shard that fall into groups without much in common, such as
languages, get an index each. The postings of rare terms are added up; for frequent terms block maxima (over
``BLOCK`` documents, like ones side by side) are added first, for many queries in one matrix product. Blocks that cannot
reach the threshold with the best of their rare parts are skipped (the pivot test of block-max WAND, on all documents
of a shard at once); for the others a second product gives the frequent part of each document. These sums are of single
precision and their largest error is allowed for: whatever may reach the threshold is scored in full from its own terms.
Document frequencies, count and mean length are those of the whole table, so scores are equal in every shard and the
merge is exact.

A term is a run of letters and digits (and all non-ASCII), A-Z folded. A query
is the set of terms of its text; each counts once. Score: sum over common terms of
idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)), with
idf = ln(1 + (n - df + 0.5) / (df + 0.5)). Scores are rounded to 6 places before they
rank; ties go to the smaller id.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.packed import by_group, gather, pack, spread, unpack
from llm.scratch import blocks, keep
from llm.words import PUNCTUATION, mix, words

K1, B = 1.2, 0.75
SHARD, BLOCK, QUERIES = 12_000, 16, 128
SHARDS = 16  # searched by one task at most; fewer where cores would stay idle
ASKED, ASKED_BYTES = 4_000, 6_000_000  # queries of a block, by number and by bytes of their texts
FREQUENT, LONG = 1 / 10, 100
PART, APART = 1_000, 0.8  # documents of an index at least; share of the variance between two that stand apart
HELD = 100_000  # queries whose best documents a task remembers before it hands them on
_SLACK, _TINY = 1e-5, 1e-30


def postings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of every text, sorted by row and term, and the number of terms of each text."""
    rows, terms, counts, sizes = [], [], [], []
    for w in words(texts, lower=True, breaks=PUNCTUATION):
        order = np.lexsort((w.hash, w.row))
        row, term = w.row[order], w.hash[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
        at = np.flatnonzero(new)
        rows.append((row[at] + w.first).astype(np.int32))
        terms.append(term[at])
        counts.append(np.diff(np.append(at, len(row))).astype(np.int32))
        sizes.append(np.diff(w.begin))
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in (rows, terms, counts, sizes))


def _frequencies(groups: int):
    """Terms of a batch with the number of its documents that hold them, packed by term range.

    Range -1 holds the number of its documents and that of their terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, terms, _, sizes = postings(batch.column(0))
            every, count = np.unique(terms, return_counts=True)
            group = spread(every, groups)
            parts = [(-1, pack(np.array([batch.num_rows]), np.array([sizes.sum()])))]
            parts += [(g, pack(every[r], count[r])) for g, r in by_group(group)]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["grp", "part"])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, terms = gather(batch.column(0).to_pylist(), np.int64, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([int(terms.sum())])], ["n", "terms"])


def _asked(groups: int):
    """Terms of each query, packed by term range; queries without terms vanish."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, terms, _, _ = postings(batch.column(1))
            ids = batch.column(0).to_numpy()[rows] if len(rows) else np.zeros(0, np.int64)
            order = np.argsort(terms, kind="stable")
            terms, ids = terms[order], ids[order]
            parts = [(g, pack(terms[r], ids[r])) for g, r in by_group(spread(terms, groups))]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["grp", "part"])

    return run


def _weigh(count: int):
    """Of one term range: each query's terms with their document frequency, packed by block of queries."""

    def run(asked: pa.Table, counted: pa.Table) -> pa.Table:
        terms, ids = gather(asked["part"].to_pylist(), np.uint64, np.int64)
        seen, times = gather(counted["part"].to_pylist(), np.uint64, np.int64)
        every, back = np.unique(seen, return_inverse=True)
        df = np.bincount(back, times, len(every)) if len(every) else np.zeros(0)
        at = np.minimum(np.searchsorted(every, terms), max(len(every) - 1, 0))
        held = every[at] == terms if len(every) else np.zeros(len(terms), bool)
        terms, ids, df = terms[held], ids[held], df[at[held]]
        block = (mix(ids.view(np.uint64)) % np.uint64(count)).astype(np.int64)
        order = np.lexsort((terms, ids, block))
        block, terms, ids, df = block[order], terms[order], ids[order], df[order].astype(np.int64)
        new = np.ones(len(terms), bool)  # a term counts once, also where several rows of a query hold it
        new[1:] = (terms[1:] != terms[:-1]) | (ids[1:] != ids[:-1])
        block, terms, ids, df = block[new], terms[new], ids[new], df[new]
        parts = [(q, pack(ids[r], terms[r], df[r])) for q, r in by_group(block)]
        return pa.table({"block": pa.array([q for q, _ in parts], pa.int64()), "part": pa.array([p for _, p in parts], pa.binary())})

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of queries: its terms with their frequencies, its queries with their sizes, and the place of each query's terms."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids, terms, df = gather(batch["parts"][row].as_py(), np.int64, np.uint64, np.int64)
            every, first, at = np.unique(terms, return_index=True, return_inverse=True)
            order = np.lexsort((at, ids))
            queries, sizes = np.unique(ids, return_counts=True)
            parts = [pack(every, df[first]), pack(queries, sizes), pack(at[order].astype(np.int32))]
            block = batch["block"][row].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([parts], pa.list_(pa.binary()))], ["block", "parts"])


class Best:
    """The k best (score, id) of a query so far; of equal scores the smaller id is better."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]

    @property
    def least(self) -> float:
        """What a score must reach to be among them."""
        return float(self.scores[-1]) if len(self.scores) == self.k else 0.0


def indexes(ids: np.ndarray, texts: pa.Array, mean: float, part: int = PART) -> list[Index]:
    """The inverted indexes of one shard: one for each group of like documents that stands apart, of at least ``part`` documents."""
    rows, terms, tf, sizes = postings(texts)
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes / mean)[rows]) if len(rows) else np.zeros(0)
    del tf
    by_term = np.argsort(terms, kind="stable").astype(np.int32)
    terms = terms[by_term]
    new = np.ones(len(terms), bool)
    new[1:] = terms[1:] != terms[:-1]
    held = np.empty(len(rows), np.int32)
    held[by_term] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    terms = terms[new]
    often = np.bincount(held, minlength=len(terms)) > FREQUENT / 2 * len(ids)
    there = np.zeros((len(ids), int(often.sum())), np.float32)
    common = np.flatnonzero(often[held])
    there[rows[common], (np.cumsum(often) - 1)[held[common]]] = 1
    del common
    groups = _groups(there, part)
    del there
    out = []
    for group in groups:
        member = np.zeros(len(ids), bool)
        member[group] = True
        use = member[rows]
        number, where = (np.cumsum(x, dtype=np.int32) - np.int32(1) for x in (member, use))
        out.append(Index(ids[member], number[rows[use]], terms, held[use], impact[use], where[by_term[use[by_term]]]))
    return out


class Index:
    """Inverted index of like documents; they are numbered so that those most alike stand together.

    ``rows``, ``held`` and ``impact``: the document of each posting, its place in ``terms`` and its impact, by document and term;
    ``by_term``: the order of postings by term and document.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, held: np.ndarray, impact: np.ndarray, by_term: np.ndarray,
                 block: int = BLOCK, frequent: float = FREQUENT):
        df = np.bincount(held, minlength=len(terms))
        self.terms, self.begin = terms[df > 0], np.append(0, np.cumsum(df[df > 0]))
        often = np.flatnonzero(np.diff(self.begin) > frequent * len(ids))
        self.place = np.full(len(self.terms), -1)
        self.place[often] = np.arange(len(often))
        # the terms of each document, with their impacts
        self.held = (np.cumsum(df > 0, dtype=np.int32) - np.int32(1))[held]
        self.impact, self.first = impact, np.searchsorted(rows, np.arange(len(ids) + 1))
        # frequent terms: the impacts of each document, and the largest ones of each block
        rows, impact = rows[by_term], impact[by_term].astype(np.float32)
        del by_term
        dense = np.zeros((len(ids), len(often)), np.float32)
        for k, t in enumerate(often.tolist()):
            run = slice(self.begin[t], self.begin[t + 1])
            dense[rows[run], k] = impact[run]
        self.order = _by_likeness(dense)
        self.ids, self.dense = ids[self.order], dense[self.order]
        del dense
        self.edges = np.arange(0, len(ids), block)
        self.most = np.maximum.reduceat(self.dense, self.edges, axis=0) if len(ids) else self.dense
        # the other terms: the document and the rounded impact of a posting side by side, so that a list of them is copied at once;
        # long lists, which most queries read, stand together
        number = np.empty(len(ids), np.int32)
        number[self.order] = np.arange(len(ids))
        size = np.diff(self.begin)
        size[often] = 0
        lists = np.argsort(-size, kind="stable")
        where = _spans(self.begin[lists], self.begin[lists] + size[lists])[0].astype(np.int32)
        self.stop = np.empty(len(size), np.int64)
        self.stop[lists] = np.cumsum(size[lists])
        self.begin = self.stop - size
        self.pairs = np.empty((len(where), 2), np.int32)
        self.pairs[:, 0], self.pairs[:, 1] = number[rows[where]], impact.view(np.int32)[where]
        self.weighed = np.zeros(len(self.terms), bool)

    def _weigh(self, at: np.ndarray, idf: np.ndarray) -> None:
        """Turn the rounded impacts of terms into scores. A term has one idf in all queries, so this is done once."""
        fresh = ~self.weighed[at]
        at, idf = at[fresh], idf[fresh]
        self.weighed[at] = True
        rounded = self.pairs.view(np.float32)
        for first in range(0, len(at), 4096):
            some = at[first : first + 4096]
            where, size = _spans(self.begin[some], self.stop[some])
            rounded[where, 1] *= np.repeat(idf[first : first + 4096], size).astype(np.float32)

    def search(self, terms: np.ndarray, idf: np.ndarray, sizes: np.ndarray, entries: np.ndarray, best: list[Best]) -> int:
        """Bring ``best``, one for each query, up to date with this shard; returns how many documents were scored in full.

        ``terms`` are those of all queries, each with its ``idf``; a query has the next ``sizes`` of ``entries``, places in ``terms``.
        Documents without a common term never rank.
        """
        if not len(self.terms) or not len(terms):
            return 0
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        held = self.terms[at] == terms
        place = np.where(held, self.place[at], -1)
        rare = held & (place < 0)
        self._weigh(at[rare], idf[rare])
        starts, stops = self.begin[at], self.stop[at]
        ends = np.cumsum(sizes)
        weights = np.zeros((len(sizes), self.dense.shape[1]), np.float32)
        often = np.flatnonzero(place[entries] >= 0)
        weights[np.repeat(np.arange(len(sizes)), sizes)[often], place[entries[often]]] = idf[entries[often]]
        bounds = weights @ self.most.T
        # queries that are best served by the same block are like each other and are done together
        order = np.argsort(bounds.argmax(axis=1), kind="stable")
        where, size = _spans((ends - sizes)[order], ends[order])
        asked, of = entries[where], np.repeat(np.arange(len(order)), size)
        asked, of = asked[rare[asked]], of[rare[asked]]
        long = (stops - starts > LONG)[asked]
        short, of_short, long, of_long = asked[~long], of[~long], asked[long], of[long]
        short_cuts = np.searchsorted(of_short, np.arange(0, len(order) + QUERIES, QUERIES)).tolist()
        long_cuts = np.searchsorted(of_long, np.arange(len(order) + 1)).tolist()
        lists, done = self.pairs.view(np.int64)[:, 0], 0
        for chunk, first in enumerate(range(0, len(order), QUERIES)):
            some = order[first : first + QUERIES].tolist()
            # short lists of all these queries at once, long ones query by query
            run = slice(short_cuts[chunk], short_cuts[chunk + 1])
            where, size = _spans(starts[short[run]], stops[short[run]])
            pairs = lists[where].view(np.int32).reshape(-1, 2)
            cell = np.repeat((of_short[run] - first) * len(self.ids), size) + pairs[:, 0]
            part = np.bincount(cell, pairs.view(np.float32)[:, 1], len(some) * len(self.ids)).astype(np.float32).reshape(len(some), -1)
            for j, row in enumerate(part):
                e = long[long_cuts[first + j] : long_cuts[first + j + 1]]
                if len(e):
                    pairs = np.concatenate([lists[a:b] for a, b in zip(starts[e].tolist(), stops[e].tolist(), strict=True)])
                    row += np.bincount(pairs.view(np.int32)[::2], pairs.view(np.float32)[1::2], len(row))
            for j, docs in self._reach(part, weights[some], bounds[some], [best[q] for q in some]):
                q = some[j]
                e = entries[ends[q] - sizes[q] : ends[q]]
                e = e[held[e]]
                scores = np.round(self._score(self.order[docs].tolist(), at[e].astype(np.int32), idf[e]), 6)
                best[q].add(scores[scores > 0], self.ids[docs[scores > 0]])
                done += len(docs)
        return done

    def _reach(self, part: np.ndarray, weights: np.ndarray, bounds: np.ndarray, best: list[Best]) -> Iterator[tuple[int, np.ndarray]]:
        """The documents that can be among the best of each query by what rare terms give: blocks by their maxima, then documents."""
        # sums of positive products in single precision are right to this share of them
        near = 2.0**-23 * (weights.shape[1] + 8)
        least = np.array([b.least for b in best])
        cut = np.maximum(least * (1 - near) - _SLACK, _TINY)
        need = (bounds * (1 + near) + np.maximum.reduceat(part, self.edges, axis=1) >= cut[:, None]).any(axis=0)
        found = []
        for a, b in _runs(need, 4):
            docs = slice(int(self.edges[a]), int(self.edges[b]) if b < len(self.edges) else len(self.ids))
            about = weights @ self.dense[docs].T
            about += part[:, docs]
            found.append((docs.start, about))
        # where much is left, as if nothing was found before, the k-th best here is a threshold too
        left = sum(((about >= cut.astype(np.float32)[:, None]).sum(axis=1) for _, about in found), np.zeros(len(best), np.int64))
        for j in np.flatnonzero(left > 2 * np.array([b.k for b in best])).tolist():
            every, k = np.concatenate([about[j] for _, about in found]), best[j].k
            cut[j] = max(cut[j], np.partition(every, len(every) - k)[len(every) - k] * (1 - 3 * near) - _SLACK)
        hits = [(*np.nonzero(about >= cut.astype(np.float32)[:, None]), a) for a, about in found]
        q, doc = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in ([q for q, _, _ in hits], [doc + a for _, doc, a in hits]))
        order = np.argsort(q, kind="stable")
        for j, r in by_group(q[order]):
            yield j, doc[order[r]]

    def _score(self, rows: list[int], terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Scores in full; ``terms`` ascend, and so do those of a document."""
        scores = np.zeros(len(rows))
        for place, row in enumerate(rows):
            run = slice(self.first[row], self.first[row + 1])
            held, impact = self.held[run], self.impact[run]
            if len(held):
                at = np.minimum(np.searchsorted(held, terms), len(held) - 1)
                both = np.flatnonzero(held[at] == terms)
                scores[place] = impact[at[both]] @ idf[both]
        return scores


def _spans(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some ranges, one range after the other, and the sizes of the ranges."""
    size = stops - starts
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - size), size), size


def _runs(there: np.ndarray, gap: int) -> Iterator[tuple[int, int]]:
    """Ranges that hold all true places; those with less than ``gap`` places between them are one."""
    at = np.flatnonzero(there)
    if len(at):
        cuts = np.flatnonzero(np.diff(at) > gap)
        yield from zip(at[np.append(0, cuts + 1)].tolist(), (at[np.append(cuts, len(at) - 1)] + 1).tolist(), strict=True)


def _by_likeness(dense: np.ndarray, least: int = 256, rounds: int = 6) -> np.ndarray:
    """An order of rows in which like ones stand together: halves along the direction in which rows differ most, again and again."""
    there, order = (dense > 0).astype(np.float32), np.arange(len(dense))
    todo = [(0, len(dense))]
    while todo:
        a, b = todo.pop()
        if b - a <= least or not there.shape[1]:
            continue
        some = there[order[a:b]]
        some -= some.mean(axis=0)
        axis = np.linspace(-1, 1, there.shape[1], dtype=np.float32)
        for _ in range(rounds):
            axis = (some @ axis) @ some
            axis /= max(float(np.abs(axis).max()), 1e-30)
        order[a:b] = order[a:b][np.argsort(some @ axis, kind="stable")]
        todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return order


def _groups(there: np.ndarray, least: int, rounds: int = 12) -> list[np.ndarray]:
    """Rows parted where they fall into two heaps along the direction in which they differ most; no group is smaller than ``least``.

    ``there`` is brought to rows of length one.
    """
    there /= np.sqrt(np.maximum(there.sum(axis=1, keepdims=True), 1))
    todo, done = [np.arange(len(there))], []
    while todo:
        rows = todo.pop()
        if len(rows) < 2 * least or not there.shape[1]:
            done.append(rows)
            continue
        some = there[rows]
        some -= some.mean(axis=0)
        axis = np.linspace(-1, 1, there.shape[1], dtype=np.float32)
        for _ in range(rounds):
            axis = (some @ axis) @ some
            axis /= max(float(np.abs(axis).max()), _TINY)
        along = (some @ axis).astype(np.float64)
        order = np.argsort(along, kind="stable")
        sums, left = np.cumsum(along[order])[:-1], np.arange(1, len(rows))
        # the share of the variance that lies between both sides; 0.64 for a bell, 0.75 for a level heap
        between = sums**2 / (left * (len(rows) - left)) / max(float(along @ along), _TINY) * len(rows)
        between[: least - 1] = between[len(rows) - least :] = 0
        cut = int(between.argmax())
        if between[cut] > APART:
            todo += [rows[order[: cut + 1]], rows[order[cut + 1 :]]]
        else:
            done.append(rows)
    return done


def _search(k: int, n: int, mean: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        found: dict[int, Best] = {}

        def search(blocks: IO[bytes]) -> None:
            parts = _indexes(held, mean)
            blocks.seek(0)
            for known, asked, entries in _load(blocks):
                terms, df = unpack(known, np.uint64, np.int64)
                queries, sizes = unpack(asked, np.int64, np.int64)
                (entries,) = unpack(entries, np.int32)
                best = [found.setdefault(q, Best(k)) for q in queries.tolist()]
                for index in parts:
                    index.search(terms, np.log(1 + (n - df + 0.5) / (df + 0.5)), sizes, entries, best)

        def out() -> pa.RecordBatch:
            queries = np.repeat(np.array(list(found), np.int64), [len(b.ids) for b in found.values()])
            ids, scores = (np.concatenate([getattr(b, x) for b in found.values()]) for x in ("ids", "scores"))
            return pa.RecordBatch.from_arrays([pa.array(queries), pa.array(ids), pa.array(scores)], ["query_id", "id", "score"])

        # all blocks of queries come first; they wait in a file and meet one shard after the other
        with tempfile.TemporaryFile() as blocks:
            for batch in batches:
                for group in _pieces(batch):
                    if group["kind"][0].as_py() == 0:
                        for row in range(group.num_rows):
                            pickle.dump(group["parts"][row].as_py(), blocks)
                        continue
                    if group["shard"][0].as_py() != shard:
                        if held:
                            search(blocks)
                        shard = group["shard"][0].as_py()
                        if len(found) >= HELD:
                            yield out()
                            found.clear()
                    held.append(group)
            if held:
                search(blocks)
        if found:
            yield out()

    return run


def _indexes(held: list[pa.RecordBatch], mean: float) -> list[Index]:
    """The indexes of some rows, which are let go."""
    table = pa.Table.from_batches(held).select(["id", "text"])
    held.clear()
    ids, texts = table["id"].to_numpy(), table["text"].combine_chunks()
    del table
    return indexes(ids, texts, mean)


def _load(file: IO[bytes]) -> Iterator[list[bytes]]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one shard and kind."""
    key = batch["shard"].to_numpy().astype(np.int64) * 2 + batch["kind"].to_numpy()
    for _, rows in by_group(key):
        yield batch.slice(rows.start, rows.stop - rows.start)


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """``(query_id, rank, id, score)``: the k best rows of ``docs`` for each row of ``queries`` (same columns).

    Null and empty texts hold no terms: such documents are never found and such
    queries find nothing. Rows with a null id take no part. Documents that repeat an id
    rank as often as they stand there; of queries that repeat an id the terms join.
    Fewer than k rows come back if fewer share a term. Other columns are not read.
    """
    spark = docs.sparkSession
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")  # noqa: E731,E501
    base, asked, groups = pick(docs), pick(queries), blocks(spark)
    counted = keep(base.select("text").mapInArrow(_frequencies(groups), "grp int, part binary"), "term-counts")
    totals = counted.filter("grp = -1").select("part").mapInArrow(_totals, "n long, terms long")
    total = totals.agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    n, mean = total["n"] or 0, max((total["terms"] or 0) / max(total["n"] or 0, 1), 1.0)
    shards = max(1, -(-n // shard))
    # every task reads all queries once, for all of its shards
    tasks = max(-(-shards // SHARDS), min(shards, 2 * spark.sparkContext.defaultParallelism))
    size = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    many = max(1, -(-size["n"] // ASKED), -(-(size["bytes"] or 0) // ASKED_BYTES))
    wanted = asked.mapInArrow(_asked(groups), "grp int, part binary")
    weighed = wanted.groupBy("grp").cogroup(counted.filter("grp >= 0").groupBy("grp")).applyInArrow(_weigh(many), "block long, part binary")
    gathered = weighed.groupBy("block").agg(F.collect_list("part").alias("parts"))
    ready = keep(gathered.mapInArrow(_blocks, "block long, parts array<binary>"), "query-terms")
    number = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    streamed = base.select(
        F.pmod(number, F.lit(tasks)).alias("task"), F.lit(1).alias("kind"), number.alias("shard"),
        "id", "text", F.lit(None).cast("array<binary>").alias("parts"),
    ).unionByName(
        ready.select(
            F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"),
            F.lit(0).alias("kind"), F.lit(-1).alias("shard"), F.col("block").alias("id"), F.lit(None).cast("string").alias("text"), "parts",
        )
    )
    found = (
        streamed.repartitionById(tasks, F.col("task"))
        .sortWithinPartitions("kind", "shard", "id", "text")
        .mapInArrow(_search(k, n, mean), "query_id long, id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
