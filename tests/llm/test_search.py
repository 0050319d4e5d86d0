"""Search: how queries travel, and pruning by block maxima and thresholds, against plain scoring."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import search
from llm.search import Best, indexes, postings, top_k
from tests.llm import brute
from tests.llm.conftest import prose

SPARE = "spark.sql.shuffle.partitions"


def foreign(seed: int, n: int) -> str:
    return " ".join(w[::-1] + "o" for w in prose(seed, n).split())


@pytest.fixture(scope="module")
def mixed():
    """Two languages without common terms; some copies."""
    rows = [(k, (prose if k % 3 else foreign)(k % 150, 20 + k % 37)) for k in range(400)]
    return rows + [(401, None), (402, ""), (403, "stone")]


def test_queries_take_the_same_room_whatever_the_partitions(spark, mixed, monkeypatch):
    """They were cut into a part for each of twice the shuffle partitions, and unpacked so for every shard."""
    sizes, found, keep = [], [], search.keep

    def measured(df, name):
        kept = keep(df, name)
        if name == "query-terms":
            sizes.append(kept.agg(F.sum(F.expr("aggregate(parts, 0, (n, p) -> n + octet_length(p))"))).first()[0])
        return kept

    monkeypatch.setattr(search, "keep", measured)
    docs = spark.createDataFrame(mixed, "doc_id long, text string")
    before = spark.conf.get(SPARE)
    try:
        for partitions in ("1", "40"):
            spark.conf.set(SPARE, partitions)
            found.append(sorted(map(tuple, top_k(docs, docs.filter("doc_id % 10 = 0"), k=5).collect())))
    finally:
        spark.conf.set(SPARE, before)
    assert found[0] == found[1] and sizes[0] == sizes[1]


@pytest.mark.parametrize("shard", [9, 100, 10_000])
def test_several_shards_a_task(spark, mixed, shard):
    docs = spark.createDataFrame(mixed, "doc_id long, text string").repartition(3)
    got = top_k(docs, docs.filter("doc_id % 7 = 0"), k=6, shard=shard).collect()
    want = brute.bm25(mixed, [q for q in mixed if q[0] % 7 == 0], 6)
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got) == sorted(want)


@pytest.mark.parametrize("least", [20, 1000])
def test_few_documents_are_scored_in_full(mixed, least):
    """Over two shards, with thresholds that go on; all scores equal those of brute force."""
    rows = [(i, t) for i, t in mixed if t]
    mean = sum(len(t.split()) for _, t in rows) / len(rows)
    queries = [rows[7], rows[9], (-1, "stone the of"), (-2, "nosuchterm")]
    every, at = np.unique(postings(pa.array([t for _, t in queries]))[1], return_inverse=True)
    df = np.array([(postings(pa.array([t for _, t in rows]))[1] == e).sum() for e in every])
    idf = np.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
    lengths = np.array([len(set(t.split())) for _, t in queries])
    best, scored = [Best(4) for _ in queries], 0
    for part in (rows[::2], rows[1::2]):
        found = indexes(np.array([i for i, _ in part]), pa.array([t for _, t in part]), mean, part=least)
        assert sum(len(x.ids) for x in found) == len(part) and (len(found) > 1) == (least < 100)
        scored += sum(x.search(every, idf, lengths, at.astype(np.int32), best) for x in found)
    want = brute.bm25(rows, queries, 4)
    assert [(q, r + 1, i) for (q, _), b in zip(queries, best, strict=True) for r, i in enumerate(b.ids.tolist())] == want
    assert all(math.isclose(x, round(x, 6)) for b in best for x in b.scores) and len(best[3].ids) == 0
    assert scored < len(rows) // 4


def test_long_and_short_lists_give_the_same(mixed, monkeypatch):
    texts = pa.array([t for _, t in mixed])
    _, terms, _, _ = postings(texts)
    every, df = np.unique(terms, return_counts=True)
    rows, asked, _, _ = postings(texts.slice(0, 60))
    entries, sizes = np.searchsorted(every, asked).astype(np.int32), np.bincount(rows, minlength=60)
    idf = np.log(1 + (len(mixed) - df + 0.5) / (df + 0.5))
    seen = []
    for long, frequent in ((0, 0.1), (5, 0.9), (10**9, 0.3)):
        monkeypatch.setattr(search, "LONG", long)
        monkeypatch.setattr(search.Index.__init__, "__defaults__", (4, frequent))
        best = [Best(5) for _ in sizes]
        for index in indexes(np.arange(len(mixed)), texts, 30.0, part=50):
            index.search(every, idf, sizes, entries, best)
        seen.append([(b.ids.tolist(), b.scores.tolist()) for b in best])
    assert seen[0] == seen[1] == seen[2]


def test_likeness_keeps_every_document_and_parts_languages():
    rng = np.random.default_rng(5)
    kind = rng.integers(0, 2, 1000)
    dense = (rng.random((1000, 40)) < np.where(np.arange(40)[None, :] // 20 == kind[:, None], 0.5, 0.02)).astype(np.float32)
    order = search._by_likeness(dense, least=64)
    assert sorted(order.tolist()) == list(range(1000))
    assert np.abs(np.diff(kind[order])).sum() < 50 < np.abs(np.diff(kind)).sum()
    assert search._by_likeness(np.zeros((300, 0), np.float32)).tolist() == list(range(300))
