"""Ranked search against plain scoring, and its range-maximum tables against plain maxima."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm.ranked_search import Peaks, rank
from tests.llm.brute import fold
from tests.llm.conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> list[str]:
    return TERM.findall(fold(text or ""))


def expected(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    """(item, rank, id, score) of every item."""
    known = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    known = [(i, c) for i, c in known if c]
    n, size = len(known), sum(sum(c.values()) for _, c in known)
    df = Counter(t for _, c in known for t in c)
    asked: dict[int, Counter] = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, query in asked.items():
        scored = []
        for i, c in known:
            m = 100 - 75 + (75 * sum(c.values()) * n) // size
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t, times in query.items()
                if c[t]
            )
            if score > 0:
                scored.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, terms string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, slice int")
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in rank(d, q, **options).collect())


@pytest.mark.parametrize("limit", [1_500, 1_000_000_000])
def test_rank(spark, texts, limit):
    docs = list(texts.items()) + [(3, prose(3, 40)), (3, prose(3, 40)), (None, prose(4, 50))]
    docs += [(1000 + k, prose(k % 7, 30 + k % 11)) for k in range(300)]  # many ties
    items = [(k, prose(k, 25) + " River river") for k in range(8)]
    items += [(8, None), (9, ""), (10, "nosuchterm"), (11, "stone"), (11, "stone river"), (None, "stone"), (12, "été ÉTÉ one"), (13, "the")]
    assert found(spark, docs, items, limit=limit) == expected(docs, items, 10)


def test_fewer_documents_than_ranks_and_none(spark):
    docs, items = [(1, "a b"), (2, "b c c"), (3, "")], [(1, "c c b"), (2, "z")]
    assert found(spark, docs, items, k=10) == expected(docs, items, 10)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    assert found(spark, docs, items, k=1) == expected(docs, items, 1)


def test_peaks():
    rng = random.Random(2)
    values = np.array([rng.randrange(9) for _ in range(200)])
    peaks = Peaks(values, 200)
    lo = np.array([a for a in range(200) for _ in range(a + 1, 201)])
    hi = np.array([b for a in range(200) for b in range(a + 1, 201)])
    assert peaks.find(lo, hi).tolist() == [a + int(np.argmax(values[a:b])) for a, b in zip(lo, hi, strict=True)]


def test_few_documents_are_scored():
    """A document that stands out is found without scoring all the others."""
    from llm.packed import pack
    from llm.ranked_search import Best, Index

    docs, rng = 20_000, np.random.default_rng(3)
    lists = [np.sort(rng.choice(docs, docs // 3, replace=False)) for _ in range(6)]
    row = np.concatenate(lists).astype(np.int32)
    tf = rng.integers(1, 3, len(row)).astype(np.int32)
    for k, members in enumerate(lists):
        at = sum(len(x) for x in lists[:k]) + np.searchsorted(members, [500, 501, 502])
        tf[at] = 40
    names = np.arange(6, dtype=np.uint64)
    index = Index(
        pack(np.arange(docs), np.full(docs, 100)), names, np.array([len(x) for x in lists]), pack(row, tf), names, docs, docs * 100
    )
    best = Best(1)
    scored = index.search(names, np.ones(6, np.int64), best, width=8)
    plain = np.bincount(index.row, index.impact, docs)
    assert best.scores[0] == plain.max() and best.ids[0] == int(np.argmax(plain)) and scored < docs // 4
