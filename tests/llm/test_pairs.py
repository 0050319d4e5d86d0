"""Near duplicates, substring dedup, fingerprints and search against brute force."""

import pytest

from llm import fingerprints
from llm.components import components
from llm.near_duplicates import near_duplicates, representatives
from llm.search import top_k
from llm.substring_dedup import COVER, PERIOD, remove_repeats
from tests.llm import brute
from tests.llm.conftest import prose


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(documents, texts, size, percent):
    want = brute.near_duplicates(texts, size, percent)
    rows = near_duplicates(documents, shingle=size, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_of_a_chain(spark):
    """Each text is like the next only; one component, though no star shows all links."""
    words = [f"w{k}" for k in range(130)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 60])) for k in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_duplicates(dict(rows), 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, shingle=3, percent=85).collect()} == want


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == []
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in found), key=str) == sorted(
        [(None, None, True)] * 2 + [(4, 4, True)] * 2 + [(5, 4, False)], key=str
    )


def test_representatives_keep_columns(documents, texts):
    left = representatives(documents)
    want = {i for i, (_, c) in brute.near_duplicates(texts, 5, 80).items() if i == c}
    assert {r.doc_id for r in left.collect()} == want and left.columns == documents.columns


def test_small_sets_are_densified_like_large_ones():
    """Sketches agree in as many bins as the sets are alike, with 1, 2 or few filled bins too; no bin stays empty."""
    import numpy as np

    from llm.minhash_sets import sketches

    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 6, 12, 60):
        shared, alike = [], []
        for _ in range(300):
            both = rng.integers(1, 2**63, size, dtype=np.uint64)
            one, two = (np.append(both, rng.integers(1, 2**63, rng.integers(0, size + 1), dtype=np.uint64)) for _ in range(2))
            out = sketches(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]), 240)
            assert (out != 0xFFFFFFFFFFFFFFFF).all() and set(out[0].tolist()) <= set(sketches(one, np.array([0, len(one)]), 240)[0].tolist())
            shared.append((out[0] == out[1]).mean())
            alike.append(size / (len(one) + len(two) - size))
        assert abs(np.mean(shared) - np.mean(alike)) < 0.04, size


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (8, 7), (7, 7), (9, 5)], "u long, v long")
    assert {(r.node, r.component) for r in components(links).collect()} == {
        (5, 3), (4, 3), (3, 3), (9, 3), (8, 7), (7, 7)
    }


def test_cover_brings_any_two_places_together():
    for a in range(PERIOD):
        for b in range(PERIOD):
            assert any((a + k) % PERIOD in COVER and (b + k) % PERIOD in COVER for k in range(PERIOD))


def test_substrings(documents, texts):
    rows = remove_repeats(documents, columns=documents.columns)
    want = brute.removed(sorted(texts.items()))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_words) for r in rows.collect()) == want
    assert sum(w[2] for w in want) > 500
    kept = {(r.doc_id, r.text, r.lang, r.block, r.kind, r.c0) for r in rows.collect()}
    assert kept == {(r.doc_id, r.text, r.lang, r.block, r.kind, r.c0) for r in documents.collect()}


def test_substrings_of_repeated_rows_and_null_ids(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(None, passage), (None, passage), (7, passage), (7, passage), (8, "q " * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in remove_repeats(docs).collect())
    assert found == [("7", 30, 30), ("7", 30, 30), ("8", 25, 24), ("None", 30, 0), ("None", 30, 30)]
    assert remove_repeats(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        remove_repeats(docs, window=10)


def test_edited_pairs(spark, documents, texts):
    for parts in (1, 5):
        rows = fingerprints.edited_pairs(documents, parts=parts).collect()
        want = brute.edited([(i, t or "") for i, t in sorted(texts.items())])
        assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == want
        by_text = {}
        for r in rows:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            assert by_text.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint
    one = spark.createDataFrame([(1, "the river the stone the light"), (None, "of water")], "doc_id long, text string")
    assert {r.doc_id: r.near_next for r in fingerprints.edited_pairs(one).collect()} == {1: 1.0, None: 0.0}
    assert fingerprints.edited_pairs(one.limit(0)).collect() == []


def test_alike_finds_all_pairs(spark):
    rows = [(10 * k, prose(k, 300)) for k in range(6)]
    rows += [(i + j, " ".join(t.split()[: 300 - 9 * j] + ["river"] * j)) for i, t in rows for j in range(1, 7)]
    rows += [(90, None), (91, "river stone"), (92, "river stone")]
    spots = fingerprints.spot_signatures(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = {r.fingerprint: set(r.signatures) for r in spots.collect() if r.signatures}
    want = {
        tuple(sorted((a, b)))
        for a in sets
        for b in sets
        if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    }
    got = [tuple(sorted((r.fingerprint, r.other))) for r in fingerprints.alike(spots, least=0.8).collect()]
    assert sorted(got) == sorted(want) and want


def test_search(documents, texts):
    rows = [(i, t) for i, t in sorted(texts.items())]
    queries = documents.filter("doc_id % 10 = 0")
    got = top_k(documents, queries, k=4, shard=7)
    want = brute.bm25(rows, [(i, t) for i, t in rows if i % 10 == 0], 4)
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got.collect()) == sorted(want)
    assert top_k(documents.limit(0), queries).collect() == []
    assert top_k(documents, queries.limit(0)).collect() == []


def test_repeated_query_rows_count_their_terms_once(spark):
    docs = spark.createDataFrame([(k, prose(k, 30) + (" rareword" if k == 3 else "")) for k in range(40)], "doc_id long, text string")
    once = spark.createDataFrame([(1, "stone rareword river")], "doc_id long, text string")
    assert sorted(map(tuple, top_k(docs, once).collect())) == sorted(map(tuple, top_k(docs, once.unionByName(once)).collect()))
