"""The registered queries over whole small tables, against brute force, libraries and what the contracts fix."""

import hashlib
import zlib

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from llm import oracle, queries
from tests.compare import connect, differences
from tests.llm import brute
from tests.llm.test_licenses import expected as licence_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    table = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text", "lang"])
    return {r["doc_id"]: (r["text"], r["lang"]) for r in table.to_pylist()}


def rows(spark, name):
    return queries.queries()[name](spark, FOLDER).collect()


def test_all_operators_are_registered():
    numbers = {n[2:].split("_")[0] for n in queries.queries() if n.startswith("op")}
    assert numbers == {str(k) for k in range(1, 14)} and "pipeline" in queries.queries()


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_queries_with_sql(spark, name):
    assert differences(queries.queries()[name](spark, FOLDER), connect(FOLDER), oracle.SQL[name]) is None


def test_minhash(spark, docs):
    want = brute.near_duplicates({i: t for i, (t, _) in docs.items()}, 3, 85)
    found = rows(spark, "op2_minhash")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want and all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_search_asks_every_hundredth_row(spark, docs):
    texts = sorted((i, t) for i, (t, _) in docs.items())
    found = [(r.query_id, r["rank"], r.doc_id) for r in rows(spark, "op4_search")]
    assert sorted(found) == sorted(brute.bm25(texts, [q for q in texts if q[0] % 100 == 0], 10))


def test_chat_holds_every_conversation_and_the_probe(spark):
    turns: dict[int, list] = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in pq.read_table(f"{FOLDER}/conversations.parquet").to_pylist():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    found = {r.conv_id: r for r in rows(spark, "op5_chat")}
    assert set(found) == set(turns)
    for conv, said in turns.items():
        said.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in said)
        learned = "".join(text for _, role, text in said if role == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(said), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_substrings(spark, docs):
    want = {i: (n, gone, brute.sha(kept)) for i, n, gone, kept in brute.removed(sorted((i, t) for i, (t, _) in docs.items()))}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows(spark, "op6_substrings")} == want


def test_languages_of_held_out_rows(spark, docs):
    found = rows(spark, "op7_languages")
    assert len(found) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    judged = [(r.lang_pred, docs[r.doc_id][1]) for r in found if r.held_out and docs[r.doc_id][1]]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged) and all(0 <= r.score <= 1 for r in found)


def test_fingerprints_of_edited_texts(spark, docs):
    want = brute.edited([(i, t or "") for i, (t, _) in sorted(docs.items())])
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows(spark, "op9_spotsigs")} == want


def test_packing_holds_every_token(spark, docs):
    tokens = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want = set()
    for i, (text, _) in docs.items():
        ids = [*tokens.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want.add((i, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
    found = rows(spark, "op10_packing")
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == want and len(found) == len(want)
    fill: dict[int, list] = {}
    for r in found:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 1024 and sorted(o for o, _ in p)[0] == 0 for p in fill.values())


def test_licences(spark, docs):
    found = {r.doc_id: r for r in rows(spark, "op11_licenses")}
    some = [i for i, (t, _) in docs.items() if t and len(t) < 1500]
    for i in some[:60]:
        r = found[i]
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))
        assert got == licence_rows(docs[i][0]), i
    assert len(found) == len(docs)
