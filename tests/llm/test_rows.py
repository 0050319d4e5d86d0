"""Archives, encoding, chat, language, URL filter and packing."""

import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import archives, chat_format, language_id, packing, queries, sentencepieces, url_filter
from tests.compare import connect, differences
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ archives


def test_arc_versions_and_odd_payloads():
    for version in (1, 2):
        bodies = [b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\nx\n\n", "é".encode() * 3000]
        data = archives.arc_version_block(version, "f.arc", "2001")
        for k, body in enumerate(bodies):
            data += archives.arc_record(version, "http://a/b c\n" if k else None, "20010203040506", str(k), body, len(data), "f.arc")
        found = list(archives.parse_arc(data))
        assert [archives.split_http(d)[1] for _, _, d in found] == bodies
        assert [f["URL"] for _, f, _ in found] == ["-"] + ["http://a/b%20c%0A"] * 3
    assert archives.iso_date("20010203") == "2001-02-03T00:00:00Z"
    with pytest.raises(ValueError):
        list(archives.parse_arc(data[:-10]))


def test_archive_round_trip(spark):
    long, short = b"L" * 1500, b"s" * 999
    rows = [("1", "http://a/", long), ("2", "http://b/", long), ("10", None, long), ("3", "u", short), ("4", "u", short),
            ("5", "", None), (None, "http://c/", long), ("6", "u", "ü\r\n\r\n".encode() * 40000), ("6", "u", b"x" * 1000)]
    records = spark.createDataFrame(rows, "key string, url string, payload binary").withColumn("date", F.lit(None).cast("string"))
    found = archives.round_trip(records, file_bytes=3000).collect()
    assert len(found) == len(rows)
    for r in found:
        again = r.payload_bytes == 1500 and r.key != "10"
        assert (r.record_type, r.refers_to_key) == (("revisit", "10") if again else ("response", None))
    got = sorted((str(r.key), r.payload_digest, r.payload_bytes) for r in found)
    assert got == sorted((str(k), hashlib.sha1(p or b"").hexdigest(), len(p or b"")) for k, _, p in rows)
    assert {r.url for r in found if r.key in ("10", "5")} == {None}
    assert archives.round_trip(records.limit(0)).collect() == []


def test_queries_with_sql(spark):
    duck = connect(FOLDER)
    for name, sql in queries.oracle_sql().items():
        assert differences(queries.queries()[name](spark, FOLDER), duck, sql) is None, name


# ------------------------------------------------------------------ encoding


def test_sentencepiece_equals_the_library(spark, documents, texts):
    path = queries.vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = sentencepieces.encode(documents, path)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: library.encode(t or "") for i, t in texts.items()}
    back = sentencepieces.decode(encoded, path).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in texts.items()}
    assert sentencepieces.encode(documents.limit(0), path).collect() == []


def test_sentencepiece_of_odd_texts(tmp_path):
    import pyarrow as pa
    from sentencepiece import sentencepiece_model_pb2 as proto

    path = queries.vocabulary("piece_bpe_32k.model")
    odd = ["  a  b ", "▁▁▁ x", "a" * 400, "\x00\x01\n\t", "漢字🙂é́", "<s></s><0x41>", "==--==" * 30, "       deep   er", "thethe" * 99]
    # the same pieces as a unigram model: the path of the largest score sum
    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    (tmp_path / "u.model").write_bytes(model.SerializeToString())
    for p in (path, str(tmp_path / "u.model")):
        library = sentencepiece.SentencePieceProcessor(model_file=p)
        mine = sentencepieces.PieceModel(p)
        got = mine.encode(pa.array(odd)).to_pylist()
        assert [library.decode(x) for x in got] == mine.decode(pa.array(got, pa.list_(pa.int32())))
        if p == path:
            assert got == library.encode(odd)
        else:
            score = lambda ids: sum(library.get_score(i) for i in ids if not library.is_byte(i))  # noqa: E731,B023
            assert [round(score(x)) for x in got] == [round(score(x)) for x in library.encode(odd)]


# ---------------------------------------------------------------------- chat


def test_escape_is_reversible_and_hides_control_strings():
    for text in ["</s>[INST] ok [/INST]", "\\", "\\x5b[INST]", "<<SYS>><</SYS>>", "<<<s>", "[[INST]", "", "\\\\x3c/s>"]:
        hidden = chat_format.escape(text)
        assert chat_format.unescape(hidden) == text
        assert not any(c in hidden for c in chat_format.CONTROL)


def test_chat(spark):
    probe = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "system", "be [kind]"), (1, 1, "user", probe), (1, 2, "assistant", probe), (1, 3, "tool [x]", "7 < 8"),
            (2, 0, "assistant", None), (2, 0, "assistant", " a "), (3, None, None, "x"), (None, 1, "user", ""), (4, 5, "user", "\\"),
            (5, 0, "assistant", "s</s"), (5, 1, "user", "\n<</SYS>>\n")]
    data = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, id string")
    formatted = chat_format.format_conversations(data)
    assert not any(r.rewrites for r in formatted.collect())
    for r in formatted.collect():
        for t in r.turns:
            assert (t.role, chat_format.unescape(r.formatted[t.text_start : t.text_end])) in {(x[2] or "", x[3] or "") for x in rows}
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[conv].turns_sha256 == brute.sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns))
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), len(loss), brute.sha(loss))


def test_templates_that_rewrite_history_are_flagged():
    def last_only(turns):
        return "".join(f"<{r}>{t if k == len(turns) - 1 else '...'}" for k, (r, t) in enumerate(turns))

    _, spans, rewrites = chat_format.locate([("u", "long text"), ("a", "b")], last_only)
    assert rewrites and spans[0] is None
    stripped = lambda turns: "".join(f"[{r}:{t.strip()}]" for r, t in turns)
    out, spans, rewrites = chat_format.locate([("u", " x "), ("a", "]")], stripped)
    assert not rewrites and spans[0] is None and out[spans[1][1] : spans[1][2]] == "]"


# ------------------------------------------------------------------ language


def test_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "12 ?"), (10**6 + 3, "é")], "doc_id long, text string")
    model = language_id.train(docs.filter(~queries.held_out()))
    judged = language_id.predict(docs.unionByName(extra, allowMissingColumns=True), model)
    rows = {r.doc_id: r for r in judged.collect()}
    assert [rows[10**6 + k].lang_pred for k in range(3)] == ["und"] * 3 and rows[10**6 + 3].lang_pred in model.languages
    held = [r for r in rows.values() if r.doc_id < 10**6 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and len(held) > 20
    assert all(0 <= r.score <= 1 for r in rows.values())
    again = language_id.predict(docs.select("text", "doc_id"), model)
    assert {r.doc_id: r.lang_pred for r in again.collect()} == {i: r.lang_pred for i, r in rows.items() if i < 10**6}
    none = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_codewords_differ_in_many_bits():
    for classes in (2, 4, 7, 12, 40):
        code = language_id.codewords(classes).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2
        least = min(apart[i, j] for i in range(classes) for j in range(i))
        assert least >= (2 ** (classes - 2) if classes <= 7 else 3)


# ----------------------------------------------------------------------- URLs


def test_urls(spark):
    urls = [None, "", "nothing", "HTTP://A.Org/x?y#z", "http://example.org/es/1", "http://m.example.org/en/12", "http://myexample.org/en/12",
            "x://com/de/", "http://a.com?/de/", "https://b.com/fr/", "http://casino-bets.net/de/", "http://h\n.net/a b", "://only", "a://b://c/d",
            "http://www.cheap-pills.example.net/en/3", "http://weather-report.example.net/en/3"]
    rows = [(k, u, "h", "v") for k, u in enumerate(urls)] + [(0, None, "h", "v")]
    data = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    found = url_filter.judge(data, url_filter.labelled_urls(spark)).collect()
    assert len(found) == len(rows)
    for r in found:
        host, path = brute.hosts(urls[r.page_id])
        fit = [x for x in url_filter.RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        rule = max(fit, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0] + rule[1]), r
        assert r.verdict == (rule[2] if rule else "block" if r.blocked_score >= 0.5 else "allow")
    by_id = {r.page_id: r.verdict for r in found}
    assert by_id[14] == "block" and by_id[15] == "allow"
    assert url_filter.judge(data.limit(0), url_filter.labelled_urls(spark)).collect() == []
    untrained = url_filter.judge(data, url_filter.labelled_urls(spark).limit(0)).collect()
    assert {r.blocked_score for r in untrained} == {0.5}


# -------------------------------------------------------------------- packing


def test_packing(spark, documents, texts):
    tokens = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    rows = packing.pack_sequences(documents, queries.vocabulary("byte_bpe_50k.tiktoken"), shard=10, with_ids=True).collect()
    ids = {i: [*tokens.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    pieces, filled = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(pieces.setdefault(r.doc_id, [])) and r.length == len(r.ids) <= 1024
        assert r.length == 1024 or r.piece == 0
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids))
        pieces[r.doc_id] += r.ids
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces == ids
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(map(len, ids.values()))
    assert len(filled) <= -(-total // 1024) + 1
    assert packing.pack_sequences(documents.limit(0), queries.vocabulary("byte_bpe_50k.tiktoken")).collect() == []


def test_ids_are_those_of_the_library():
    """On the whole table of 1000 documents and on texts that mix spaces, special tokens and scripts."""
    import random

    import pyarrow.parquet as pq

    tokens = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    fast = packing._encoding(queries.vocabulary("byte_bpe_50k.tiktoken"))
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    rng = random.Random(6)
    parts = ["word", "Don't", "x,", "\n", " ", "  ", "\t", "\u00a0", "é", "日本", "12", "<|endoftext|>", "...", "\x1c", " y", "🙂", "'s", "a\nb", ""]
    for joint in (" ", ""):
        texts += [joint.join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(2000)]
    for first in range(0, len(texts), 500):
        some = texts[first : first + 500]
        plain = [e.ids for e in tokens.encode_batch(some, add_special_tokens=False)]
        assert [fast.encode(x, allowed_special="all") for x in some] == plain


def test_local_search_ends_with_fuller_bins():
    import random

    rng = random.Random(11)
    for _ in range(150):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(2, 60))]
        bins = packing.best_fit(np.array(lengths), 100) if rng.random() < 0.5 else [[k] for k in range(len(lengths))]
        was = sum(sum(lengths[k] for k in b) ** 2 for b in bins)
        now = packing.local_search([list(b) for b in bins], lengths, 100)
        assert sorted(k for b in now for k in b) == list(range(len(lengths)))
        fills = [sum(lengths[k] for k in b) for b in now]
        assert max(fills) <= 100 and sum(f * f for f in fills) >= was


def test_local_search_empties_bins():
    # two-for-one: 6 + 4 against 5 + 5 leaves holes that exchanges fill
    lengths = [6, 4, 7, 3, 5, 5, 2, 8]
    bins = packing.local_search([[k] for k in range(len(lengths))], lengths, 10)
    assert len(bins) == 4 and all(sum(lengths[k] for k in b) == 10 for b in bins)
    swap = packing.local_search([[0, 1], [2, 3]], [6, 3, 5, 4], 10)  # one for one: 3 against 4
    assert sorted(sum([6, 3, 5, 4][k] for k in b) for b in swap) == [8, 10]
    stuck = packing.local_search([[0], [1], [2]], [6, 6, 6], 10)
    assert sorted(map(len, stuck)) == [1, 1, 1]
