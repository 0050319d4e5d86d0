"""Token alignment against plain counting, and its perfect hash."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from llm import token_alignment
from llm.packed import pack
from llm.perfect_hash import PerfectHash
from llm.queries import vocabulary
from llm.token_alignment import Alignment, align
from tests.llm.conftest import prose

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def byte_level() -> dict[str, int]:
    out, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def expected(docs: list[tuple]) -> list[tuple]:
    import sentencepiece
    from tokenizers import Tokenizer

    one, chars = Tokenizer.from_file(A), byte_level()
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    groups_of = []
    for _, text in docs:
        groups: list = []
        if text:
            a = one.encode(" " + text, add_special_tokens=False).ids
            b = two.encode(text)
            bytes_a = [bytes(chars[c] for c in one.id_to_token(i)) for i in a]
            bytes_b = []
            for i in b:
                piece = two.id_to_piece(i)
                bytes_b.append(bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode())
            if b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
                i = j = at_a = at_b = 0
                ga, gb = [], []
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        ga.append(a[i])
                        at_a += len(bytes_a[i])
                        i += 1
                    else:
                        gb.append(b[j])
                        at_b += len(bytes_b[j])
                        j += 1
                    if at_a == at_b:
                        groups.append((ga, gb))
                        ga, gb = [], []
        groups_of.append(groups)
    counts = Counter()
    for groups in groups_of:
        counts.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    most: dict[int, int] = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (doc, _), groups in zip(docs, groups_of, strict=True):
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        joined = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append(
            (
                doc,
                sum(len(ga) for ga, _ in groups),
                sum(len(gb) for _, gb in groups),
                len(groups),
                len(links),
                sum(counts[p] == most[p[0]] for p in links),
                sum(counts[p] for p in links),
                hashlib.sha256(joined.encode()).hexdigest() if groups else "",
            )
        )
    return out


def found(spark, docs, **options):
    rows = align(spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, a int, bucket string"), A, B, **options)
    return [tuple(r) for r in rows.collect()]


@pytest.mark.parametrize("block", [2_000, 4_000_000])
def test_align(spark, texts, block, monkeypatch):
    docs = list(texts.items()) + [(3, texts[3]), (None, "null id"), (None, None)]
    docs += [
        (100, " leading and trailing "),
        (101, "<|endoftext|> <s> </s> <0x41>"),
        (102, "a▁b"),
        (103, "日本語のテキスト 🙂🙂 naïve ﬁ ﷺ"),
        (104, "\x00\x01 nul"),
        (105, "=" * 3000 + " " * 500 + "\t\n\r\n" * 40),
        (106, "Ünïcödé" * 200),
        (107, "x" * 5000),
    ]
    docs += [(200 + k, prose(k % 5, 40)) for k in range(60)]
    assert sorted(found(spark, docs, block=block), key=str) == sorted(expected(docs), key=str)


def test_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("limit", [1, 7, 50, 10_000])
def test_links_in_any_portions(limit, monkeypatch):
    """Groups and documents larger than a portion give the same links and pairs."""
    rng = np.random.default_rng(4)
    width = np.array([1, 2, 3, 5])
    sizes, a, b = [], [], []
    for _ in range(12):
        x = rng.integers(0, 4, rng.integers(0, 30))
        rest, y = int(width[x].sum()), []
        while rest:
            y.append(int(rng.choice([k for k in range(4) if width[k] <= rest])))
            rest -= int(width[y[-1]])
        sizes.append((len(x), len(y)))
        a += x.tolist()
        b += y
    one, two = np.array(sizes).T
    made = Alignment(one, two, np.array(a), np.array(b), width, width)
    whole = Counter()
    for doc, pair, times in made.links(10**9):
        for d, p, t in zip(doc.tolist(), pair.tolist(), times.tolist(), strict=True):
            whole[d, p] += t
    cut = Counter()
    for doc, pair, times in made.links(limit):
        for d, p, t in zip(doc.tolist(), pair.tolist(), times.tolist(), strict=True):
            cut[d, p] += t
    assert cut == whole and sum(whole.values()) == made.n_links().sum()
    monkeypatch.setattr(Alignment.links, "__defaults__", (limit,))
    row = {"sizes": pack(one, two), "a": pack(np.array(a, np.uint32)), "b": pack(np.array(b, np.uint32))}
    for portions in ([made], list(Alignment.of_block(row, (width, width), 40))):
        found = [p.pairs() for p in portions]
        pair, count = token_alignment.added([p for p, _ in found], [c for _, c in found])
        assert dict(zip(pair.tolist(), count.tolist(), strict=True)) == Counter(p for _, p in whole)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        function = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
        assert sorted(function.find(keys).tolist()) == list(range(len(keys))) and function.size == len(keys)
    with pytest.raises(ValueError, match="not in the hash"):
        token_alignment.verified(function, keys[np.argsort(function.find(keys))], np.array([12345], np.uint64))


def test_segments_give_the_ids_of_whole_texts():
    import random

    encoder = token_alignment.Encoder(A, B)
    assert encoder.apart
    rng = random.Random(8)
    parts = ["word", "Don't", "x,", "\n", " ", "  ", "\t", " ", "é", "日本", "12", "###", "...", "\x1c", " y", "🙂", "'s", "a\nb", ""]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    for text, (a, b) in zip(texts, encoder.encode(texts), strict=True):
        whole = encoder.whole(text) if text else None
        assert (a.tolist(), b.tolist()) == (([], []) if whole is None else (whole[0].tolist(), whole[1].tolist())), text


def test_words_with_punctuation_give_the_ids_of_whole_texts():
    import random

    rng = random.Random(9)
    words = ["word", "x", "é", "Straße", "naïve", "ÿ", "É", "ª", "×", "x²", "日本", "don't", "a_b", "12", "ﬁ", "a\nb", "ý", "Ünï", ""]
    marks = [",", ".", "...", "!?", "'", "'s", "\n.", "_", "__", "-", "</s>", "<|endoftext|>", "]);", "\"", "()", "²", "́", "▁", ""]
    texts = [" ".join(rng.choice(words) + rng.choice(marks) + rng.choice(marks) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    encoder = token_alignment.Encoder(A, B)
    assert encoder.endings
    for k in range(0, len(texts), 500):
        for text, (a, b) in zip(texts[k : k + 500], encoder.encode(texts[k : k + 500]), strict=True):
            whole = encoder.whole(text) if text else None
            assert (a.tolist(), b.tolist()) == (([], []) if whole is None else (whole[0].tolist(), whole[1].tolist())), text
    encoder.endings = False
    encoder._forget()
    for text, (a, b) in zip(texts, encoder.encode(texts), strict=True):
        whole = encoder.whole(text) if text else None
        assert (a.tolist(), b.tolist()) == (([], []) if whole is None else (whole[0].tolist(), whole[1].tolist())), text


def test_known_words_with_known_endings_are_not_encoded_again():
    encoder = token_alignment.Encoder(A, B)
    encoder.encode(["alpha beta gamma, one. two"])
    text = "alpha, beta. two. one, alpha beta, gamma."
    whole = encoder.whole(text)

    def encoded(_):
        raise AssertionError("encoded again")

    encoder.encode_a = encoder.encode_b = encoded
    ((a, b),) = encoder.encode([text])
    assert (a.tolist(), b.tolist()) == (whole[0].tolist(), whole[1].tolist())
