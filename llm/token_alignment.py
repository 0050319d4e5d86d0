"""Aligns the tokens of two tokenizers and counts which of them stand for the same text.

Byte offsets where tokens of both end cut a document into groups; all tokens of one side are linked with all of
the other side in their group. The count of a pair of ids is the number of documents in which it is linked.

1. Blocks of documents are encoded once and kept as packed ids.
2. The documents are aligned; each block gives its distinct pairs with the number of its documents that hold them.
3. Distinct pairs are dealt to buckets by their first id, and a minimal perfect hash of each bucket is built.
4. Each share of a bucket's blocks adds its counts in a dense vector indexed by that hash; the vectors are summed in
   a tree of ``FAN`` branches. Next to each number its pair is stored, so that a look-up is verified.
5. The pairs of every block look up their counts; a second pass aligns the documents again and adds them.

An id has as many pairs as the other vocabulary has ids at most, so no bucket outgrows the vocabularies, whatever the
number of documents; blocks of a bucket are split, so no task reads all documents of a frequent pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.packed import by_group, gather, pack, spread, unpack
from llm.perfect_hash import PerfectHash
from llm.scratch import blocks, keep
from llm.segments import LETTERS, PUNCTUATED, PUNCTUATION, SEGMENTS, TOGETHER, byte_level, open_ended, segments
from llm.words import chunks, text_bytes

BLOCK = 4_000_000  # bytes of text in a block
CHUNK = 1_000_000  # bytes encoded at once
TOKENS = 500_000  # tokens of both sides aligned at once
LINKS = 250_000  # links expanded at once
FAN = 64
_WORD = "x"
_STEP = (1 << 32) + 1
_BLOCKS = "block long, ids array<long>, sizes binary, a binary, b binary"
_PAIRS = "bucket int, block long, pairs binary"
_RESULT = (
    "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


@lru_cache(maxsize=4)
def first_tokenizer(path: str):
    """A ``tokenizers`` file with byte-level entries: encoder, the bytes of every id, and those of ids found in texts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    known = byte_level([tokenizer.id_to_token(k) for k in range(tokenizer.get_vocab_size())])
    special = tokenizer.get_added_tokens_decoder()

    def encode(text: str) -> list[int]:
        return tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids

    return encode, known, [x for k, x in enumerate(known) if k not in special]


@lru_cache(maxsize=4)
def second_tokenizer(path: str):
    """A ``sentencepiece`` model: encoder, the bytes of every id, and those of ids found in texts."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        known.append(bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode())
    return model.encode, known, [x for k, x in enumerate(known) if not model.is_control(k) and not model.is_unknown(k)]


@lru_cache(maxsize=4)
def lengths(path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes each id of either side stands for."""
    return tuple(
        np.array([len(x) for x in known], np.int64) for known in (first_tokenizer(path_a)[1], second_tokenizer(path_b)[1])
    )


class Encoder:
    """Encodes texts on either side; the ids of segments met before are looked up.

    That no piece of the second tokenizer holds a space after another character is checked; then its tokens end at a
    segment's end too. Otherwise whole texts are encoded. Where no entry of either side holds punctuation after a letter,
    a word and the punctuation at its end are encoded apart, the latter after ``_WORD``.
    """

    def __init__(self, path_a: str, path_b: str):
        (self.encode_a, self.bytes_a, plain_a), (self.encode_b, self.bytes_b, plain_b) = first_tokenizer(path_a), second_tokenizer(path_b)
        self.apart = all(b" " not in known.lstrip(b" ") for known in self.bytes_b)
        self.endings = not any(PUNCTUATED.search(known) for known in (*plain_a, *plain_b))
        self.sizes = lengths(path_a, path_b)
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}  # numbers of segments
        self.open: dict[str, int] = {}  # of those open-ended
        self.unlike: set[int] = set()
        self.ids = [np.zeros(0, np.uint32), np.zeros(0, np.uint32)]  # of all segments, by number
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of either side; None where the bytes of one are not those of a space and the text."""
        a, b = self.encode_a(text), self.encode_b(text)
        expected = b" " + text.encode()
        same = b"".join(map(self.bytes_a.__getitem__, a)) == expected and b"".join(map(self.bytes_b.__getitem__, b)) == expected
        return (np.array(a, np.uint32), np.array(b, np.uint32)) if same else None

    def _cut(self, segs: list[str], first: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
        """(ids, counts) of either side. Segments are encoded as one text and cut where they end; in halves if a side does
        not give that back."""
        found = self.whole(" ".join(segs))
        if found:
            ends, out = np.cumsum([1 + len(s.encode()) for s in segs]), []
            for ids, sizes in zip(found, self.sizes, strict=True):
                at = np.cumsum(sizes[ids])
                last = np.searchsorted(at, ends)
                if (at[last] != ends).any():
                    raise ValueError("a token goes on beyond its segment")
                out.append((ids, np.diff(last, prepend=-1)))
            yield out
        elif len(segs) == 1:
            self.unlike.add(first)
            yield [(np.zeros(0, np.uint32), np.zeros(1, np.int64))] * 2
        else:
            half = len(segs) // 2
            yield from self._cut(segs[:half], first)
            yield from self._cut(segs[half:], first + half)

    def _number(self, segs: list[str], numbers: dict[str, int], found: Iterable[list[tuple[np.ndarray, np.ndarray]]]) -> None:
        first = len(self.seen) + len(self.open)
        numbers.update(zip(segs, range(first, first + len(segs)), strict=True))
        for side, parts in enumerate(zip(*found, strict=True)):
            self.ids[side] = np.concatenate([self.ids[side], *(ids for ids, _ in parts)])
            counts = np.concatenate([n for _, n in parts])
            self.ends[side] = np.concatenate([self.ends[side], self.ends[side][-1] + np.cumsum(counts)])

    def _learn(self, segs: list[str], numbers: dict[str, int], together: int) -> None:
        first = len(self.seen) + len(self.open)
        starts = range(0, len(segs), together)
        self._number(segs, numbers, [x for k in starts for x in self._cut(segs[k : k + together], first + k)])

    def _learn_closed(self, segs: set[str]) -> None:
        """New segments; a word and punctuation after it are put together from both."""
        alone, split = segs, []
        if self.endings:
            for s in segs:
                word = s.rstrip(PUNCTUATION)
                if word and len(word) < len(s) and word[-1] in LETTERS and word != _WORD:
                    split.append((s, word, _WORD + s[len(word) :]))
            both = {_WORD, *(w for _, w, _ in split), *(e for _, _, e in split)}
            alone = (segs.difference(s for s, _, _ in split) | both) - self.seen.keys()
        self._learn(list(alone), self.seen, TOGETHER)
        if split:
            first = len(self.seen) + len(self.open)
            at = np.array([[self.seen[w], self.seen[e]] for _, w, e in split]).ravel()
            found = []
            for side in range(2):
                skip = np.zeros(len(at), np.int64)
                skip[1::2] = np.diff(self.ends[side])[self.seen[_WORD]]
                ids, ends = self._take(side, at, skip)
                found.append((ids, np.diff(np.append(0, ends[1::2]))))
            if self.unlike:
                unlike = np.isin(at, list(self.unlike)).reshape(-1, 2).any(axis=1)
                self.unlike.update((first + np.flatnonzero(unlike)).tolist())
            self._number([s for s, _, _ in split], self.seen, [found])

    def _take(self, side: int, numbers: np.ndarray, skip: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered segments but for the first ``skip`` of each, and where each one's end."""
        begin = self.ends[side][numbers] + skip
        counts = np.maximum(self.ends[side][numbers + 1] - begin, 0)
        ends = np.cumsum(counts)
        return self.ids[side][np.repeat(begin - ends + counts, counts) + np.arange(counts.sum())], ends

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of every text; none where a side does not give the text back."""
        nothing = (np.zeros(0, np.uint32), np.zeros(0, np.uint32))
        if not self.apart:
            return [(self.whole(t) or nothing) if t else nothing for t in texts]
        if len(self.seen) + len(self.open) > SEGMENTS:
            self._forget()
        # parts between all spaces are a text's segments if none of them is empty or open-ended
        parts = [t.split(" ") if t else [] for t in texts]
        new = set().union(*parts) - self.seen.keys()
        odd = {s for s in new if not s or open_ended(s)}
        again = {k for k, segs in enumerate(parts) if not odd.isdisjoint(segs)} if odd else set()
        if again:
            for k in again:
                parts[k] = segments(texts[k])
            new = (new - odd).union(*(parts[k] for k in again)) - self.seen.keys()
            opened = {s for s in new if open_ended(s)}
            new -= opened
            self._learn(list(opened - self.open.keys()), self.open, 1)
        if new:
            self._learn_closed(new)
        found: list[int] = []
        for k, segs in enumerate(parts):
            found += [self.seen[s] if s in self.seen else self.open[s] for s in segs] if k in again else map(self.seen.__getitem__, segs)
        numbers = np.array(found, np.int64)
        cuts = np.append(0, np.cumsum([len(segs) for segs in parts], dtype=np.int64))
        sides = []
        for side in range(2):
            ids, ends = self._take(side, numbers)
            at = np.append(0, ends)[cuts].tolist()
            sides.append([ids[x:y] for x, y in zip(at[:-1], at[1:], strict=True)])
        out = list(zip(*sides, strict=True))
        if self.unlike:
            unlike = np.append(0, np.cumsum(np.isin(numbers, list(self.unlike))))[cuts]
            for k in np.flatnonzero(np.diff(unlike)).tolist():
                out[k] = self.whole(texts[k]) or nothing
        return out


def _encode(path_a: str, path_b: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        number, encoder = TaskContext.get().partitionId(), Encoder(path_a, path_b)
        ids, sizes, sides, held = [], [], ([], []), 0

        def out() -> pa.RecordBatch:
            flat = [np.concatenate(s) if s else np.zeros(0, np.uint32) for s in sides]
            size = np.array(sizes, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number]),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([pack(size[:, 0], size[:, 1])], pa.binary()),
                    *(pa.array([pack(f)], pa.binary()) for f in flat),
                ],
                ["block", "ids", "sizes", "a", "b"],
            )

        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for first, last in chunks(offsets, CHUNK):
                texts = [t or "" for t in batch.column(1).slice(first, last - first).to_pylist()]
                ids += batch.column(0).slice(first, last - first).to_pylist()
                for a, b in encoder.encode(texts):
                    sizes.append((len(a), len(b)))
                    sides[0].append(a)
                    sides[1].append(b)
                held += int(offsets[last] - offsets[first])
                if held >= block:
                    yield out()
                    number, ids, sizes, sides, held = number + _STEP, [], [], ([], []), 0
        if ids:
            yield out()

    return run


class Alignment:
    """Groups of a block of documents. Every document's tokens cover the same bytes on both sides, so the
    block is aligned as one text.

    docs: first group of each document, with the number of groups at the end. a, b: the tokens; a_at, b_at: first
    token of each group on either side, with their number at the end.
    """

    def __init__(self, n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray):
        self.n_a, self.n_b, self.a, self.b = n_a, n_b, a.astype(np.int64), b.astype(np.int64)
        ends_a, ends_b = np.cumsum(length_a[self.a], dtype=np.int64), np.cumsum(length_b[self.b], dtype=np.int64)
        last_a = np.flatnonzero(np.isin(ends_a, ends_b, assume_unique=True, kind="sort"))
        last_b = np.searchsorted(ends_b, ends_a[last_a])
        self.a_at, self.b_at = np.append(0, last_a + 1), np.append(0, last_b + 1)
        self.docs = np.searchsorted(self.a_at, np.append(0, np.cumsum(self.n_a)))
        self.per_group = np.diff(self.a_at) * np.diff(self.b_at)

    @classmethod
    def of_block(cls, row: dict, sizes: tuple[np.ndarray, np.ndarray], tokens: int = TOKENS) -> Iterator[Alignment]:
        """The documents of an encoded block in portions of about ``tokens`` tokens, one document at least."""
        n_a, n_b = unpack(row["sizes"], np.int64, np.int64)
        (a,), (b,) = unpack(row["a"], np.uint32), unpack(row["b"], np.uint32)
        at_a, at_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        for first, last in chunks(at_a + at_b, tokens):
            yield cls(n_a[first:last], n_b[first:last], a[at_a[first] : at_a[last]], b[at_b[first] : at_b[last]], *sizes)

    def n_groups(self) -> np.ndarray:
        return np.diff(self.docs)

    def n_links(self) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(self.per_group))[self.docs])

    def links(self, limit: int = LINKS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair, times) of all links, about ``limit`` at once; whole documents unless one has more.

        A group with more links than that gives its distinct pairs and how often each is linked.
        """
        owner = np.repeat(np.arange(len(self.n_a)), np.diff(self.docs))
        total = np.append(0, np.cumsum(self.per_group))
        first, groups = 0, len(self.per_group)
        while first < groups:
            last = int(np.searchsorted(total, total[first] + limit, side="right")) - 1
            if last <= first:
                yield from self._large(first, int(owner[first]), limit)
                first += 1
                continue
            if last < groups and owner[last - 1] == owner[last]:  # back to where the last document begins, if it fits
                begin = int(self.docs[owner[last]])
                last = begin if begin > first else last
            count = self.per_group[first:last]
            group = np.repeat(np.arange(first, last), count)
            within = np.arange(int(count.sum())) - np.repeat(total[first:last] - total[first], count)
            wide = np.diff(self.b_at)[group]
            pair = (self.a[self.a_at[group] + within // wide] << 32) | self.b[self.b_at[group] + within % wide]
            yield owner[group], pair.astype(np.uint64), np.ones(len(pair), np.int64)
            first = last

    def _large(self, group: int, doc: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        a, times_a = np.unique(self.a[self.a_at[group] : self.a_at[group + 1]], return_counts=True)
        b, times_b = np.unique(self.b[self.b_at[group] : self.b_at[group + 1]], return_counts=True)
        step = max(1, limit // len(b))
        for k in range(0, len(a), step):
            pair = ((a[k : k + step, None] << 32) | b[None, :]).ravel().astype(np.uint64)
            yield np.full(len(pair), doc), pair, (times_a[k : k + step, None] * times_b[None, :]).ravel()

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs and how many documents hold each."""
        every, counts = [], []
        open_doc, seen = -1, []  # pairs of a document that comes in several parts

        def close() -> None:
            if seen:
                pair = np.unique(np.concatenate(seen))
                every.append(pair)
                counts.append(np.ones(len(pair), np.int64))
                seen.clear()

        for doc, pair, _ in self.links():
            if doc[0] == doc[-1]:
                if doc[0] != open_doc:
                    close()
                    open_doc = int(doc[0])
                seen.append(np.unique(pair))
                continue
            inside = doc != open_doc
            if not inside.all():
                seen.append(np.unique(pair[~inside]))
                doc, pair = doc[inside], pair[inside]
            close()
            # the last document may go on in the next part
            open_doc = int(doc[-1])
            seen.append(np.unique(pair[doc == open_doc]))
            doc, pair = doc[doc != open_doc], pair[doc != open_doc]
            order = np.lexsort((doc, pair))
            doc, pair = doc[order], pair[order]
            new = np.ones(len(pair), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
            some, count = np.unique(pair[new], return_counts=True)
            every.append(some)
            counts.append(count)
        close()
        return added(every, counts)

    def digests(self) -> list[str]:
        """Of every document: its groups as ``a1,a2|b1;a3|b2,b3`` in decimal ids, hashed; '' without tokens."""
        group_a = np.repeat(np.arange(len(self.per_group)), np.diff(self.a_at))
        group_b = np.repeat(np.arange(len(self.per_group)), np.diff(self.b_at))
        codes = np.zeros(len(self.a) + len(self.b), np.int64)
        mark_a, mark_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        mark_a[self.a_at[1:] - 1], mark_b[self.b_at[1:] - 1] = 1, 2
        strings, size = _strings(max(int(self.a.max(initial=0)), int(self.b.max(initial=0))) // 10_000 + 1)
        codes[np.arange(len(self.a)) + self.b_at[group_a]] = self.a + mark_a * size
        codes[np.arange(len(self.b)) + self.a_at[group_b + 1]] = self.b + mark_b * size
        cuts = np.append(0, np.cumsum(self.n_a + self.n_b)).tolist()
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            joined = "".join(map(strings.__getitem__, codes[a:b].tolist()))[:-1]
            out.append(hashlib.sha256(joined.encode()).hexdigest() if joined else "")
        return out


@lru_cache(maxsize=2)
def _strings(thousands: int) -> tuple[list[str], int]:
    """Ids in decimal with what follows them: a comma, a bar, a semicolon."""
    size = thousands * 10_000
    return [f"{k}{mark}" for mark in ",|;" for k in range(size)], size


def _row(batch: pa.RecordBatch, k: int) -> dict:
    return {c: batch[c][k].as_py() for c in ("sizes", "a", "b")}


def added(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of several lists, with the sums of their counts."""
    if not pairs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pair, back = np.unique(np.concatenate(pairs), return_inverse=True)
    out = np.zeros(len(pair), np.int64)
    np.add.at(out, back, np.concatenate(counts))
    return pair, out


def _align(sizes: tuple[np.ndarray, np.ndarray], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = [portion.pairs() for portion in Alignment.of_block(_row(batch, k), sizes)]
                pair, count = added([p for p, _ in found], [c for _, c in found])
                bucket = bucket_of(pair, buckets)
                order = np.argsort(bucket, kind="stable")
                pair, count, bucket = pair[order], count[order], bucket[order]
                parts = [(g, pack(pair[r], count[r])) for g, r in by_group(bucket)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([g for g, _ in parts], pa.int32()),
                        pa.array([batch["block"][k].as_py()] * len(parts), pa.int64()),
                        pa.array([p for _, p in parts], pa.binary()),
                    ],
                    ["bucket", "block", "pairs"],
                )

    return run


def bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    """By the first id, so that a bucket holds all pairs of an id."""
    from llm.words import mix

    return spread(mix(pairs >> np.uint64(32)), buckets)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket the perfect hash of its pairs, and the pairs in its order."""
    now, held = None, np.zeros(0, np.uint64)
    parts: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        keys = np.unique(np.concatenate([held, *parts]))
        function = PerfectHash.build(keys)
        ordered = np.empty_like(keys)
        ordered[function.find(keys)] = keys
        columns = [pa.array([now], pa.int32()), pa.array([function.to_bytes()], pa.binary()), pa.array([pack(ordered)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "hash", "pairs"])

    for batch in batches:
        for bucket, blob in zip(batch["bucket"].to_pylist(), batch["pairs"], strict=True):
            if bucket != now:
                if now is not None:
                    yield out()
                now, held, parts, size = bucket, np.zeros(0, np.uint64), [], 0
            (pair, _) = unpack(blob.as_py(), np.uint64, np.int64)
            parts.append(pair)
            size += len(pair)
            if size > max(1_000_000, len(held)):
                held, parts, size = np.unique(np.concatenate([held, *parts])), [], 0
    if now is not None:
        yield out()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dense counts of one share of a bucket's blocks: the hash comes first, then the blocks' pairs."""
    now, function, keys, vector = None, None, None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([pack(vector)], pa.binary())],
            ["bucket", "share", "counts"],
        )

    for batch in batches:
        for bucket, share, known, blob in zip(*(batch[c] for c in ("bucket", "share", "hash", "pairs")), strict=True):
            here = (bucket.as_py(), share.as_py())
            if here != now:
                if now is not None:
                    yield out()
                now, function = here, PerfectHash.from_bytes(known.as_py())
                (keys,) = unpack(blob.as_py(), np.uint64)
                vector = np.zeros(len(keys), np.int64)
                continue
            pair, count = unpack(blob.as_py(), np.uint64, np.int64)
            vector[verified(function, keys, pair)] += count
    if now is not None:
        yield out()


def verified(function: PerfectHash, keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Numbers of pairs, each checked against the pair stored there."""
    at = function.find(pairs)
    if (at < 0).any() or (keys[at] != pairs).any():
        raise ValueError("a pair is not in the hash of its bucket")
    return at


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the count vectors of each (bucket, share)."""
    now, vector = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([pack(vector)], pa.binary())],
            ["bucket", "share", "counts"],
        )

    for batch in batches:
        for bucket, share, blob in zip(batch["bucket"].to_pylist(), batch["share"].to_pylist(), batch["counts"], strict=True):
            (more,) = unpack(blob.as_py(), np.int64)
            if (bucket, share) == now:
                vector = vector + more
                continue
            if now is not None:
                yield out()
            now, vector = (bucket, share), more
    if now is not None:
        yield out()


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count of every pair of a block and whether no pair of its first id has more."""
    function = keys = counts = best = None
    for batch in batches:
        rows = []
        for block, known, blob, summed in zip(*(batch[c] for c in ("block", "hash", "pairs", "counts")), strict=True):
            if known.is_valid:
                function = PerfectHash.from_bytes(known.as_py())
                (keys,), (counts,) = unpack(blob.as_py(), np.uint64), unpack(summed.as_py(), np.int64)
                _, owner = np.unique(keys >> np.uint64(32), return_inverse=True)
                most = np.zeros(owner.max(initial=-1) + 1, np.int64)
                np.maximum.at(most, owner, counts)
                best = counts == most[owner]
                continue
            (pair, _) = unpack(blob.as_py(), np.uint64, np.int64)
            at = verified(function, keys, pair)
            rows.append((block.as_py(), pack(pair, counts[at], best[at])))
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())], ["block", "pairs"]
        )


def _report(sizes: tuple[np.ndarray, np.ndarray]):
    """Second pass: the pairs of a block come first, then its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            for k in range(batch.num_rows):
                if not batch["ids"][k].is_valid:
                    held.append(batch["pairs"][k].as_py())
                    continue
                pair, count, best = gather(held, np.uint64, np.int64, np.bool_)
                order = np.argsort(pair)
                pair, count, best = pair[order], count[order], best[order]
                held, done = [], 0
                for found in Alignment.of_block(_row(batch, k), sizes):
                    total, n_best = np.zeros(len(found.n_a), np.int64), np.zeros(len(found.n_a), np.int64)
                    for doc, link, times in found.links():
                        at = np.searchsorted(pair, link)
                        np.add.at(total, doc, count[at] * times)
                        np.add.at(n_best, doc, best[at] * times)
                    columns = [found.n_a, found.n_b, found.n_groups(), found.n_links(), n_best, total]
                    ids = batch["ids"][k].values.slice(done, len(total))
                    done += len(total)
                    yield pa.RecordBatch.from_arrays(
                        [ids, *(pa.array(c, pa.int64()) for c in columns), pa.array(found.digests(), pa.string())],
                        [c.split()[0] for c in _RESULT.split(", ")],
                    )

    return run


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``docs``.

    ``path_a``: a byte-level file of ``tokenizers``, which encodes a space and the text; ``path_b``: a ``sentencepiece`` model,
    which encodes the text. Null and empty texts, and texts that either side does not give back byte by byte, have no
    tokens: zeros and ''. n_best: links whose count is the highest of their first id. Null ids are carried
    through; rows that repeat an id are documents of their own. Other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    encoded = keep(base.mapInArrow(_encode(path_a, path_b, block), _BLOCKS), "encoded")
    sizes = tuple(x.astype(np.int32) for x in lengths(path_a, path_b))
    buckets, shares = blocks(spark, 1), max(1, -(-encoded.count() // FAN))
    pairs = keep(encoded.select("block", "sizes", "a", "b").mapInArrow(_align(sizes, buckets), _PAIRS), "pairs")
    hashes = keep(
        pairs.select("bucket", "pairs")
        .repartitionById(buckets, F.col("bucket"))
        .sortWithinPartitions("bucket")
        .mapInArrow(_hash, "bucket int, hash binary, pairs binary"),
        "hashes",
    )
    each_share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    of_block = F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int").alias("share")
    nothing = F.lit(None).cast("binary")
    to_count = hashes.select("bucket", each_share, F.lit(0).alias("kind"), "hash", "pairs").unionByName(
        pairs.select("bucket", of_block, F.lit(1).alias("kind"), nothing.alias("hash"), "pairs")
    )
    counts = (
        to_count.repartition("bucket", "share")
        .sortWithinPartitions("bucket", "share", "kind")
        .mapInArrow(_count, "bucket int, share int, counts binary")
    )
    left = shares
    while left > 1:
        left = -(-left // FAN)
        counts = (
            counts.withColumn("share", F.floor(F.col("share") / FAN).cast("int"))
            .repartition("bucket", "share")
            .sortWithinPartitions("bucket", "share")
            .mapInArrow(_add, "bucket int, share int, counts binary")
        )
    counted = keep(hashes.join(counts.select("bucket", "counts"), "bucket"), "counted")
    to_find = counted.select(
        "bucket", each_share, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), "hash", "pairs", "counts"
    ).unionByName(
        pairs.select("bucket", of_block, F.lit(1).alias("kind"), "block", nothing.alias("hash"), "pairs", nothing.alias("counts"))
    )
    known = (
        to_find.repartition("bucket", "share")
        .sortWithinPartitions("bucket", "share", "kind")
        .mapInArrow(_look_up, "block long, pairs binary")
    )
    empty = [nothing.alias(c) for c in ("sizes", "a", "b")]
    streamed = known.select("block", F.lit(0).alias("kind"), "pairs", F.lit(None).cast("array<long>").alias("ids"), *empty).unionByName(
        encoded.select("block", F.lit(1).alias("kind"), nothing.alias("pairs"), "ids", "sizes", "a", "b")
    )
    return (
        streamed.repartitionById(2 * buckets, F.pmod("block", F.lit(2 * buckets)).cast("int"))
        .sortWithinPartitions("block", "kind")
        .mapInArrow(_report(sizes), _RESULT)
        .withColumnRenamed("id", id_col)
    )
