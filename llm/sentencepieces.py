"""SentencePiece encoding and decoding: batched Viterbi over distinct segments, in numpy.

A chunk's texts are normalised (a leading mark, spaces as marks) and cut at
every pair of characters that stands in no piece: no piece can cross such a
place, so the cuts are exact. Equal segments are solved once. Segments of equal
length advance together: for each end, all substrings up to the longest piece
are probed by hash among the sorted piece keys, and a vectorised maximum over
their scores stores the back pointer.

The public model is a merge (BPE) model. Its encodings are not the paths of the
largest score sum, so for such models a step from piece p to piece t is allowed
only if merging the characters of p + t gives p, t again. A segmentation all of whose
steps are allowed is the merge result, and there is just one; the same
maximum then finds it. Unigram models need no such condition. Characters in no
piece fall back to their bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.words import Runs, chunks, mix, text_bytes

MARK = "▁"
_CHUNK = 1_000_000
_DECODED = 200_000
_LOW = 0x250
_SLOTS = 1 << 20
_KEPT = 400_000
_MERGES, _UNIGRAM = 2, 1


def _runs(codes: np.ndarray) -> Runs:
    return Runs(codes.astype(np.uint64) + np.uint64(1))


def gather(values: np.ndarray, begin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[begin[r]:begin[r + 1]] for each r in ``rows``, joined, and where each begins."""
    sizes = begin[rows + 1] - begin[rows]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(ends[-1]) + np.repeat(begin[rows] - ends[:-1], sizes)
    return values[at], ends


class PieceModel:
    """The pieces of a model file, as sorted keys; ``encode`` and ``decode`` take whole columns."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only models without character map and with white space kept are supported")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.merging = model.trainer_spec.model_type == _MERGES
        if not self.merging and model.trainer_spec.model_type != _UNIGRAM:
            raise ValueError("only merge and unigram models are supported")
        kind = type(model.pieces[0])
        self.size = len(model.pieces)
        self.pieces = [p.piece for p in model.pieces]
        self.rank = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.byte_id = np.zeros(256, np.int32)
        self.unknown_id = 0
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte_id[int(p.piece[1:-1], 16)] = i
            elif p.type == kind.UNKNOWN:
                self.unknown_id = i
            elif p.type == kind.USER_DEFINED:
                raise ValueError("models with user defined pieces are not supported")
        self.fallback = bool(model.trainer_spec.byte_fallback)
        usable = [(p, s, i) for p, (s, i) in self.rank.items() if not self.merging or self.merge(p) == [p]]
        self.longest = max(len(p) for p, _, _ in usable)
        codes = np.array([ord(c) for p, _, _ in usable for c in p], np.uint32)
        ends = np.cumsum([len(p) for p, _, _ in usable])
        keys = _runs(codes).hash(ends - [len(p) for p, _, _ in usable], ends)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for _, _, i in usable], np.int32)[order]
        self.scores = np.array([s for _, s, _ in usable])[order]
        self.lowest = float(self.scores.min()) - 10
        singles = {p for p, _, _ in usable if len(p) == 1}
        if any(c not in singles for p, _, _ in usable for c in p):
            raise ValueError("every character of a piece must be a piece")
        pairs = sorted({(ord(a), ord(b)) for p, _, _ in usable for a, b in zip(p, p[1:], strict=False)})
        self.pair_keys = np.array([a << 21 | b for a, b in pairs], np.int64)
        self.low_pairs = np.zeros((_LOW, _LOW), bool)
        for a, b in pairs:
            if a < _LOW and b < _LOW:
                self.low_pairs[a, b] = True
        self._step_key = np.full(_SLOTS, -1, np.int64)
        self._step_good = np.zeros(_SLOTS, bool)
        self._seen, self._seen_ids, self._seen_begin = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(1, np.int64)
        # what each id stands for when decoding
        out = [p.piece.replace(MARK, " ").encode() if p.type == kind.NORMAL else b"" for p in model.pieces]
        for value, i in enumerate(self.byte_id.tolist()):
            out[i] = bytes([value]) if self.fallback else out[i]
        self.raw = np.frombuffer(b"".join(out), np.uint8)
        self.raw_begin = np.concatenate([[0], np.cumsum([len(o) for o in out])])

    def merge(self, text: str) -> list[str]:
        """What merging gives: again and again the best adjacent pair, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.rank[m][0], k) for k in range(len(parts) - 1) if (m := parts[k] + parts[k + 1]) in self.rank]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _allowed(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Which steps stand in the merge of both pieces; verdicts are kept in a table of fixed size."""
        step = before.astype(np.int64) * self.size + after
        slot = (mix(step.astype(np.uint64)) & np.uint64(_SLOTS - 1)).astype(np.int64)
        good = self._step_good[slot]
        new = np.flatnonzero(self._step_key[slot] != step)
        if len(new):
            every, back = np.unique(step[new], return_inverse=True)
            verdict = np.array(
                [
                    self.merge(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
                    for a, b in zip((every // self.size).tolist(), (every % self.size).tolist(), strict=True)
                ]
            )
            good[new] = verdict[back]
            self._step_key[slot[new]], self._step_good[slot[new]] = step[new], good[new]
        return good

    def _solve(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of segments of one length (rows), row by row, and how many each has; unknown: -1."""
        rows, length = codes.shape
        best = np.full((rows, length + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((rows, length + 1), -1, np.int32)
        step = np.zeros((rows, length + 1), np.int32)
        runs = _runs(np.ascontiguousarray(codes).ravel())
        base = np.arange(rows) * length
        for end in range(1, length + 1):
            for size in range(1, min(end, self.longest) + 1):
                begin = end - size
                live = np.flatnonzero(np.isfinite(best[:, begin]))
                if not len(live):
                    continue
                hashes = runs.hash(base[live] + begin, base[live] + end)
                at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
                hit = self.keys[at] == hashes
                if size == 1 and length == 1:  # a character in no piece stands alone
                    miss = live[~hit]
                    best[miss, 1], step[miss, 1] = self.lowest, 1
                live, at = live[hit], at[hit]
                piece = self.ids[at]
                if self.merging and begin:
                    good = self._allowed(last[live, begin], piece)
                    live, at, piece = live[good], at[good], piece[good]
                value = best[live, begin] + self.scores[at]
                more = value > best[live, end]
                live = live[more]
                best[live, end], last[live, end], step[live, end] = value[more], piece[more], size
        return self._trace(last, step)

    @staticmethod
    def _trace(last: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, places = last.shape
        taken = np.zeros((rows, places), bool)
        at = np.full(rows, places - 1)
        live = np.arange(rows)
        while len(live):
            taken[live, at[live]] = True
            at[live] -= step[live, at[live]]
            live = live[at[live] > 0]
        taken[:, 0] = False
        return last[taken], taken.sum(axis=1)

    def _cuts(self, codes: np.ndarray) -> np.ndarray:
        """Whether a segment ends after each character but the last."""
        a, b = codes[:-1], codes[1:]
        low = (a < _LOW) & (b < _LOW)
        joined = np.zeros(len(a), bool)
        joined[low] = self.low_pairs[a[low], b[low]]
        rest = np.flatnonzero(~low)
        key = a[rest].astype(np.int64) << 21 | b[rest]
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        joined[rest] = self.pair_keys[at] == key
        return ~joined

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a few megabytes of texts, one text after the other, and where each begins."""
        normal = [self.prefix + t.replace(" ", MARK) if t else "" for t in texts]
        codes = np.frombuffer("".join(normal).encode("utf-32-le"), np.uint32)
        rows = np.concatenate([[0], np.cumsum([len(t) for t in normal])])
        if not len(codes):
            return np.zeros(0, np.int32), rows
        cut = np.ones(len(codes), bool)
        cut[1:] = self._cuts(codes)
        cut[rows[:-1][rows[:-1] < len(codes)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(codes))
        keys, one, back = np.unique(_runs(codes).hash(starts, ends), return_index=True, return_inverse=True)
        sizes = ends[one] - starts[one]
        known = np.minimum(np.searchsorted(self._seen, keys), max(len(self._seen) - 1, 0))
        old = np.flatnonzero(self._seen[known] == keys) if len(self._seen) else np.zeros(0, np.int64)
        fresh = np.ones(len(one), bool)
        fresh[old] = False
        ids, begin = gather(self._seen_ids, self._seen_begin, known[old])
        parts, owners, counts = [ids], [np.repeat(old, np.diff(begin))], np.zeros(len(one), np.int64)
        counts[old] = np.diff(begin)
        for length in np.unique(sizes[fresh]).tolist():
            same = np.flatnonzero((sizes == length) & fresh)
            chars = codes[starts[one[same]][:, None] + np.arange(length)]
            ids, each = self._solve(chars)
            if length == 1:
                ids, each = self._bytes(ids, chars[:, 0])
            parts.append(ids)
            owners.append(np.repeat(same, each))
            counts[same] = each
        order = np.argsort(np.concatenate(owners), kind="stable")
        solved, begin = np.concatenate(parts)[order], np.concatenate([[0], np.cumsum(counts)])
        self._remember(keys[fresh], *gather(solved, begin, np.flatnonzero(fresh)))
        ids, begin = gather(solved, begin, back)
        return ids, begin[np.searchsorted(starts, rows)]

    def _remember(self, keys: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> None:
        """Keep solved segments for later texts, up to a fixed number."""
        if len(self._seen) >= _KEPT or not len(keys):
            return
        every = np.concatenate([self._seen, keys])
        order = np.argsort(every)
        joined = np.concatenate([self._seen_begin, begin[1:] + self._seen_begin[-1]])
        self._seen_ids, self._seen_begin = gather(np.concatenate([self._seen_ids, ids]), joined, order)
        self._seen = every[order]

    def _bytes(self, ids: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Single characters: the unknown ones as their bytes, or as the unknown piece."""
        out = [
            [i] if i >= 0 else self.byte_id[list(chr(c).encode())].tolist() if self.fallback else [self.unknown_id]
            for i, c in zip(ids.tolist(), chars.tolist(), strict=True)
        ]
        return np.array([i for x in out for i in x], np.int32), np.array([len(x) for x in out])

    def encode(self, column: pa.Array) -> pa.Array:
        """A list of ids for each text; null and empty texts have none."""
        _, offsets = text_bytes(column)
        ids, begin = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for first, last in chunks(offsets, _CHUNK):
            got, where = self._encode([t or "" for t in column.slice(first, last - first).to_pylist()])
            ids.append(got)
            begin.append(where[1:] + begin[-1][-1])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(begin).astype(np.int32)), pa.array(np.concatenate(ids)))

    def decode(self, column: pa.Array) -> list[str]:
        """The text of each list of ids: marks become spaces, the first one goes if it was put there."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        offsets = column.offsets.to_numpy().astype(np.int64)
        ids = column.values.to_numpy()
        texts: list[str] = []
        for first, last in chunks(offsets, _DECODED):
            raw, begin = gather(self.raw, self.raw_begin, ids[offsets[first] : offsets[last]].astype(np.int64))
            cut = begin[offsets[first : last + 1] - offsets[first]].tolist()
            data = raw.tobytes()
            texts += [data[a:b].decode(errors="replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]


@lru_cache(maxsize=4)
def model(path: str) -> PieceModel:
    """The model of a file, once per process."""
    return PieceModel(path)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pieces.encode(batch.column(1))], ["id", "ids"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every row of ``docs``; null and empty texts have no ids. Other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encoded(path), "id long, ids array<int>").withColumnRenamed("id", id_col)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            crcs = [zlib.crc32(x.values.to_numpy().astype("<u4").tobytes()) for x in batch.column(1)]
            texts = pa.array(pieces.decode(batch.column(1)), pa.string())
            counts = pc.cast(pc.list_value_length(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(crcs, pa.int64()), texts], ["id", "n_ids", "ids_crc32", "text"])

    return run


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, n_ids, ids_crc32, text)``: the texts of lists of ids, their number and a checksum of them (unsigned 32 bits, little-endian)."""
    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    return rows.mapInArrow(_decoded(path), "id long, n_ids long, ids_crc32 long, text string").withColumnRenamed("id", id_col)
