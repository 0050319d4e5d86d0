"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of it is a binary classifier over hashed
byte n-grams (A-Z folded): the log odds of an n-gram between the languages
whose bit is 1 and those whose bit is 0, all languages weighing the same. A
text's margin for a bit is the sum of its n-grams' log odds over the square root
of their number. Decoding adds the logistic loss of all margins against every
codeword and takes the least; the runner-up's distance gives the score, and a
text whose two best codewords are closer than ``AMBIGUOUS`` is flagged.

Up to seven languages have the exhaustive code (every way to split them);
more have random words, the best of several draws by least distance.

Training reads a bounded sample: about ``per_language`` rows of each language,
chosen by a hash of the id. Prediction reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.words import _LOWER, chunks, mix, text_bytes

ORDERS = (2, 4)
BUCKETS = 1 << 15
PER_LANGUAGE = 4000
AMBIGUOUS = 0.5
UNDETERMINED = "und"


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A (classes, bits) matrix of -1 and 1: exhaustive to seven classes, then random with a large least distance."""
    if classes < 2:
        return np.ones((classes, 0), dtype=np.int8)
    if classes <= 7:
        splits = np.arange(1, 1 << (classes - 1))  # the last class always has -1
        return np.where((splits[None, :] >> np.arange(classes)[:, None]) & 1, 1, -1).astype(np.int8)
    bits = int(np.ceil(10 * np.log2(classes)))
    draw = np.random.default_rng(seed)
    best, least = None, -1
    for _ in range(200):
        code = np.where(draw.random((classes, bits)) < 0.5, -1, 1).astype(np.int8)
        if (np.abs(code.sum(axis=0)) == classes).any():
            continue
        apart = int(((bits - code.astype(int) @ code.T.astype(int)) // 2 + np.eye(classes, dtype=int) * bits).min())
        if apart > least:
            best, least = code, apart
    return best


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams of each order and where each row's begin; grams stay inside a row."""
    data = _LOWER[data].astype(np.uint64)
    for order in ORDERS:
        rows = np.maximum(np.diff(offsets) - order + 1, 0)
        begin = np.concatenate([[0], np.cumsum(rows)])
        if len(data) < order:
            yield np.zeros(0, np.int64), begin
            continue
        value = np.full(len(data) - order + 1, order, dtype=np.uint64)
        for k in range(order):
            value = value * np.uint64(257) + data[k : len(data) - order + 1 + k]
        inside = np.ones(len(value), dtype=bool)
        for k in range(1, order):
            edge = offsets[1:-1] - k
            inside[edge[(edge >= 0) & (edge < len(value))]] = False
        # a row shorter than the order has no start of its own; its places are edges of the next row as well
        value = value[inside]
        yield (mix(value) % np.uint64(BUCKETS)).astype(np.int64), begin


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for lang in set(langs.tolist()):
            data, offsets = text_bytes(batch.column(1).filter(pa.array(langs == lang)))
            into = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for first, last in chunks(offsets):
                cut = offsets[first : last + 1]
                for grams, _ in _grams(data[cut[0] : cut[-1]], cut - cut[0]):
                    into += np.bincount(grams, minlength=BUCKETS)
    for lang, counts in sums.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])],
            ["lang", "gram", "n"],
        )


class Model:
    """Languages, their codewords and the weights of the bits' classifiers."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
        self.weights = np.zeros((self.code.shape[1], counts.shape[1]), dtype=np.float32)
        for b in range(self.code.shape[1]):
            one, two = share[self.code[:, b] > 0].mean(axis=0), share[self.code[:, b] < 0].mean(axis=0)
            self.weights[b] = np.log(one / two)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, bits = len(offsets) - 1, self.code.shape[1]
        out, total = np.zeros((rows, bits)), np.zeros(rows)
        for grams, begin in _grams(data, offsets):
            some = np.flatnonzero(np.diff(begin))
            if not len(some):
                continue
            total += np.diff(begin)
            for b in range(bits):
                out[some, b] += np.add.reduceat(self.weights[b][grams], begin[some], dtype=np.float64)
        return out / np.sqrt(np.maximum(total, 1))[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language number, its share of exp(-loss), and whether the next one is too close."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :]).sum(axis=2)
        best = loss.argmin(axis=1)
        if self.code.shape[0] == 1:
            return best, np.ones(len(best)), np.zeros(len(best), bool)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        two = np.partition(loss, 1, axis=1)
        return best, 1 / share.sum(axis=1), two[:, 1] - two[:, 0] < AMBIGUOUS


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` rows of each language (all, if it has fewer), chosen by a hash of the id.

    Rows without language or text do not count. What reaches the driver is at
    most BUCKETS sums a language.
    """
    rows = labelled.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).filter("lang is not null and text is not null and id is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    whole = 1 << 30
    limit = F.create_map(*[F.lit(x) for k in languages for x in (k, min(whole, whole * per_language // sizes[k]))])
    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(whole)) < limit[F.col("lang")])
    sums = chosen.select("lang", "text").mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")
    )
    counts = np.zeros((len(languages), BUCKETS))
    table = sums.toArrow()
    at = {k: i for i, k in enumerate(languages)}
    counts[[at[k] for k in table["lang"].to_pylist()], table["gram"].to_numpy()] = table["n"].to_numpy()
    return Model(languages, counts)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            data, offsets = text_bytes(texts)
            best, score, close = (np.zeros(batch.num_rows, kind) for kind in (np.int64, float, bool))
            if model.languages:
                for first, last in chunks(offsets, 500_000):
                    cut = offsets[first : last + 1]
                    found = model.decode(model.margins(data[cut[0] : cut[-1]], cut - cut[0]))
                    best[first:last], score[first:last], close[first:last] = found
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            known = letters & bool(model.languages)
            best[~known], score[~known], close[~known] = len(model.languages), 0.0, True
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(close)],
                [*batch.schema.names[:-1], "lang_pred", "score", "ambiguous"],
            )

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (0 to 1) and ambiguous, from the text alone.

    ``und``, score 0 and ambiguous for texts that are null or have no letter,
    and where no language was learned. With one learned language all other
    texts are of it, score 1. Input columns named like the results are left out.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)), F.col(text_col).cast("string").alias("t"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])
    done = inner.mapInArrow(_predict(model), f"{fields}, lang_pred string, score double, ambiguous boolean")
    return done.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(kept)), "lang_pred", "score", "ambiguous")
