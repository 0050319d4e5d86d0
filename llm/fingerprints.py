"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

Each common word (anchor) gives one signature with the ``CHAIN`` content words
after it, ``DISTANCE`` content words apart. Navigation and lists hold few common
words, running text many, so signatures sit in the text proper. A text that
has words but no complete chain uses its words themselves as signatures.

Fingerprints are compared by the Jaccard likeness of their signature sets. For
joins, sets are partitioned by length: two sets with likeness of at least t have
lengths within a factor of t, so they lie in the same partition or in
neighbours, and each set needs only its rarest signatures as join keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from llm.words import PUNCTUATION, mix, run_hashes, words

CHAIN, DISTANCE = 2, 1

#: Common words of English, French, German and Spanish.
COMMON = """
a an the and or of to in is it that for was on are as with be by this from at not he his have had but they which you she
le la les un une de des du et en est que qui dans pour pas sur par au aux avec ce il elle ne se son sa plus
der die das und ist in zu den von mit nicht ein eine auf dem des im es sich auch als an bei nach wie er sie
el los las uno una y o del al por con para no es su lo como que se mas pero sus le
""".split()


def _hash_words(names: list[str]) -> np.ndarray:
    data = [np.frombuffer(n.encode(), np.uint8).astype(np.uint64) + np.uint64(1) for n in names]
    ends = np.cumsum([len(d) for d in data])
    return np.unique(run_hashes(np.concatenate(data), ends - [len(d) for d in data], ends))


_COMMON = _hash_words(COMMON)


def spot_sets(texts: pa.Array, chain: int = CHAIN, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct signatures of every text, one text after the other, and where each begins."""
    owners, sigs = [], []
    for w in words(texts, lower=True, breaks=PUNCTUATION):
        common = np.isin(w.hash, _COMMON)
        content = np.flatnonzero(~common)
        anchors = np.flatnonzero(common)
        next_content = np.searchsorted(content, anchors)
        last = next_content + chain * distance - 1
        anchors, next_content = anchors[last < len(content)], next_content[last < len(content)]
        if len(anchors):
            same = w.row[content[next_content + chain * distance - 1]] == w.row[anchors]
            anchors, next_content = anchors[same], next_content[same]
        value = w.hash[anchors]
        for k in range(1, chain + 1):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + w.hash[content[next_content + k * distance - 1]])
        owner = w.row[anchors]
        rows = w.last - w.first
        bare = np.bincount(owner, minlength=rows) == 0
        plain = bare[w.row]
        owners.append(np.concatenate([owner, w.row[plain]]) + w.first)
        sigs.append(np.concatenate([value, w.hash[plain]]))
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    sig = np.concatenate(sigs) if sigs else np.zeros(0, np.uint64)
    order = np.lexsort((sig, owner))
    owner, sig = owner[order], sig[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (sig[1:] != sig[:-1])
    return sig[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], floor: float = 0.0) -> np.ndarray:
    """Jaccard of the i-th sets of both; two empty sets are equal. Below ``floor`` by their lengths alone: 0."""
    sizes = [np.diff(x[1]) for x in (a, b)]
    small, large = np.minimum(*sizes), np.maximum(*sizes)
    able = small >= floor * large
    rows = [np.repeat(np.arange(len(s)), s) for s in sizes]
    keep = [able[r] for r in rows]
    owner = np.concatenate([r[k] for r, k in zip(rows, keep, strict=True)])
    value = np.concatenate([x[0][k] for x, k in zip((a, b), keep, strict=True)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    twice = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
    same = np.bincount(owner[1:][twice], minlength=len(small))
    union = sizes[0] + sizes[1] - same
    return np.where(able, np.where(union > 0, same / np.maximum(union, 1), 1.0), 0.0)


def digest(sets: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """A short name of each set: its length and a 128-bit digest of its members."""
    sig, begin = sets
    cut = begin.tolist()
    return [
        f"{b - a}:{hashlib.blake2b(sig[a:b].tobytes(), digest_size=16).hexdigest()}"
        for a, b in zip(cut[:-1], cut[1:], strict=True)
    ]


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig, begin = spot_sets(batch.column(1))
        lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(sig.view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), lists, pa.array(digest((sig, begin)))], ["id", "signatures", "fingerprint"]
        )


def spot_signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, signatures, fingerprint)`` of every row; null texts count as empty and have no signature."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_spots, "id long, signatures array<long>, fingerprint string")
    return out.select(F.col("id").alias(id_col), "signatures", "fingerprint")


def _partition(size: Column, least: float) -> Column:
    return F.floor(F.log(size.cast("double")) / F.lit(-np.log(least))).cast("int")


def alike(spots: DataFrame, id_col: str = "doc_id", least: float = 0.8) -> DataFrame:
    """Pairs of class fingerprints ``(fingerprint, other, likeness)`` with likeness of at least ``least``.

    Rows with equal fingerprints are one class (join back on fingerprint). A set
    of n signatures shares one of its n - ceil(least * n) + 1 rarest with any set
    it is alike to; only those are join keys, within equal or neighbouring length
    partitions, and lengths prune before sets are met. Empty sets pair with nothing.
    """
    classes = spots.groupBy("fingerprint").agg(F.first("signatures").alias("sigs")).filter(F.size("sigs") > 0)
    spread = classes.select("fingerprint", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    seen = spread.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = (
        spread.join(seen, "sig")
        .groupBy("fingerprint", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("by_rarity"))
    )
    keys = ranked.select(
        "fingerprint",
        "n",
        _partition(F.col("n"), least).alias("part"),
        F.explode(F.slice("by_rarity.sig", F.lit(1), F.col("n") - F.ceil(least * F.col("n")).cast("int") + 1)).alias("sig"),
    )
    left = keys.select("sig", "part", F.col("n").alias("n1"), F.col("fingerprint").alias("f1"))
    right = keys.select(
        "sig", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), F.col("n").alias("n2"), F.col("fingerprint").alias("f2")
    )
    within = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("f1") < F.col("f2")))
    pairs = left.join(right, ["sig", "part"]).filter(within & (F.col("n1") >= least * F.col("n2"))).select("f1", "f2").distinct()
    sets = lambda k: classes.select(F.col("fingerprint").alias(f"f{k}"), F.col("sigs").alias(f"s{k}"))
    same = F.size(F.array_intersect("s1", "s2"))
    return (
        pairs.join(sets(1), "f1")
        .join(sets(2), "f2")
        .select(F.col("f1").alias("fingerprint"), F.col("f2").alias("other"), (same / (F.size("s1") + F.size("s2") - same)).alias("likeness"))
        .filter(F.col("likeness") >= least)
    )


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document against its edited text and its successor; rows come sorted by (part, peek, id, text)."""
    held: pa.RecordBatch | None = None

    def judge(table: pa.Table, alone: bool) -> pa.RecordBatch:
        part, peek = table["part"].to_pylist(), table["peek"].to_pylist()
        texts = [t or "" for t in table["text"].to_pylist()]
        if alone:
            own, after = list(range(len(texts))), [None] * len(texts)
        else:
            own = [i for i in range(len(texts) - 1) if not peek[i] and part[i] is not None and part[i] == part[i + 1]]
            after = [i + 1 for i in own]
        edited = []
        for i, j in zip(own, after, strict=True):
            half = len(texts[i]) // 2
            edited.append(texts[i][: len(texts[i]) - half] + (texts[j][:half] if j is not None else ""))
        every = spot_sets(pa.array([*texts, ""], pa.string()))
        pick = lambda at: _take(every, np.array([len(texts) if k is None else k for k in at], dtype=np.int64))
        mine, following, changed = pick(own), pick(after), spot_sets(pa.array(edited, pa.string()))
        return pa.RecordBatch.from_arrays(
            [
                table["id"].combine_chunks().take(pa.array(own, pa.int64())),
                pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array(digest(mine), pa.string()),
                pa.array(digest(changed), pa.string()),
                pa.array(likeness(mine, changed)),
                pa.array(likeness(mine, following)),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            outside = batch.filter(batch["part"].is_null())
            if outside.num_rows:
                yield judge(pa.Table.from_batches([outside]), True)
            batch = batch.filter(batch["part"].is_valid())
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([held, batch] if held is not None else [batch])
            yield judge(table, False)
            held = batch.slice(batch.num_rows - 1)


def _take(sets: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sig, begin = sets
    sizes = begin[rows + 1] - begin[rows]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(begin[rows], sizes)
    return sig[at], np.concatenate([[0], ends])


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Each document's fingerprint against those of its half-replaced text and of the next document.

    Documents are ordered by id (rows that repeat an id by text); after the last
    comes the first. They are dealt to ranges of ids by exact bounds, ids of
    the table, and a range's first document is dealt to the range before as
    well. So one shuffle brings every document together with its successor. Rows
    with a null id stand outside the order: an empty text follows each.
    Null texts count as empty. An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shares = F.array(*[F.lit(k / parts) for k in range(parts)])
    found = rows.agg(F.min("id").alias("least"), F.percentile_approx("id", shares, F.lit(max(10_000, 20 * parts))).alias("at")).first()
    known = [0] if found["least"] is None else [found["least"], *found["at"]]
    bounds = np.unique(np.array(known, dtype=np.int64))

    @pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        """Twice the range, and 1 more for its first document."""
        values = ids.to_numpy()
        at = np.searchsorted(bounds, values, side="right") - 1
        return pd.Series(2 * at + (bounds[np.maximum(at, 0)] == values))

    part = F.col("place").bitwiseAND(F.lit(-2)) / 2
    own = F.struct(part.cast("int").alias("part"), F.lit(False).alias("peek"))
    before = F.struct(F.pmod(part.cast("int") - 1, F.lit(len(bounds))).cast("int").alias("part"), F.lit(True).alias("peek"))
    dealt = (
        rows.withColumn("place", F.when(F.col("id").isNotNull(), place(F.coalesce("id", F.lit(int(bounds[0]))))))
        .withColumn("dealt", F.explode(F.when(F.col("place") % 2 == 1, F.array(own, before)).otherwise(F.array(own))))
        .select(F.col("dealt.part").alias("part"), F.col("dealt.peek").alias("peek"), "id", "text")
        .repartition(parts, F.coalesce("part", (F.xxhash64("text") % parts).cast("int")))
        .sortWithinPartitions("part", "peek", "id", "text")
    )
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(_edit, schema).withColumnRenamed("id", id_col)
