"""Substring dedup with difference-cover anchors.

A passage of ``window`` words repeats if the same words start earlier: in a
document with a smaller id, or earlier in the same one. Hashing every window
of the corpus would shuffle a row per word, twice. Instead windows of
``ANCHOR`` words are hashed only at word places whose remainder modulo
``PERIOD`` lies in ``COVER``, a difference cover: for any two places there is a
shift below the period that brings both into the cover. So two equal passages
of at least ANCHOR + PERIOD - 1 = 20 words share an anchor at the same
distance from their starts, wherever they stand. Four places of 13 are hashed.

1. Anchors of all documents meet by hash; those that occur once drop out.
2. Repeated anchors return to their documents and extend: every window of
   ``window`` words around one is hashed in full (96 bits).
3. These windows meet by hash; every occurrence but the first is a repeat.
4. Repeats return to their documents, and the words they cover go.

Hot passages: each map batch (step 1) and each block of documents (step 2)
sends one row per distinct hash, its first, and settles its other occurrences
itself. A hash therefore brings a receiving task no more rows than there are
batches. Rows travel packed (``llm.packed``) and are dealt to groups by hash, in a
number that follows ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.packed import by_group, gather, pack, spread
from llm.scratch import blocks
from llm.words import words

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1

_BATCH = 3000  # documents whose anchors a map task holds at a time
_NO_ID = np.iinfo(np.int64).min
_NOTE = "block int, note binary"
_ROWS, _PASS = 0, 1
_MOVED = "grp int, kind int, rows binary"
_ANCHORS = (np.uint64, np.int64, np.int32, np.int32, np.uint8)
_WINDOWS = (np.uint64, np.uint32, np.int64, np.int32, np.int32)
_PLACES = (np.int64, np.int32)


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, _NO_ID).to_numpy()


def _deal(out: dict[str, list], groups: np.ndarray, kind: int, columns: list[np.ndarray]) -> None:
    """Add packed rows, dealt to their groups; inside a group the order stays."""
    order = np.argsort(groups, kind="stable")
    columns = [c[order] for c in columns]
    for group, rows in by_group(groups[order]):
        out["grp"].append(group)
        out["kind"].append(kind)
        out["rows"].append(pack(*(c[rows] for c in columns)))


def _moved(out: dict[str, list]) -> pa.Table:
    return pa.table({"grp": pa.array(out["grp"], pa.int32()), "kind": pa.array(out["kind"], pa.int32()), "rows": pa.array(out["rows"], pa.binary())})


def _firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that are the first with their key, whether their key repeats, and all other rows (all in order)."""
    order = np.lexsort(keys)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = order[new]
    repeats = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
    by_place = np.argsort(first)
    return first[by_place], repeats[by_place], np.sort(order[~new])


def _anchors(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = np.isin(np.arange(PERIOD), COVER)
        for batch in (b.slice(k, _BATCH) for b in batches for k in range(0, b.num_rows, _BATCH)):
            ids, home = _ids(batch.column(0)), batch.column(1).to_numpy()
            parts: list[tuple] = []
            for w in words(batch.column(2)):
                at, hashes = w.windows(ANCHOR)
                place = at - w.begin[w.row[at]]
                use = cover[place % PERIOD]
                row = w.row[at[use]] + w.first
                parts.append((hashes[use], ids[row], place[use].astype(np.int32), home[row]))
            hashes, doc, place, block = (np.concatenate([p[k] for p in parts]) for k in range(4))
            first, repeats, others = _firsts(hashes)
            out: dict[str, list] = {"grp": [], "kind": [], "rows": []}
            flags = repeats.astype(np.uint8)
            _deal(out, spread(hashes[first], groups), _ROWS, [hashes[first], doc[first], place[first], block[first], flags])
            known = np.sort(np.concatenate([first[repeats], others]))
            _deal(out, block[known], _PASS, [doc[known], place[known]])
            yield from _moved(out).to_batches()

    return run


def _by_block(block: np.ndarray, doc: np.ndarray, place: np.ndarray, passed: list) -> pa.Table:
    """Notes to blocks of documents; ``passed``: (block, note) pairs that go on as they are."""
    order = np.lexsort((place, doc, block))
    block, doc, place = block[order], doc[order], place[order]
    notes = [(b, pack(doc[r], place[r])) for b, r in by_group(block)] + passed
    return pa.table({"block": pa.array([b for b, _ in notes], pa.int32()), "note": pa.array([n for _, n in notes], pa.binary())})


def _split(table: pa.Table) -> tuple[list[bytes], list]:
    kinds, rows, groups = table["kind"].to_pylist(), table["rows"].to_pylist(), table["grp"].to_pylist()
    return [r for k, r in zip(kinds, rows, strict=True) if k == _ROWS], [
        (g, r) for g, k, r in zip(groups, kinds, rows, strict=True) if k == _PASS
    ]


def _repeated(table: pa.Table) -> pa.Table:
    """Anchors of one hash range: the places of those that occur elsewhere too."""
    rows, passed = _split(table)
    hashes, doc, place, block, flag = gather(rows, *_ANCHORS)
    order = np.argsort(hashes, kind="stable")
    twin = np.zeros(len(order), dtype=bool)
    same = hashes[order][1:] == hashes[order][:-1]
    twin[1:] |= same
    twin[:-1] |= same
    tell = order[twin & (flag[order] == 0)]  # flagged ones have been told by their own batch
    return _by_block(block[tell], doc[tell], place[tell], passed)


def _later(table: pa.Table) -> pa.Table:
    """Windows of one hash range: the places of all but each one's first occurrence."""
    rows, passed = _split(table)
    high, low, doc, place, block = gather(rows, *_WINDOWS)
    order = np.lexsort((place, doc, low, high))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    tell = order[again]
    return _by_block(block[tell], doc[tell], place[tell], passed)


def _ordered(docs: pa.Table) -> pa.Table:
    """Documents by id; rows that repeat an id by text. Null ids come first."""
    keys = pa.table({"i": pa.array(_ids(docs["c0"])), "t": docs["c1"]})
    return docs.take(pc.sort_indices(keys, sort_keys=[("i", "ascending"), ("t", "ascending")]))


def _starts(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first word place of each row: rows that repeat an id count on."""
    before = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    new = np.ones(len(ids), dtype=bool)
    new[1:] = ids[1:] != ids[:-1]
    return before - before[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))] if len(ids) else before


def _notes(notes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    doc, place = gather(notes["note"].to_pylist(), *_PLACES)
    order = np.lexsort((place, doc))
    return doc[order], place[order]


def _extend(window: int, groups: int):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        out: dict[str, list] = {"grp": [], "kind": [], "rows": []}
        if not docs.num_rows or not notes.num_rows:
            return _moved(out)
        home = docs["block"][0].as_py()
        docs = _ordered(docs)
        ids = _ids(docs["c0"])
        doc, place = _notes(notes)
        low, high = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
        found: list[tuple] = []
        counts = np.zeros(len(ids), dtype=np.int64)
        for w in words(docs["c1"]):
            counts[w.first : w.last] = np.diff(w.begin)
            marks = np.zeros(len(w.row) + 1, dtype=np.int64)
            for row in np.flatnonzero(high[w.first : w.last] > low[w.first : w.last]):
                at = w.begin[row] + place[low[w.first + row] : high[w.first + row]]
                marks[at[at < w.begin[row + 1]] + 1] = 1
            marks = np.cumsum(marks)
            at, first_hash = w.windows(window)
            near = marks[at + window - ANCHOR + 1] > marks[at]
            _, second_hash = w.windows(window, 1)
            at = at[near]
            row = w.row[at]
            found.append((first_hash[near], (second_hash[near] >> np.uint64(32)).astype(np.uint32), row + w.first, at - w.begin[row]))
        upper, lower, row, inside = (np.concatenate([f[k] for f in found]) for k in range(4))
        doc, place = ids[row], (_starts(ids, counts)[row] + inside).astype(np.int32)
        first, _, others = _firsts(lower, upper)
        columns = [upper, lower, doc, place, np.full(len(upper), home, np.int32)]
        _deal(out, spread(upper[first], groups), _ROWS, [c[first] for c in columns])
        _deal(out, np.full(len(others), home, np.int32), _PASS, [doc[others], place[others]])
        return _moved(out)

    return run


def _cut(window: int, names: list[str]):
    def run(docs: pa.Table, notes: pa.Table) -> pa.Table:
        docs = _ordered(docs)
        ids = _ids(docs["c0"])
        doc, place = _notes(notes)
        counts = np.zeros(len(ids), dtype=np.int64)
        for w in words(docs["c1"]):
            counts[w.first : w.last] = np.diff(w.begin)
        starts = _starts(ids, counts)
        low = np.searchsorted(doc, ids)
        high = np.searchsorted(doc, ids, side="right")
        texts, removed = [], np.zeros(len(ids), dtype=np.int64)
        for w in words(docs["c1"]):
            hits = np.zeros(len(w.row) + 1, dtype=np.int64)
            for row in np.flatnonzero(high[w.first : w.last] > low[w.first : w.last]):
                own = place[low[w.first + row] : high[w.first + row]].astype(np.int64) - starts[w.first + row]
                own = own[(own >= 0) & (own <= counts[w.first + row] - window)] + w.begin[row]
                np.add.at(hits, own, 1)
                np.add.at(hits, own + window, -1)
            gone = np.cumsum(hits)[:-1] > 0
            raw = w.data.tobytes()
            begin, start, end = w.begin.tolist(), w.start.tolist(), w.end.tolist()
            for row in range(w.last - w.first):
                a, b = begin[row], begin[row + 1]
                stay = np.flatnonzero(~gone[a:b]).tolist()
                removed[w.first + row] = b - a - len(stay)
                texts.append(b" ".join([raw[start[a + k] : end[a + k]] for k in stay]).decode())
        out = {n: docs[n] for n in names}
        out |= {"n_words": pa.array(counts), "n_removed": pa.array(removed), "kept": pa.array(texts, pa.string())}
        return pa.table(out)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   columns: list[str] | None = None) -> DataFrame:
    """``id_col`` and ``columns`` of every row with n_words, n_removed and kept_words.

    The text comes back only where ``columns`` names it.

    A word goes if a window of ``window`` (at least 20) consecutive words of
    its text covers it whose words also start earlier, in the order of (id,
    place). Windows are judged on the input. kept_words: the others, joined by
    one space. Null and empty texts have no words. Rows with a null id come
    before all ids; rows that repeat an id come one after the other in the order
    of their texts, so of two equal rows the second loses its windows. Extra
    columns may have any names.
    """
    if window < WINDOW:
        raise ValueError(f"window must be at least {WINDOW} words, for shorter ones may hold no anchor")
    spark = docs.sparkSession
    groups = blocks(spark)
    carried = [c for c in columns or [] if c not in (id_col, text_col)]
    results = [id_col, *carried, *([text_col] if text_col in (columns or []) else [])]
    base = docs.select(
        F.col(id_col).cast("long").alias("c0"),
        F.col(text_col).cast("string").alias("c1"),
        *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried, 2)),
    ).withColumn("block", F.pmod(F.xxhash64("c0"), F.lit(groups)).cast("int"))
    anchors = base.select("c0", "block", "c1").mapInArrow(_anchors(groups), _MOVED)
    told = anchors.groupBy("grp").applyInArrow(_repeated, _NOTE)
    homes = base.groupBy("block")
    windows = homes.cogroup(told.groupBy("block")).applyInArrow(_extend(window, groups), _MOVED)
    later = windows.groupBy("grp").applyInArrow(_later, _NOTE)
    names = {"c0": id_col, "c1": text_col, **{f"c{k}": c for k, c in enumerate(carried, 2)}}
    fields = [f for f in base.schema.fields if names.get(f.name) in results]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + ["n_words long, n_removed long, kept string"])
    cut = homes.cogroup(later.groupBy("block")).applyInArrow(_cut(window, [f.name for f in fields]), schema)
    return cut.select(
        *(F.col(f.name).alias(names[f.name]) for f in fields), "n_words", "n_removed", F.col("kept").alias("kept_words")
    )
