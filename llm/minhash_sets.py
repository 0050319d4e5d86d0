"""Shingle sets of texts, their digests and one-permutation sketches, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from llm.words import mix, run_hashes, words


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per chunk: its first row, all sets one after the other, where each begins.

    A set holds the sorted distinct hashes of the ``size``-word shingles of the
    text, A-Z folded; of a shorter text the whole sequence; of no words nothing.
    """
    for w in words(texts, lower=True):
        rows = w.last - w.first
        at, hashes = w.windows(size)
        owner = w.row[at]
        count = np.diff(w.begin)
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            owner = np.concatenate([owner, short])
            hashes = np.concatenate([hashes, run_hashes(w.hash, w.begin[short], w.begin[short + 1])])
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        new = np.ones(len(owner), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        owner, hashes = owner[new], hashes[new]
        yield w.first, hashes, np.searchsorted(owner, np.arange(rows + 1))


def sketches(hashes: np.ndarray, begin: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation sketch of every set, empty bins densified; sets without members give rows of 0.

    One hash permutes the members: its high bits name the bin, and a bin keeps
    its least value. An empty bin copies a filled one chosen by a hash of (bin,
    try), the same for every set (optimal densification), so that two sets
    agree in a bin with the probability of their likeness. It goes on until every bin is filled.
    """
    rows = len(begin) - 1
    owner = np.repeat(np.arange(rows), np.diff(begin))
    value = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    which = ((value >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(rows * bins, top)
    np.minimum.at(out, owner * bins + which, value)
    out = out.reshape(rows, bins)
    filled = out != top
    some = filled.any(axis=1)
    empty_row, empty_bin = np.nonzero(~filled & some[:, None])
    alone = filled.sum(axis=1)[empty_row] == 1  # any number of tries ends in the one filled bin
    only = filled.argmax(axis=1)[empty_row[alone]]
    out[empty_row[alone], empty_bin[alone]] = out[empty_row[alone], only]
    empty_row, empty_bin = empty_row[~alone], empty_bin[~alone]
    attempt = 0
    while len(empty_row):
        attempt += 1
        aim = mix((empty_bin.astype(np.uint64) << np.uint64(32)) + np.uint64(attempt))
        aim = ((aim >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        hit = filled[empty_row, aim]
        out[empty_row[hit], empty_bin[hit]] = out[empty_row[hit], aim[hit]]
        empty_row, empty_bin = empty_row[~hit], empty_bin[~hit]
    out[~some] = 0
    return out


def band_hashes(sketch: np.ndarray, bands: int) -> np.ndarray:
    """A hash of each of ``bands`` equal parts of every sketch; the parts' numbers go into it."""
    rows, bins = sketch.shape
    parts = sketch.reshape(rows, bands, bins // bands)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (rows, bands)).copy()
    for k in range(bins // bands):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out
