"""Many small numeric rows in one binary value, compressed column by column.

Word-level rows (a hash, a document, a place) go through a shuffle as a few
thousand packed values instead of as hundreds of millions of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pack(*columns: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    rows, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    raw = pa.decompress(pa.py_buffer(blob)[16:], size, "zstd")
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, rows, at))
        at += rows * np.dtype(kind).itemsize
    return out


def gather(blobs: list[bytes], *kinds: type) -> list[np.ndarray]:
    """The columns of several packed values, one after the other."""
    parts = [unpack(b, *kinds) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds)]


def by_group(groups: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of a sorted array and where its run lies."""
    if len(groups):
        cuts = np.flatnonzero(np.diff(groups)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(groups)], strict=True):
            yield int(groups[a]), slice(a, b)


def spread(hashes: np.ndarray, groups: int) -> np.ndarray:
    """The group of each hash by its high half, in hash order."""
    return ((hashes >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int32)
