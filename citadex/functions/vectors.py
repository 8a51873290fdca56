"""Vector helpers for Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

Encoder = Callable[[list[str]], np.ndarray]

QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "  # fixed value
_WORD = re.compile(r"[^\W_]+")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, dim) float64 matrix of a list column whose lists all have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    if n and (column.null_count or flat.size % n or len(set(column.value_lengths().to_pylist())) > 1):
        raise ValueError("vectors of one table must all have the same dimension")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def list_column(rows: np.ndarray) -> pa.Array:
    flat = pa.array(rows.astype("float32").reshape(-1))
    offsets = np.arange(0, rows.size + 1, rows.shape[1] if rows.size else 1, dtype="int32")
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def normalise(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.clip(norms, 1e-12, None)


def hashed_encoder(dim: int) -> Encoder:
    """Bag of words hashed into ``dim`` counts: needs no model, so builds and tests run anywhere."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        seen: dict[str, int] = {}
        for i, text in enumerate(texts):
            for word in _WORD.findall(text.lower()):
                slot = seen.get(word)
                if slot is None:
                    slot = seen[word] = int(hashlib.sha1(word.encode()).hexdigest()[:8], 16) % dim
                out[i, slot] += 1.0
        return normalise(out)

    return encode


def best_k(distances: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest (distance, id) pairs of every row, row by row in that order; all rows at once."""
    if distances.shape[1] > 4 * k:
        near = ~(distances > np.partition(distances, k - 1, axis=1)[:, k - 1 : k])  # what is not a number stays, and comes last
    else:
        near = np.ones(distances.shape, bool)
    row, column = np.nonzero(near)
    order = np.lexsort((ids[column], distances[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)  # where each row begins
    keep = np.arange(len(row)) - first < k
    return row[keep], column[keep]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rounded L2 distances of the rows of ``a`` from those of ``b``, pair by pair."""
    return np.round(np.sqrt(((a - b) ** 2).sum(1)), 6)
