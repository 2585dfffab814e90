"""What both vector operators share: valid vectors as packed doubles, and bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vector: Column) -> Column:
    """Not null, not empty, no null and no non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def matrix(cells: list[bytes], width: int) -> np.ndarray:
    """Rows of packed doubles."""
    return np.frombuffer(b"".join(cells), np.float64).reshape(-1, width)


def packed(values: list[list[float]], width: int) -> list[bytes]:
    """Rows as bytes of `width` doubles; missing components at the end count as zero."""
    out = np.zeros((len(values), width))
    for row, v in zip(out, values, strict=True):
        row[: len(v)] = v
    return [r.tobytes() for r in out]


def bounded_sample(df: DataFrame, by: str, rows: int) -> list:
    """At most `rows` rows, those of the smallest hashes of column `by`: the same ones whatever the partitioning."""
    return df.orderBy(F.xxhash64(by), by).limit(rows).collect()


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of a bounded sample."""
    rng = np.random.default_rng(seed)
    unique = np.unique(points, axis=0)
    centres = unique[rng.permutation(len(unique))[:k]].copy()
    for _ in range(rounds):
        near = distances(points, centres).argmin(axis=1)
        for c in range(len(centres)):
            own = points[near == c]
            if len(own):
                centres[c] = own.mean(axis=0)
    return centres


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of x to all rows of y."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :], 0)
