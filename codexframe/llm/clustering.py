"""Centroid clustering over weighted distinct vectors.

Vectors become whole numbers, and equal ones one row with their multiplicity, before any round begins. A round assigns
every distinct vector to its nearest centroid and adds up, in exact whole numbers, what each centroid gets: a task gives
one row of sums a centroid, so that a round moves centroids x dimensions numbers a task and no vector. Only the
centroids are with the driver. The last assignment is joined back to the vec_ids by the vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexframe.llm.common import anew, arrow_schema, materialize
from codexframe.llm.vectors import valid

#: Whole components beyond this leave no room for exact 64-bit distances.
_MOST = 1 << 27


def _wholes(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of every row (ties: the smaller number) and its squared distance, exactly."""
    most = int(max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # every intermediate is a whole number that doubles hold
        a, c = x.astype(np.float64), centres.astype(np.float64)
        far = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]
    else:
        far = np.stack([((x - own) ** 2).sum(1) for own in centres], axis=1)
    best = far.argmin(axis=1)
    return best.astype(np.int32), far[np.arange(len(x)), best].astype(np.int64)


def _sums(centres: np.ndarray):
    """A task's sums: of each centroid it has vectors for, their number and their components' sums."""
    k, dims = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x, copies = _wholes(batch.column(0), dims), batch.column(1).to_numpy()
            own = nearest(x, centres)[0]
            np.add.at(many, own, copies)
            np.add.at(total, own, x * copies[:, None])
        lived = np.flatnonzero(many)
        yield pa.RecordBatch.from_pydict({"cluster": lived.astype(np.int32), "many": many[lived], "total": list(total[lived])}, schema=pa.schema([("cluster", pa.int32()), ("many", pa.int64()), ("total", pa.list_(pa.int64()))]))

    return run


def cluster_vectors(vectors: DataFrame, dims: int = 64, scale: int = 64, centroids: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """Clusters of vectors (vec_id, embedding) by `rounds` rounds of Lloyd's algorithm in whole numbers.

    Vectors with exactly `dims` components, none null or non-finite, take part; a component x becomes floor(scale * x).
    Centroids start as the vectors whose sha256 of "<seed>:<vec_id>" is smallest. In a round each vector goes to its
    nearest centroid (squared Euclidean distance, ties to the smaller number), and each centroid with vectors becomes
    their componentwise floor(sum / count); one without stays. A last assignment follows.

    Returns a row per vector that takes part: vec_id, cluster, distance (squared), cluster_inertia and inertia
    (distances summed over the cluster and over all), centroid_sha256 (components in decimal, joined by commas). A null
    vec_id takes no part. Repeated rows count as often as they come; a repeated vec_id with other vectors is a vector
    of its own, and as a start the lesser vector comes first. Fewer vectors than centroids start fewer. An empty table
    gives no rows; other columns are ignored. A component beyond 2^27 in whole numbers raises an error, since squared
    distances would not stay exact.
    """
    spark = vectors.sparkSession
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    takes_part = F.col("vec_id").isNotNull() & valid(F.col("embedding")) & (F.size("embedding") == dims)
    bounded = F.forall("q", lambda x: (x <= _MOST) & (x >= -_MOST))
    ints = F.transform(F.when(bounded, F.col("q")).otherwise(F.raise_error(F.lit(f"a component is beyond {_MOST} in whole numbers"))), lambda x: x.cast("int"))
    rows = vectors.where(takes_part).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q")).select("vec_id", ints.alias("q"))

    distinct = materialize(rows.groupBy("q").agg(F.count("*").alias("copies")), "distinct-vectors")
    first = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "vec_id", "q").limit(centroids).collect()
    ddl = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], ddl)
    centres = np.array([r.q for r in first], np.int64)

    exact = "decimal(38,0)"
    for _ in range(rounds):
        part = distinct.mapInArrow(_sums(centres), "cluster int, many long, total array<long>")
        added = part.groupBy("cluster").agg(F.sum(F.col("many").cast(exact)).alias("many"), *(F.sum(F.col("total")[d].cast(exact)).alias(f"d{d}") for d in range(dims)))
        for r in added.collect():  # a row a centroid
            centres[r.cluster] = [int(r[f"d{d}"]) // int(r.many) for d in range(dims)]

    final = centres.copy()
    schema = arrow_schema(spark, "q array<int>, copies long, cluster int, distance long")

    def assign(batches):
        for batch in batches:
            own, far = nearest(_wholes(batch.column(0), dims), final)
            yield pa.RecordBatch.from_pydict({"q": batch.column(0), "copies": batch.column(1), "cluster": own, "distance": far}, schema=schema)

    placed = materialize(distinct.mapInArrow(assign, "q array<int>, copies long, cluster int, distance long"), "assigned-vectors")
    inertia = {r.cluster: int(r.own) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast(exact) * F.col("copies")).alias("own")).collect()}
    told = [(c, own, sum(inertia.values()), hashlib.sha256(",".join(map(str, final[c].tolist())).encode()).hexdigest()) for c, own in sorted(inertia.items())]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row a centroid
    back = rows.join(anew(placed.select("q", "cluster", "distance")), "q")
    return back.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
