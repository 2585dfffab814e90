"""Exact top-k search by inner product over a pivot-distance index.

Inner products become distances by one added coordinate (every row is lifted to the same norm, queries get zero).
Rows are keyed by their nearest pivot and their distance to it, and cut into rings of that distance. A query first
searches the ring it falls in; its k-th best distance then bounds, by the triangle inequality, which rings of which
pivots, and which annulus within them, can hold anything better. A task finds these by binary search in the rings'
edges, so that only the visits themselves are shuffled, and a ring is copied only to the blocks of its own visitors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexframe.llm.common import anew, arrow_schema, map_batches, materialize
from codexframe.llm.vectors import bounded_sample, matrix, packed, valid

_HITS = "query_id long, vec_id long, score long"
#: Room for rounding in distances, relative.
_SLACK = 1e-6


def _products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: exact in doubles, or in 64-bit integers where doubles would round."""
    if q.size and r.size and np.abs(q).max() * np.abs(r).max() * q.shape[1] >= 2**53:
        return q.astype(np.int64) @ r.astype(np.int64).T
    return q @ r.T


def best_of_block(qid: np.ndarray, rid: np.ndarray, scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best allowed rows of every query, ties to the smaller id."""
    low = np.where(allowed, scores, -np.inf)
    if low.shape[1] > k:
        least = np.partition(low, -k, axis=1)[:, -k]
        allowed = allowed & (low >= least[:, None])
    q, r = np.nonzero(allowed)
    s = scores[q, r]
    order = np.lexsort((rid[r], -s, q))
    q, r, s = q[order], r[order], s[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return qid[q[keep]], rid[r[keep]], s[keep].astype(np.int64)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 64, sample_rows: int = 20_000, ring_rows: int = 4096, query_block: int = 4096) -> DataFrame:
    """The k rows of highest inner product for every query: query_id, rank (from 1), vec_id, score; ties to smaller vec_id.

    rows and queries: (vec_id long, embedding array of whole numbers as doubles). A query's own vec_id is no candidate.
    Vectors that are null, empty, or hold null or non-finite components take no part, nor does a null vec_id. A
    repeated vec_id keeps its least vector. Shorter vectors count as padded with zeros. Fewer candidates than k give
    fewer rows, empty tables none; other columns are ignored. Pivots come from a sample of at most `sample_rows`; the
    edges of the rings (a number for every `ring_rows` rows) go to all tasks.
    """
    spark = rows.sparkSession

    def clean(df):
        return df.where(valid(F.col("embedding")) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("v"))

    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    width = max(width, queries.agg(F.max(F.size("embedding"))).first()[0] or 1, 1)

    def pack(batch: pa.RecordBatch) -> dict:
        cells = packed(batch.column(1).to_pylist(), width)
        return {"vec_id": batch.column(0), "v": cells, "norm2": [float((np.frombuffer(c) ** 2).sum()) for c in cells]}

    kind = "vec_id long, v binary, norm2 double"
    data = map_batches(clean(rows), pack, kind)
    # of equal vectors, only the k + 1 smallest ids can ever be among the k best of a query other than themselves
    copies = Window.partitionBy("v").orderBy("vec_id")
    data = materialize(data.withColumn("copy", F.row_number().over(copies)).where(f"copy <= {k + 1}").drop("copy"), "vectors")
    asked = materialize(map_batches(clean(queries), pack, kind), "queries")
    size = data.agg(F.count("*"), F.max("norm2")).first()
    if not size[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lift2 = size[1]
    # components are whole numbers: two bytes each where none is larger
    letter = "<i2" if max(lift2, asked.agg(F.max("norm2")).first()[0] or 0) < 2.0**30 else "<f8"

    def small(v: np.ndarray) -> list[bytes]:
        return [row.tobytes() for row in v.astype(letter)]

    def whole(cells: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(cells), letter).reshape(-1, width).astype(np.float64)

    drawn = matrix([bytes(r.v) for r in bounded_sample(data, "vec_id", sample_rows)], width)
    unique = np.unique(drawn, axis=0)
    centres = unique[np.random.default_rng(11).permutation(len(unique))[:pivots]]
    centre2 = (centres * centres).sum(axis=1)
    centre_up = np.sqrt(np.maximum(lift2 - centre2, 0))

    def to_pivots(v: np.ndarray, up: np.ndarray) -> np.ndarray:
        d2 = (v * v).sum(1)[:, None] + centre2[None, :] - 2 * (v @ centres.T) + (up[:, None] - centre_up[None, :]) ** 2
        return np.sqrt(np.maximum(d2, 0))

    def lifted(v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(lift2 - (v * v).sum(1), 0))

    d = to_pivots(drawn, lifted(drawn))
    near, far = d.argmin(axis=1), d.min(axis=1)
    edges = []
    for p in range(len(centres)):
        own = far[near == p]
        rings = max(1, round(len(own) / len(drawn) * size[0] / ring_rows))
        edges.append(np.quantile(own, np.arange(1, rings) / rings) if len(own) else np.zeros(0))
    lived_in = np.bincount(near, minlength=len(centres)) > 0

    def key(batch: pa.RecordBatch) -> dict:
        v = matrix(batch.column(1).to_pylist(), width)
        d = to_pivots(v, lifted(v))
        p = d.argmin(axis=1)
        own = d[np.arange(len(v)), p]
        ring = [int(np.searchsorted(edges[a], b)) for a, b in zip(p, own, strict=True)]
        return {"pivot": p.astype(np.int32), "ring": ring, "vec_id": batch.column(0), "v": small(v), "far": own}

    index = materialize(map_batches(data, key, "pivot int, ring int, vec_id long, v binary, far double"), "index")
    visit_kind = "query_id long, v binary, norm2 double, pivot int, ring int, dp double, tau double"

    def seed(batch: pa.RecordBatch) -> dict:
        v = matrix(batch.column(1).to_pylist(), width)
        d = np.where(lived_in, to_pivots(v, np.zeros(len(v))), np.inf)
        p = d.argmin(axis=1)
        dp = d[np.arange(len(v)), p]
        ring = [int(np.searchsorted(edges[a], b)) for a, b in zip(p, dp, strict=True)]
        return {"query_id": batch.column(0), "v": small(v), "norm2": batch.column(2), "pivot": p.astype(np.int32), "ring": ring, "dp": dp, "tau": np.full(len(v), np.inf)}

    def reach(batch: pa.RecordBatch) -> dict:
        """Rings of the annuli within tau, and of cells whose rows can be within tau; without the ring of the first visit."""
        v = matrix(batch.column(1).to_pylist(), width)
        d, tau = to_pivots(v, np.zeros(len(v))), batch.column(3).to_numpy(zero_copy_only=False)
        first = np.where(lived_in, d, np.inf).argmin(axis=1)
        out: dict[str, list] = {c: [] for c in ("row", "pivot", "ring", "dp")}
        for q, (own, t) in enumerate(zip(d, tau, strict=True)):
            for p in np.flatnonzero(own <= own.min() + 2 * t):
                dp = own[p]
                skip = int(np.searchsorted(edges[p], dp)) if p == first[q] else -1
                for ring in range(int(np.searchsorted(edges[p], dp - t)), int(np.searchsorted(edges[p], dp + t, "right")) + 1):
                    if ring != skip:
                        out["row"].append(q), out["pivot"].append(int(p)), out["ring"].append(ring), out["dp"].append(dp)
        row = np.array(out.pop("row"), np.int64)
        cells, norm2 = small(v), batch.column(2).to_numpy()
        return {"query_id": batch.column(0).to_numpy()[row], "v": [cells[q] for q in row], "norm2": norm2[row], **out, "tau": tau[row]}

    schema = arrow_schema(spark, _HITS)

    def search(asking, residents):
        if not asking.num_rows or not residents.num_rows:
            return schema.empty_table()
        residents = residents.sort_by([("far", "ascending"), ("vec_id", "ascending")])
        asking = asking.sort_by([("dp", "ascending"), ("query_id", "ascending")])
        far, rid, r = residents["far"].to_numpy(), residents["vec_id"].to_numpy(), whole(residents["v"].to_pylist())
        dp, tau, qid, q = asking["dp"].to_numpy(), asking["tau"].to_numpy(), asking["query_id"].to_numpy(), whole(asking["v"].to_pylist())
        out: list[tuple] = []
        for at in range(0, len(q), 256):
            part = slice(at, at + 256)
            lo, hi = np.searchsorted(far, dp[part] - tau[part]), np.searchsorted(far, dp[part] + tau[part], "right")
            a, b = int(lo.min()), int(hi.max())
            if a >= b:
                continue
            scores = _products(q[part], r[a:b])
            place = np.arange(a, b)[None, :]
            allowed = (place >= lo[:, None]) & (place < hi[:, None]) & (rid[None, a:b] != qid[part][:, None])
            out.append(best_of_block(qid[part], rid[a:b], scores, allowed, k))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)), schema=schema)

    def visit(visits):
        """Hits of all visits; visitors of a ring beyond query_block are dealt over blocks, each with the ring's rows."""
        asked_for = visits.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / query_block).alias("blocks"))
        asked_for = materialize(asked_for, "rings")
        wanted = visits.join(asked_for, ["pivot", "ring"]).withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks"))
        wanted = wanted.select("pivot", "ring", "block", "query_id", "v", "dp", "tau").groupBy("pivot", "ring", "block")
        wide = anew(index).join(anew(asked_for), ["pivot", "ring"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        return wanted.cogroup(wide.groupBy("pivot", "ring", "block")).applyInArrow(search, _HITS)

    near_hits = materialize(visit(materialize(map_batches(asked, seed, visit_kind), "seeds")), "hits")
    bound = near_hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    tau = F.sqrt(F.greatest(F.col("norm2") + F.lit(lift2) - 2 * F.col("least"), F.lit(0.0))) * (1 + _SLACK) + _SLACK
    bounded = asked.withColumnRenamed("vec_id", "query_id").join(bound, "query_id", "left").select("query_id", "v", "norm2", F.when(F.col("n") >= k, tau).otherwise(float("inf")).alias("tau"))
    visits_schema = arrow_schema(spark, visit_kind)

    def reach_all(batches):
        for batch in batches:  # a few queries at a time: each can visit very many rings
            for at in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_pydict(reach(batch.slice(at, 64)), schema=visits_schema)

    hits = near_hits.unionByName(visit(materialize(bounded.mapInArrow(reach_all, visit_kind), "visits")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
