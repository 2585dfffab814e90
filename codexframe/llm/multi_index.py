"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector has a codebook of its own, and the pairs of codes are the cells that entries are filed under. A
query walks the cells by the sum of both half distances, nearest first, with a heap over the two sorted lists of codes;
the entries of the cells it comes to are ranked again by their distance as it is. How many cells a walk takes is measured:
a bounded number of queries is held against all rows by brute force, and walks are as long as it takes to come to the
wanted share of their true neighbours. A query that has found too few entries walks on, four times as far. Cells of
one left code and neighbouring right codes form regions of a bounded number of entries, so that a query and its hits
travel once a region; a region with very many entries or visitors is dealt over blocks of both.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexframe.llm.common import anew, arrow_schema, materialize
from codexframe.llm.vectors import bounded_sample, distances, kmeans, valid

_ENTRIES = "cell long, vec_id long, v binary"
_HITS, _VISITS = "query_id long, vec_id long, score double", "region long, query_id long, q binary, codes array<int>"


def walk(left: np.ndarray, right: np.ndarray, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Cells (left code, right code) from the `first`-th to before the `last`-th by the sum of their distances, ties by rank."""
    a, b = left.argsort(kind="stable"), right.argsort(kind="stable")
    left, right = left[a].tolist(), right[b].tolist()
    heap, step = [(left[0] + right[0], 0, 0)], 0
    while heap and step < last:
        _, i, j = heapq.heappop(heap)
        if step >= first:
            yield int(a[i]), int(b[j])
        step += 1
        if j + 1 < len(right):
            heapq.heappush(heap, (left[i] + right[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(left):
            heapq.heappush(heap, (left[i + 1] + right[0], i + 1, 0))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of q to rows of x, one by one."""
    d = q - x
    return np.sqrt((d * d).sum(axis=1))


def best_of_block(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int, allowed: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest allowed of x to each of q but those of its own id, ties to the smaller id, by exact distances."""
    far = np.where((xid[None, :] != qid[:, None]) & allowed, distances(q, x), np.inf)
    keep = np.isfinite(far)
    if far.shape[1] > k:  # products round: what is within their error of the k-th is in reach
        room = 1e-12 * ((q * q).sum(1)[:, None] + (x * x).sum(1).max())
        keep &= far <= np.partition(far, k - 1, axis=1)[:, k - 1 : k] + room
    i, j = np.nonzero(keep)
    score = np.concatenate([_exact(q[i[at : at + 65536]], x[j[at : at + 65536]]) for at in range(0, len(i), 65536)] or [np.zeros(0)])
    order = np.lexsort((xid[j], score, i))
    i, j, score = i[order], j[order], score[order]
    near = np.arange(len(i)) - np.searchsorted(i, i) < k
    return qid[i[near]], xid[j[near]], score[near]


class MultiIndex:
    """Codebooks of both halves, how many right codes a region takes, and how many cells a walk takes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, half: int, wide: int):
        off = right - right.mean(axis=0)
        self.left, self.right, self.half = left, right[(off @ np.linalg.svd(off, full_matrices=False)[2][0]).argsort(kind="stable")], half  # neighbours side by side
        self.wide, self.across, self.visits = min(wide, len(right)), -(-len(right) // wide), 1

    @property
    def cells(self) -> int:
        return len(self.left) * len(self.right)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.left), distances(x[:, self.half :], self.right)

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)

    def steps(self, q: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells a walk of each of q takes until it comes to the cell beside it."""
        a, b = self.halves(q)
        right, row = np.sort(b, axis=1), np.arange(len(q))
        far = a[row, cells // len(self.right)] + b[row, cells % len(self.right)]
        # cells no farther: for every left code, the right codes within what is left of the distance
        return np.array([np.searchsorted(right[n], far[n] - a[n], "right").sum() for n in row], np.int64)

    def calibrate(self, q: np.ndarray, cells: np.ndarray, recall: float) -> None:
        """Make walks so long that they come to the share `recall` of the cells that q's neighbours are filed under."""
        self.visits = min(self.cells, max(1, int(np.quantile(self.steps(q, cells), recall, method="higher")))) if len(q) else self.cells


def fit(sample: np.ndarray, codes: int, wide: int) -> MultiIndex:
    half = max(1, sample.shape[1] // 2)
    return MultiIndex(kmeans(sample[:, :half], codes), kmeans(sample[:, half:], codes), half, wide)


def nearest_vectors(rows: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.97, cell_rows: int = 64, codes: int = 1024, sample_rows: int = 20_000, trials: int = 256, region_rows: int = 2048, block_rows: int = 4096) -> DataFrame:
    """The k rows nearest to every query that a walk finds: query_id, rank (from 1), vec_id, score (Euclidean distance).

    rows and queries: (vec_id, embedding). A query's own vec_id is no candidate; ties go to the smaller vec_id. Vectors
    that are null, empty or zero, or hold null or non-finite components, take no part, nor does a null vec_id. A
    repeated vec_id keeps its least vector; of equal vectors all that can be among the k best are kept. Shorter vectors
    count as padded with zeros. Fewer candidates than k give all of them; empty tables give no rows; other columns are
    ignored. Codebooks, of at most `codes` codes, are fitted on at most `sample_rows` rows; every row is filed. Walks are so
    long that at most `trials` queries come to the share `recall` of their true neighbours, as brute force over all rows
    finds them; regions take about `region_rows` rows. Components beyond 1e150 give infinite distances and are not found.
    """
    spark = rows.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def clean(df):
        taken = valid(F.col("embedding")) & F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0)
        return df.where(taken).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").groupBy("vec_id").agg(F.min("embedding").alias("v"))

    # of equal vectors, only the k + 1 smallest ids can ever be among the k nearest of a query other than themselves
    copies = Window.partitionBy("v").orderBy("vec_id")
    data = materialize(clean(rows).withColumn("copy", F.row_number().over(copies)).where(f"copy <= {k + 1}").drop("copy"), "vectors")
    asked = materialize(clean(queries).withColumnRenamed("vec_id", "query_id"), "queries")
    n, widest = data.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not asked.count():
        return nothing
    width = max(2, widest, asked.agg(F.max(F.size("v"))).first()[0])
    letter = "<f4" if data.schema["v"].dataType.elementType.simpleString() == asked.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"

    def dense(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), width))
        ends = np.cumsum(sizes := np.array([len(v) for v in column], np.int64))
        flat = column.flatten().to_numpy(zero_copy_only=False)
        out[np.repeat(np.arange(len(out)), sizes), np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
        return out

    def small(x: np.ndarray) -> list[bytes]:
        return [r.tobytes() for r in x.astype(letter)]

    def whole(cells: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(cells), letter).reshape(-1, width).astype(np.float64)

    def drawn_from(df: DataFrame, by: str, most: int) -> tuple[np.ndarray, np.ndarray]:
        held = bounded_sample(df, by, most)
        return np.array([r[by] for r in held], np.int64), np.array([[*r.v, *[0.0] * (width - len(r.v))] for r in held], np.float64)

    drawn = drawn_from(data, "vec_id", sample_rows)[1]
    size = int(np.clip(np.sqrt(n / cell_rows), 2, min(codes, max(2, len(drawn) // 8))))
    index = fit(drawn, size, int(np.clip(region_rows * size**2 // n, 1, size)))

    schemas = {ddl: arrow_schema(spark, ddl) for ddl in (_ENTRIES, _VISITS, _HITS)}

    def file(batches):
        for batch in batches:
            x = dense(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(index.cell(x)), batch.column(0), pa.array(small(x), pa.binary())], schema=schemas[_ENTRIES])

    entries = materialize(data.mapInArrow(file, _ENTRIES), "entries")
    region = (F.expr(f"cell div {len(index.right)}") * index.across + F.expr(f"cell % {len(index.right)} div {index.wide}")).alias("region")
    filed = materialize(entries.groupBy(region).agg(F.ceil(F.count("*") / block_rows).alias("eb")), "regions")

    tried, trial = drawn_from(asked, "query_id", trials)

    def nearest_of_task(batches):
        """The task's k nearest of every trial query, with their cells."""
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for batch in batches:
            x, xid, cells = whole(batch.column(2).to_pylist()), batch.column(1).to_numpy(), batch.column(0).to_numpy()
            by_id = np.argsort(xid)
            for at in range(0, len(x), 4096):
                q, own, score = best_of_block(tried, trial, xid[at : at + 4096], x[at : at + 4096], k)
                new = (q, own, score, cells[by_id[np.searchsorted(xid, own, sorter=by_id)]])
                held = [np.concatenate(c) for c in zip(held, new, strict=True)]
                order = np.lexsort((held[1], held[2], held[0]))
                held = [c[order] for c in held]
                held = [c[np.arange(len(c)) - np.searchsorted(held[0], held[0]) < k] for c in held]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["query_id", "vec_id", "score", "cell"])

    true = entries.mapInArrow(nearest_of_task, _HITS + ", cell long").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    true = true.where(f"rank <= {k}").select("query_id", "cell").toPandas()  # at most trials * k rows
    place = {int(i): n for n, i in enumerate(tried)}
    index.calibrate(trial[[place[i] for i in true["query_id"]]], true["cell"].to_numpy(np.int64), recall)

    def visits_of(first: int, last: int):
        """A row for each region that a query's walk comes to, with the right codes of its cells there, counted in the region."""

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 64):  # a few queries at a time: each can visit very many cells
                    part = batch.slice(at, 64)
                    x = dense(part.column(1))
                    a, b = index.halves(x)
                    row, own, codes = [], [], []
                    for r in range(len(x)):
                        met: dict[int, list[int]] = {}
                        for i, j in walk(a[r], b[r], first, last):
                            met.setdefault(i * index.across + j // index.wide, []).append(j % index.wide)
                        row += [r] * len(met)
                        own += met.keys()
                        codes += met.values()
                    kept = small(x)
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), part.column(0).take(pa.array(row, pa.int64())), pa.array([kept[r] for r in row], pa.binary()), pa.array(codes, pa.list_(pa.int32()))], schema=schemas[_VISITS])

        return run

    def search(asking, living):
        schema = schemas[_HITS]
        if not asking.num_rows or not living.num_rows:
            return schema.empty_table()
        qid, xid, q, x = asking["query_id"].to_numpy(), living["vec_id"].to_numpy(), whole(asking["q"].to_pylist()), whole(living["v"].to_pylist())
        code, met = living["cell"].to_numpy() % len(index.right) % index.wide, np.zeros((len(q), index.wide), bool)
        for own, codes in zip(met, asking["codes"].to_pylist(), strict=True):
            own[codes] = True
        found = [best_of_block(qid[at : at + 256], q[at : at + 256], xid, x, k, met[at : at + 256, code]) for at in range(0, len(q), 256)]
        return pa.table(dict(zip(schema.names, (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)), schema=schema)

    def look(asking: DataFrame, first: int, last: int) -> DataFrame:
        """Hits of the walks of some queries from one step to another; crowded regions go by blocks of entries and of visitors."""
        visits = materialize(asking.mapInArrow(visits_of(first, last), _VISITS).join(anew(filed), "region"), "visits")
        crowd = materialize(visits.groupBy("region").agg(F.ceil(F.count("*") / block_rows).alias("qb")), "crowds")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        going = visits.join(anew(crowd), "region").withColumn("qn", F.pmod(F.xxhash64("query_id"), "qb")).withColumn("en", every("eb")).select("region", "qn", "en", "query_id", "q", "codes")
        living = anew(entries).withColumn("region", region).join(anew(crowd), "region").join(anew(filed), "region")
        living = living.withColumn("en", F.pmod(F.xxhash64("vec_id"), "eb")).withColumn("qn", every("qb")).select("region", "qn", "en", "vec_id", "v", "cell")
        keys = ["region", "qn", "en"]
        return materialize(going.groupBy(*keys).cogroup(living.groupBy(*keys)).applyInArrow(search, _HITS), "hits")

    hits, first, last, asking = None, 0, index.visits, asked
    while True:
        new = look(asking, first, last)
        hits = new if hits is None else hits.unionByName(new)
        if last >= index.cells:
            break
        found = hits.groupBy("query_id").agg(F.count("*").alias("n"))
        asking = materialize(asked.join(found, "query_id", "left").where(f"coalesce(n, 0) < {k}").select("query_id", "v"), "asking")
        if asking.isEmpty():
            break
        first, last = last, min(index.cells, 4 * last)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
