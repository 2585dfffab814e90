"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the vector, span a grid of cells. Neighbouring cells form regions of a bounded
number of vectors. Each vector lives in one region and visits those of the cells nearest to it by the sum of both half
distances, in the order of a multi-sequence traversal. How many cells it goes through is set so that a neighbour planted
exactly at the threshold is met with the target recall. Every pair that meets is verified by its cosine. Only counts and
links to a local root leave a task, never all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexframe.llm.common import anew, arrow_schema, connected_components, map_batches, materialize
from codexframe.llm.vectors import bounded_sample, distances, kmeans, valid

#: Cells beyond which a traversal is not followed, and codes of a book.
_DEPTH, _CODES = 2048, 2048


class Grid:
    """Product of two codebooks, the traversal of its cells, and their regions: a left code and `wide` right codes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, half: int, wide: int = 1, visits: int = 1):
        self.left, self.right, self.half, self.wide = left, right, half, wide
        self.across = -(-len(right) // wide)
        self.set_visits(visits)

    def set_visits(self, visits: int) -> None:
        self.visits = min(visits, len(self.left) * len(self.right))
        # the n-th nearest cell has ranks (i, j) in both halves with (i + 1) (j + 1) <= n
        self.ranks = np.array([(i, j) for i in range(min(len(self.left), self.visits)) for j in range(min(len(self.right), self.visits // (i + 1)))])

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.left), distances(x[:, self.half :], self.right)

    def home(self, x: np.ndarray) -> np.ndarray:
        """Region of every row's own cell."""
        a, b = self.halves(x)
        return a.argmin(axis=1) * self.across + b.argmin(axis=1) // self.wide

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Regions of the `visits` nearest cells of every row, nearest first, repeats included."""
        a, b = self.halves(x)
        oa, ob = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        rows = np.arange(len(x))[:, None]
        i, j = self.ranks[:, 0], self.ranks[:, 1]
        far = a[rows, oa[:, i]] + b[rows, ob[:, j]]
        order = far.argsort(axis=1, kind="stable")[:, : self.visits]
        return (oa[:, i] * self.across + ob[:, j] // self.wide)[rows, order]


def fit_grid(sample: np.ndarray, codes: int, wide: int, cosine: float, recall: float, trials: int = 2000) -> Grid:
    """Codebooks from a bounded sample of unit vectors, and visits that meet a planted neighbour at the target recall."""
    half = sample.shape[1] // 2
    left, right = kmeans(sample[:, :half], codes), kmeans(sample[:, half:], codes)
    grid = Grid(left, right, half, wide, min(_DEPTH, len(left) * len(right)))
    rng = np.random.default_rng(5)
    x = sample[rng.integers(0, len(sample), trials)]
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1)[:, None] * x
    norm = np.linalg.norm(z, axis=1)
    y = cosine * x + np.sqrt(1 - cosine**2) * z / np.where(norm > 0, norm, 1)[:, None]

    def met(p, q):
        """The step at which p comes to q's region."""
        steps = []
        for at in range(0, len(p), 200):
            same = grid.nearest(p[at : at + 200]) == grid.home(q[at : at + 200])[:, None]
            steps.append(np.where(same.any(axis=1), same.argmax(axis=1), grid.visits - 1))
        return np.concatenate(steps)

    # a pair is met if either visits the other's region
    grid.set_visits(int(np.quantile(np.minimum(met(x, y), met(y, x)), recall, method="higher")) + 1)
    return grid


def local_roots(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable by the pairs (a, b) of places in ids."""
    root = ids.copy()
    while len(a):
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        if (before == root).all():
            break
    return root


def near_vectors(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.995, cell_rows: int = 32, region_rows: int = 512, sample_rows: int = 20_000, block_rows: int = 2048) -> DataFrame:
    """Links of vectors (vec_id, embedding, label) with equal labels and a cosine of at least `cosine`.

    Returns a row per row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable
    by links, itself included), kept (vec_id = component_id). A vector that is null, empty or zero, or holds null or
    non-finite components, or has a null label, links with nothing. Equal vectors of a label are one class and link
    with each other. Shorter vectors count as padded with zeros. A repeated vec_id counts as two vectors of one
    component; a null vec_id links with nothing and has null in the last two columns. Other columns are ignored; an
    empty table gives no rows. Codebooks are fitted on at most `sample_rows` rows; every row is indexed.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").alias("label"))
    width = max(2, rows.agg(F.max(F.size("embedding"))).first()[0] or 2)
    # components as they come: four bytes each if they are floats
    letter = "<f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def pack(batch: pa.RecordBatch) -> dict:
        out = np.zeros((batch.num_rows, width), letter)
        for own, v in zip(out, batch.column(2).to_pylist(), strict=True):
            own[: len(v)] = v
        return {"vec_id": batch.column(0), "label": batch.column(1), "v": [r.tobytes() if r.any() else None for r in out + 0.0]}

    def unit(cells: list[bytes]) -> np.ndarray:
        v = np.frombuffer(b"".join(cells), letter).reshape(-1, width).astype(np.float64)
        most = np.abs(v).max(axis=1, initial=1e-300)[:, None]
        return v / (np.linalg.norm(v / most, axis=1)[:, None] * most)

    kind = rows.schema["label"].dataType.simpleString()
    fit = rows.where(valid(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    cells = map_batches(fit.select("vec_id", "label", "embedding"), pack, f"vec_id long, label {kind}, v binary").where("v is not null")
    most = fit.groupBy("label").count().agg(F.max("count")).first()[0]
    plain = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    drawn = [bytes(r.v) for r in bounded_sample(cells, "vec_id", sample_rows)] if most else []
    if not drawn:
        return plain
    codes = int(np.clip(np.sqrt(most / cell_rows), 2, _CODES))
    grid = fit_grid(unit(drawn), codes, int(np.clip(region_rows * codes**2 // most, 1, codes)), cosine, recall)

    def place(batch: pa.RecordBatch) -> dict:
        x = unit(batch.column(2).to_pylist())
        return {**{n: batch.column(k) for k, n in enumerate(("label", "digest", "v", "copies", "vec_id"))}, "home": grid.home(x), "visits": [np.unique(r).tolist() for r in grid.nearest(x)]}

    classes = cells.withColumn("digest", F.md5("v")).groupBy("label", "digest").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"))
    placed = map_batches(classes.select("label", "digest", "v", "copies", "vec_id"), place, f"label {kind}, digest string, v binary, copies long, vec_id long, home int, visits array<int>")
    # rep numbers the classes as they are written; a vec_id would not do, rows may share one
    placed = materialize(placed.withColumn("rep", F.monotonically_increasing_id()), "placed")
    visitors = placed.select("label", "rep", "v", "copies", "home", F.explode("visits").alias("region"))
    residents = placed.select("label", "rep", "v", "copies", "visits", F.col("home").alias("region"))

    def blocks(side, name):
        return side.groupBy("label", "region").agg(F.ceil(F.count("*") / block_rows).alias(name))

    of = materialize(blocks(residents, "r").join(blocks(visitors, "w"), ["label", "region"]), "blocks")
    deal = lambda side, own, other: (
        side.join(anew(of), ["label", "region"]).withColumn(f"{own}b", F.pmod(F.xxhash64("rep"), F.col(own))).withColumn(f"{other}b", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
    )
    keys = ["label", "region", "rb", "wb"]
    visitors = deal(visitors, "w", "r").select(*keys, "rep", "v", "copies", "home")
    residents = deal(residents, "r", "w").select(*keys, "rep", "v", "copies", "visits")
    schema = arrow_schema(spark, "rep long, found long, root long")

    def compare(visiting, living):
        if not visiting.num_rows or not living.num_rows:
            return schema.empty_table()
        x, y = unit(visiting["v"].to_pylist()), unit(living["v"].to_pylist())
        a, b = visiting["rep"].to_numpy(), living["rep"].to_numpy()
        many_a, many_b = visiting["copies"].to_numpy(), living["copies"].to_numpy()
        i, j = np.nonzero(x @ y.T >= cosine)
        keep = a[i] != b[j]
        i, j = i[keep], j[keep]
        if not len(i):
            return schema.empty_table()
        # whether the resident finds the visitor in turn: (resident, home of the visitor) among (resident, its visits)
        homes, sizes = visiting["home"].to_numpy().astype(np.int64), np.array([len(r) for r in living["visits"].to_pylist()])
        seen = living["visits"].combine_chunks().flatten().to_numpy().astype(np.int64)
        regions = int(max(homes.max(), seen.max())) + 1
        back = np.isin(j * regions + homes[i], np.repeat(np.arange(len(y)), sizes) * regions + seen)
        ids = np.unique(np.concatenate([a[i], b[j]]))
        pa_, pb_ = np.searchsorted(ids, a[i]), np.searchsorted(ids, b[j])
        found = np.bincount(pa_, many_b[j], len(ids)) + np.bincount(pb_[~back], many_a[i[~back]], len(ids))
        return pa.table({"rep": ids, "found": found.astype(np.int64), "root": local_roots(pa_, pb_, ids)}, schema=schema)

    met = materialize(visitors.groupBy(*keys).cogroup(anew(residents).groupBy(*keys)).applyInArrow(compare, "rep long, found long, root long"), "met")
    counts = met.groupBy("rep").agg(F.sum("found").alias("found"))
    names = anew(placed.select("label", "digest", "rep", "copies", "vec_id")).withColumnRenamed("vec_id", "of_class")
    of_row = materialize(cells.select("vec_id", "label", F.md5("v").alias("digest")).join(names, ["label", "digest"]).select("vec_id", "rep", "copies", "of_class"), "class-of-row")
    # rows of one vec_id are one component
    ids = of_row.select("vec_id", "rep").distinct()
    first = ids.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("vec_id", "a")
    same = ids.join(first, "vec_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    components = connected_components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(same)).toDF("rep", "component")
    least = components.join(names.select("rep", "of_class"), "rep").groupBy("component").agg(F.min("of_class").alias("least"))
    reached = components.join(least, "component").select("rep", "least")
    out = of_row.join(counts, "rep", "left").join(reached, "rep", "left")
    out = out.select("vec_id", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "of_class").alias("component_id"))
    linked = out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    takes_part = F.coalesce(valid(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0), F.lit(False))
    others = rows.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    return linked.unionByName(others)
