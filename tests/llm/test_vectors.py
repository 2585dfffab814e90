"""Clustering, resampling and approximate neighbours against brute force, with awkward rows."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codexframe.llm import clustering, multi_index, queries, resampling

VECTORS = "vec_id long, embedding array<double>, label int, q int, cluster int, rank int, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], VECTORS)


def as_floats(v):
    return [float(x) for x in v]


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_importance_resampling"])
def test_query_equals_duckdb(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*' * os.path.isdir(at)}'")
    want = con.sql(f"SELECT {', '.join(sorted(got.columns))} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(sorted(got.columns)).collect())


def brute_clusters(rows, dims, scale, centroids, rounds, seed):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if i is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r))[:centroids]
    centres = [v for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        centres = [tuple(sum(x) // len(mine) for x in zip(*mine, strict=True)) if (mine := [v for (_, v), o in zip(kept, own, strict=True) if o == k]) else c for k, c in enumerate(centres)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    return sorted((i, k, far, sum(f for _, o, f in last if o == k), sum(f for _, _, f in last), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for i, k, far in last)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, as_floats(v)) for i, v in enumerate(np.round(rng.normal(0, 1, (300, 5)) * 4) / 8)]  # coarse: many equal vectors and ties
    rows += [(i, [0.25] * 5) for i in range(300, 420)] + [(7, rows[7][1]), (8, [9.0, -9.0, 9.0, -9.0, 0.5])]
    odd = [(900, None), (901, []), (902, [1.0] * 4), (903, [1.0] * 6), (904, [1.0, None, 1.0, 1.0, 1.0]), (905, [float("nan")] * 5), (906, [1.0, float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 5)]
    got = clustering.cluster_vectors(frame(spark, rows + odd), dims=5, scale=8, centroids=7, rounds=3, seed=1)
    assert sorted(map(tuple, got.collect())) == brute_clusters(rows + odd, 5, 8, 7, 3, 1)


def test_clusters_of_few_and_none(spark):
    rows = [(1, [0.5, -0.01]), (2, [0.5, -0.01]), (3, [-2.0, 3.0])]
    got = clustering.cluster_vectors(frame(spark, rows), dims=2, scale=64, centroids=16)
    assert sorted(map(tuple, got.collect())) == brute_clusters(rows, 2, 64, 16, 3, 1)
    assert clustering.cluster_vectors(frame(spark, rows).where("false"), dims=2).collect() == []
    assert clustering.cluster_vectors(frame(spark, [(1, None), (2, [1.0])]), dims=2).collect() == []


def test_clusters_stay_exact_or_raise(spark):
    x = np.array([[1 << 27, -(1 << 27)], [(1 << 27) - 1, 5]], np.int64)
    assert clustering.nearest(x, x[::-1].copy())[0].tolist() == [1, 0]
    far = clustering.nearest(x, np.array([[-(1 << 27), 1 << 27]], np.int64))[1]
    assert far.tolist() == [2 * (1 << 28) ** 2, ((1 << 28) - 1) ** 2 + ((1 << 27) - 5) ** 2]
    with pytest.raises(Exception, match="whole numbers"):
        clustering.cluster_vectors(frame(spark, [(1, [1e9, 0.0])]), dims=2).collect()


def brute_draw(docs, target, grams, buckets, least, percent, seed):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    def runs(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, grams + 1) for k in range(len(w) - n + 1)]

    s, t = Counter(b for _, d in docs for b in runs(d)), Counter(b for d in target for b in runs(d))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, d in docs:
        f = runs(d)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(d)) >= least))
    able = sorted((r for r in rows if r[4] and r[0] is not None), key=lambda r: (-r[3], r[0], r[1]))
    drawn = len(able) * percent // 100
    return [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if not (r[4] and r[0] is not None)]


@pytest.mark.parametrize("grams", [1, 2])
def test_draw_equals_brute_force(spark, grams):
    rng = np.random.default_rng(4)
    vocabulary = ["alpha", "Beta", "gamma9", "déjà", "ΣΙΓΜΑ", "x", "target", "passage", "12", "naïve"]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 40)))) for i in range(150)]
    docs += [(i, docs[3][1]) for i in range(150, 260)] + [(5, docs[5][1]), (6, "another text of one id " * 6), (None, "no id " * 30), (300, None), (301, ""), (302, " .,;\n"), (303, "long words " * 60_000)]
    target = ["target passage alpha alpha", "target passage alpha alpha", None, "", "Passage naïve"]
    got = resampling.resample(spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, digest int, score int, copies int"), spark.createDataFrame([(t, 0) for t in target], "text string, doc_id int"), grams=grams, buckets=97, least_words=6, percent=30)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_draw(docs, target, grams, 97, 6, 30, 2024)))


def test_draw_of_empty_tables_and_wrong_bytes(spark):
    docs = spark.createDataFrame([(1, "some words " * 20)], "doc_id long, text string")
    none = docs.where("false")
    assert resampling.resample(none, docs.select("text")).collect() == []
    [row] = resampling.resample(docs, none.select("text"), percent=100).collect()
    assert (row.n_features, row.rank) == (40, 1)
    wrong = spark.sql("SELECT cast(id AS long) doc_id, cast(x'61ff6220c3' as string) text FROM range(3)")
    assert [r.n_features for r in resampling.resample(wrong, none.select("text")).collect()] == [2, 2, 2]


def test_places_of_a_large_sort(spark):
    rows = spark.range(0, 5000, 1, 7).select(F.pmod(F.hash("id"), F.lit(50)).alias("s"), "id")
    got = [(r.s, r.id) for r in resampling.numbered(rows, [F.desc("s"), F.asc("id")]).orderBy("place").collect()]
    assert got == sorted(((r.s, r.id) for r in rows.collect()), key=lambda r: (-r[0], r[1]))


def brute_neighbours(rows, asked, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q in asked:
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        out[int(ids[q])] = [(int(ids[n]), far[n]) for n in np.lexsort((ids, far)) if n != q][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_neighbours_are_exact_when_walks_cover_all(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (400, 6))
    x[100:160] = x[3]  # more equal vectors than neighbours asked for
    rows = [(i, as_floats(v)) for i, v in enumerate(x)]
    odd = [(800, None), (801, []), (802, [0.0] * 6), (803, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (804, [float("nan")] * 6), (None, rows[0][1]), (5, rows[5][1])]
    df = frame(spark, rows + odd)
    got = found(multi_index.nearest_vectors(df, df.where("vec_id % 20 = 0"), k=4, recall=1.0, cell_rows=8, block_rows=16))
    want = brute_neighbours(rows, range(0, 400, 20), 4)
    assert {q: [i for i, _ in h] for q, h in got.items()} == {q: [i for i, _ in h] for q, h in want.items()}
    assert all(s == pytest.approx(t, abs=1e-12) for q in want for (_, s), (_, t) in zip(got[q], want[q], strict=True))


def test_neighbours_of_clusters_reach_recall_and_walk_on(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 3, (12, 16))
    x = centres[rng.integers(0, 12, 3000)] + rng.normal(0, 0.4, (3000, 16))
    rows = [(i, as_floats(v)) for i, v in enumerate(x)]
    df = frame(spark, rows)
    want = brute_neighbours(rows, range(0, 3000, 30), 10)
    got = found(multi_index.nearest_vectors(df, df.where("vec_id % 30 = 0"), cell_rows=20))
    assert {len(h) for h in got.values()} == {10}
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
    short = found(multi_index.nearest_vectors(df, df.where("vec_id = 30"), k=500, recall=0.01, cell_rows=20))  # the first walk ends too early
    assert len(short[30]) == 500
    assert {len(h) for h in found(multi_index.nearest_vectors(df.where("vec_id < 4"), df.where("vec_id < 2"))).values()} == {3}
    assert multi_index.nearest_vectors(df.where("false"), df).collect() == [] == multi_index.nearest_vectors(df, df.where("false")).collect()


def test_walk_goes_by_sum_of_distances():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(9)
    steps = list(multi_index.walk(a, b, 0, 63))
    sums = [a[i] + b[j] for i, j in steps]
    assert sums == sorted(sums) and len(set(steps)) == 63
    assert list(multi_index.walk(a, b, 10, 20)) == steps[10:20]


def test_recall_of_the_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute_neighbours(rows, [n for n, (i, _) in enumerate(rows) if i % 100 == 0], 10)
    got = found(queries.QUERIES["op13_approximate_neighbours"](spark, sf_dir))
    assert set(got) == set(want) and {len(h) for h in got.values()} == {10}
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
