"""The stored index: words and stems, pages with pruning, segments, against plain scoring of all rows."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codexframe.operators import index


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, body string, kind string")


def scores(rows, words):
    """id: score of the rows that hold all words."""
    split = {i: (t or "").lower().split() for i, t, _ in rows}
    n, average = len(split), sum(map(len, split.values())) / len(split)
    out = {i: 0.0 for i, own in split.items() if all(w in own for w in words)}
    for w in words:
        df = sum(w in own for own in split.values())
        for i in out:
            tf = split[i].count(w)
            out[i] -= max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(split[i]) / average))
    return out


def check(own, rows, words, limit=10, offset=0):
    want = scores(rows, words)
    assert {r.id: pytest.approx(r.score, abs=1e-9) for r in own.search(" ".join(words)).hits.collect()} == want
    best = sorted(want, key=lambda i: (round(want[i], 12), i))[offset : offset + limit]
    assert [r.id for r in own.page(" ".join(words), limit, offset).collect()] == best


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40))), rng.choice("xyz")) for i in range(n)]


def test_index_survives_nulls_and_replaces_itself(spark, tmp_path):
    rows = [(1, "red red fish", "x"), (2, None, None), (3, "", "fish"), (4, "Red, fish!", "y")]
    at = f"file://{tmp_path}/index"
    index.write_index(frame(spark, rows).where("false"), "id", ["body"], at)
    assert index.search_index(spark, at, "red").hits.collect() == []
    index.write_index(frame(spark, rows), "id", ["body"], at)
    found = index.search_index(spark, at, "red FISH")
    assert [(r.id, r.kind) for r in found.hits.orderBy("score").collect()] == [(1, "x"), (4, "y")]
    assert [(r.facet, r.value, r.n) for r in found.counts("kind").orderBy("facet", "value").collect()] == [("kind", "x", 1), ("kind", "y", 1), ("total", "", 2)]
    assert index.search_index(spark, at, '"fish red"').hits.collect() == []
    assert [r.id for r in index.search_index(spark, at, '"red fish"').hits.orderBy("id").collect()] == [1, 4]
    assert [r.id for r in index.search_index(spark, at, "", [F.col("kind") == "y"]).hits.collect()] == [4]
    assert not index.search_index(spark, at, "").asked
    assert index.search_index(spark, at, "red nowhere").hits.collect() == [] == index.Index(spark, at).page("red nowhere").collect()


def test_repeated_and_null_keys_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="key of 2 rows"):
        index.write_index(frame(spark, [(1, "a", ""), (1, "b", "")]), "id", ["body"], f"{tmp_path}/a")
    with pytest.raises(ValueError, match="no key"):
        index.write_index(frame(spark, [(None, "a", "")]), "id", ["body"], f"{tmp_path}/b")
    with pytest.raises(ValueError, match="analyzer"):
        index.create_index(spark, f"{tmp_path}/c", frame(spark, []).schema, "id", ["body"], "french")


def test_stems_and_diacritics(spark, tmp_path):
    rows = [(1, "Connected connections", ""), (2, "a résumé, resumes", ""), (3, "connective RÉSUMÉ connection", ""), (4, "connector resumption", "")]
    own = index.write_index(frame(spark, rows), "id", ["body"], f"{tmp_path}/i", analyzer="stem")
    ids = lambda q, **k: sorted(r.id for r in own.search(q, **k).hits.collect())
    assert ids("connect") == [1, 3] and ids("resume") == [2, 3] == ids("Résumés") and ids('"connecting resume"') == [3] and ids("connect resume") == [3]
    assert index.Index(spark, f"{tmp_path}/i").analyzer == "stem"
    plain = index.write_index(frame(spark, rows), "id", ["body"], f"{tmp_path}/p")
    assert plain.search("connect").hits.count() == 0


def test_fields_and_their_places(spark, tmp_path):
    rows = [(1, "red fish", "blue"), (2, "blue", "red fish"), (3, "blue red", "fish")]
    own = index.write_index(frame(spark, rows), "id", ["body", "kind"], f"{tmp_path}/i")
    ids = lambda q, **k: sorted(r.id for r in own.search(q, **k).hits.collect())
    assert ids("red", fields=["kind"]) == [2] and ids("red") == [1, 2, 3] and ids('"red fish"') == [1, 2] and ids('"red fish"', fields=["body"]) == [1]


def test_pages_equal_full_scoring_and_read_less(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 8)
    rows = corpus(3000)
    own = index.write_index(frame(spark, rows), "id", ["body"], f"{tmp_path}/i")
    for words in (["w3"], ["w0", "w7"], ["w40", "w1"], ["w2", "w2"], ["w50", "w51", "w0"]):
        check(own, rows, words, 10, 3)
    for words in (["w0"], ["w3"]):
        least, _ = own.bounds(" ".join(words), 10)
        assert own.entries(words, least).count() < 0.2 * own.entries(words).count()
    # a filter counts before the page, and rows of an exact match come first whatever their score
    want = scores(rows, ["w1"])
    kinds = {i: k for i, _, k in rows}
    got = own.page("w1", 30, filters=[F.col("kind") != "z"], exact=(F.col("kind") == "y") & (F.col("id") % 50 == 0)).collect()
    assert [r.id for r in got] == sorted((i for i in want if kinds[i] != "z"), key=lambda i: (not (kinds[i] == "y" and i % 50 == 0), round(want[i], 12), i))[:30]
    assert {r.id for r in own.page('"w0 w1" w2', 5000).collect()} == {r.id for r in own.search('"w0 w1" w2').hits.collect()}


def test_less_of_the_files_is_read(spark, tmp_path):
    """Blocks that cannot reach the bound are skipped in the file, not filtered after it was read."""
    rows = [(i, " ".join(["common"] * (1 + (i % 997 == 0) * 5) + ["pad"] * (i % 61)), "x") for i in range(60_000)]
    own = index.write_index(frame(spark, rows), "id", ["body"], f"{tmp_path}/i")
    least, _ = own.bounds("common", 10)

    def rows_read(df):
        """Rows that come out of the scan, as its metrics count them."""
        plan = df._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        return sum(leaf.metrics().apply("numOutputRows").value() for leaf in (plan.collectLeaves().apply(k) for k in range(plan.collectLeaves().size())))

    whole, some = own._blocks(["common"]), own._blocks(["common"], least)
    assert "GreaterThanOrEqual(impact" in some._jdf.queryExecution().toString()
    assert own.entries(["common"], least).count() < 0.2 * own.entries(["common"]).count() and some.count() < 0.2 * whole.count()
    assert rows_read(some) < 0.5 * rows_read(whole)


def test_changes_equal_a_rebuild(spark, tmp_path):
    rng, state, own = random.Random(4), {}, index.create_index(spark, f"{tmp_path}/i", frame(spark, []).schema, "id", ["body"])
    fresh = corpus(400, 9)
    for step in range(5):
        new = [(i, *rng.choice(fresh)[1:]) for i in rng.sample(range(150), 40)]
        before = {s["id"] for s in own.segments}
        own = own.add(frame(spark, new))
        state |= {r[0]: r for r in new}
        assert len(before - {s["id"] for s in own.segments}) in (0, index.FANOUT, index.FANOUT - 1)
        gone = rng.sample(sorted(state), 5)
        own = own.remove(frame(spark, [(i, None, None) for i in [*gone, 999]]))
        for i in gone:
            del state[i]
        assert own.size == len(state)
        check(own, list(state.values()), ["w0"])
        check(own, list(state.values()), ["w1", "w2"])
    assert sorted(tuple(r) for r in own.rows().collect()) == sorted((i, k) for i, _, k in state.values())
    assert len(own.segments) < 5
    index.Index(spark, f"{tmp_path}/i").clean()
    check(index.Index(spark, f"{tmp_path}/i"), list(state.values()), ["w3"])
    with pytest.raises(Exception, match="manifest/v="):  # a manifest from before another change
        stale = index.Index(spark, f"{tmp_path}/i")
        stale.remove(frame(spark, [(next(iter(state)), "", "")]))
        stale.remove(frame(spark, [(sorted(state)[-1], "", "")]))


def test_a_batch_is_taken_apart_in_portions_of_words():
    words = [[["a"] * 30, ["b"]], [[], []], [["c"] * 500], [["d"] * 10], [["e"] * 60], [["f"] * 60]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(words, pa.list_(pa.list_(pa.string())))], names=["k", "w"])
    for whole in (batch, batch.slice(1, 4), batch.slice(6)):
        cut = list(index.portions(whole, 1, 100))
        assert [r for part in cut for r in part.to_pylist()] == whole.to_pylist()
        assert all(part.num_rows == 1 or sum(len(f) for r in part.to_pylist() for f in r["w"]) <= 100 for part in cut)
    assert len(list(index.portions(batch, 1, 100))) == 4


def test_a_task_holds_portions_and_not_batches(monkeypatch, spark, tmp_path):
    """The rows of one batch go out in several batches as soon as they have more words than a portion."""
    own = index.create_index(spark, f"file://{tmp_path}/portions", spark.createDataFrame([], "k long, text string").schema, "k", ["text"])
    schema, sizes = pa.schema([("k", pa.int64()), ("_words", pa.list_(pa.list_(pa.string())))]), []
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array([[[f"w{i}"] * 10_000] for i in range(50)], schema.field(1).type)], schema=schema)

    class Words:
        def mapInArrow(self, run, _):  # noqa: N802
            sizes.extend(out.num_rows for out in run(iter([batch])))

    own._split(Words())
    assert sum(sizes) == 100 and max(sizes) <= 10


def split_of(spark, path, batch, schema, fields, analyzer="plain"):
    """What a task makes of a batch."""
    own, out = index.create_index(spark, path, schema, "k", fields, analyzer), []

    class Words:
        def mapInArrow(self, run, _):  # noqa: N802
            out.extend(run(iter([batch])))

    own._split(Words())
    return out


def words_batch(words, keys=None):
    return pa.RecordBatch.from_arrays([pa.array(keys or range(len(words)), pa.int64()), pa.array(words, pa.list_(pa.list_(pa.string())))], names=["k", "_words"])


def test_a_long_text_is_no_pile_of_objects(spark, tmp_path):
    """A row has at least a portion of its own, however long: its words must not become Python objects."""
    import tracemalloc

    many = 400_000
    batch = words_batch([[[f"w{i % 1000}" for i in range(many)]]])
    schema = spark.createDataFrame([], "k long, t string").schema
    tracemalloc.start()
    out = split_of(spark, f"file://{tmp_path}/long", batch, schema, ["t"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 1001 and peak < 80 * many


@pytest.mark.parametrize("analyzer", ["plain", "stem"])
def test_places_of_words_by_row_and_field(spark, tmp_path, monkeypatch, analyzer):
    monkeypatch.setattr(index, "PORTION", 7)
    rng, root = random.Random(3), index._root(analyzer)
    words = [[rng.choices(["connect", "connected", "a", "é", "fish"], k=rng.randint(0, 6)) for _ in range(2)] for _ in range(40)] + [[[], []]]
    schema = spark.createDataFrame([], "k long, t string, u string").schema
    keys = [3 * k for k in range(len(words))]
    for rows in (words, [[[], []]] * 3):
        batch = words_batch(rows, keys[: len(rows)])
        rows_, posted = {}, {}
        for r in (r for b in split_of(spark, f"file://{tmp_path}/{len(rows)}", batch, schema, ["t", "u"], analyzer) for r in b.to_pylist()):
            if r["term"] is None:
                rows_[r["k"]] = (r["length"], sorted(r["terms"]))
            else:
                assert (r["k"], r["term"]) not in posted
                posted[r["k"], r["term"]] = (r["length"], r["places"])
        want: dict = {}
        for k, fields in zip(keys, rows, strict=False):
            for f, own in enumerate(fields):
                for p, w in enumerate(own):
                    want.setdefault((k, root(w)), (sum(map(len, fields)), []))[1].append(f * index._FIELD + p)
        assert posted == want
        assert rows_ == {k: (sum(map(len, f)), sorted({root(w) for own in f for w in own})) for k, f in zip(keys, rows, strict=False)}


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_blocks_go_on_over_batches(size):
    terms = [(0, "a")] * 9 + [(0, "b")] * 4 + [(1, "b")] * 5 + [(1, "c")] + [(2, "c")] * 8
    rows = pa.RecordBatch.from_pylist([{"deal": d, "term": t, "key": k} for k, (d, t) in enumerate(terms)])
    got = []
    for part, begins in index.in_blocks((rows.slice(k, size) for k in range(0, len(terms), size)), 4):
        got += [part.slice(b, e - b).column("key").to_pylist() for b, e in zip(begins, [*begins[1:], part.num_rows], strict=True)]
    assert got == [[0, 1, 2, 3], [4, 5, 6, 7], [8], [9, 10, 11, 12], [13, 14, 15, 16], [17], [18], [19, 20, 21, 22], [23, 24, 25, 26]]
    assert list(index.in_blocks(iter([rows.slice(0, 0)]), 4)) == []


def test_tasks_that_make_blocks_grow_in_number(spark, tmp_path, monkeypatch):
    """The postings of a task are bounded: it is their number that says over how many tasks they go, not a setting."""
    monkeypatch.setattr(index, "TASK", 400)
    monkeypatch.setattr(index, "HEAVY", 400)
    made, sizes = index.Index._made, {}

    def seen(self, postings):
        sizes[len(sizes)] = [r["count"] for r in postings.groupBy(F.spark_partition_id()).count().collect()]
        return made(self, postings)

    monkeypatch.setattr(index.Index, "_made", seen)
    for n in (400, 3200):
        rows = corpus(n)
        own = index.write_index(frame(spark, rows), "id", ["body"], f"{tmp_path}/{n}")
        check(own, rows, ["w0", "w3"])
    few, many = sizes.values()
    assert len(many) > 2 * len(few) and max(many) < 4 * max(few)
