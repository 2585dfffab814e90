"""Near-duplicate and repeated-text operators against brute force, with awkward rows."""

import hashlib
import random

import numpy as np
import pytest

from codexframe.llm.embedding_dedup import local_roots, near_vectors
from codexframe.llm.minhash import near_duplicates, one_of_each_group, shingle_hashes
from codexframe.llm.substrings import STRETCH_STARTS, naming_place, remove_repeats, repeats_of_block, runs, stretches, without_repeats
from codexframe.llm.suffix_array import suffix_array

DOCS = "doc_id long, text string, lang string, bucket long, rep long, label int, name string"


def docs_of(spark, texts):
    """(doc_id, text) rows beside columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, None, 1, 2, 3, "x") for i, t in texts], DOCS)


def groups(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def word_set(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def near_copies(rng, n):
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            own = rng.choice(texts).split()
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(60, 120))))
    return texts


@pytest.mark.parametrize(("size", "threshold", "rows"), [(3, 85, 7), (5, 80, 6)])
def test_near_duplicates_match_brute_force(spark, size, threshold, rows):
    texts = dict(enumerate(near_copies(random.Random(size), 150)))
    texts |= {200: None, 201: "", 202: " \t\n", 203: "one two", 204: "ONE\ttwo", 205: "one two three", 206: "x " * 5000, 207: "x " * 4000}
    sets = {i: word_set(t, size) for i, t in texts.items()}
    ids = sorted(texts)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (u := len(sets[a] | sets[b])) and 100 * len(sets[a] & sets[b]) >= threshold * u]
    want = groups(links, ids)
    rows_ = [*texts.items(), (None, "one two"), (0, texts[0])]
    got = near_duplicates(docs_of(spark, rows_), shingle=size, threshold=threshold, rows=rows).collect()
    assert len(got) == len(rows_)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == want[r.doc_id]) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, None)]
    kept = one_of_each_group(docs_of(spark, rows_), shingle=size, threshold=threshold, rows=rows)
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))


def test_rows_of_one_doc_id_keep_the_links_of_both_texts(spark):
    rng = random.Random(8)
    a, b = ([f"{x}{rng.randrange(10**6)}" for _ in range(200)] for x in "ab")
    rows = [(5, a), (5, b), (6, [*a[:-1], "x"]), (7, [*b[:-1], "y"]), (8, a), (9, [f"c{k}" for k in range(50)]), (4, [*a[:-2], "z"])]
    got = near_duplicates(docs_of(spark, [(i, " ".join(t)) for i, t in rows]), shingle=3, threshold=85, rows=7).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(4, 4, True), (5, 4, False), (5, 4, False), (6, 4, False), (7, 4, False), (8, 4, False), (9, 9, True)]


def test_near_duplicates_of_one_large_group(spark):
    base = [f"b{k}" for k in range(200)]
    rng = random.Random(1)
    texts = []
    for _ in range(400):
        own = list(base)
        own[rng.randrange(200)] = f"e{rng.random()}"
        texts.append(" ".join(own))
    got = near_duplicates(docs_of(spark, enumerate(texts))).collect()
    assert {r.component_id for r in got} == {0}


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(docs_of(spark, [])).collect() == []
    assert {r.doc_id: r.component_id for r in near_duplicates(docs_of(spark, [(1, None), (2, "")])).collect()} == {1: 1, 2: 2}


def test_shingles_of_few_words():
    assert len(shingle_hashes(None, 3)) == 0 and len(shingle_hashes(b" \n", 3)) == 0
    assert len(shingle_hashes(b"a b", 3)) == 1 and len(shingle_hashes(b"a b c d", 3)) == 2
    assert (shingle_hashes(b"A b C", 3) == shingle_hashes(b"a B c", 3)).all()


def test_suffix_array_is_sorted():
    rng = random.Random(4)
    for _ in range(300):
        text = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 60))]
        text = text * rng.choice([1, 1, 3])
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_equal_strings_have_equal_names():
    rng = random.Random(5)
    shared = bytes(rng.randrange(97, 101) for _ in range(90))
    a, b = (bytes(rng.randrange(97, 101) for _ in range(rng.randrange(0, 50))) + shared + b"zz" for _ in range(2))
    names = []
    for raw in (a, b):
        lo, hi, name, _ = runs(raw, 40, 16)
        at = {s: n for x, y, n in zip(lo, hi, name) for s in range(x, y + 1)}
        assert sorted(at) == list(range(len(raw) - 39))
        start = raw.index(shared)
        names.append([at[start + k] for k in range(51)])
    assert names[0] == names[1]


def test_block_marks_repeats_within_and_across_texts():
    assert [m.tolist() for m in repeats_of_block([b"abcabcx", b"zabc", b"q"], 3)] == [[True, False, False, True, False], [False, True], []]


def test_stretches_cover_all_starts_and_share_cores():
    rng = random.Random(11)
    for _ in range(60):
        raw = bytes(rng.randrange(97, 101) for _ in range(rng.randrange(60, 130)))
        lo, hi, _, _ = runs(raw, 60, 20)
        for x, y in zip(lo.tolist(), hi.tolist()):
            part = raw[x : y + 60]
            own = stretches(part, 60, 20)
            assert [at for a, b, _ in own for at in range(a, b + 1)] == list(range(y - x + 1))
            place = naming_place(part, 60, 20)
            for a, b, core in own:
                assert b <= core and core - STRETCH_STARTS < a and (place - core) % STRETCH_STARTS == 0 and core + 60 - STRETCH_STARTS + 1 <= a + 60


def brute_removed(raws, length):
    seen = {}
    for raw in raws:
        for k in range(len(raw) - length + 1):
            seen[raw[k : k + length]] = seen.get(raw[k : k + length], 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = True
        left = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("block_classes", [500, 2])
def test_repeats_match_brute_force(spark, monkeypatch, block_classes):
    from codexframe.llm import substrings

    real = substrings.repeated_spans
    monkeypatch.setattr(substrings, "repeated_spans", lambda d, n, p: real(d, n, p, block_bytes=600, block_classes=block_classes))
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(30))
    texts = [" ".join(word() for _ in range(40)) + (passage if k % 3 else "") + " ".join(word() for _ in range(30)) for k in range(30)]
    texts += [texts[0], texts[0][:120], "ab" * 200, "xyz" * 90 + "q", None, "", "short"]
    got = {r.doc_id: r for r in remove_repeats(docs_of(spark, enumerate(texts)), length=60, piece=20).collect()}
    want = brute_removed([(t or "").encode() for t in texts], 60)
    assert [(got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) for k in range(len(texts))] == want


def test_copies_of_a_class_are_told_by_their_places(spark, monkeypatch):
    """Beyond the two tables of runs, a class has one row, however many copies it has: no run is joined with its class."""
    from codexframe.llm import substrings

    rng, counts, real = random.Random(3), {}, substrings.materialize
    fresh = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = fresh(120)
    texts = [passage] * 40 + [fresh(90) + passage + fresh(90) for _ in range(6)] + [fresh(150)]

    def counted(df, name):
        out = real(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(substrings, "materialize", counted)
    got = {r.doc_id: r for r in remove_repeats(docs_of(spark, enumerate(texts)), length=60, piece=20).collect()}
    want = brute_removed([t.encode() for t in texts], 60)
    assert [(got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) for k in range(len(texts))] == want
    assert counts["shared-runs"] > 40 and all(n < 40 for name, n in counts.items() if name not in ("runs", "shared-runs"))


def test_repeats_of_repeated_rows_and_other_columns(spark):
    text = "é" + "".join(chr(97 + (k * k + k // 7) % 26) for k in range(150)) + "é"
    rows = [(1, text), (1, text), (None, "tail " + text), (2, None)]
    out = without_repeats(docs_of(spark, rows), length=100, piece=40)
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("1", ""), ("1", ""), ("2", None), ("None", "tail ")]
    assert remove_repeats(docs_of(spark, [])).collect() == []


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 8))
    vectors = np.concatenate([base, base[rng.integers(0, 6, 120)] + 0.12 * rng.standard_normal((120, 8)), base[:3], base[:1] * 2])
    rows = [(i, [float(x) for x in v], int(i % 2), 1, 2) for i, v in enumerate(vectors)]
    odd = [(900, None, 0), (901, [0.0] * 8, 0), (902, [1.0, None] + [0.0] * 6, 0), (903, [float("nan")] + [1.0] * 7, 0), (904, [float("inf")] * 8, 1), (905, rows[0][1], None), (None, rows[0][1], 0), (906, [], 0)]
    frame = spark.createDataFrame(rows + [(i, v, lab, 1, 2) for i, v, lab in odd], "vec_id long, embedding array<double>, label int, cell long, rep long")
    got = {r.vec_id: r for r in near_vectors(frame, cosine=0.93, recall=1.0, cell_rows=8).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    label = np.arange(len(vectors)) % 2
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    want = groups(zip(*(x.tolist() for x in np.nonzero(linked))), range(len(vectors)))
    exact = sum(got[i].n_links == linked[i].sum() and got[i].component_id == want[i] for i in range(len(vectors)))
    assert exact >= 0.95 * len(vectors) and len(got) == len(vectors) + len(odd)
    assert all(got[i].n_links <= linked[i].sum() for i in range(len(vectors)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (900, 901, 902, 903, 904, 905, 906))
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, None)
    assert near_vectors(frame.where("false")).collect() == []


def test_one_vector_may_come_very_often_and_an_id_twice(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal(8)
    rows = [(i, [float(x) for x in base], 0) for i in range(10, 60)] + [(5, [float(x) for x in base + 0.01], 0), (5, [float(x) for x in -base], 0), (3, [float(x) for x in -base * 2], 0), (1, [float(x) for x in base], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), recall=1.0).collect())
    assert got == [(1, 0, 1), (3, 1, 3), (5, 1, 3), (5, 50, 3), *[(i, 50, 3) for i in range(10, 60)]]


def test_local_roots_reach_the_smallest():
    ids = np.array([3, 5, 7, 9, 11])
    assert local_roots(np.array([0, 1, 3]), np.array([1, 2, 4]), ids).tolist() == [3, 3, 3, 9, 9]
