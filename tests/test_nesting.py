"""Outlines cut into chunks against a stack that walks each document from its start."""

import random

import pytest

from codexframe.operators import nesting

ROWS = "doc long, at long, level int, row string, chunk string"


def expected(rows):
    out, stacks = {}, {}
    for doc, at, level, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        stack = stacks.setdefault(doc, [])
        if level is None:
            out[doc, at] = []
            continue
        while stack and stack[-1][1] >= level:
            stack.pop()
        out[doc, at] = list(stack)
        stack.append((at, level))
    return out


@pytest.mark.parametrize("chunks", [1, 4, 67])
def test_levels_1_to_50_in_small_chunks(spark, chunks):
    draw = random.Random(7)
    rows = [(d, at, draw.randint(1, 50) if draw.random() < 0.95 else None, f"r{at}", "c") for d, n in ((1, 120), (2, 1), (3, 60), (None, 20)) for at in range(n)]
    df = spark.createDataFrame(draw.sample(rows, len(rows)), ROWS)
    found = nesting.open_above(df, "doc", "at", "level", chunks)
    got = {(r.doc, r.at): [(x["order"], x["level"]) for x in r.path] for r in found.collect()}
    assert got == expected(rows) and found.columns == [*df.columns, "path"]
    assert {(r.doc, r.at): r.parent for r in nesting.parents(df, "doc", "at", "level", chunks).collect()} == {k: (v[-1][0] if v else None) for k, v in got.items()}


def test_ever_deeper_and_ever_higher_rows_keep_or_lose_all(spark):
    rows = [(1, at, at if at < 30 else 60 - at, "", "") for at in range(60)]
    found = nesting.open_above(spark.createDataFrame(rows, ROWS), "doc", "at", "level", 20)
    assert {(r.doc, r.at): [(x["order"], x["level"]) for x in r.path] for r in found.collect()} == expected(rows)


def test_no_rows_and_names_that_are_taken(spark):
    empty = spark.createDataFrame([], ROWS)
    assert nesting.parents(empty, "doc", "at", "level").collect() == []
    df = spark.createDataFrame([("x", "b", 2, 9), ("x", "a", 1, 9)], "above string, ends string, level int, path int")
    assert {(r.ends, r.level): r.path for r in nesting.open_above(df, "above", "ends", "level").collect()} == {("a", 1): [], ("b", 2): [("a", 1)]}
