"""Every registered query against its DuckDB SQL, and the others against brute force in Python."""

import datetime
import decimal
import math
import os
import re
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from codexframe.plans import registry

SAME_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_duckdb(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    for column, kind in got.dtypes:
        assert types[column].startswith(SAME_TYPES[kind]) or kind in ("int", "bigint"), (column, kind, types[column])
        assert "HUGEINT" not in types[column] and "DECIMAL" not in types[column], column
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_every_query_is_named_once():
    found = __spark_entry__.queries()
    assert set(registry.QUERIES) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)


def test_entry_works_without_the_training_data_operators(tmp_path):
    root = Path(__spark_entry__.__file__).parent
    for name in ("codexframe", "__spark_entry__.py", "corpus_pipeline.py"):
        part = root / name
        if part.is_dir():
            shutil.copytree(part, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif part.exists():
            shutil.copy(part, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n == 'pipeline' or n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_entry_gives_a_page(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "lang", "source", "score"]


def test_snippets_mark_the_term(spark, sf_dir):
    rows = registry.QUERIES["search_snippet"](spark, sf_dir).collect()
    assert rows
    for r in rows:
        assert re.search("«[^»]*[Ww][Ii][Tt][Hh][^»]*»", r.snippet) or "«" not in r.snippet
        assert len(r.snippet.split(" ")) <= 24


def test_stemmed_search_finds_words_of_the_stems(spark, sf_dir):
    from codexframe.functions.stem import stem
    from codexframe.operators.index import folded_word
    from codexframe.plans.search_queries import _FORMS

    got = {r.doc_id for r in registry.QUERIES["search_stemmed"](spark, sf_dir).collect()}
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        form = _FORMS[r.doc_id % 24] if r.doc_id % 24 < len(_FORMS) else ""
        if {"connect", stem("resume")} <= {stem(folded_word(w.lower())) for w in re.findall(r"[^\W_]+", f"{r.text or ''} {form}")}:
            want.add(r.doc_id)
    assert got == want and want


def test_overlapping_spans_go_in_order(spark, sf_dir):
    for r in registry.QUERIES["citation_overlap"](spark, sf_dir).collect():
        s = r.p_size
        taken, at = [], -1
        for start, end in sorted([(0, s % 7 + 1), (s % 5, s % 5 + 6), (s % 11 + 3, s % 11 + 5)], key=lambda x: (x[0], -x[1])):
            if start >= at:
                taken.append(f"{start}-{end}")
                at = end
        assert r.spans == ",".join(taken)


def test_page_nodes_keep_order_and_depth(spark, sf_dir):
    rows = registry.QUERIES["html_parse_nodes"](spark, sf_dir).collect()
    depth = {(r.page_id, r.ord): r.depth for r in rows}
    assert len(depth) == len(rows)
    for r in rows:
        assert (r.parent is None) == (r.depth == 0)
        if r.parent is not None:
            assert r.parent < r.ord and depth[r.page_id, r.parent] == r.depth - 1


def test_every_reference_is_resolved_or_reported(spark, sf_dir):
    keys = {r.p_partkey for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").collect()}
    got = {r.p_partkey: r.target for r in registry.QUERIES["ref_resolve_all"](spark, sf_dir).collect()}
    assert got == {k: None if k % 11 == 0 else k for k in keys}


@pytest.mark.parametrize("name", ["citations_by_authority", "citations_of_others", "designation_of_lines", "designation_leading", "citation_forms", "citation_detect"])
def test_rows_of_one_small_file_are_dealt_over_tasks(spark, sf_dir, name):
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
