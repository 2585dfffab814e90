"""Registered queries, the URL oracle, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from codexframe.llm import queries


def test_names():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 14)]


def test_url_query_equals_duckdb(spark, sf_dir):
    got = queries.QUERIES["op7_url_filters"](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.sql(queries.ORACLES["op7_url_filters"])
    assert sorted(map(repr, got.select(sorted(got.columns)).toPandas().itertuples(index=False, name=None))) == sorted(map(repr, want.df()[sorted(got.columns)].itertuples(index=False, name=None)))


def test_pipeline_stages(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "substring_dedup", "secrets", "packing"] and corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    rows = out.collect()
    assert 0 < len({r.doc_id for r in rows}) < spark.read.parquet(f"{sf_dir}/documents.parquet").count()


@pytest.mark.parametrize("stage", [f for n, f in corpus_pipeline.STAGES if n != "packing"])
def test_stages_keep_columns_and_clean_rows(spark, sf_dir, tmp_path, stage):
    clean = " ".join(f"word{k % 37} of plain prose that goes on," for k in range(3)) + " until it ends."
    rows = [(1, clean, "en", "s", len(clean)), (2, None, None, None, None), (2, None, None, None, None), (None, "other words here.", "en", "s", 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    if stage is corpus_pipeline.quality:  # no labels fit: every row has the score of none, beyond the threshold
        assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    else:
        assert clean in [r.text for r in out.collect()]
    assert stage(spark, docs.where("false"), sf_dir).collect() == []


WRONG = "cast(x'61ff6220c3' as string)"


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_text_that_is_not_utf8(spark, sf_dir, stage):
    docs = spark.sql(f"SELECT cast(id AS long) doc_id, {WRONG} text, 'en' lang, 's' source, 5L n_chars, 1 digest, 2 rep FROM range(3)")
    assert {r[0] for r in stage(spark, docs, sf_dir).select("doc_id").collect()} <= {0, 1, 2}


def test_packing_takes_awkward_rows(spark, sf_dir):
    rows = [(1, "plain words"), (1, "plain words"), (None, None), (2, ""), (3, "x " * 9000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, bin long")
    out = corpus_pipeline.packing(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece) for r in out) == [(False, 1, 0), (False, 1, 0), (False, 2, 0), *[(False, 3, k) for k in range(3)], (True, 0, 0)]
