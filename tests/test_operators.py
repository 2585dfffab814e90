"""Query texts, catalogs, metadata, relations and rendered output on small tables, with nulls and empty inputs."""

import pytest
from pyspark.sql import functions as F

from codexframe.functions import citations, metadata, relations, versions
from codexframe.functions import text as fn
from codexframe.operators import catalog, index, markup, navigation, references


def test_query_texts_become_units():
    assert index.query_units('"of  the" CS-X.2 a_b OR* !?') == [["of", "the"], ["cs", "x", "2"], ["a", "b"], ["or"]]
    assert index.query_units(' "" !') == [] and index.query_units("") == []


def test_catalog_ids_come_once(spark):
    one, two = (spark.createDataFrame([(i, i)], "id string, title string") for i in ("a", "b"))
    assert {r.id for r in catalog.merged([one, two], "id").collect()} == {"a", "b"}
    with pytest.raises(Exception, match="comes twice"):
        catalog.merged([one, one], "id").collect()
    for read in (lambda df: df.count(), lambda df: df.select("title").collect(), lambda df: df.where("title = 'a'").count()):
        with pytest.raises(Exception, match="comes twice"):
            read(catalog.merged([one, two, one], "id"))


@pytest.mark.parametrize(
    "function",
    [versions.version_label, versions.reported_size, relations.relation_key, relations.requirement_by_suffix, metadata.scalar, fn.slugify, fn.ed_decision, fn.query_designation, versions.iso_date, fn.to_ascii],
)
def test_null_stays_null(spark, function):
    frame = spark.createDataFrame([(None,), ("",)], "t string")
    assert frame.select(function(F.col("t")).alias("x")).first().x is None


def test_citations_of_nothing(spark):
    frame = spark.createDataFrame([(None,), ("",), ("none",)], "t string")
    assert [r.x or [] for r in frame.select(citations.citations_of(F.col("t")).alias("x")).collect()] == [[], [], []]
    with pytest.raises(ValueError, match="no authority"):
        citations.citations_of(F.col("t"), "ICAO")


def test_metadata_is_merged_and_empty(spark):
    rows = [("a", 0, "TypeOfContent", "AMC; GM"), ("a", 1, "typeOfContent", "GM;CS"), ("a", 2, "title", " T; "), ("a", 3, "sourceTitle", "N/A"), ("a", 4, "odd", "v"), ("b", 0, "odd", None)]
    got = {r.k: r for r in metadata.normalized(spark.createDataFrame(rows, "k string, ord int, name string, value string"), ["k"]).withColumn("e", metadata.is_empty()).collect()}
    assert got["a"].type_of_content == ["AMC", "GM", "CS"] and got["a"].source_title == "T" and got["a"].raw == {"odd": "v"} and not got["a"].e
    assert got["b"].e and got["b"].raw == {"odd": None} and got["b"].keywords == []


def test_spellings_cover_the_publisher():
    known = metadata.spellings()
    assert known["EASACategory"] == "easa_category" and known["RegulatorySource"] == known["regulatorySource"] == "regulatory_source" and known["sdt-id"] == "sdt_id" and known["source-title"] == "source_title"
    assert set(known.values()) == {*metadata.LISTS, *metadata.SCALARS}


def test_relations_respect_boundaries(spark):
    requirements = spark.createDataFrame([("r1", "CS-23.2", 1), ("r2", "CS-23.21", 2), ("r0", "", 0)], "requirement string, designation string, ord int")
    materials = spark.createDataFrame([("m", "AMC", "", ["CS-23.21 Title"]), ("n", None, None, None)], "material string, designation string, title string, targets array<string>")
    assert [(r.material, r.requirement) for r in references.relation_map(materials, requirements).collect()] == [("m", "r2")]


def test_equal_references_resolve_alike(spark):
    refs = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "w string")
    names = spark.createDataFrame([("a", 7), ("a", 3)], "name string, target int")
    got = references.resolve(refs, names, [F.col("w")], "name", "target", "target").collect()
    assert sorted((r.w or "", r.target or 0) for r in got) == [("", 0), ("a", 3), ("a", 3), ("z", 0)]


def test_tables_of_one_row_and_short_rows(spark):
    rows = [(1, 0, 0, 1, 1, "a"), (1, 0, 1, 1, 1, "b"), (1, 1, 0, 1, 1, "x|"), (2, 0, 0, 1, 1, "")]
    frame = spark.createDataFrame(rows, "t int, row_no int, col_no int, colspan int, rowspan int, text string")
    got = {r.t: r.markdown for r in markup.tables(frame, ["t"]).collect()}
    assert got == {1: "| a | b |\n| --- | --- |\n| x| |   |", 2: "|   |\n| --- |"}


def test_nearest_of_no_designation(spark):
    frame = spark.createDataFrame([(["", None, "a", ""],), ([],)], "p array<string>")
    assert [r.x for r in frame.select(navigation.nearest(F.col("p")).alias("x")).collect()] == ["a", None]


def test_edges_of_formatted_pieces_stay(spark):
    df = spark.createDataFrame([(1, 1, " a ", False), (1, 2, " b ", True), (2, 1, " c ", True), (3, 1, " d ", None)], "p int, o int, t string, plain boolean")
    got = {(r.p, r.o): r.x for r in df.select("p", "o", navigation.trimmed_edges(["p"], "o", "t", F.col("plain")).alias("x")).collect()}
    assert got == {(1, 1): " a ", (1, 2): " b", (2, 1): "c", (3, 1): " d "}


def test_best_snippet_takes_a_text_apart_once(spark):
    """However many hits a text has: what a function over arrays names again would be worked out again, once a hit."""
    from codexframe.operators.search import best_snippet

    texts = ["one two With three", "no hit", None, "", "from " + "x " * 30 + "and with, from " + "y " * 30 + "end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = rows.select("k", best_snippet(F.col("text"), ["with", "from"], words=6, before=2).alias("s"))
    assert {r.k: r.s for r in found.collect()} == {0: "one two «With» three", 1: None, 2: None, 3: None, 4: "…x and «with,» «from» y y…"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_siblings_are_dealt_by_their_number(spark):
    """Tasks grow in number with the pairs, also when the input is one small partition."""
    rows = [(m, r) for r in range(40) for m in range(r % 3, 60, 3)] * 2 + [(None, 1), (5, None), (None, None), (7, 999)]
    found = references.siblings(spark.createDataFrame(rows, "m long, r long").coalesce(1), "m", "r", rows=500)
    kept = {(m, r) for m, r in rows if m is not None and r is not None}
    want = sorted({(a, b) for a, r in kept for b, s in kept if r == s and a != b})
    got = [tuple(x) for x in found.withColumn("at", F.spark_partition_id()).collect()]
    assert found.columns == ["m", "sibling"] and sorted(x[:2] for x in got) == want
    assert len({x[2] for x in got}) > 10  # 7,600 pairs one way round
    assert references.siblings(spark.createDataFrame([], "m long, r long"), "m", "r").collect() == []
