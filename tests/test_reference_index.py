"""References in runs of text: detection, resolution, and the stored index, on small trees."""

import random
import re

from pyspark.sql import functions as F

from codexframe.operators import reference_index as ri
from codexframe.operators import trees
from codexframe.operators.references import resolve
from codexframe.plans import citing_queries
from tests.test_trees import NAMES, SCHEMA, flat, p, t


def rule(name, *inner, **about):
    return ("requirement", {"designation": name, "node_id": f"id-{name}", "title": "", **about}, list(inner))


def frame(spark, *documents):
    return spark.createDataFrame([r for k, d in enumerate(documents) for r in flat(k, ("document", {}, d))], SCHEMA).repartition(3)


def shape(found, doc=0):
    rows = sorted((r for r in found.collect() if r.doc == doc), key=lambda r: r.ord)
    assert [r.ord for r in rows] == list(range(len(rows)))
    return [(r.depth, r.type, r.text, r.target_designation) for r in rows if r.type in ("text", "internal_reference")]


def test_designations_cut_by_runs_are_found_and_text_is_kept(spark):
    nodes = frame(spark, [rule("CS-VLA.307", p("as required by ", "CS-VLA ", "303", " above."), p("CS-VLA 307 itself, ", ("bold", {}, [t("CS 23.1 "), t("bold")])))])
    assert shape(ri.detected(nodes, ["doc"])) == [
        (3, "text", "as required by ", None), (3, "internal_reference", "CS-VLA 303", "CS-VLA.303"), (3, "text", " above.", None),
        (3, "text", "CS-VLA 307 itself, ", None), (4, "internal_reference", "CS 23.1", "CS-23.1"), (4, "text", " bold", None),
    ]


def test_headings_and_given_references_stay(spark):
    given = ("internal_reference", {"target_designation": "CS-23.9", "text": None}, [t("CS 23.9")])
    nodes = frame(spark, [rule("CS-23.1", ("heading", {}, [t("CS 23.2")]), p("a ", given, " CS 23.3"), ("section", {}, [p("CS 23.1 and CS 23.4")]))])
    assert [x[3] for x in shape(ri.detected(nodes, ["doc"])) if x[1] == "internal_reference"] == ["CS-23.9", "CS-23.3", "CS-23.4"]


def test_authorities_and_empty_texts(spark):
    nodes = frame(spark, [rule("R", p("CS 23.1 and § 25.2", ""), p(t(None)))], [])
    assert [x[3] for x in shape(ri.detected(nodes, ["doc"], "FAA")) if x[3]] == ["14 CFR 25.2"]
    assert [x[3] for x in shape(ri.detected(nodes, ["doc"])) if x[3]] == ["CS-23.1", "14 CFR 25.2"]
    assert ri.detected(nodes.limit(0), ["doc"]).count() == 0 and ri.reference_index(nodes.limit(0), ["doc"]).count() == 0


def test_reader_grammar_takes_single_runs_in_any_case(spark):
    nodes = frame(spark, [rule("CS-23.1", p("amc1  CS 23 and cs 23.2210.1, CS ", "23.4 GM CS-VLA.3"), ("heading", {}, [t("CS-23.1")]), p(("bold", {}, [t("CS 23.5")])))])
    assert [x[2:] for x in shape(ri.parsed(nodes, ["doc"])) if x[3]] == [("amc1  CS 23", "amc1 CS-23"), ("cs 23.2210.1", "cs-23.2210.1"), ("GM CS-VLA.3", "GM CS-VLA.3"), ("CS-23.1", "CS-23.1")]


def test_names_resolve_exactly_then_loosely_then_without_groups(spark):
    ref = lambda d: ("internal_reference", {"target_designation": d}, [])
    names = ["CS-23.1", "cs 23.2", "CS-23.3(a)(1)", "cs 23.1(b)", "E 7", "CS-23.9"]
    first = [rule("CS-23.1", p(*map(ref, names))), rule("CS-23.1", node_id="later"), rule("CS-23.2"), rule("CS-23.3"), rule("X", erules_id="E-7")]
    index = ri.reference_index(frame(spark, first, [rule("CS-23.9", p(ref("CS-23.1")))]), ["doc"])
    got = {(r.doc, r.target_designation): r.target_id for r in index.collect()}
    assert got == {(0, "CS-23.1"): "id-CS-23.1", (0, "cs 23.2"): "id-CS-23.2", (0, "CS-23.3(a)(1)"): "id-CS-23.3", (0, "cs 23.1(b)"): "id-CS-23.1", (0, "E 7"): "id-X", (0, "CS-23.9"): None, (1, "CS-23.1"): None}
    assert {(r.source_id, r.source_ord) for r in index.collect() if r.doc == 0} == {("id-CS-23.1", 1)}


def test_stored_context_reads_only_its_buckets(spark, tmp_path):
    rng = random.Random(7)
    documents = [[rule(f"CS-23.{k}", p(*(f"CS 23.{rng.choice([1, rng.randrange(1, 12)])} " for _ in range(3)))) for k in range(1, 10)] for _ in range(4)]
    nodes = ri.detected(frame(spark, *documents), ["doc"])
    index = ri.reference_index(nodes, ["doc"])
    stored = ri.store(spark, index, ["doc"], str(tmp_path / "refs"), rows_a_bucket=20)
    again = ri.StoredReferences(spark, stored.path)
    assert again.buckets > 4 and again.keys == ["doc"] and again.edges().count() == index.count()
    rows, asked = index.collect(), nodes.where("type = 'requirement' and node_id = 'id-CS-23.1'").select("doc", "ord", "designation")
    context = again.context(asked, "designation")
    say = lambda r, side: (side, r.doc, r.source_id, r.text, r.target_designation, r.target_id)
    wanted = {say(r, "outgoing") for r in rows if r.source_id == "id-CS-23.1"} | {say(r, "incoming") for r in rows if r.target_id == "id-CS-23.1"}
    got = [say(r, r.side) for r in context.collect()]
    assert set(got) == wanted and len(got) == len(wanted)
    assert "PartitionFilters: [isnotnull(bucket" in context._jdf.queryExecution().toString() or "PartitionFilters: [bucket" in context._jdf.queryExecution().toString()


def test_random_runs_equal_plain_matching(spark):
    """Texts cut anywhere give the references of the whole text, by a plain regular expression."""
    rng = random.Random(3)
    words = ["CS 23.10", "CS-VLA 303", "(a)", " ", " and ", "x", "§", "AMC VLA 21(c)", "CS-", "23.5", ".", "\n", "é"]
    texts = ["".join(rng.choice(words) for _ in range(12)) for _ in range(60)]

    def cut(text):
        at = sorted({0, *(rng.randrange(len(text)) for _ in range(4)), len(text)})
        return [text[a:b] for a, b in zip(at, at[1:], strict=False)]

    nodes = frame(spark, *([rule("R", p(*cut(s)))] for s in texts))
    rows = ri.detected(nodes, ["doc"], "EASA").where("type in ('text', 'internal_reference')").orderBy("doc", "ord").collect()
    form = re.compile(r"(?<![\w./-])(?:(?:AMC|GM)\d*\s+CS[-\s]?[A-Z]{2,12}[.\s]\d+|(?:AMC|GM)\d*\s+CS[-\s]?\d+\.\d+|(?:AMC|GM)\d*\s+[A-Z]{2,12}\s+\d+|CS[-\s][A-Z]{2,12}[.\s]\d+|CS[-\s]\d+\.\d+)(?:\([a-z0-9]+\))*")
    for k, text in enumerate(texts):
        assert "".join(r.text for r in rows if r.doc == k) == text
        assert [r.text for r in rows if r.doc == k and r.type == "internal_reference"] == form.findall(text), text


def test_files_link_citations_and_ids(spark):
    nodes = ri.detected(frame(spark, [rule("CS-23.1", p("CS 23.2 ", ("internal_reference", {"target_designation": "E2"}, []))), rule("CS-23.2", erules_id="E2")]), ["doc"])
    got = {r.path: r.content for r in trees.files(nodes, ["doc"]).collect()}
    assert "[CS 23.2](rules/cs-23-2.md) [E2](rules/cs-23-2.md)" in got["rules/cs-23-1.md"]
    found = ri.linked(nodes, ri.reference_index(nodes, ["doc"]), ["doc"]).where("type = 'internal_reference'").select("target_id").collect()
    assert [r.target_id for r in found] == ["id-CS-23.2"] * 2 and NAMES[0] == "doc"


def test_references_are_resolved_without_broadcasts_and_names_read_once(spark):
    """A small file can become many references: estimates by its bytes must not send them through the driver."""
    refs, names = spark.range(3).selectExpr("cast(id as string) as r"), spark.range(3).selectExpr("cast(id as string) as n", "id as t")
    out = resolve(refs, names, [F.col("r")], "n", "t", "t")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.r, r.t) for r in out.collect()) == [("0", 0), ("1", 1), ("2", 2)]


def test_nodes_of_parts_keep_the_tasks_they_are_dealt_to(spark, sf_dir):
    """Adaptive execution puts small parts together, which then become a dozen nodes each, in one task."""
    nodes = citing_queries._nodes(spark, sf_dir).select("brand", "ord")
    nodes.count()
    assert nodes.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
