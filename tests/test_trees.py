"""Whole node trees in Markdown, HTML and JSON, against a plain walk and by example."""

import json
import random

from codexframe.operators import trees

SCHEMA = "doc int, ord bigint, depth int, type string, " + trees.ATTRIBUTES
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def flat(doc, tree):
    """Rows of nested (type, attributes, children) in pre-order."""
    out = []

    def visit(node, depth):
        kind, about, children = node
        out.append({"doc": doc, "ord": len(out), "depth": depth, "type": kind, **about})
        for c in children:
            visit(c, depth + 1)

    visit(tree, 0)
    return [tuple(r.get(n) for n in NAMES) for r in out]


def t(text):
    return ("text", {"text": text}, [])


def p(*inline):
    return ("paragraph", {}, [t(i) if isinstance(i, str) else i for i in inline])


def rows(*rows, heads=1):
    return [("row", {"header": k < heads}, [("cell", {}, [p(c)] if isinstance(c, str) else c) for c in r]) for k, r in enumerate(rows)]


def shown(spark, render, *documents, **options):
    frame = spark.createDataFrame([r for k, d in enumerate(documents) for r in flat(k, d)], SCHEMA).repartition(3)
    got = {r.doc: r.body for r in render(frame, ["doc"], **options).collect()}
    return [got[k] for k in range(len(documents))]


NESTED = ("document", {"title": "Doc"}, [
    ("section", {"designation": "A", "title": "Part"}, [
        p("Intro ", ("bold", {}, [t("strong"), ("italic", {}, [t(" both")])]), "."), p("  "),
        ("requirement", {"designation": "R.1", "title": "Rule", "erules_id": "E-1", "node_id": "n1"}, [
            ("heading", {"level": 3, "designation": "(a)"}, [t("Head")]),
            ("list", {"ordered": True}, [("list_item", {"number": 1}, [t("one"), ("list", {"ordered": False}, [("list_item", {}, [t("in & out")]), ("list_item", {}, [t("deep")])])]), ("list_item", {"number": 2}, [t("two")])]),
            ("guidance", {"designation": "G", "title": "Help"}, [p("NESTED text ", ("internal_reference", {"text": "R.1", "target_designation": "R.1", "target_id": "n1"}, []), ("hyperlink", {"url": "https://x.y"}, [t("site")]), ("figure", {"image_path": "a b.png", "caption": "Cap"}, []))]),
        ]),
    ]),
])


def test_topics_lists_and_figures_nest(spark):
    [md] = shown(spark, trees.markdown, NESTED)
    assert md == (
        "# A: Part\n\nIntro **strong* both***.\n\n## R.1: Rule\n\n**ERules ID:** E-1\n\n### (a): Head\n\n1. one\n- in & out\n- deep\n2. two\n"
        "### G: Help\n\nNESTED text [R.1](#n1)[site](https://x.y)\n\n![Cap](assets/a%20b.png)\n*Cap*\n\n"
    )
    [html] = shown(spark, trees.html, NESTED)
    assert html == (
        '<section id="A"><h2>A: Part</h2><p>Intro <strong>strong<em> both</em></strong>.</p><section class="requirement" id="n1"><h3>R.1: Rule</h3><p class="erules-id"><strong>ERules ID:</strong> E-1</p>'
        '<h3>(a): Head</h3><ol><li>one<ul><li>in &amp; out</li><li>deep</li></ul></li><li>two</li></ol><section class="guidance" id="G"><h4>G: Help</h4>'
        '<p>NESTED text <a class="internal-ref" data-erules-target-id="n1" data-erules-target-designation="R.1">R.1</a><a href="https://x.y">site</a></p>'
        '<figure><img data-erules-asset="a b.png" alt="Cap"/><figcaption>Cap</figcaption></figure></section></section></section>'
    )


def test_tables_in_cells(spark):
    inner = ("table", {}, rows(["x", "y<"], [[("table", {}, rows(["deep"], heads=0))], "z"]))
    plain = ("document", {}, [("table", {"caption": "T"}, rows(["a", "b"], ["1", ""], ["2"], [[p("up"), inner], "down\nline"]))])
    spanned = ("document", {}, [("table", {}, [("row", {"header": True}, [("cell", {"colspan": 2}, [p("h")])]), ("row", {}, [("cell", {}, [p("a")]), ("cell", {"rowspan": 2}, [p("b & c")])])]), p("after")])
    bare = ("document", {}, [("table", {}, rows(["a"], ["b"], heads=0)), ("table", {}, [])])
    nested = "<table><thead><tr><th>x</th><th>y&lt;</th></tr></thead><tbody><tr><td><table><tbody><tr><td>deep</td></tr></tbody></table></td><td>z</td></tr></tbody></table>"
    md = shown(spark, trees.markdown, plain, spanned, bare)
    assert md[0] == f"**T**\n\n| a | b |\n| --- | --- |\n| 1 |   |\n| 2 |   |\n| up<br>{nested} | down<br>line |\n\n"
    assert md[1] == '<table><thead><tr><th colspan="2">h</th></tr></thead><tbody><tr><td>a</td><td rowspan="2">b &amp; c</td></tr></tbody></table>\n\nafter\n\n'
    assert md[2] == "|   |\n| --- |\n| a |\n| b |\n\n"
    html = shown(spark, trees.html, plain, spanned)
    assert html[0] == f"<table><caption>T</caption><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td></td></tr><tr><td>2</td></tr><tr><td>up<br/>{nested}</td><td>down\nline</td></tr></tbody></table>"
    assert html[1] == '<table><thead><tr><th colspan="2">h</th></tr></thead><tbody><tr><td>a</td><td rowspan="2">b &amp; c</td></tr></tbody></table><p>after</p>'


def plain_json(node):
    kind, about, children = node
    out = {"type": kind, "id": about.get("node_id"), "metadata": {}} | {f: about.get(f) for f in trees.FIELDS.get(kind, [])}
    if kind == "paragraph":
        out["text"] = "".join(said(c) for c in children if c[0] in trees.INLINE)
    if kind == "table":
        cells = lambda r: [[plain_json(i) for i in c[2]] for c in r[2]]
        return out | {"caption": about.get("caption"), "headers": [cells(r) for r in children if r[1].get("header")], "rows": [cells(r) for r in children if not r[1].get("header")]}
    if children:
        out["children"] = [plain_json(c) for c in children]
    return out


def said(node):
    return (node[1].get("text") or node[1].get("target_designation") or "") + "".join(said(c) for c in node[2])


def test_json_by_type_equals_a_walk(spark):
    inner = ("table", {}, rows(["x", "y"], ["", 'q"\\']))
    table = ("document", {"title": 'T "x"'}, [("table", {"caption": "C"}, rows(["a"], [[p("up"), inner]])), ("table", {}, rows(["only"], heads=1)), ("table", {}, rows(["b"], heads=0))])
    for got, tree in zip(shown(spark, trees.json, NESTED, table), (NESTED, table), strict=True):
        assert json.loads(got) == plain_json(tree)


def plain_html(node):
    kind, about, children = node
    inner = "".join(map(plain_html, children))
    if kind in ("section", "guidance"):
        return f'<section{" class=" + chr(34) + kind + chr(34) if kind == "guidance" else ""} id="{about["designation"]}"><h6>{about["designation"]}: {about["title"]}</h6>{inner}</section>'
    return {"text": about.get("text", ""), "bold": f"<strong>{inner}</strong>", "paragraph": f"<p>{inner}</p>" if inner.strip() else "", "list": f"<ul>{inner}</ul>", "list_item": f"<li>{inner}</li>"}.get(kind, inner)


def test_random_trees_equal_a_walk(spark):
    rng = random.Random(3)

    def inline(n=2):
        return [t(rng.choice(["w", "x y", "z."])) if n == 0 or rng.random() < 0.7 else ("bold", {}, inline(n - 1)) for _ in range(rng.randint(1, 3))]

    def blocks(n):
        out = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.choice(["paragraph", "list", "section", "guidance", "odd"]) if n else "paragraph"
            if kind == "paragraph":
                out.append((kind, {}, inline()))
            elif kind == "list":
                out.append((kind, {}, [("list_item", {}, [*inline(0), *([("list", {}, [("list_item", {}, inline(1))])] if rng.random() < 0.4 else [])]) for _ in range(rng.randint(1, 3))]))
            else:
                out.append((kind, {"designation": f"D{rng.randrange(99)}", "title": "T"}, blocks(n - 1)))
        return out

    documents = [("document", {}, blocks(7)) for _ in range(25)]
    assert shown(spark, trees.html, *documents, level=6) == [plain_html(d) for d in documents]


def test_no_nodes(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert [f(frame, ["doc"]).collect() for f in (trees.markdown, trees.html, trees.json)] == [[], [], []]
    bare = spark.createDataFrame([(1, 0, 0, "text")], "doc int, ord bigint, depth int, type string")
    assert trees.markdown(bare, ["doc"]).first().body == ""


def test_nodes_in_partitions_of_documents_are_not_shuffled(spark):
    rows = [(d, o, depth, kind, text) for d in range(4) for o, (depth, kind, text) in enumerate([(0, "document", None), (1, "paragraph", None), (2, "text", f"of {d}")])]
    nodes = spark.createDataFrame(rows, "doc long, ord long, depth int, type string, text string").repartition(5, "doc")
    for render in (trees.markdown, trees.html, trees.json):
        out = render(nodes, ["doc"])
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(r.body for r in trees.markdown(nodes, ["doc"]).collect()) == [f"of {d}\n\n" for d in range(4)]


def test_nodes_are_put_in_order_once(spark):
    """One sort a document, no copies of nodes for what they ask of others, and no pass over them before."""
    nodes = spark.createDataFrame([(1, 0, 0, "document", None), (1, 1, 1, "paragraph", None), (1, 2, 2, "text", "x")], "doc long, ord long, depth int, type string, text string").repartition(5, "doc")
    for render in (trees.markdown, trees.html, trees.json):
        plan = render(nodes, ["doc"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") == 1 and "Generate" not in plan and "Aggregate" not in plan


def test_documents_lie_over_batches(spark):
    """Documents that begin and end within batches, or are longer than one, come out as whole ones do."""
    documents = [NESTED, ("document", {"title": "x"}, []), ("document", {}, [p(f"n {k}") for k in range(40)]), NESTED]
    renders = (trees.markdown, trees.html, trees.json)
    want = [shown(spark, render, *documents) for render in renders]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert [shown(spark, render, *documents) for render in renders] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
