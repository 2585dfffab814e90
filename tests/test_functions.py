"""Scalar functions, operators and the stemmer on small tables, with nulls, ties and empty inputs."""

import pytest
from pyspark.sql import functions as F

from codexframe.functions import citations, metadata, versions
from codexframe.functions import text as fn
from codexframe.functions.stem import stem
from codexframe.operators import navigation as nav
from codexframe.operators import references as refs
from codexframe.operators import render, search
from codexframe.sources.markup import links, page_nodes


def each(spark, function, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in frame.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


CASES = [
    (fn.tokens, {"Éa-b 12": ["éa", "b", "12"], None: [], "": []}),
    (fn.collapse_whitespace, {" a \t\x0b b\r\nc \r d ": " a b\nc\nd ", None: None, "": ""}),
    (fn.slugify, {"Hello, World -- x": "hello-world-x", "-": "", None: None, "a" * 150: "a" * 100}),
    (fn.slugify_rule, {"CS 23.101": "cs-23-101", None: None}),
    (fn.base_designation, {"CS-23.5(a)(1)": "CS-23.5", "CS-23.5": None, None: None}),
    (fn.citations, {"see CS-23.5 and AMC CS-25.1(a); x/CS-9.9": ["CS-23.5", "AMC CS-25.1(a)"], "": [], None: None}),
    (fn.citations, {"CS 23.2000, CS-VLA 303; AMC VLA 21(c) GM2 CS LSA 3": ["CS-23.2000", "CS-VLA.303", "AMC VLA 21(c)", "GM2 CS-LSA.3"], "AMC1 CS-23.5 x/AMC1-CS-9.9 a-CS 9.9": ["AMC1 CS-23.5"], "cs 23.1": []}),
    (fn.canonical_designation, {" cs\u00a0 23.101 (a)": "CS-23.101 (a)", "CS-VLA 1": "CS-VLA.1", "amc1  23.2100": "AMC1 CS-23.2100", "AMC vla 21(c) and gm1 lsa 2": "AMC VLA 21(c) and GM1 LSA 2", "AMC1 CS-23--5": "AMC1 CS-23-5", "": "", None: None}),
    (fn.leading_designation, {"AMC1 23.2000 Title": "AMC1 CS-23.2000", "CS 23.2000": "CS-23.2000", "GM LSA 3: x": "GM LSA 3", "AMC CS-TEST.300 T": "AMC CS-TEST.300", "CS-VLA": "CS-VLA", "CS VLA 21(c) T": "CS-VLA.21(c)", "On CS-23.5": None, "CS-23": None, None: None}),
    (fn.split_list, {"a; n/a;b ;-;a": ["a", "b"], "": [], None: None}),
    (fn.html_escape, {"<a href=\"x\">&'</a>": "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;&lt;/a&gt;", None: None}),
    (fn.link_escape, {"a(b) <c>%": "a%28b%29%20%3Cc%3E%25", None: None}),
    (versions.version_label, {"CS-23 Amdt 6": "Amendment 6", "Initial Issue": "Initial Issue", "Issue 2": "Issue 2", "Rev 3": None, "none": None, None: None}),
    (versions.version_slug, {"CS-23 & AMC / Amendment 6": "cs-23-and-amc-amendment-6", "": "unknown"}),
    (citations.second_designation, {"§ 23.1": "14 CFR 23.1", "": "", None: ""}),
    (metadata.scalar, {" x; ": "x", "N/A": None, None: None}),
    (fn.version_order, {"amendment-12-1": [12, 1], "initial": [], None: None}),
]


@pytest.mark.parametrize(("function", "cases"), CASES, ids=[c[0].__name__ for c in CASES])
def test_scalar_functions(spark, function, cases):
    assert each(spark, function, list(cases)) == list(cases.values())


@pytest.mark.parametrize(
    ("word", "root"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("controlling", "control"), ("connection", "connect"), ("is", "is"), ("été", "été")],
)
def test_stems(word, root):
    assert stem(word) == root


def test_bare_codes_are_no_numbered_designations(spark):
    assert each(spark, lambda v: fn.leading_designation(v, require_number=True), ["CS-VLA", "CS-VLA 1", "CS-23.5 T"]) == [None, "CS-VLA.1", "CS-23.5"]


def test_level_stack_against_an_explicit_stack(spark):
    levels = [1, 2, 3, 3, 1, 3, 2, 2, 3, 1, 2, 3, 3, 2, 3]
    rows = [(d, i, level) for d in (1, 2) for i, level in enumerate(levels[d:])]
    frame = spark.createDataFrame(rows, "doc long, ord int, level int")
    want_parent, want_above = {}, set()
    for d in (1, 2):
        stack = []
        for _, i, level in [r for r in rows if r[0] == d]:
            while stack and stack[-1][1] >= level:
                stack.pop()
            want_parent[d, i] = stack[-1][0] if stack else None
            want_above |= {(d, i, a, k + 1) for k, (a, _) in enumerate(reversed(stack))}
            stack.append((i, level))
    got = nav.level_parents(frame, "doc", "ord", "level", [1, 2, 3]).collect()
    assert {(r.doc, r.ord): r.parent for r in got} == want_parent
    assert {tuple(r) for r in nav.ancestors(frame, "doc", "ord", "level", [1, 2, 3]).collect()} == want_above
    assert nav.ancestors(frame.where("false"), "doc", "ord", "level", [1, 2, 3]).collect() == []


def test_islands_and_disambiguation(spark):
    frame = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a"), (2, 1, None)], "doc int, ord int, v string")
    runs = nav.islands(frame.withColumn("s", nav.changes("v", "doc", "ord")), "doc", "ord", F.col("s"))
    # the first row of a document has no row before, which counts as null
    assert [(r.doc, r.ord, r.island) for r in runs.orderBy("doc", "ord").collect()] == [(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 5, 3), (2, 1, 0)]
    named = nav.disambiguated(frame.where("v = 'a'"), "v", ["ord"])
    assert [r.node_id for r in named.orderBy("ord").collect()] == ["a", "a--2", "a--3"]


def test_references_fall_back_and_first_target_wins(spark):
    given = spark.createDataFrame([(1, "A-1"), (2, "a 1"), (3, "B-2(a)"), (4, "none"), (5, None)], "i int, wanted string")
    targets = spark.createDataFrame([("A-1", 20), ("A-1", 10), ("B-2", 30)], "name string, target int")
    w = F.col("wanted")
    keys = [w, F.replace(F.upper(w), F.lit(" "), F.lit("-")), fn.base_designation(w)]
    got = refs.resolve(given, targets, keys, "name", "target", "target").orderBy("i").collect()
    assert [(r.target, r.step) for r in got] == [(10, 0), (10, 1), (30, 2), (None, None), (None, None)]
    assert sorted(r.wanted for r in refs.unresolved(given.where("wanted is not null").select("wanted"), "wanted", targets, "name").collect()) == ["B-2(a)", "a 1", "none"]


def test_prefixes_need_a_boundary(spark):
    candidates = spark.createDataFrame([("CS-23.2100 AMC",), ("CS-23.21(a)",), ("X",)], "c string")
    requirements = spark.createDataFrame([("CS-23.21", 1), ("CS-23.2100", 2)], "r string, o int")
    got = refs.prefix_matches(candidates, "c", requirements, "r", "o").collect()
    assert {r.c: r.r for r in got} == {"CS-23.2100 AMC": "CS-23.2100", "CS-23.21(a)": "CS-23.21"}


def test_search_arguments_are_checked(spark):
    frame = spark.createDataFrame([(1, "a", ""), (2, "b", None), (3, "a", "x")], "i int, v string, blank string")
    with pytest.raises(ValueError):
        search.page(frame, ["i"], limit=0)
    with pytest.raises(ValueError):
        search.page(frame, ["i"], offset=-1)
    with pytest.raises(ValueError):
        search.one_of("v", ["z"], ("a", "b"))
    assert [r.i for r in search.page(frame, ["i"], 1, 1).collect()] == [2]
    assert [tuple(r) for r in search.facet(frame, "blank").collect()] == [("x", 1)]
    assert frame.where(search.one_of("v", [])).count() == 3


def test_ranked_search_counts_phrases_as_terms(spark):
    frame = spark.createDataFrame([(1, "red fox and red hen"), (2, "fox red"), (3, None), (4, "")], "i int, t string")
    assert [r.i for r in search.bm25(frame, "t", ["red"], [["red", "fox"]]).collect()] == [1]
    assert search.bm25(frame, "t", ["red", "fox"]).columns == ["i", "t", "score"]
    assert search.bm25(frame.where("false"), "t", ["red"]).collect() == []


def test_ranked_search_stems_folds_and_counts_phrases(spark):
    frame = spark.createDataFrame([(1, "Über connected lines"), (2, "u\u0308ber den"), (3, "plain words here"), (4, None)], "i int, t string")
    assert [r.i for r in search.bm25(frame, "t", ["connect"], stemmed=True).collect()] == [1]
    assert sorted(r.i for r in search.bm25(frame, "t", ["uber"], stemmed=True).collect()) == [1, 2] and search.bm25(frame, "t", ["uber"]).collect() == []
    assert [r.i for r in search.bm25(frame, "t", [], [["ÜBER", "connecting"]], stemmed=True).collect()] == [1]
    rows = spark.createDataFrame([(1, "a a a b"), (2, "a a c b"), (3, "c c c c"), (4, "d d d d"), (5, "e e e e")], "i int, t string")
    score = {r.i: r.score for r in search.bm25(rows, "t", [], [["a", "a"]]).collect()}
    assert set(score) == {1, 2} and score[1] < score[2]


def test_renderers_keep_order(spark):
    frame = spark.createDataFrame([(1, 2, "b<"), (1, 1, "a"), (2, 1, None)], "d int, o int, t string")
    assert {r.d: r.body for r in render.plain_text(frame, "d", "o", F.col("t")).collect()}[1] == "a\nb<"
    assert {r.d: r.body for r in render.html(frame, "d", "o", F.lit("k"), F.col("t")).collect()}[1] == '<p class="k">a</p><p class="k">b&lt;</p>'
    assert {r.d: r.body for r in render.markdown(frame, "d", "o", F.lit(2), F.lit("T"), F.col("t")).collect()}[1] == "## T\n\na\n\n## T\n\nb<"
    assert {r.d: r.body for r in render.json_document(frame, "d", "o", "t").collect()}[1] == '[{"o":1,"t":"a"},{"o":2,"t":"b<"}]'


def test_markup_tolerates_broken_pages(spark):
    pages = spark.createDataFrame([(1, '<p>a<b>c</p><a href="x">d'), (2, None), (3, "")], "k long, html string")
    rows = [(r.k, r.ord, r.parent, r.depth, r.node_type, r.text) for r in page_nodes(pages, "k", "html").orderBy("k", "ord").collect()]
    assert rows == [(1, 0, None, 0, "p", ""), (1, 1, 0, 1, "text", "a"), (1, 2, 0, 1, "b", ""), (1, 3, 2, 2, "text", "c"), (1, 4, None, 0, "a", ""), (1, 5, 4, 1, "text", "d")]
    assert [tuple(r) for r in links(pages, "k", "html").collect()] == [(1, "x")]


def test_lists_of_json_are_read_whatever_is_given(spark):
    given = {'["a", "é", 1, null]': ["a", "é", "1", None], "[]": [], "": [], "{}": [], '"a"': [], "[": [], "null": [], None: []}
    df = spark.createDataFrame([(k,) for k in given], "t string")
    assert {r.t: r.x for r in df.select("t", fn.decoded_list(df.t).alias("x")).collect()} == given
