"""Bodies of our own making as nodes, lists, cells and captions."""

from codexframe.sources import bodies

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def p(text, style=None, num=None):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:numId w:val="{num}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def cell(text, span=None, merge=None):
    props = (f'<w:gridSpan w:val="{span}"/>' if span else "") + ("" if merge is None else f'<w:vMerge w:val="{merge}"/>' if merge else "<w:vMerge/>")
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{p(text)}</w:tc>"


def table(*rows):
    return "<w:tbl>" + "".join(f"<w:tr>{''.join(r)}</w:tr>" for r in rows) + "</w:tbl>"


BODY = (
    p("Top", "Heading2") + p("one", num=1) + p("two", num=1) + p("plain") + p("three", num=2) + p("Table 1: spans")
    + table([cell("wide", span=2), cell("m", merge="restart")], [cell("a"), cell("b"), cell("", merge="")], [cell("c"), cell("d"), cell("", merge="continue")], [cell("e"), cell("f"), cell("g")])
    + "<w:sdt><w:sdtContent>" + p("in a tag", "Title") + "</w:sdtContent></w:sdt>"
)


def nodes(spark):
    rows = [("k", "word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{BODY}</w:body></w:document>'.encode()), ("bad", "word/document.xml", b"<x"), ("none", "word/document.xml", None), ("other", "a.xml", b"<x/>"), ("empty", "word/document.xml", b"<x/>")]
    return bodies.body_nodes(spark.createDataFrame([(a, b, bytearray(c) if c is not None else None) for a, b, c in rows], "package string, part string, data binary"))


def test_paragraphs_are_told_apart(spark):
    rows = [r for r in nodes(spark).orderBy("ord").collect() if r.node_type != "cell"]
    assert [r.text for r in rows if r.package == "bad"] == ["ParseError: unclosed token: line 1, column 0"]
    rows = [r for r in rows if r.package != "bad"]
    assert [(r.node_type, r.level, r.num_id, r.text) for r in rows] == [
        ("heading", 2, None, "Top"), ("list_item", None, "1", "one"), ("list_item", None, "1", "two"), ("paragraph", None, None, "plain"),
        ("list_item", None, "2", "three"), ("paragraph", None, None, "Table 1: spans"), ("heading", 1, None, "in a tag"),
    ]


def test_runs_keep_formats_links_and_drawings(spark):
    run = lambda text, props="": f"<w:r><w:rPr>{props}</w:rPr><w:t>{text}</w:t></w:r>"
    body = "<w:p>" + run("a") + run("b") + run("c", '<w:vertAlign w:val="superscript"/><w:b/>') + run("d", "<w:i/>") + "<w:hyperlink><w:r><w:t>anchor</w:t></w:r></w:hyperlink></w:p>"
    frame = spark.createDataFrame([("k", "word/document.xml", bytearray(f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'.encode()))], "package string, part string, data binary")
    (row,) = bodies.body_nodes(frame).collect()
    assert [(r.kind, r.text) for r in row.runs] == [("", "ab"), ("superscript+bold", "c"), ("italic", "d"), ("link", "anchor")] and row.text == "abcdanchor"


def test_stored_names_get_suffixes(spark):
    rows = [("p", "x.png", "h1", 1), ("p", "x.png", "h2", 2), ("p", "x.png", "h1", 3), ("q", "x.png", "h2", 1)]
    got = bodies.stored_names(spark.createDataFrame(rows, "package string, name string, sha256 string, ord int"), ["package"]).collect()
    assert sorted((r.package, r.ord, r.stored) for r in got) == [("p", 1, "x.png"), ("p", 2, "x-1.png"), ("p", 3, "x.png"), ("q", 1, "x.png")]


def test_adjacent_items_form_lists(spark):
    assert [(r.list_no, r.number, r.text) for r in bodies.lists(nodes(spark)).orderBy("ord").collect()] == [(1, 1, "one"), (1, 2, "two"), (2, 1, "three")]


def test_cells_span_rows_and_columns(spark):
    got = {r.text: (r.row_no, r.col_no, r.colspan, r.rowspan) for r in bodies.cells(nodes(spark)).collect()}
    assert got == {"wide": (0, 0, 2, 1), "m": (0, 2, 1, 3), "a": (1, 0, 1, 1), "b": (1, 1, 1, 1), "c": (2, 0, 1, 1), "d": (2, 1, 1, 1), "e": (3, 0, 1, 1), "f": (3, 1, 1, 1), "g": (3, 2, 1, 1)}


def test_captions_come_from_neighbours(spark):
    assert [(r.table_no, r.caption) for r in bodies.captions(nodes(spark)).collect()] == [(1, "Table 1: spans")]
    assert bodies.captions(nodes(spark).where("false")).collect() == []
