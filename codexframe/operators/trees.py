"""Whole node trees as Markdown, as an HTML fragment and as JSON by type: topics in topics, lists, headings, figures, tables in cells.

A document's nodes lie in pre-order with their depth. One sort a document puts them in order; over batches of whole
documents, array arithmetic tells every node what it lies in, its place among siblings and what it holds (`_place`).
Columns then say what opens a node and what closes it, and both are laid out in one order: a node's opening at its
place, its closing behind the last node in it. A document is one group, as long as its own text. Nodes that come in
partitions of documents are not shuffled, and nothing is asked of the nodes before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from codexframe.functions.text import html_escape, link_escape, web_scheme
from codexframe.operators.markup import MARKS, figure_html, figure_markdown, inline_html, inline_markdown, rule_paths

#: What a node can say beside its place (doc keys, ord, depth, type); columns that are missing count as null.
ATTRIBUTES = "node_id string, designation string, title string, erules_id string, level int, ordered boolean, number int, header boolean, colspan int, rowspan int, caption string, image_path string, alt_text string, text string, url string, path string, target_id string, target_designation string, detected boolean, metadata string"
TOPICS = ["section", "requirement", "guidance", "acceptable_means_of_compliance"]
INLINE = ["text", "bold", "italic", "superscript", "subscript", "hyperlink", "internal_reference", "line_break"]
_HOLDERS = ["paragraph", "heading", "list_item", "cell"]  # what inline content belongs to
#: What a node is told: of its parent, how many topics and tables it lies in, its place among siblings, its table's form, and what it holds (inline content: whether its holder is filled).
_PLACE = "_parent_type string, _parent_ordered boolean, _parent_header boolean, _nested int, _tables int, _in_cell boolean, _nth int, _first_alike boolean, _grid_spans boolean, _grid_wide int, _spans boolean, _wide int, _blocks int, _cells int, _heads int, _bodies int, _full boolean, _filled boolean, _holds boolean, _said string"
_CLASSES = {"requirement": "requirement", "guidance": "guidance", "acceptable_means_of_compliance": "amc"}


def _is(*types: str) -> Column:
    return F.col("type").isin(*types)


def attributed(nodes: DataFrame) -> DataFrame:
    """nodes with a column for each attribute."""
    kinds = dict(column.split() for column in ATTRIBUTES.split(", "))
    return nodes.withColumns({name: (F.col(name) if name in nodes.columns else F.lit(None)).cast(kind) for name, kind in kinds.items()})


def ancestors(nodes: DataFrame, keys: list[str], about: Column) -> tuple[DataFrame, int]:
    """nodes with _above, what each one lies in from the document down (about of each level), and the deepest level."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0  # one number: how many columns the window has
    so_far = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    levels = F.array(*(F.last(F.when(F.col("depth") == level, about), ignorenulls=True).over(so_far) for level in range(deepest + 1)))
    return nodes.withColumn("_above", F.slice(levels, F.lit(1), F.col("depth"))), deepest


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole documents from rows in order, whose first one of each document has _start."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("_start"))
        if len(starts):
            if whole := [b for b in (*held, batch.slice(0, starts[-1])) if b.num_rows]:
                yield pa.concat_batches(whole)
            held = []
            batch = batch.slice(starts[-1])
        held.append(batch)
    if whole := [b for b in held if b.num_rows]:
        yield pa.concat_batches(whole)


def _parents(depth: np.ndarray, starts: np.ndarray, document: np.ndarray) -> np.ndarray:
    """The nearest node before each that is less deep, in its document; -1 for none."""
    parent = np.full(len(depth), -1)
    for level in np.unique(depth)[1:]:
        rows, above = np.flatnonzero(depth == level), np.flatnonzero(depth < level)
        own = np.append(above, -1)[np.searchsorted(above, rows) - 1]
        parent[rows] = np.where(own < starts[document[rows]], -1, own)
    return parent


def _last_within(depth: np.ndarray, ends: np.ndarray, document: np.ndarray) -> np.ndarray:
    """The last node in each, or itself: the one before the next that is no deeper, or before the document's end."""
    last = np.empty(len(depth), "int64")
    for level in np.unique(depth):
        rows, stops = np.flatnonzero(depth == level), np.flatnonzero(depth <= level)
        after = np.append(stops, len(depth))[np.searchsorted(stops, rows, side="right")]
        last[rows] = np.minimum(after, ends[document[rows]]) - 1
    return last


def _rank(group: np.ndarray) -> np.ndarray:
    """The place of each row among those of its group, from 1."""
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    out = np.empty(len(group), "int64")
    out[order] = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group)))) + 1
    return out


def _place(batch: pa.RecordBatch) -> dict[str, pa.Array | np.ndarray]:
    """_PLACE of the nodes of whole documents."""
    n, kind = batch.num_rows, batch.column("type")
    one_of = lambda *types: pc.is_in(kind, pa.array(types)).to_numpy(zero_copy_only=False)
    flag = lambda name: pc.fill_null(batch.column(name), False).to_numpy(zero_copy_only=False)
    depth, start, head = batch.column("_depth").to_numpy(), flag("_start"), flag("header")
    starts, document = np.flatnonzero(start), np.cumsum(start) - 1
    parent = _parents(depth, starts, document)
    inline, topic, cell, table, row, holder = one_of(*INLINE), one_of(*TOPICS), one_of("cell"), one_of("table"), one_of("row"), one_of(*_HOLDERS)
    # from the top down; the row at n, which is that of -1, stands for what lies in nothing
    of = {name: np.append(own, False) for name, own in {"topic": topic, "table": table, "cell": cell, "holder": holder}.items()}
    nested, tables = np.zeros(n + 1, "int64"), np.zeros(n + 1, "int64")
    nearest = {name: np.full(n + 1, -1) for name in ("table", "cell", "holder")}
    for level in np.unique(depth):
        rows = np.flatnonzero(depth == level)
        above = parent[rows]
        nested[rows], tables[rows] = nested[above] + of["topic"][above], tables[above] + of["table"][above]
        for name, found in nearest.items():
            found[rows] = np.where(of[name][above], above, found[above])
    in_cell, grid, held_by = nearest["cell"][:n], nearest["table"][:n], np.where(inline, nearest["holder"][:n], -1)
    siblings = np.where(parent < 0, n + document, parent)
    nth = _rank(siblings)
    grid = np.where(grid < 0, n + document, grid)
    count = lambda of, which: np.bincount(of[which & (of >= 0)], minlength=2 * n)
    spans, wide = count(grid, cell & flag("_span")) > 0, np.zeros(2 * n, "int64")
    np.maximum.at(wide, grid[cell], nth[cell])
    filled = count(held_by, flag("_seen"))[:n] > 0
    rows = ~inline & row
    out = {
        "_parent_type": kind.take(pa.array(parent, mask=parent < 0)), "_parent_ordered": np.append(flag("ordered"), False)[parent], "_parent_header": np.append(head, False)[parent],
        "_nested": nested[:n], "_tables": tables[:n], "_in_cell": in_cell >= 0, "_nth": nth, "_first_alike": _rank(siblings * 4 + inline * 2 + head) == 1,
        "_grid_spans": spans[grid], "_grid_wide": wide[grid], "_spans": spans[:n], "_wide": wide[:n],
        "_blocks": count(parent, ~inline)[:n], "_cells": count(parent, cell)[:n], "_heads": count(parent, rows & head)[:n], "_bodies": count(parent, rows & ~head)[:n],
        "_full": count(in_cell, (inline & flag("_says")) | table)[:n] > 0, "_filled": np.where(inline, (held_by < 0) | filled[held_by], filled),
        "_holds": np.append((depth[1:] > depth[:-1]) & ~start[1:], False),
    }
    if "_piece" in batch.schema.names:
        at = np.flatnonzero(held_by >= 0)
        at = at[np.argsort(held_by[at], kind="stable")]
        holders, first = np.unique(held_by[at], return_index=True)
        said = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), batch.column("_piece").take(pa.array(at))), "")
        own = np.full(n, -1)
        own[holders] = np.arange(len(holders))
        out["_said"] = said.take(pa.array(own, mask=own < 0))
    return out


def _placed(nodes: DataFrame, keys: list[str], said: bool = False) -> DataFrame:
    """nodes with all attributes and _PLACE, in order; _said, the text that holders hold, only if asked for."""
    given = [c for c in dict.fromkeys([*nodes.columns, "ordered", "header"]) if c not in ("ord", "depth")]
    piece = F.when(_is("line_break"), "\n").otherwise(F.coalesce("text", F.when(_is("internal_reference"), F.col("target_designation")), F.lit("")))
    span = (F.coalesce("colspan", F.lit(1)) > 1) | (F.coalesce("rowspan", F.lit(1)) > 1)
    # numbering puts documents together and in order, and says where each one starts
    start = F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) == 1
    asked = {"_start": start, "_depth": F.col("depth").cast("long"), "_span": _is("cell") & span, "_says": piece != "", "_seen": piece.rlike(r"(?U)\S")} | ({"_piece": piece} if said else {})
    rows = attributed(nodes).select(*given, *(c.alias(name) for name, c in asked.items()))
    kept = [f for f in rows.schema.fields if f.name not in ("_span", "_says", "_seen", "_piece")]
    schema = StructType([*kept, *(f for f in StructType.fromDDL(_PLACE).fields if said or f.name != "_said")])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in _whole(batches):
            told = _place(batch)
            columns = (batch.column(f.name) if f.name in batch.schema.names else told[f.name] for f in arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return attributed(rows.mapInArrow(run, schema)).withColumn("_inline", F.coalesce(_is(*INLINE), F.lit(False)))


def _uncompiled(column: Column) -> Column:
    """The same column; a projection with a lambda function stays out of whole-stage code.

    All that nodes can open and close with would be one method there, longer than the 8,000 bytes that a JVM compiles.
    """
    return F.get(F.transform(F.array(column), lambda x: x), F.lit(0))


def _rendered(placed: DataFrame, keys: list[str], opened: Column, closed: Column) -> DataFrame:
    """One row a document: what opens and closes its nodes, in order. placed keeps the order of _placed."""
    shown = placed.select(*keys, "_start", _uncompiled(F.col("_depth")).alias("_depth"), F.coalesce(opened, F.lit("")).alias("_open"), F.coalesce(closed, F.lit("")).alias("_close"))
    schema = StructType([*(shown.schema[k] for k in keys), StructField("body", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in _whole(batches):
            n, depth = batch.num_rows, batch.column("_depth").to_numpy()
            starts = np.flatnonzero(batch.column("_start"))
            ends = np.append(starts[1:], n)
            last = _last_within(depth, ends, np.repeat(np.arange(len(starts)), ends - starts))
            # an opening at its node's place; behind the last node in it a closing, the deepest first
            most = depth.max() - depth.min() + 2
            order = np.argsort(np.concatenate([np.arange(n) * most, last * most + depth.max() - depth + 1]))
            pieces = pa.concat_arrays([batch.column("_open"), batch.column("_close")]).take(pa.array(order))
            body = pc.binary_join(pa.ListArray.from_arrays(pa.array(2 * np.append(starts, n), pa.int32()), pieces), "")
            own = [batch.column(k).take(pa.array(starts)) for k in keys]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*own, body], arrow, strict=True)], schema=arrow)

    return shown.mapInArrow(run, schema)


def _chosen(pairs: list[tuple[Column, Column | str]]) -> Column:
    """The value of the first condition that holds, else nothing."""
    out = F.lit("")
    for condition, value in reversed(pairs):
        out = F.when(F.coalesce(condition, F.lit(False)), value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def _given(*columns: str) -> Column:
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def _label() -> Column:
    return F.regexp_replace(F.concat(F.coalesce("designation", F.lit("")), F.lit(": "), F.coalesce("title", F.lit(""))), "^[: ]+|[: ]+$", "")


def _table_tags(escape_caption: Column) -> tuple[list, list]:
    """HTML of tables, rows and cells: (opening, closing). Head rows come first; cells that a merge goes on in are left out of the nodes."""
    head, attribute = F.coalesce("header", F.lit(False)), lambda n: F.when(F.coalesce(F.col(n), F.lit(1)) > 1, F.concat(F.lit(f' {n}="'), F.col(n).cast("string"), F.lit('"'))).otherwise("")
    tag = F.when(F.col("_parent_header"), "th").otherwise("td")
    first = F.col("_nth") == 1
    row = F.concat(F.when(head & first, "<thead>").when(~head & first, "<tbody>").when(~head & F.col("_first_alike"), "</thead><tbody>").otherwise(""), F.lit("<tr>"))
    end = F.when(F.col("_bodies") > 0, "</tbody>").when(F.col("_heads") > 0, "</thead>").otherwise("")
    opening = [(_is("table"), F.concat(F.lit("<table>"), escape_caption)), (_is("row"), row), (_is("cell"), F.concat(F.lit("<"), tag, attribute("colspan"), attribute("rowspan"), F.lit(">")))]
    closing = [(_is("table"), F.concat(end, F.lit("</table>"))), (_is("row"), F.lit("</tr>")), (_is("cell"), F.concat(F.lit("</"), tag, F.lit(">")))]
    return opening, closing


def markdown(nodes: DataFrame, keys: list[str], level: int | Column = 1, prefix: str | Column = "assets") -> DataFrame:
    """Markdown of every document (keys, body) from its nodes (keys, ord, depth, type, attributes).

    Nodes are in pre-order; inline content of a paragraph or list item comes before the blocks in it. Topics are headed by
    designation and title, one level deeper in each other, six at most. A table without spans is a Markdown table, its
    head the first head row (blank without one), any other, and any in a cell, an HTML one; paragraphs and tables of a
    cell are set apart by <br>. Blank paragraphs are left out. Nodes of other types show what they hold. level and prefix
    (of assets) can be columns of the nodes.
    """
    placed = _placed(nodes, keys)
    hashes = lambda: F.concat(F.repeat(F.lit("#"), F.least(F.col("_nested") + level, F.lit(6))), F.lit(" "))
    blocks, in_cell = F.col("_blocks") > 0, F.col("_in_cell")
    # a block right after inline content ends its line
    after_inline = ~F.col("_inline") & F.col("_first_alike") & (F.col("_nth") > 1)
    first = _chosen([(in_cell & (F.col("_parent_type") == "cell") & (F.col("_nth") > 1), "<br>"), (~in_cell & after_inline & (F.col("_parent_type") == "paragraph"), "\n\n"), (~in_cell & after_inline & (F.col("_parent_type") == "list_item"), "\n")])
    within, spans = in_cell, F.col("_spans")
    own_html = F.when(_is("table"), within | spans).otherwise(F.col("_grid_spans") | (F.col("_tables") > 1))
    tags, ends = _table_tags(F.lit(""))
    heads = F.col("_heads")
    rule = lambda wide: F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), wide), " | "), F.lit(" |\n"))
    blank = lambda wide: F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit(" "), wide), " | "), F.lit(" |\n"))
    wide = F.col("_wide").cast("int")
    bold = F.when(~within, F.coalesce(F.concat(F.lit("**"), _given("caption"), F.lit("**\n\n")), F.lit(""))).otherwise("")
    grid = F.col("_grid_wide").cast("int")
    row_end = F.concat(F.repeat(F.lit(" |  "), grid - F.col("_cells").cast("int")), F.lit(" |\n"))
    no_cells = F.col("_cells") == 0
    said = F.when(in_cell, F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("<br>"))).otherwise(F.coalesce("text", F.lit("")))
    in_html = in_cell & ((F.col("_tables") > 1) | F.col("_grid_spans"))
    said = F.when(in_html, html_escape(said)).otherwise(said)
    marks = {name: (left, right) for name, (left, right, _) in MARKS.items()}
    label = F.coalesce(F.nullif(said, F.lit("")), F.col("target_designation"))
    opened = _chosen([
        (_is(*_HOLDERS[:1]) & ~F.col("_filled") & ~blocks, ""),
        (_is(*TOPICS), F.concat(hashes(), F.coalesce("designation", F.lit("")), F.lit(": "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.when(~_is("section"), F.coalesce(F.concat(F.lit("**ERules ID:** "), _given("erules_id"), F.lit("\n\n")), F.lit(""))).otherwise(""))),
        (_is("heading") & ~in_cell, F.concat(hashes(), F.coalesce(F.concat(_given("designation"), F.lit(": ")), F.lit("")))),
        (_is("list_item") & ~in_cell, F.when(F.col("_parent_ordered"), F.concat(F.col("_nth").cast("string"), F.lit(". "))).otherwise("- ")),
        (_is("table") & own_html, F.concat(bold, tags[0][1])), (_is("table"), F.concat(bold, F.when((wide > 0) & (heads == 0), F.concat(blank(wide), rule(wide))).otherwise(""))),
        (_is("row") & own_html, tags[1][1]), (_is("row") & no_cells, F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit(" "), grid), " | "))), (_is("row"), "| "),
        (_is("cell") & own_html, tags[2][1]), (_is("cell"), F.concat(F.when(F.col("_nth") > 1, " | ").otherwise(""), F.when(F.col("_full"), "").otherwise(" "))),
        (_is("figure") & ~in_cell, F.concat(figure_markdown(F.coalesce("image_path", F.lit("")), F.col("alt_text"), F.col("caption"), prefix), F.lit("\n\n"))),
        (_is("text"), F.when(_shown(), said).otherwise("")),
        *((_is(name), F.concat(F.lit(left), said)) for name, (left, _) in marks.items()),
        (_is("hyperlink"), F.concat(F.lit("["), said)),
        (_is("internal_reference"), inline_markdown(F.lit("reference"), label, F.col("url"), F.col("path"), F.coalesce("target_id", F.lit("")), F.coalesce("detected", F.lit(False)))),
        (_is("line_break"), F.when(in_cell, "<br>").otherwise("\n")),
    ])
    closed = _chosen([
        (_is("paragraph") & ~in_cell & F.col("_filled") & ~blocks, "\n\n"), (_is("heading") & ~in_cell, "\n\n"), (_is("list_item") & ~in_cell & ~blocks, "\n"),
        (_is("table") & own_html, F.concat(ends[0][1], F.when(within, "").otherwise("\n\n"))), (_is("table"), F.when(wide > 0, "\n").otherwise("")),
        (_is("row") & own_html, "</tr>"),
        (_is("row"), F.concat(F.when(no_cells, " |\n").otherwise(row_end), F.when(F.coalesce("header", F.lit(False)) & (F.col("_nth") == 1), rule(grid)).otherwise(""))),
        (_is("cell") & own_html, ends[2][1]),
        *((_is(name), right) for name, (_, right) in marks.items()), (_is("hyperlink"), F.concat(F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")"))),
    ])
    return _rendered(placed, keys, F.concat(first, opened), closed)


def _shown() -> Column:
    """Text counts unless it is all there is of a blank paragraph."""
    return F.col("_filled") | F.col("_in_cell")


def html(nodes: DataFrame, keys: list[str], level: int = 2) -> DataFrame:
    """An HTML fragment of every document (keys, body); nodes as for markdown. Links go to the web only, references and assets are data."""
    placed = _placed(nodes, keys)
    in_cell, blocks = F.col("_in_cell"), F.col("_blocks") > 0
    after_inline = ~F.col("_inline") & F.col("_first_alike") & (F.col("_nth") > 1)
    first = _chosen([(in_cell & (F.col("_parent_type") == "cell") & (F.col("_nth") > 1), "<br/>"), (~in_cell & after_inline & (F.col("_parent_type") == "paragraph"), "</p>")])
    h = lambda n: F.concat(F.lit("h"), F.least(F.greatest(n, F.lit(1)), F.lit(6)).cast("string"))
    topic, heading = h(F.col("_nested") + level), h(F.coalesce("level", F.lit(1)))
    around = lambda tag, inner: F.concat(F.lit("<"), tag, F.lit(">"), inner, F.lit("</"), tag, F.lit(">"))
    css = reduce(lambda out, c: F.when(F.col("type") == c[0], F.lit(f' class="{c[1]}"')).otherwise(out), _CLASSES.items(), F.lit(""))
    number = F.when(~_is("section"), F.coalesce(F.concat(F.lit('<p class="erules-id"><strong>ERules ID:</strong> '), html_escape(_given("erules_id")), F.lit("</p>")), F.lit(""))).otherwise("")
    list_tag = F.when(F.coalesce("ordered", F.lit(False)), "ol").otherwise("ul")
    tags, ends = _table_tags(F.coalesce(F.concat(F.lit("<caption>"), html_escape(_given("caption")), F.lit("</caption>")), F.lit("")))
    said, web = html_escape(F.coalesce("text", F.lit(""))), web_scheme(F.coalesce("url", F.lit("")))
    label = F.coalesce(_given("text"), F.col("target_designation"), F.lit(""))
    marks = {name: tag for name, (_, _, tag) in MARKS.items()}
    opened = _chosen([
        (_is(*TOPICS), F.concat(F.lit("<section"), css, F.lit(' id="'), html_escape(F.coalesce(_given("node_id", "designation"), F.lit(""))), F.lit('">'), around(topic, html_escape(_label())), number)),
        (_is("paragraph") & ~in_cell & F.col("_filled"), "<p>"),
        (_is("heading") & ~in_cell, F.concat(F.lit("<"), heading, F.lit(">"), F.coalesce(F.concat(html_escape(_given("designation")), F.lit(": ")), F.lit("")))),
        (_is("list") & ~in_cell, F.concat(F.lit("<"), list_tag, F.lit(">"))), (_is("list_item") & ~in_cell, "<li>"), *tags,
        (_is("figure") & ~in_cell, figure_html(F.coalesce("image_path", F.lit("")), F.col("alt_text"), F.col("caption"))),
        (_is("text"), F.when(_shown(), said).otherwise("")), *((_is(name), F.concat(F.lit(f"<{tag}>"), said)) for name, tag in marks.items()),
        (_is("hyperlink"), F.concat(F.when(web, F.concat(F.lit('<a href="'), html_escape(F.coalesce("url", F.lit(""))), F.lit('">'))).otherwise('<span class="external-link-invalid">'), said)),
        (_is("internal_reference"), inline_html(F.lit("reference"), label, F.col("url"), F.coalesce("target_designation", F.lit("")), F.coalesce("target_id", F.lit("")))),
        (_is("line_break"), "<br/>"),
    ])
    closed = _chosen([
        (_is(*TOPICS), "</section>"), (_is("paragraph") & ~in_cell & F.col("_filled") & ~blocks, "</p>"), (_is("heading") & ~in_cell, F.concat(F.lit("</"), heading, F.lit(">"))),
        (_is("list") & ~in_cell, F.concat(F.lit("</"), list_tag, F.lit(">"))), (_is("list_item") & ~in_cell, "</li>"), *ends,
        *((_is(name), f"</{tag}>") for name, tag in marks.items()), (_is("hyperlink"), F.when(web, "</a>").otherwise("</span>")),
    ])
    return _rendered(placed, keys, F.concat(first, opened), closed)


#: What a node of a type shows in JSON beside type, id and metadata (fixed values).
FIELDS = {
    "document": ["title"], "section": ["designation", "title", "level"], "requirement": ["designation", "title", "erules_id"], "guidance": ["designation", "title", "erules_id"],
    "acceptable_means_of_compliance": ["designation", "title", "erules_id"], "heading": ["level", "designation"], "list": ["ordered"], "list_item": ["number"],
    "figure": ["image_path", "caption", "alt_text"], "hyperlink": ["text", "url"], "internal_reference": ["text", "target_id", "target_designation"],
    **{t: ["text"] for t in ("text", "bold", "italic", "superscript", "subscript")},
}


def json(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """JSON of every document (keys, body): each node by its type, its children in it; a table's rows as lists of cells, lists of what is in them."""
    placed = _placed(nodes, keys, said=True)
    options = {"ignoreNullFields": "false"}
    plain = lambda *fields: F.expr(f"substring(to_json(named_struct({', '.join(fields)}), map('ignoreNullFields', 'false')), 2)")
    inner = lambda *fields: F.regexp_replace(plain(*fields), r"\}$", "")
    head = F.concat(F.lit("{"), inner("'type', type", "'id', node_id"), F.lit(',"metadata":'), F.coalesce("metadata", F.lit("{}")))
    own = F.lit("")
    for kind, fields in FIELDS.items():
        own = F.when(F.col("type") == kind, F.concat(F.lit(","), inner(*(f"'{f}', {f}" for f in fields)))).otherwise(own)
    text = F.to_json(F.struct(F.coalesce(F.col("_said"), F.lit("")).alias("text")), options)
    own = F.when(_is("paragraph"), F.concat(F.lit(","), F.regexp_replace(text, r"^\{|\}$", ""))).otherwise(own)
    comma = F.when(F.col("_nth") > 1, ",").otherwise("")
    is_head = F.coalesce("header", F.lit(False))
    caption = F.concat(F.lit(","), inner("'caption', caption"), F.lit(',"headers":['))
    turn = F.when(~is_head & F.col("_first_alike"), '],"rows":[').otherwise(comma)
    opened = _chosen([(_is("table"), F.concat(comma, head, caption)), (_is("row"), F.concat(turn, F.lit("["))), (_is("cell"), F.concat(comma, F.lit("["))), (F.lit(True), F.concat(comma, head, own, F.when(F.col("_holds"), ',"children":[').otherwise("")))])
    closed = _chosen([(_is("table"), F.when(F.col("_bodies") > 0, "]}").otherwise('],"rows":[]}')), (_is("row", "cell"), "]"), (F.lit(True), F.when(F.col("_holds"), "]}").otherwise("}"))])
    return _rendered(placed, keys, opened, closed)


def files(nodes: DataFrame, keys: list[str], prefix: str = "assets") -> DataFrame:
    """Markdown files of documents split by their topmost topics: keys, path, content.

    Nodes as for markdown, the document at depth 0. All that lies in a topmost topic is in its file, rules/ or sections/
    and a slug; index.md has the document's title and identity, lists the topics, and holds what lies outside them. A
    reference to a designation that has a file, or to the ERules ID of one in rules/, links to it (of several, the last one).
    """
    order = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    nodes = attributed(nodes)
    top = F.last(F.when(F.col("depth") == 1, F.struct("ord", "type", "level")), ignorenulls=True).over(order)
    within = nodes.withColumn("_top", top).where("depth > 0").withColumns({"_unit": F.col("_top.ord"), "depth": F.col("depth") - 1})
    level = F.when(F.col("_top.type") == "section", F.least(F.coalesce("_top.level", F.lit(1)) + 1, F.lit(6))).when(F.col("_top.type").isin(TOPICS), 1).otherwise(2)
    tops = nodes.where(F.col("depth") == 1).where(_is(*TOPICS))
    paths = rule_paths(tops.select(*keys, "ord", F.col("type").alias("kind"), F.coalesce("designation", F.lit("")).alias("designation"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("erules_id", F.lit("")).alias("erules_id")), keys)
    names = F.array("designation", F.when(F.col("kind") != "section", F.col("erules_id")))
    named = paths.select(*keys, "ord", "path", F.explode(names).alias("target_designation")).where("target_designation <> ''")
    linked = named.groupBy(*keys, "target_designation").agg(F.max_by("path", "ord").alias("_file"))
    within = within.withColumn("_base", level).join(linked, [*keys, "target_designation"], "left").withColumn("path", F.coalesce("_file", "path"))
    body = F.when(F.col("_top.type").isin(TOPICS), f"../{prefix}").otherwise(prefix)
    shown = markdown(within.withColumn("_prefix", body).drop("_top"), [*keys, "_unit"], F.col("_base"), F.col("_prefix"))
    whole = paths.withColumnRenamed("ord", "_unit").join(shown, [*keys, "_unit"])
    out = whole.select(*keys, "path", F.col("body").alias("content"))
    entry = F.concat(F.lit("- ["), "designation", F.lit(": "), "title", F.lit("]("), link_escape(F.col("path")), F.lit(")\n"))
    lines = paths.select(*keys, F.col("ord").alias("_unit"), entry.alias("line")).unionByName(shown.join(paths.select(*keys, F.col("ord").alias("_unit")), [*keys, "_unit"], "left_anti").select(*keys, "_unit", F.col("body").alias("line")))
    listed = lines.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_unit", "line"))), lambda x: x["line"]), "").alias("lines"))
    head = nodes.where(F.col("depth") == 0).select(*keys, F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n")).alias("head"))
    index = head.join(listed, keys, "left").select(*keys, F.lit("index.md").alias("path"), F.concat("head", F.lit("## Contents\n\n"), F.coalesce("lines", F.lit(""))).alias("content"))
    return out.unionByName(index)
