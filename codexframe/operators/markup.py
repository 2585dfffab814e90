"""Markdown and HTML of documents: inline content, tables with spans, blocks in order, files by topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexframe.functions.citations import citations_of
from codexframe.functions.text import html_escape, link_escape, rule_file_slug, safe_name, web_scheme

#: Marks around text by format, in Markdown and in HTML (fixed values).
MARKS = {"superscript": ("<sup>", "</sup>", "sup"), "subscript": ("<sub>", "</sub>", "sub"), "bold": ("**", "**", "strong"), "italic": ("*", "*", "em")}


def segments(text: Column, own: Column | None = None, authority: str = "") -> Column:
    """A text as an array of (kind, text, target): its citations of other rules (reference), and what lies between (plain)."""
    hits = citations_of(text, authority, own)
    edge = F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit(None).cast("string").alias("designation"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,text:string,target:string>>").alias("out"))
    piece = lambda kind, a, b, target: F.struct(F.lit(kind).alias("kind"), F.substring(text, a + 1, b - a).alias("text"), target.alias("target"))

    def step(state, hit):
        both = F.array(piece("", state["at"], hit["start"], F.lit(None).cast("string")), piece("reference", hit["start"], hit["end"], hit["designation"]))
        return F.struct(hit["end"].alias("at"), F.concat(state["out"], F.filter(both, lambda x: x["text"] != "")).alias("out"))

    return F.aggregate(F.concat(hits, F.array(edge)), start, step)["out"]


def inline_markdown(kind: Column, text: Column, url: Column, path: Column, target_id: Column, detected: Column) -> Column:
    """One piece of inline content; a reference links to its file, else to its place, and stays plain where it was found in running text."""
    out = text
    for name, (left, right, _) in MARKS.items():
        out = F.when(F.array_contains(F.split(kind, r"\+"), name), F.concat(F.lit(left), out, F.lit(right))).otherwise(out)
    link = lambda to: F.concat(F.lit("["), text, F.lit("]("), to, F.lit(")"))
    reference = F.coalesce(link(link_escape(path)), F.when(target_id != "", link(F.concat(F.lit("#"), target_id))), F.when(detected, text), F.concat(F.lit("["), text, F.lit("]")))
    return F.when(kind == "link", link(url)).when(kind == "reference", reference).when(kind == "break", F.lit("\n")).otherwise(out)


def inline_html(kind: Column, text: Column, url: Column, target: Column, target_id: Column, fragment: bool = True) -> Column:
    """One piece of inline content, escaped; links other than to the web become plain spans. In a fragment, references carry data only."""
    shown = html_escape(text)
    out = shown
    for name, (_, _, tag) in MARKS.items():
        out = F.when(F.array_contains(F.split(kind, r"\+"), name), F.concat(F.lit(f"<{tag}>"), out, F.lit(f"</{tag}>"))).otherwise(out)
    link = F.when(web_scheme(url), F.concat(F.lit('<a href="'), html_escape(url), F.lit('">'), shown, F.lit("</a>"))).otherwise(F.concat(F.lit('<span class="external-link-invalid">'), shown, F.lit("</span>")))
    data = lambda name, c: F.when(c != "", F.concat(F.lit(f'data-erules-{name}="'), html_escape(c), F.lit('"')))
    if fragment:
        attributes = F.concat_ws(" ", data("target-id", target_id), data("target-designation", target))
    else:
        attributes = F.concat(F.lit('href="#'), html_escape(F.coalesce(target_id, F.lit(""))), F.lit('"'))
    reference = F.concat(F.lit('<a class="internal-ref" '), attributes, F.lit(">"), shown, F.lit("</a>"))
    return F.when(kind == "link", link).when(kind == "reference", reference).when(kind == "break", F.lit("<br/>")).otherwise(out)


def _in_order(*values: Column | str, by: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(F.col(by).alias("_o"), *values)))


def tables(cells: DataFrame, keys: list[str], caption: Column | None = None) -> DataFrame:
    """Tables of cells (keys, row_no, col_no, colspan, rowspan, text; merged continuations left out): keys, markdown, html.

    A table without spans is a Markdown table, the first row its head; any other is an HTML table in Markdown too.
    """
    attribute = lambda n: F.when(F.col(n) > 1, F.concat(F.lit(f' {n}="'), F.col(n).cast("string"), F.lit('"'))).otherwise("")
    tag = F.when(F.col("row_no") == 0, "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, attribute("colspan"), attribute("rowspan"), F.lit(">"), html_escape(F.col("text")), F.lit("</"), tag, F.lit(">"))
    text = F.when(F.col("text") == "", " ").otherwise(F.replace("text", F.lit("\n"), F.lit("<br>")))
    shown = cells if caption is None else cells.withColumn("caption", caption)
    rows = shown.withColumns({"_cell": cell, "_text": text}).groupBy(*keys, "row_no").agg(
        _in_order("_cell", "_text", by="col_no").alias("c"), F.max((F.col("colspan") > 1) | (F.col("rowspan") > 1)).alias("spans"), *([F.first("caption").alias("caption")] if caption is not None else [])
    )
    join = lambda field, by: F.array_join(F.transform("c", lambda x: x[field]), by)
    rows = rows.select(*keys, "row_no", "spans", F.size("c").alias("wide"), join("_cell", "").alias("h"), F.concat(F.lit("| "), join("_text", " | "), F.lit(" |")).alias("m"), *(["caption"] if caption is not None else []))
    whole = rows.groupBy(*keys).agg(_in_order("h", "m", "wide", by="row_no").alias("r"), F.max("spans").alias("spans"), F.max("wide").alias("wide"), *([F.first("caption").alias("caption")] if caption is not None else []))
    line = lambda x: F.concat(F.lit("<tr>"), x["h"], F.lit("</tr>"))
    body = F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0)))
    named = F.coalesce(F.concat(F.lit("<caption>"), html_escape(F.col("caption")), F.lit("</caption>")), F.lit("")) if caption is not None else F.lit("")
    html = F.concat(F.lit("<table>"), named, F.lit("<thead>"), line(F.get("r", F.lit(0))), F.lit("</thead>"), F.when(F.size("r") > 1, F.concat(F.lit("<tbody>"), F.array_join(F.transform(body, line), ""), F.lit("</tbody>"))).otherwise(""), F.lit("</table>"))
    # rows of fewer cells get blank ones at their end
    padded = F.transform("r", lambda x: F.concat(x["m"], F.repeat(F.lit("   |"), F.col("wide") - x["wide"])))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("wide")), " | "), F.lit(" |"))
    plain = F.array_join(F.concat(F.slice(padded, 1, 1), F.array(rule), F.slice(padded, 2, F.greatest(F.size("r") - 1, F.lit(0)))), "\n")
    bold = F.coalesce(F.concat(F.lit("**"), F.col("caption"), F.lit("**\n\n")), F.lit("")) if caption is not None else F.lit("")
    return whole.select(*keys, F.concat(bold, F.when(F.col("spans"), html).otherwise(plain)).alias("markdown"), html.alias("html"))


def figure_markdown(path: Column, alt: Column, caption: Column, prefix: str | Column = "assets") -> Column:
    given = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c))
    shown = F.concat(F.lit("!["), given(alt, caption, F.lit("Figure")), F.lit("]("), link_escape(F.concat(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit("/"), path)), F.lit(")"))
    return F.concat(shown, F.coalesce(F.concat(F.lit("\n*"), given(caption), F.lit("*")), F.lit("")))


def figure_html(path: Column, alt: Column, caption: Column) -> Column:
    """A figure of a fragment: its asset as data only, none where the name is not a plain one."""
    given = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c))
    asset = html_escape(F.when(safe_name(path), path).otherwise(""))
    title = F.coalesce(F.concat(F.lit("<figcaption>"), html_escape(given(caption)), F.lit("</figcaption>")), F.lit(""))
    return F.concat(F.lit('<figure><img data-erules-asset="'), asset, F.lit('" alt="'), html_escape(given(alt, caption, F.lit("Figure"))), F.lit('"/>'), title, F.lit("</figure>"))


def rule_paths(topics: DataFrame, keys: list[str]) -> DataFrame:
    """Files of top-level topics (keys, ord, kind, designation, title, erules_id): adds path, rules/ or sections/ and a slug."""
    slug = rule_file_slug(F.col("designation"), F.when(F.col("kind") != "section", F.col("erules_id")), F.col("title"), F.lit(""))
    return topics.withColumn("path", F.concat(F.when(F.col("kind") == "section", "sections/").otherwise("rules/"), slug, F.lit(".md")))


def split_files(topics: DataFrame, blocks: DataFrame, keys: list[str], titles: DataFrame) -> DataFrame:
    """Markdown files of documents split by topic: keys, path, content; index.md lists the topics and holds what lies outside them.

    blocks: (keys, topic or null, ord, markdown); titles: (keys, title).
    """
    named = rule_paths(topics.select(*keys, "ord", "kind", "designation", "title", "erules_id"), keys)
    held = blocks.where("topic is not null").groupBy(*keys, F.col("topic").alias("ord")).agg(F.array_join(F.transform(_in_order("markdown", by="ord"), lambda x: F.concat(x["markdown"], F.lit("\n\n"))), "").alias("body"))
    heading = F.concat(F.when(F.col("kind") == "section", "##").otherwise("#"), F.lit(" "), "designation", F.lit(": "), "title", F.lit("\n\n"))
    number = F.when((F.col("kind") != "section") & (F.col("erules_id") != ""), F.concat(F.lit("**ERules ID:** "), "erules_id", F.lit("\n\n"))).otherwise("")
    files = named.join(held, [*keys, "ord"], "left").select(*keys, "path", F.concat(heading, number, F.coalesce("body", F.lit(""))).alias("content"))
    entry = F.concat(F.lit("- ["), "designation", F.lit(": "), "title", F.lit("]("), link_escape(F.col("path")), F.lit(")\n"))
    lines = named.select(*keys, "ord", entry.alias("line")).unionByName(blocks.where("topic is null").select(*keys, "ord", F.concat("markdown", F.lit("\n\n")).alias("line")))
    index = lines.groupBy(*keys).agg(F.array_join(F.transform(_in_order("line", by="ord"), lambda x: x["line"]), "").alias("lines"))
    index = titles.join(index, keys, "left").select(*keys, F.lit("index.md").alias("path"), F.concat(F.lit("# "), "title", F.lit("\n\n## Contents\n\n"), F.coalesce("lines", F.lit(""))).alias("content"))
    return files.unionByName(index)


def html_document(title: Column, document_id: Column, authority: Column, version: Column, body: Column) -> Column:
    """A whole HTML page: head, what identifies the document, and its body (already HTML)."""
    row = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"<dt>{name}</dt><dd>"), html_escape(c), F.lit("</dd>"))).otherwise("")
    rows = F.concat(row("ID", document_id), row("Authority", authority), row("Version", version))
    shown = html_escape(F.coalesce(F.nullif(title, F.lit("")), F.nullif(document_id, F.lit("")), F.lit("Regulation")))
    meta = F.when(rows != "", F.concat(F.lit('<dl class="doc-meta">'), rows, F.lit("</dl>"))).otherwise("")
    return F.concat(F.lit('<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="utf-8"/><title>'), shown, F.lit('</title></head>\n<body><main class="regulation"><h1>'), shown, F.lit("</h1>"), meta, body, F.lit("</main></body>\n</html>\n"))


def plain_text(rows: DataFrame, keys: list[str], order: str, text: Column) -> DataFrame:
    """Text of each key's rows, one a line: white space collapsed, blank rows and repeats of the row before left out."""
    shown = rows.select(*keys, order, F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")).alias("t")).where("t <> ''")
    fresh = shown.withColumn("_last", F.lag("t").over(Window.partitionBy(*keys).orderBy(order))).where("_last is null or _last <> t")
    return fresh.groupBy(*keys).agg(F.array_join(F.transform(_in_order("t", by=order), lambda x: x["t"]), "\n").alias("body"))


def item_json(erules_id: Column, node_id: Column, designation: Column, title: Column, content: Column, references: Column) -> Column:
    """A requirement by itself: id, rule, title, content and its references as JSON."""
    return F.to_json(F.struct(F.coalesce(F.nullif(erules_id, F.lit("")), node_id).alias("id"), designation.alias("rule"), title.alias("title"), content.alias("content"), references.alias("references")))


def reference_tree(designation: Column, outgoing: Column, incoming: Column) -> Column:
    """Two lines below a designation: what it refers to, and what refers to it (arrays)."""
    names = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("(none)")
    return F.concat(designation, F.lit("\n├── references → "), names(outgoing), F.lit("\n└── referenced-by → "), names(incoming))
