"""Deterministic output of one document's ordered rows: plain text, Markdown, HTML, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexframe.functions.text import html_escape


def joined(df: DataFrame, doc: str, order: str, piece: Column, between: str) -> DataFrame:
    """One row a document: its pieces in order. A document is one group, as long as its own text."""
    pieces = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p"))))
    return df.groupBy(doc).agg(F.array_join(F.transform(pieces, lambda x: x["p"]), between).alias("body"))


def plain_text(df: DataFrame, doc: str, order: str, text: Column) -> DataFrame:
    return joined(df, doc, order, text, "\n")


def markdown(df: DataFrame, doc: str, order: str, level: Column, title: Column, text: Column) -> DataFrame:
    return joined(df, doc, order, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title, F.lit("\n\n"), text), "\n\n")


def html(df: DataFrame, doc: str, order: str, kind: Column, text: Column) -> DataFrame:
    return joined(df, doc, order, F.concat(F.lit('<p class="'), kind, F.lit('">'), html_escape(text), F.lit("</p>")), "")


def json_document(df: DataFrame, doc: str, order: str, *columns: str) -> DataFrame:
    """One row a document: a JSON array of its rows' columns in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order), *columns)))
    return df.groupBy(doc).agg(F.to_json(rows).alias("body"))


def json_tree(nodes: DataFrame, doc: str, fields: list[str]) -> DataFrame:
    """One JSON object a document, nodes inside nodes: nodes (doc, ord, parent, depth, fields); children only where there are any.

    Built level by level from the deepest one up: a join a level, and a node's children are as long as its own text.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0  # one number
    below = None
    for level in range(deepest, -1, -1):
        own = nodes.where(F.col("depth") == level).select(doc, "ord", "parent", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("json"))
        if below is not None:
            children = below.groupBy(doc, F.col("parent").alias("ord")).agg(F.sort_array(F.collect_list(F.struct(F.col("ord").alias("o"), "json"))).alias("c"))
            listed = F.concat(F.lit(',"children":['), F.array_join(F.transform("c", lambda x: x["json"]), ","), F.lit("]}"))
            own = own.join(children, [doc, "ord"], "left").select(doc, "ord", "parent", F.when(F.col("c").isNull(), F.col("json")).otherwise(F.concat(F.expr("substring(json, 1, length(json) - 1)"), listed)).alias("json"))
        below = own
    return below.select(doc, "json")
