"""Order and hierarchy in flattened documents: all by windows over one document's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(doc: str, order: str | list[str]):
    return Window.partitionBy(doc).orderBy(order)


def level_parents(df: DataFrame, doc: str, order: str, level: str, levels: list[int]) -> DataFrame:
    """Adds parent: the order of the nearest earlier row of a lower level; a row closes all rows of its level and above."""
    before = ordered(doc, order).rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(before) for k in levels}
    out = df
    for k in levels:
        out = out.withColumn(f"_last{k}", last[k])
    parent = F.lit(None)
    for own in sorted(levels):
        lower = [F.col(f"_last{k}") for k in levels if k < own]
        nearest = F.greatest(*lower) if len(lower) > 1 else (lower[0] if lower else F.lit(None))
        parent = F.when(F.col(level) == own, nearest).otherwise(parent)
    return out.withColumn("parent", parent).drop(*(f"_last{k}" for k in levels))


def ancestors(df: DataFrame, doc: str, order: str, level: str, levels: list[int]) -> DataFrame:
    """One row for each open ancestor: doc, order, ancestor, depth (1: nearest).

    The last row of a level is an ancestor if no later row had a lower level, which needs no recursion.
    """
    before = ordered(doc, order).rowsBetween(Window.unboundedPreceding, -1)
    out = df
    for k in levels:
        out = out.withColumn(f"_last{k}", F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(before))
    open_ = []
    for k in levels:
        alive = F.col(level) > k
        for lower in [x for x in levels if x < k]:
            alive = alive & (F.coalesce(F.col(f"_last{k}") > F.col(f"_last{lower}"), F.col(f"_last{k}").isNotNull()))
        open_.append(F.when(alive, F.col(f"_last{k}")))
    found = F.sort_array(F.array_compact(F.array(*open_)), asc=False)
    return out.select(doc, order, F.posexplode(found).alias("depth", "ancestor")).select(doc, order, "ancestor", (F.col("depth") + 1).cast("long").alias("depth"))


def islands(df: DataFrame, doc: str, order: str | list[str], starts: Column, name: str = "island") -> DataFrame:
    """Adds the number of the run that a row is in; a run starts wherever `starts` holds."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(ordered(doc, order).rowsBetween(Window.unboundedPreceding, 0)))


def changes(column: str, doc: str, order: str | list[str]) -> Column:
    """Whether a value differs from the row before."""
    return ~F.col(column).eqNullSafe(F.lag(column).over(ordered(doc, order)))


def first_of(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def disambiguated(df: DataFrame, candidate: str, order: list) -> DataFrame:
    """Adds node_id: the candidate, with --2, --3 and so on for later rows of the same candidate."""
    n = F.row_number().over(Window.partitionBy(candidate).orderBy(*order))
    return df.withColumn("node_id", F.concat(candidate, F.when(n > 1, F.concat(F.lit("--"), n.cast("string"))).otherwise("")))


#: Kinds of structure by the words that open a designation and title, after definitions and appendices (fixed values).
OPENING = ("book", "part", "subpart", "chapter")
#: Titles of front matter, and the level a kind has by itself (fixed values).
FRONT = ("disclaimer", "note from the editor", "incorporated amendments", "preamble")
LEVELS = {"front_matter": 1, "part": 1, "book": 1, "appendix": 1, "subpart": 2, "definitions": 2, "chapter": 3, "section": 3}


def structure_kind(title: Column, designation: Column | None = None, content_types: Column | None = None) -> Column:
    """Kind of a section by its content types, designation and title."""
    types = F.lower(F.coalesce(content_types, F.lit(""))) if content_types is not None else F.lit("")
    shown = F.concat_ws(" ", F.coalesce(designation, F.lit("")) if designation is not None else F.lit(""), F.coalesce(title, F.lit("")))
    low = F.trim(F.regexp_replace(F.lower(shown), r"(?U)\s+", " "))
    out = F.when(F.contains(types, F.lit("definition")) | low.rlike(r"(?U)\bdefinitions?\b"), "definitions").when(F.contains(types, F.lit("appendix")) | low.rlike(r"(?U)^append(?:ix|ices)\b"), "appendix")
    for kind in OPENING:
        out = out.when(low.rlike(rf"(?U)^{kind}\b"), kind)
    return out.when(low.isin(*FRONT) | F.startswith(low, F.lit("toc ")), "front_matter").otherwise("section")


def structure_level(level: Column, kind: Column) -> Column:
    """A section's own level where it has one beyond the first, else its kind's."""
    own = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    return F.when(level > 1, level).otherwise(F.coalesce(F.try_element_at(own, kind), F.lit(3)))


def nearest(path: Column) -> Column:
    """The last of a path's values, from the root down, that is there."""
    return F.try_element_at(F.filter(path, lambda d: d.isNotNull() & (d != "")), F.lit(-1))


def item_numbers(keys: list[str], order: str, given: Column, start: Column) -> Column:
    """Numbers of a list's items from its start; an item's own number stays."""
    return F.coalesce(given.cast("long"), (start + F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))


def trimmed_edges(keys: list[str], order: str, text: str, plain: Column | None = None) -> Column:
    """A piece of text without white space at the beginning if it is its paragraph's first, at the end if it is the last.

    Where plain is given, pieces for which it does not hold (formatted ones) stay as they are.
    """
    own = Window.partitionBy(*keys)
    may = F.lit(True) if plain is None else F.coalesce(plain, F.lit(False))
    left = F.when(may & (F.col(order) == F.min(order).over(own)), F.regexp_replace(text, r"(?U)^\s+", "")).otherwise(F.col(text))
    return F.when(may & (F.col(order) == F.max(order).over(own)), F.regexp_replace(left, r"(?U)\s+$", "")).otherwise(left)


def flags_beneath(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """Whether any node beneath an ancestor is a table or figure: closure (ancestor, node), nodes (node, node_type)."""
    kinds = nodes.where("node_type in ('table', 'figure')")
    found = closure.join(kinds, "node").groupBy("ancestor")
    return found.agg(F.bool_or(F.col("node_type") == "table").alias("has_table"), F.bool_or(F.col("node_type") == "figure").alias("has_figure"))
