"""Order and hierarchy queries: a conversation stands for a document, its roles for levels 1, 2 and 3."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codexframe.operators import navigation as nav
from codexframe.operators import nesting
from codexframe.plans.registry import query
from codexframe.sources.tables import table

LEVELS = [1, 2, 3]
_LEVEL = "CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END"
_OPEN = f"""
r AS (SELECT conv_id, turn, role, {_LEVEL} AS level FROM conversations),
l AS (SELECT *, max(CASE WHEN level = 1 THEN turn END) OVER w AS l1, max(CASE WHEN level = 2 THEN turn END) OVER w AS l2
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, CASE WHEN level > 1 THEN l1 END AS a1, CASE WHEN level > 2 AND (l1 IS NULL OR l2 > l1) THEN l2 END AS a2 FROM l)
"""


def _turns(spark, sf_dir):
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return table(spark, sf_dir, "conversations").withColumn("level", level)


@query("outline_preorder", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM conversations")
def outline_preorder(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.row_number().over(nav.ordered("conv_id", "turn")).cast("long").alias("ordinal"))


@query("outline_level_stack", f"WITH {_OPEN} SELECT conv_id, turn, level::BIGINT AS level, greatest(a1, a2) AS parent FROM a")
def outline_level_stack(spark, sf_dir):
    found = nav.level_parents(_turns(spark, sf_dir), "conv_id", "turn", "level", LEVELS)
    return found.select("conv_id", "turn", F.col("level").cast("long").alias("level"), F.col("parent").cast("long").alias("parent"))


@query(
    "ancestor_closure",
    f"""WITH {_OPEN}, u AS (SELECT conv_id, turn, a1 AS ancestor FROM a WHERE a1 IS NOT NULL UNION ALL SELECT conv_id, turn, a2 FROM a WHERE a2 IS NOT NULL)
        SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ancestor DESC) AS depth FROM u""",
)
def ancestor_closure(spark, sf_dir):
    return nav.ancestors(_turns(spark, sf_dir), "conv_id", "turn", "level", LEVELS)


@query("breadcrumb_path", f"WITH {_OPEN} SELECT conv_id, turn, concat_ws(' > ', a1, a2) AS path FROM a WHERE a1 IS NOT NULL OR a2 IS NOT NULL")
def breadcrumb_path(spark, sf_dir):
    closure = nav.ancestors(_turns(spark, sf_dir), "conv_id", "turn", "level", LEVELS)
    path = F.array_join(F.transform(F.sort_array(F.collect_list("ancestor")), lambda x: x.cast("string")), " > ")
    return closure.groupBy("conv_id", "turn").agg(path.alias("path"))


@query("prev_next_topic", "SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def prev_next_topic(spark, sf_dir):
    w = nav.ordered("conv_id", "turn")
    return _turns(spark, sf_dir).select("conv_id", "turn", F.lag("turn").over(w).alias("previous"), F.lead("turn").over(w).alias("next"))


@query(
    "front_matter_bucket",
    """SELECT conv_id, turn, CASE WHEN count(*) FILTER (role = 'system') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) = 0
       THEN 'front_matter' ELSE 'body' END AS bucket FROM conversations""",
)
def front_matter_bucket(spark, sf_dir):
    seen = F.count(F.when(F.col("role") == "system", 1)).over(nav.ordered("conv_id", "turn").rowsBetween(Window.unboundedPreceding, 0))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.when(seen == 0, "front_matter").otherwise("body").alias("bucket"))


@query(
    "inherited_designation",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN 'U-' || turn END IGNORE NULLS) OVER
       (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS designation FROM conversations""",
)
def inherited_designation(spark, sf_dir):
    own = F.when(F.col("role") == "user", F.concat(F.lit("U-"), F.col("turn").cast("string")))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.last(own, ignorenulls=True).over(nav.ordered("conv_id", "turn").rowsBetween(Window.unboundedPreceding, 0)).alias("designation"))


@query(
    "list_islands_numbering",
    """WITH i AS (SELECT *, sum(CASE WHEN role IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS island
       FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations))
       SELECT conv_id, turn, island, row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) AS number FROM i""",
)
def list_islands_numbering(spark, sf_dir):
    runs = nav.islands(_turns(spark, sf_dir).withColumn("starts", nav.changes("role", "conv_id", "turn")), "conv_id", "turn", F.col("starts"))
    number = F.row_number().over(Window.partitionBy("conv_id", "island").orderBy("turn")).cast("long")
    return runs.select("conv_id", "turn", F.col("island").cast("long").alias("island"), number.alias("number"))


@query(
    "rowspan_islands",
    """WITH i AS (SELECT l_orderkey, l_linenumber, sum(CASE WHEN l_returnflag IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)::BIGINT AS island
       FROM (SELECT *, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_partkey, l_suppkey, l_extendedprice) AS p FROM lineitem))
       SELECT l_orderkey, island, min(l_linenumber)::BIGINT AS first_row, count(*) AS rowspan FROM i GROUP BY l_orderkey, island""",
)
def rowspan_islands(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_extendedprice")
    order = ["l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_extendedprice"]  # line numbers repeat
    runs = nav.islands(rows.withColumn("starts", nav.changes("l_returnflag", "l_orderkey", order)), "l_orderkey", order, F.col("starts"))
    return runs.groupBy("l_orderkey", F.col("island").cast("long").alias("island")).agg(F.min("l_linenumber").cast("long").alias("first_row"), F.count("*").alias("rowspan"))


@query(
    "adjacent_dedup",
    """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
       WHERE event_type IS DISTINCT FROM p""",
)
def adjacent_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("starts", nav.changes("event_type", "user_id", "event_id"))
    return rows.where("starts").select("event_id", "user_id", "event_type")


@query(
    "run_merge",
    """WITH i AS (SELECT *, sum(CASE WHEN event_type IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island
       FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events))
       SELECT user_id, island, any_value(event_type) AS event_type, string_agg(event_id::VARCHAR, '+' ORDER BY event_id) AS merged FROM i GROUP BY user_id, island""",
)
def run_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("starts", nav.changes("event_type", "user_id", "event_id"))
    runs = nav.islands(rows, "user_id", "event_id", F.col("starts"))
    merged = F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), "+")
    return runs.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.first("event_type").alias("event_type"), merged.alias("merged"))


@query("first_wins", "SELECT p_brand, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_brand")
def first_wins(spark, sf_dir):
    return nav.first_of(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"]).select("p_brand", "p_partkey", "p_name")


@query("last_wins", "SELECT p_brand, max(p_partkey) AS p_partkey, arg_max(p_name, p_partkey) AS p_name FROM part GROUP BY p_brand")
def last_wins(spark, sf_dir):
    return nav.first_of(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_partkey")]).select("p_brand", "p_partkey", "p_name")


@query(
    "id_disambiguation",
    """SELECT p_partkey, replace(p_name, ' ', '-') || CASE WHEN n > 1 THEN '--' || n ELSE '' END AS node_id FROM
       (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""",
)
def id_disambiguation(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("candidate", F.replace("p_name", F.lit(" "), F.lit("-")))
    return nav.disambiguated(rows, "candidate", ["p_partkey"]).select("p_partkey", "node_id")


@query("figure_numbering", "SELECT l_orderkey, l_linenumber, 'order-' || l_orderkey || '-figure-' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS figure FROM lineitem")
def figure_numbering(spark, sf_dir):
    n = F.row_number().over(nav.ordered("l_orderkey", "l_linenumber"))
    name = F.concat(F.lit("order-"), F.col("l_orderkey").cast("string"), F.lit("-figure-"), n.cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", name.alias("figure"))


_KINDS = (("Subpart ", "subpart"), ("BOOK ", "book"), ("Appendix ", "appendix"), ("Chapter ", "chapter"), ("Part ", "part"), ("Definitions ", "definitions"), ("General ", "section"), ("Toc ", "front_matter"))


@query(
    "structure_classify",
    f"""SELECT page_id, list_extract([{', '.join(f"'{w}'" for w, _ in _KINDS)}], (page_id % {len(_KINDS)} + 1)::INTEGER) || page_id AS title,
        list_extract([{', '.join(f"'{k}'" for _, k in _KINDS)}], (page_id % {len(_KINDS)} + 1)::INTEGER) AS kind FROM pages""",
)
def structure_classify(spark, sf_dir):
    title = F.concat(F.element_at(F.array(*(F.lit(w) for w, _ in _KINDS)), (F.col("page_id") % len(_KINDS) + 1).cast("int")), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title")).withColumn("kind", nav.structure_kind(F.col("title")))


@query("material_category", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'requirement' WHEN o_orderpriority LIKE '2%' THEN 'acceptable_means' WHEN o_orderpriority LIKE '3%' THEN 'guidance' ELSE 'other' END AS category FROM orders")
def material_category(spark, sf_dir):
    first = F.substring("o_orderpriority", 1, 1)
    kind = F.when(first == "1", "requirement").when(first == "2", "acceptable_means").when(first == "3", "guidance").otherwise("other")
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("category"))


_OUTLINE = "o AS MATERIALIZED (SELECT o_orderstatus AS doc, o_orderkey AS place, 1 + floor(o_totalprice)::BIGINT % 50 AS level FROM orders), u AS MATERIALIZED (SELECT *, (SELECT max(b.place) FROM o b WHERE b.doc = o.doc AND b.place < o.place AND b.level < o.level) AS parent FROM o)"


def _outline(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("doc"), F.col("o_orderkey").alias("place"), (1 + F.floor("o_totalprice") % 50).alias("level"))


@query("outline_any_level", f"WITH {_OUTLINE} SELECT doc, place, level, parent FROM u")
def outline_any_level(spark, sf_dir):
    return nesting.parents(_outline(spark, sf_dir), "doc", "place", "level")


@query(
    "outline_trail",
    f"""WITH RECURSIVE {_OUTLINE}, t AS (SELECT doc, place, parent, level::VARCHAR AS trail FROM u
        UNION ALL SELECT t.doc, t.place, u.parent, u.level || ' > ' || t.trail FROM t JOIN u ON u.doc = t.doc AND u.place = t.parent) SELECT doc, place, trail FROM t WHERE parent IS NULL""",
)
def outline_trail(spark, sf_dir):
    found = nesting.open_above(_outline(spark, sf_dir), "doc", "place", "level")
    levels = F.concat(F.transform("path", lambda x: x["level"]), F.array("level"))
    return found.select("doc", "place", F.array_join(F.transform(levels, lambda k: k.cast("string")), " > ").alias("trail"))
