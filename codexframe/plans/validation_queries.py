"""Validation, version and catalog queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codexframe.functions.text import version_order
from codexframe.functions.versions import version_label, version_slug
from codexframe.plans.registry import query
from codexframe.sources.tables import table

_TAGS = ("p", "h1", "li", "a", "table", "img", "b")


def _times(tag: str):
    return F.size(F.regexp_extract_all(F.col("html"), F.lit(f"<{tag}[ >]"), F.lit(0))).cast("long").alias(f"n_{tag}")


@query("structure_counts", "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '<{t}[ >]')) AS n_{t}" for t in _TAGS) + " FROM pages")
def structure_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *map(_times, _TAGS))


@query(
    "repeated_vs_conflicting",
    """SELECT source || '/' || (n_chars % 50) AS id, count(*) AS n, CASE WHEN count(DISTINCT sha256(text)) = 1 THEN 'repeated' ELSE 'conflicting' END AS state
       FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def repeated_vs_conflicting(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), (F.col("n_chars") % 50).cast("string")).alias("id"), F.sha2("text", 256).alias("body"))
    groups = docs.groupBy("id").agg(F.count("*").alias("n"), (F.min("body") == F.max("body")).alias("same")).where("n > 1")
    return groups.select("id", "n", F.when(F.col("same"), "repeated").otherwise("conflicting").alias("state"))


@query("repeat_summary", "SELECT count(*) AS texts, coalesce(sum(n), 0)::BIGINT AS occurrences FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def repeat_summary(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("body")).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"))


@query(
    "topic_reconciliation",
    """SELECT o_orderstatus, count(*) AS declared, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS parsed FROM orders GROUP BY o_orderstatus""",
)
def topic_reconciliation(spark, sf_dir):
    parsed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")).distinct()
    both = table(spark, sf_dir, "orders").join(parsed, F.col("o_orderkey") == F.col("key"), "left")
    return both.groupBy("o_orderstatus").agg(F.count("*").alias("declared"), F.count("key").alias("parsed"))


@query("empty_text_count", "SELECT role, count(*) FILTER (trim(text) = '') AS n_empty, count(*) AS n FROM conversations GROUP BY role")
def empty_text_count(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count_if(F.trim("text") == "").alias("n_empty"), F.count("*").alias("n"))


@query(
    "validation_report",
    """WITH d AS (SELECT count(*) AS n_topics, count(DISTINCT doc_id) AS n_ids, count(*) FILTER (text = '') AS n_empty, count(*) FILTER (length(text) <> n_chars) AS n_mismatch FROM documents),
       l AS (SELECT count(*) AS n_dangling FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
       SELECT *, n_topics = n_ids AND n_mismatch = 0 AND n_dangling = 0 AS ok FROM d, l""",
)
def validation_report(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    one = docs.agg(F.count("*").alias("n_topics"), F.count_distinct("doc_id").alias("n_ids"), F.count_if(F.col("text") == "").alias("n_empty"), F.count_if(F.length("text") != F.col("n_chars")).alias("n_mismatch"))
    dangling = labels.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("n_dangling"))
    ok = (F.col("n_topics") == F.col("n_ids")) & (F.col("n_mismatch") == 0) & (F.col("n_dangling") == 0)
    return one.join(F.broadcast(dangling)).withColumn("ok", ok)  # one row each


@query(
    "line_statistics",
    """SELECT doc_id, len(lines) AS n_lines, len(list_filter(lines, lambda x: trim(x) <> '')) AS n_text, len(list_filter(lines, lambda x: contains(x, ' | '))) AS n_table FROM
       (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)""",
)
def line_statistics(spark, sf_dir):
    lines = F.split("text", "\n")
    number = lambda test: F.size(F.filter(lines, test)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), number(lambda x: F.trim(x) != "").alias("n_text"), number(lambda x: F.contains(x, F.lit(" | "))).alias("n_table"))


@query("integrity_sha256", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size FROM documents")
def integrity_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@query("latest_version_argmax", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_version_argmax(spark, sf_dir):
    last = F.max_by(F.struct("event_id", "event_type", "value"), "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last.alias("e")).select("user_id", "e.event_id", "e.event_type", "e.value")


_LABELS = "CASE p_partkey % 5 WHEN 0 THEN 'Initial Issue' WHEN 1 THEN 'Amendment ' || p_size WHEN 2 THEN 'Amdt ' || p_size WHEN 3 THEN 'Issue ' || p_size || ' & Revision ' || p_partkey ELSE 'Revision ' || p_size END"


def _labels(spark, sf_dir):
    size = F.col("p_size").cast("string")
    kinds = [F.lit("Initial Issue"), F.concat(F.lit("Amendment "), size), F.concat(F.lit("Amdt "), size), F.concat(F.lit("Issue "), size, F.lit(" & Revision "), F.col("p_partkey").cast("string")), F.concat(F.lit("Revision "), size)]
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.element_at(F.array(*kinds), (F.col("p_partkey") % 5 + 1).cast("int")).alias("given"))


@query(
    "version_label_slug",
    f"""WITH g AS (SELECT p_partkey, p_size, {_LABELS} AS given FROM part)
        SELECT p_partkey, given, CASE p_partkey % 5 WHEN 0 THEN 'Initial Issue' WHEN 1 THEN 'Amendment ' || p_size WHEN 2 THEN 'Amendment ' || p_size WHEN 3 THEN 'Issue ' || p_size ELSE 'Revision ' || p_size END AS label,
        CASE p_partkey % 5 WHEN 0 THEN 'initial-issue' WHEN 1 THEN 'amendment-' || p_size WHEN 2 THEN 'amdt-' || p_size WHEN 3 THEN 'issue-' || p_size || '-and-revision-' || p_partkey ELSE 'revision-' || p_size END AS slug FROM g""",
)
def version_label_slug(spark, sf_dir):
    return _labels(spark, sf_dir).select("p_partkey", "given", version_label(F.col("given")).alias("label"), version_slug(F.col("given")).alias("slug"))


@query(
    "version_sort_key",
    f"""WITH g AS (SELECT p_partkey, p_brand, {_LABELS} AS given FROM part)
        SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY list_transform(regexp_extract_all(given, '[0-9]+'), lambda x: x::INTEGER) DESC, p_partkey) AS newest FROM g""",
)
def version_sort_key(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.desc(version_order(F.col("given"))), "p_partkey")
    return _labels(spark, sf_dir).select("p_partkey", "p_brand", F.row_number().over(w).cast("long").alias("newest"))


@query(
    "version_freshness",
    """WITH r AS (SELECT o_custkey, max(o_orderdate) AS latest FROM orders GROUP BY o_custkey), l AS (SELECT o_custkey, max(o_orderdate) AS held FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
       SELECT c_custkey, CASE WHEN latest IS NULL THEN 'unknown' WHEN held IS NULL THEN 'not_cached' WHEN held = latest THEN 'current' ELSE 'outdated' END AS state
       FROM customer LEFT JOIN r ON r.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey""",
)
def version_freshness(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    dates = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("held"))
    state = F.when(F.col("latest").isNull(), "unknown").when(F.col("held").isNull(), "not_cached").when(F.col("held") == F.col("latest"), "current").otherwise("outdated")
    return table(spark, sf_dir, "customer").join(dates, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", state.alias("state"))


@query(
    "alias_lookup",
    """WITH a AS (SELECT lower(n_name) AS alias, n_nationkey, 0 AS p FROM nation UNION ALL SELECT lower(substring(n_name, 1, 3)), n_nationkey, 1 FROM nation),
       b AS (SELECT alias, arg_min(n_nationkey, p * 1000 + n_nationkey) AS n_nationkey FROM a GROUP BY alias)
       SELECT alias, n_nationkey FROM b""",
)
def alias_lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    names = nation.select(F.posexplode(F.array(F.lower("n_name"), F.lower(F.substring("n_name", 1, 3)))).alias("p", "alias"), "n_nationkey")
    return names.groupBy("alias").agg(F.min_by("n_nationkey", F.struct("p", "n_nationkey")).alias("n_nationkey"))


@query("catalog_collision", "SELECT id, count(*) AS n FROM (SELECT lower(p_name) AS id FROM part UNION ALL SELECT lower(p_type) FROM part) GROUP BY id HAVING count(*) > 1")
def catalog_collision(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.lower("p_name").alias("id")).unionByName(part.select(F.lower("p_type").alias("id"))).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@query("exact_version_unique", "SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand, p_size HAVING count(*) = 1")
def exact_version_unique(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("preparation_summary", "SELECT lang, count(*) AS n_topics, count(DISTINCT source) AS n_structures, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang")
def preparation_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_topics"), F.count_distinct("source").alias("n_structures"), F.sum("n_chars").alias("n_chars"))
