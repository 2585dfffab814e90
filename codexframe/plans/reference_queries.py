"""Reference queries: nations, customers and orders stand for topics at several depths, keys for designations."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexframe.functions.text import base_designation, citations
from codexframe.operators import references as refs
from codexframe.plans.registry import query
from codexframe.sources.tables import table
from codexframe.sources.work import dealt

_ID = "CASE p_partkey % 3 WHEN 0 THEN 'CS-' || p_size || '.' || p_partkey WHEN 1 THEN 'cs ' || p_size || '.' || p_partkey ELSE 'CS-' || p_size || '.' || p_partkey || '(a)(1)' END"


def _wanted(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0")
    own = F.concat(F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"))
    kind = F.col("p_partkey") % 3
    wanted = F.when(kind == 0, F.concat(F.lit("CS-"), own)).when(kind == 1, F.concat(F.lit("cs "), own)).otherwise(F.concat(F.lit("CS-"), own, F.lit("(a)(1)")))
    return part.select("p_partkey", wanted.alias("wanted"))


def _topics(spark, sf_dir):
    name = F.concat(F.lit("CS-"), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").where("p_partkey % 4 <> 1").select(name.alias("name"), F.col("p_partkey").alias("target"))


@query(
    "ref_resolve_fallback",
    f"""WITH w AS (SELECT p_partkey, {_ID} AS wanted FROM part WHERE p_partkey % 5 <> 0),
        t AS (SELECT 'CS-' || p_size || '.' || p_partkey AS name, p_partkey AS target FROM part WHERE p_partkey % 4 <> 1)
        SELECT p_partkey, wanted, coalesce(e.target, n.target, b.target) AS target, (CASE WHEN e.target IS NOT NULL THEN 0 WHEN n.target IS NOT NULL THEN 1 WHEN b.target IS NOT NULL THEN 2 END)::BIGINT AS step
        FROM w LEFT JOIN t e ON e.name = wanted LEFT JOIN t n ON n.name = replace(upper(wanted), ' ', '-')
        LEFT JOIN t b ON b.name = regexp_replace(wanted, '(\\([A-Za-z0-9]+\\))+$', '') AND wanted LIKE '%)'""",
)
def ref_resolve_fallback(spark, sf_dir):
    wanted = F.col("wanted")
    hyphened = F.replace(F.upper(wanted), F.lit(" "), F.lit("-"))
    keys = [wanted, hyphened, base_designation(wanted), base_designation(hyphened)]
    found = refs.resolve(_wanted(spark, sf_dir), _topics(spark, sf_dir), keys, "name", "target", "target")
    return found.select("p_partkey", "wanted", "target", F.col("step").cast("long").alias("step"))


@query(
    "ref_resolve_all",
    """WITH k AS (SELECT max(p_partkey) AS most FROM part),
        w AS (SELECT p_partkey, p_partkey % 11 = 0 AS beyond, 'CS-' || p_size || '.' || (p_partkey + CASE WHEN p_partkey % 11 = 0 THEN most ELSE 0 END) AS name FROM part, k)
        SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN name WHEN 1 THEN replace(lower(name), '-', ' ') ELSE name || '(a)(1)' END AS wanted,
        CASE WHEN NOT beyond THEN p_partkey END AS target, (CASE WHEN NOT beyond THEN p_partkey % 3 END)::BIGINT AS step FROM w""",
)
def ref_resolve_all(spark, sf_dir):
    """Every part's reference against every part; each eleventh names a key beyond the table and stays unresolved."""
    part, wanted, kind = table(spark, sf_dir, "part"), F.col("wanted"), F.col("p_partkey") % 3
    most = part.agg(F.max("p_partkey").alias("most"))  # one row
    key = F.col("p_partkey") + F.when(F.col("p_partkey") % 11 == 0, F.col("most")).otherwise(0)
    own = F.concat(F.col("p_size").cast("string"), F.lit("."), key.cast("string"))
    given = F.when(kind == 0, F.concat(F.lit("CS-"), own)).when(kind == 1, F.concat(F.lit("cs "), own)).otherwise(F.concat(F.lit("CS-"), own, F.lit("(a)(1)")))
    name = F.concat(F.lit("CS-"), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"))
    topics = part.select(name.alias("name"), F.col("p_partkey").alias("target"))
    hyphened = F.replace(F.upper(wanted), F.lit(" "), F.lit("-"))
    keys = [wanted, hyphened, base_designation(wanted), base_designation(hyphened)]
    found = refs.resolve(part.join(F.broadcast(most)).select("p_partkey", given.alias("wanted")), topics, keys, "name", "target", "target")
    return found.select("p_partkey", "wanted", "target", F.col("step").cast("long").alias("step"))


@query("refs_unresolved", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def refs_unresolved(spark, sf_dir):
    return refs.unresolved(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey")


@query(
    "ref_degree",
    """WITH e AS (SELECT 'o' || l_orderkey AS s, 'p' || l_partkey AS t FROM lineitem),
       u AS (SELECT s AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT t, 0, 1 FROM e)
       SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM u GROUP BY node""",
)
def ref_degree(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("s"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("t"))
    return refs.degrees(edges, "s", "t")


@query("refs_dedup", "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def refs_dedup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query(
    "citation_detect",
    """WITH t AS (SELECT p_partkey, 'See CS-' || p_size || '.' || (p_partkey + 1) || ', AMC CS-' || p_size || '.' || p_partkey || '(b) and X/CS-9.9; CS-' || p_size || '.' || p_partkey || '.' AS text FROM part)
       SELECT p_partkey, unnest(regexp_extract_all(' ' || text, '[^\\w./-]((?:(?:AMC|GM) )?CS-[0-9A-Z]+\\.[0-9]+(?:\\([a-z0-9]+\\))*)', 1)) AS citation FROM t
       EXCEPT SELECT p_partkey, 'CS-' || p_size || '.' || p_partkey FROM part""",
)
def citation_detect(spark, sf_dir):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    text = F.concat(F.lit("See CS-"), size, F.lit("."), (key + 1).cast("string"), F.lit(", AMC CS-"), size, F.lit("."), key.cast("string"), F.lit("(b) and X/CS-9.9; CS-"), size, F.lit("."), key.cast("string"), F.lit("."))
    own = F.concat(F.lit("CS-"), size, F.lit("."), key.cast("string"))
    found = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", own.alias("own"), F.explode(citations(text)).alias("citation"))
    return found.where("citation <> own").select("p_partkey", "citation").distinct()


@query(
    "citation_forms",
    """WITH p AS (SELECT p_partkey, p_partkey::VARCHAR AS k FROM part)
       SELECT p_partkey, unnest(['CS-23.' || k, 'CS-VLA.' || k, 'AMC VLA ' || k || '(c)', 'AMC1 CS-23.' || k || '(a)(1)', 'GM2 CS-LSA.' || k, 'GM CS-23.' || k]) AS citation FROM p""",
)
def citation_forms(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    shown = ("CS 23.", " and CS-VLA ", " (see AMC VLA ", "(c)), AMC1 CS-23.", "(a)(1); GM2 CS LSA ", "; GM CS 23.", ", cs 23.1, X/CS-9.")
    parts = [c for words in shown for c in (F.lit(words), key)]
    return dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.explode(citations(F.concat(*parts))).alias("citation"))


@query("citation_overlap")
def citation_overlap(spark, sf_dir):
    spans = F.array(
        F.struct(F.lit(0).alias("start"), (F.col("p_size") % 7 + 1).alias("end")),
        F.struct((F.col("p_size") % 5).alias("start"), (F.col("p_size") % 5 + 6).alias("end")),
        F.struct((F.col("p_size") % 11 + 3).alias("start"), (F.col("p_size") % 11 + 5).alias("end")),
    )
    kept = refs.without_overlaps(spans)
    shown = F.array_join(F.transform(kept, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", shown.alias("spans"))


@query(
    "relation_pairs",
    """SELECT DISTINCT material, requirement FROM (SELECT l_partkey AS material, l_suppkey AS requirement FROM lineitem WHERE l_returnflag = 'R'
       UNION ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT p_partkey, p_size::BIGINT FROM part)""",
)
def relation_pairs(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    pair = [F.col("l_partkey").alias("material"), F.col("l_suppkey").alias("requirement")]
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("material"), F.col("p_size").cast("long").alias("requirement"))
    return line.where("l_returnflag = 'R'").select(*pair).unionByName(line.where("l_quantity > 40").select(*pair)).unionByName(named).distinct()


@query(
    "relation_prefix",
    """WITH c AS (SELECT DISTINCT p_brand || ' ' || p_type AS candidate FROM part), r AS (SELECT p_brand AS requirement, min(p_partkey) AS ord FROM part GROUP BY p_brand)
       SELECT candidate, arg_min(requirement, ord) AS requirement FROM c JOIN r ON starts_with(candidate, requirement)
       AND (length(candidate) = length(requirement) OR NOT regexp_matches(substring(candidate, length(requirement) + 1, 1), '[0-9A-Za-z]')) GROUP BY candidate""",
)
def relation_prefix(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    candidates = part.select(F.concat("p_brand", F.lit(" "), "p_type").alias("candidate")).distinct()
    requirements = part.groupBy(F.col("p_brand").alias("requirement")).agg(F.min("p_partkey").alias("ord"))
    return refs.prefix_matches(candidates, "candidate", requirements, "requirement", "ord")


@query("relation_siblings", "SELECT DISTINCT a.l_partkey, b.l_partkey AS sibling FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey")
def relation_siblings(spark, sf_dir):
    return refs.siblings(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey")


@query("missing_assets", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def missing_assets(spark, sf_dir):
    there = table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return table(spark, sf_dir, "part").join(there, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")
