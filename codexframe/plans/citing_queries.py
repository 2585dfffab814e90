"""References of texts: parts of a brand and a block of keys are topics that cite the next part, in runs cut within designations."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexframe.operators import reference_index as ri
from codexframe.operators import trees
from codexframe.plans.registry import query
from codexframe.sources.tables import table
from codexframe.sources.work import shared_path, tasks_for

_KEYS = ["brand", "block"]
#: A part becomes a dozen nodes, which stay in the task that it is dealt to.
_PARTS_A_TASK = 15_000
#: Topics of the same document, with the key of the next one (the last one's is 9 digits of nines).
_TOPICS = "p AS (SELECT p_brand AS brand, p_partkey // 1000 AS block, p_partkey AS k, coalesce(lead(p_partkey) OVER (PARTITION BY p_brand, p_partkey // 1000 ORDER BY p_partkey), 999999999) AS next FROM part)"


def _nodes(spark, sf_dir):
    """Nodes of documents of a brand and a thousand keys: heading and paragraph a part."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.floor(F.col("p_partkey") / 1000).alias("block"), F.col("p_partkey").alias("k"))
    part = part.repartition(tasks_for(part, _PARTS_A_TASK), *_KEYS)
    each = part.groupBy(*_KEYS).agg(F.sort_array(F.collect_list("k")).alias("held"))  # a thousand at most
    kind = "struct<depth:int,type:string,node_id:string,designation:string,title:string,erules_id:string,text:string>"

    def node(depth, name, **values):
        own = [F.lit(depth), F.lit(name), *(values.get(c, F.lit(None)) for c in ("node_id", "designation", "title", "erules_id", "text"))]
        return F.struct(*(v if not isinstance(v, str) else F.lit(v) for v in own)).cast(kind)

    def topic(k, i):
        own, after = k.cast("string"), F.coalesce(F.get("held", i + 1), F.lit(999999999)).cast("string")
        name = F.concat(F.lit("CS-23."), own)
        return F.array(
            node(1, "requirement", node_id=F.concat(F.lit("n"), own), designation=name, title="T", erules_id=F.concat(F.lit("E"), own)), node(2, "heading"), node(3, "text", text=F.concat(F.lit("CS-23."), after)),
            node(2, "paragraph"), node(3, "text", text="See CS"), node(3, "text", text=F.concat(F.lit("-23."), after, F.lit("(a)(1), "))), node(3, "text", text=F.concat(name, F.lit(" and AMC1 CS "))),
            node(3, "text", text=F.concat(F.lit("23."), after, F.lit("."))), node(3, "bold"), node(4, "text", text=F.concat(F.lit("cs-23."), after, F.lit(" CS 23."), after)),
        )

    start = F.array(node(0, "document", title=F.col("brand")))
    flat = each.select(*_KEYS, F.posexplode(F.concat(start, F.flatten(F.transform("held", topic)))).alias("ord", "n"))
    return flat.select(*_KEYS, F.col("ord").cast("long").alias("ord"), "n.*")


_EDGES = """e AS (SELECT brand, block, k, 'CS-23.' || next || '(a)(1)' AS text, 'CS-23.' || next || '(a)(1)' AS target_designation, CASE WHEN next < 999999999 THEN 'n' || next END AS target_id FROM p
       UNION ALL SELECT brand, block, k, 'AMC1 CS 23.' || next, 'AMC1 CS-23.' || next, NULL FROM p
       UNION ALL SELECT brand, block, k, 'CS 23.' || next, 'CS-23.' || next, CASE WHEN next < 999999999 THEN 'n' || next END FROM p)"""


@query("reference_index", f"WITH {_TOPICS}, {_EDGES} SELECT brand, block, 'n' || k AS source_id, 'CS-23.' || k AS source_designation, text, target_designation, target_id, true AS detected FROM e")
def reference_index(spark, sf_dir):
    """All references of running text, with the topics that they come from and lead to."""
    found = ri.reference_index(ri.detected(_nodes(spark, sf_dir), _KEYS), _KEYS)
    return found.drop("ord", "source_ord", "target_ord")


@query(
    "references_parsed",
    f"""WITH {_TOPICS} SELECT brand, block, 'n' || k AS source_id, text, target_designation, target_id FROM (
       SELECT brand, block, k, 'CS-23.' || next AS text, 'CS-23.' || next AS target_designation, CASE WHEN next < 999999999 THEN 'n' || next END AS target_id FROM p
       UNION ALL SELECT brand, block, k, 'CS-23.' || k, 'CS-23.' || k, 'n' || k FROM p)""",
)
def references_parsed(spark, sf_dir):
    """References as the body reader finds them: in single runs, also in headings and of a topic to itself, not in bold."""
    found = ri.reference_index(ri.parsed(_nodes(spark, sf_dir), _KEYS), _KEYS)
    return found.select(*_KEYS, "source_id", "text", "target_designation", "target_id")


_stored = {}


def _references(spark, sf_dir):
    own = (spark.sparkContext.applicationId, sf_dir)
    if own not in _stored:
        found = ri.reference_index(ri.detected(_nodes(spark, sf_dir), _KEYS), _KEYS)
        _stored[own] = ri.store(spark, found, _KEYS, shared_path(spark, "references"))
    return _stored[own]


@query(
    "reference_context",
    f"""WITH {_TOPICS}, {_EDGES} SELECT k AS rule, 'outgoing' AS side, 'n' || k AS source_id, target_designation, target_id FROM e WHERE brand = 'Brand#13'
       UNION ALL SELECT substr(target_id, 2)::BIGINT, 'incoming', 'n' || k, target_designation, target_id FROM e WHERE brand = 'Brand#13' AND target_id IS NOT NULL""",
)
def reference_context(spark, sf_dir):
    """What every rule of one brand refers to, and what refers to it, from stored references."""
    stored = _references(spark, sf_dir)
    rules = stored.edges().where("brand = 'Brand#13'").select(*_KEYS, F.col("source_ord").alias("ord"), F.substring("source_id", 2, 30).cast("long").alias("rule")).distinct()
    return stored.context(rules, "rule").select("rule", "side", "source_id", "target_designation", "target_id")


@query(
    "reference_files",
    f"""WITH {_TOPICS} SELECT brand, block, 'rules/cs-23-' || k || '.md' AS path, '# CS-23.' || k || ': T' || chr(10) || chr(10) || '**ERules ID:** E' || k || chr(10) || chr(10) || '## CS-23.' || next || chr(10) || chr(10)
       || 'See CS-23.' || next || '(a)(1), CS-23.' || k || ' and AMC1 CS 23.' || next || '.**cs-23.' || next || ' ' || CASE WHEN next < 999999999 THEN '[CS 23.' || next || '](rules/cs-23-' || next || '.md)' ELSE 'CS 23.' || next END || '**' || chr(10) || chr(10) AS content FROM p""",
)
def reference_files(spark, sf_dir):
    """Files of documents split by topic, where citations that name a file's topic link to it."""
    return trees.files(ri.detected(_nodes(spark, sf_dir), _KEYS), _KEYS).where("path <> 'index.md'")
