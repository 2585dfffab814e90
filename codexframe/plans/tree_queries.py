"""Whole node trees: each order is a document of topics in topics, a numbered list, and a table with a table in a cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexframe.operators import trees
from codexframe.plans.registry import query
from codexframe.sources.tables import table
from codexframe.sources.work import tasks_for

#: A line becomes some dozen nodes, which stay in the task that it is dealt to.
_LINES_A_TASK = 15_000
_LINES = """
l AS (SELECT l_orderkey AS doc, l_partkey::VARCHAR AS part, l_suppkey::VARCHAR AS supp, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
o AS (SELECT o_orderkey AS doc, o_orderpriority AS title, o_orderstatus AS status, o_custkey::VARCHAR AS cust FROM orders WHERE o_orderkey IN (SELECT doc FROM l))
"""


def _order_nodes(spark, sf_dir):
    """Nodes (doc, ord, depth, type, attributes) of all orders that have lines."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc")
    tasks = tasks_for(lines, _LINES_A_TASK)
    line = lines.repartition(tasks, "doc").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"))).alias("lines"))
    both = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), "o_orderpriority", "o_orderstatus", "o_custkey").repartition(tasks, "doc").join(line.hint("merge"), "doc")
    kind = "struct<depth:int,type:string,designation:string,title:string,erules_id:string,ordered:boolean,header:boolean,text:string>"

    def node(depth, name, designation=None, title=None, erules_id=None, ordered=None, header=None, text=None):
        values = (F.lit(depth), F.lit(name), designation, title, erules_id, F.lit(ordered), F.lit(header), text)
        return F.struct(*(F.lit(None) if v is None else v for v in values)).cast(kind)

    def cell(depth, *inner):
        return [node(depth, "cell"), *inner]

    def words(depth, text):
        return [node(depth, "paragraph"), node(depth + 1, "text", text=text)]

    name = F.col("doc").cast("string")
    head = F.array(
        node(0, "document", title=name), node(1, "requirement", F.concat(F.lit("O-"), name), F.col("o_orderpriority"), F.col("o_orderstatus")), *words(2, F.concat(F.lit("Order of customer "), F.col("o_custkey").cast("string"))),
        node(2, "guidance", F.concat(F.lit("G-"), name), F.col("o_orderstatus")), node(3, "list", ordered=True),
    )
    items = F.flatten(F.transform("lines", lambda x: F.array(node(4, "list_item"), node(5, "text", text=F.concat(x["l_returnflag"], F.lit(" & "), x["l_partkey"].cast("string"))))))
    titles = F.array(node(3, "table"), node(4, "row", header=True), *cell(5, *words(6, F.lit("part"))), *cell(5, *words(6, F.lit("more"))))

    def row(x, i):
        number, supplier = x["l_partkey"].cast("string"), x["l_suppkey"].cast("string")
        nested = F.array(node(6, "table"), node(7, "row"), *cell(8, *words(9, supplier)))
        plain = F.array(node(6, "paragraph"), node(7, "bold"), node(8, "text", text=supplier))
        return F.concat(F.array(node(4, "row"), *cell(5, *words(6, number)), *cell(5)), F.when(i == 0, nested).otherwise(plain))

    every = F.concat(head, items, titles, F.flatten(F.transform("lines", row)))
    return both.select("doc", F.posexplode(every).alias("ord", "n")).select("doc", F.col("ord").cast("long").alias("ord"), "n.*")


_NESTED = "'<table><tbody><tr><td>' || supp || '</td></tr></tbody></table>'"


@query(
    "tree_markdown",
    f"""WITH {_LINES} SELECT doc, '# O-' || doc || ': ' || any_value(title) || chr(10) || chr(10) || '**ERules ID:** ' || any_value(status) || chr(10) || chr(10) || 'Order of customer ' || any_value(cust) || chr(10) || chr(10)
        || '## G-' || doc || ': ' || any_value(status) || chr(10) || chr(10) || string_agg(i || '. ' || flag || ' & ' || part || chr(10), '' ORDER BY i)
        || '| part | more |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || part || ' | ' || CASE WHEN i = 1 THEN {_NESTED} ELSE '**' || supp || '**' END || ' |' || chr(10), '' ORDER BY i) || chr(10) AS body FROM o JOIN l USING (doc) GROUP BY doc""",
)
def tree_markdown(spark, sf_dir):
    return trees.markdown(_order_nodes(spark, sf_dir), ["doc"])


@query(
    "tree_html",
    f"""WITH {_LINES} SELECT doc, '<section class="requirement" id="O-' || doc || '"><h2>O-' || doc || ': ' || any_value(title) || '</h2><p class="erules-id"><strong>ERules ID:</strong> ' || any_value(status) || '</p><p>Order of customer ' || any_value(cust)
        || '</p><section class="guidance" id="G-' || doc || '"><h3>G-' || doc || ': ' || any_value(status) || '</h3><ol>' || string_agg('<li>' || flag || ' &amp; ' || part || '</li>', '' ORDER BY i)
        || '</ol><table><thead><tr><th>part</th><th>more</th></tr></thead><tbody>' || string_agg('<tr><td>' || part || '</td><td>' || CASE WHEN i = 1 THEN {_NESTED} ELSE '<strong>' || supp || '</strong>' END || '</td></tr>', '' ORDER BY i)
        || '</tbody></table></section></section>' AS body FROM o JOIN l USING (doc) GROUP BY doc""",
)
def tree_html(spark, sf_dir):
    return trees.html(_order_nodes(spark, sf_dir), ["doc"])


_NODE = lambda kind: f"""{{"type":"{kind}","id":null,"metadata":{{}}"""
_TEXT = lambda c: f"""'{_NODE('text')},"text":"' || {c} || '"}}'"""
_PARAGRAPH = lambda c: f"""'{_NODE('paragraph')},"text":"' || {c} || '","children":[' || {_TEXT(c)} || ']}}'"""
_INNER = f"""'{_NODE('table')},"caption":null,"headers":[],"rows":[[[' || {_PARAGRAPH('supp')} || ']]]}}'"""
_BOLD = f"""'{_NODE('paragraph')},"text":"' || supp || '","children":[{_NODE('bold')},"text":null,"children":[' || {_TEXT('supp')} || ']}}]}}'"""


@query(
    "tree_json",
    f"""WITH {_LINES} SELECT doc, '{_NODE('document')},"title":"' || doc || '","children":[{_NODE('requirement')},"designation":"O-' || doc || '","title":"' || any_value(title) || '","erules_id":"' || any_value(status) || '","children":['
        || {_PARAGRAPH("'Order of customer ' || any_value(cust)")} || ',{_NODE('guidance')},"designation":"G-' || doc || '","title":"' || any_value(status) || '","erules_id":null,"children":[{_NODE('list')},"ordered":true,"children":['
        || string_agg('{_NODE('list_item')},"number":null,"children":[' || {_TEXT("flag || ' & ' || part")} || ']}}', ',' ORDER BY i) || ']}},{_NODE('table')},"caption":null,"headers":[[[' || {_PARAGRAPH("'part'")} || '],[' || {_PARAGRAPH("'more'")} || ']]],"rows":['
        || string_agg('[[' || {_PARAGRAPH('part')} || '],[' || CASE WHEN i = 1 THEN {_INNER} ELSE {_BOLD} END || ']]', ',' ORDER BY i) || ']}}]}}]}}]}}' AS body FROM o JOIN l USING (doc) GROUP BY doc""",
)
def tree_json(spark, sf_dir):
    return trees.json(_order_nodes(spark, sf_dir), ["doc"])


@query(
    "tree_files",
    """WITH c AS (SELECT c_nationkey AS doc, c_custkey AS k, c_name, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 100 ORDER BY c_custkey) AS i, c_custkey // 100 AS block FROM customer),
       p AS (SELECT doc, block, k, i, c_name, CASE WHEN i % 3 = 0 THEN 'sections/s-' ELSE 'rules/r-' END || k || '.md' AS path, CASE WHEN i % 3 = 0 THEN 'S ' ELSE 'R ' END || k AS d FROM c),
       q AS (SELECT *, lag(path) OVER w AS before, lag(d) OVER w AS last FROM p WINDOW w AS (PARTITION BY doc, block ORDER BY k))
       SELECT doc, block, path, CASE WHEN i % 3 = 0 THEN '### ' ELSE '# ' END || d || ': ' || c_name || chr(10) || chr(10) || CASE WHEN last IS NULL THEN 'See [[none]]' ELSE 'See [' || last || '](' || before || ')' END || chr(10) || chr(10)
              || CASE WHEN i % 3 = 0 THEN '#### ' ELSE '## ' END || 'N: nested' || chr(10) || chr(10) || '- held' || chr(10) AS content FROM q
       UNION ALL SELECT doc, block, 'index.md', '# Nation ' || doc || chr(10) || chr(10) || '## Contents' || chr(10) || chr(10) || 'Outside ' || block || chr(10) || chr(10) || string_agg('- [' || d || ': ' || c_name || '](' || path || ')' || chr(10), '' ORDER BY k) AS content FROM q GROUP BY doc, block""".replace("[[none]]", "[none]"),
)
def tree_files(spark, sf_dir):
    """Files of documents of a nation and a hundred customer keys: a topic a customer, which refers to the one before it, with a topic and a list in it."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), F.floor(F.col("c_custkey") / 100).alias("block"), F.col("c_custkey").alias("k"), "c_name")
    each = customer.groupBy("doc", "block").agg(F.sort_array(F.collect_list(F.struct("k", "c_name"))).alias("held"))  # a hundred at most
    kind = "struct<depth:int,type:string,designation:string,title:string,level:int,text:string,target_designation:string>"

    def node(depth, name, designation=None, title=None, level=None, text=None, target=None):
        return F.struct(*(F.lit(None) if v is None else v if not isinstance(v, (int, str)) else F.lit(v) for v in (depth, name, designation, title, level, text, target))).cast(kind)

    name = lambda x, i: F.concat(F.when((i + 1) % 3 == 0, "S ").otherwise("R "), x["k"].cast("string"))

    def topic(x, i):
        before = F.when(i > 0, name(F.get("held", i - 1), i - 1)).otherwise("none")
        return F.array(
            node(1, F.when((i + 1) % 3 == 0, "section").otherwise("requirement"), name(x, i), x["c_name"], 2), node(2, "paragraph"), node(3, "text", text="See "), node(3, "internal_reference", text=before, target=before),
            node(2, "guidance", "N", "nested"), node(3, "list"), node(4, "list_item"), node(5, "text", text="held"),
        )

    start = F.array(node(0, "document", title=F.concat(F.lit("Nation "), F.col("doc").cast("string"))), node(1, "paragraph"), node(2, "text", text=F.concat(F.lit("Outside "), F.col("block").cast("string"))))
    nodes = each.select("doc", "block", F.posexplode(F.concat(start, F.flatten(F.transform("held", topic)))).alias("ord", "n")).select("doc", "block", F.col("ord").cast("long").alias("ord"), "n.*")
    return trees.files(nodes, ["doc", "block"])
