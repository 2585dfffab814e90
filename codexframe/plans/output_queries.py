"""Rendered output, relations, catalogs and checks: parts, orders and lineitems stand for topics, tables and references."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codexframe.operators import catalog, markup
from codexframe.operators import references as refs
from codexframe.plans import package_queries as pkg
from codexframe.plans import registry
from codexframe.plans.registry import query
from codexframe.plans.scalar_queries import forms
from codexframe.sources import bodies, topics
from codexframe.sources.tables import table

_INLINE = [
    (("", "a<{k}", "", "", "", ""), ("a<{k}", "a&lt;{k}")), (("superscript+bold", "{k}", "", "", "", ""), ("**<sup>{k}</sup>**", "<strong><sup>{k}</sup></strong>")), (("italic", "x{k}", "", "", "", ""), ("*x{k}*", "<em>x{k}</em>")),
    (("link", "s", "HTTPS://h/{k}", "", "", ""), ("[s](HTTPS://h/{k})", '<a href="HTTPS://h/{k}">s</a>')), (("link", "s", "javascript:{k}", "", "", ""), ("[s](javascript:{k})", '<span class="external-link-invalid">s</span>')),
    (("reference", "CS 23.{k}", "", "rules/a(b).md", "n1", "t"), ("[CS 23.{k}](rules/a%28b%29.md)", '<a class="internal-ref" data-erules-target-id="n1" data-erules-target-designation="D&amp;{k}">CS 23.{k}</a>')),
    (("reference", "r{k}", "", None, "n{k}", "t"), ("[r{k}](#n{k})", '<a class="internal-ref" data-erules-target-id="n{k}" data-erules-target-designation="D&amp;{k}">r{k}</a>')),
    (("reference", "r{k}", "", None, "", "t"), ("r{k}", '<a class="internal-ref" data-erules-target-designation="D&amp;{k}">r{k}</a>')), (("reference", "r{k}", "", None, "", ""), ("[r{k}]", '<a class="internal-ref" data-erules-target-designation="D&amp;{k}">r{k}</a>')),
    (("break", "", "", "", "", ""), ("\n", "<br/>")),
]
forms(
    "inline_markup", ("markdown", "html"), [((*a, "D&{k}"), b) for a, b in _INLINE],
    lambda kind, text, url, path, at, found, target: (markup.inline_markdown(kind, text, url, path, at, found == "t"), markup.inline_html(kind, text, url, target, at)),
)
forms(
    "citation_segments", ("segments",),
    [(("See CS 23.{k}(a), § 25.1.", "x"), (":See |reference:CS 23.{k}(a)>CS-23.{k}(a)|:, |reference:§ 25.1>14 CFR 25.1|:.",)), (("CS-VLA {k}", "CS-VLA.{k}"), (":CS-VLA {k}",)), (("", "x"), ("",)), (("AMC VLA {k}", "x"), ("reference:AMC VLA {k}>AMC VLA {k}",))],
    lambda text, own: (F.array_join(F.transform(markup.segments(text, own), lambda s: F.concat(s["kind"], F.lit(":"), s["text"], F.coalesce(F.concat(F.lit(">"), s["target"]), F.lit("")))), "|"),),
)
forms(
    "figure_markup", ("markdown", "html"),
    [(("a-({k}).png", "", "Fig <{k}>"), ("![Fig <{k}>](assets/a-%28{k}%29.png)\n*Fig <{k}>*", '<figure><img data-erules-asset="a-({k}).png" alt="Fig &lt;{k}&gt;"/><figcaption>Fig &lt;{k}&gt;</figcaption></figure>')),
     (("../{k}", "Alt", ""), ("![Alt](assets/../{k})", '<figure><img data-erules-asset="" alt="Alt"/></figure>')), (("{k}.png", "", ""), ("![Figure](assets/{k}.png)", '<figure><img data-erules-asset="{k}.png" alt="Figure"/></figure>'))],
    lambda path, alt, caption: (markup.figure_markdown(path, alt, caption), markup.figure_html(path, alt, caption)),
)
_HEAD = '<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="utf-8"/><title>'
forms(
    "html_documents", ("page",),
    [(("T & {k}", "id-{k}", "", "v<1", "<p>{k}</p>"), (_HEAD + 'T &amp; {k}</title></head>\n<body><main class="regulation"><h1>T &amp; {k}</h1><dl class="doc-meta"><dt>ID</dt><dd>id-{k}</dd><dt>Version</dt><dd>v&lt;1</dd></dl><p>{k}</p></main></body>\n</html>\n',)),
     (("", "", "", "", "{k}"), (_HEAD + 'Regulation</title></head>\n<body><main class="regulation"><h1>Regulation</h1>{k}</main></body>\n</html>\n',))],
    lambda *c: (markup.html_document(*c),),
)
_LINK = '<p><a class="matomo_download" href="/d/{k}" title="x.zip" type="application/zip; length={k}">CS-23 <b>Amendment {k}</b> (XML)</a><a href="#top">Top</a><A HREF="/en/downloads/{k}">Issue 2</A><a href="/d/{k}" class="matomo_download">again</a><a href="/plain">no</a></p>'
forms(
    "landing_publications", ("found",),
    [((_LINK, "https://h.org/p/q"), ("https://h.org/d/{k};CS-23 Amendment {k} (XML);Amendment {k};amendment-{k};xml;{k};x.zip|https://h.org/en/downloads/{k};Issue 2;Issue 2;issue-2;other;-;-",)), (("<a href='/x{k}'>none</a>", "https://h.org"), ("",))],
    lambda html, url: (F.lit(None).cast("string"),),
)


def _landing(spark, sf_dir):
    from codexframe.plans.scalar_queries import _column

    pages = table(spark, sf_dir, "part").select("p_partkey", _column([_LINK, "<a href='/x{k}'>none</a>"]).alias("html"), _column(["https://h.org/p/q", "https://h.org"]).alias("url"))
    shown = F.concat_ws(";", "url", "title", "label", "slug", "format", F.coalesce(F.col("size").cast("string"), F.lit("-")), F.coalesce("file", F.lit("-")))
    found = catalog.publications(pages, "p_partkey", "url", "html").groupBy("p_partkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", shown.alias("s")))), lambda x: x["s"]), "|").alias("found"))
    return pages.select("p_partkey").join(found, "p_partkey", "left").select("p_partkey", F.coalesce("found", F.lit("")).alias("found"))


registry.QUERIES["landing_publications"] = _landing

_CELLS = "(SELECT l_orderkey AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS r, l_returnflag || '&' || l_partkey AS a, l_suppkey::VARCHAR AS b FROM lineitem)"
_H = "'<tr><' || g || s || '>' || replace(a, '&', '&amp;') || '</' || g || '><' || g || '>' || b || '</' || g || '></tr>'"


@query(
    "table_markup",
    f"""WITH c AS (SELECT *, CASE WHEN r = 0 THEN 'th' ELSE 'td' END AS g, CASE WHEN r = 0 AND t % 2 = 0 THEN ' rowspan="2"' ELSE '' END AS s FROM {_CELLS}),
        x AS (SELECT t, '<table><caption>Order ' || t || '</caption><thead>' || string_agg(CASE WHEN r = 0 THEN {_H} END, '') || '</thead>' || CASE WHEN count(*) > 1 THEN '<tbody>' || string_agg(CASE WHEN r > 0 THEN {_H} END, '' ORDER BY r) || '</tbody>' ELSE '' END || '</table>' AS html,
              string_agg('| ' || a || ' | ' || b || ' |' || CASE WHEN r = 0 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY r) AS plain FROM c GROUP BY t)
        SELECT t, '**Order ' || t || '**' || chr(10) || chr(10) || CASE WHEN t % 2 = 0 THEN html ELSE plain END AS markdown, html FROM x""",
)
def table_markup(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = line.select(F.col("l_orderkey").alias("t"), (F.row_number().over(order) - 1).alias("row_no"), F.array(F.concat("l_returnflag", F.lit("&"), F.col("l_partkey").cast("string")), F.col("l_suppkey").cast("string")).alias("c"))
    cells = rows.select("t", "row_no", F.posexplode("c").alias("col_no", "text")).withColumn("colspan", F.lit(1))
    spanned = (F.col("row_no") == 0) & (F.col("col_no") == 0) & (F.col("t") % 2 == 0)
    return markup.tables(cells.withColumn("rowspan", F.when(spanned, 2).otherwise(1)), ["t"], F.concat(F.lit("Order "), F.col("t").cast("string")))


_FORM = lambda at: pkg._sql_form(at, "v").removesuffix(" AS v")
_SLUG = "CASE WHEN d <> '' THEN lower(replace(replace(d, '.', '-'), ' ', '-')) WHEN kind = 'section' THEN lower(replace(title, ' ', '-')) ELSE lower(replace(e, ' ', '-')) END"
_FILES = f"""
f AS (SELECT p_brand AS package, p_partkey, {_FORM(1)} AS kind, {_FORM(2)} AS d, {_FORM(3)} AS title, {_FORM(4)} AS e, {_FORM(6)} AS body FROM part),
g AS (SELECT *, CASE WHEN kind = 'section' THEN 'sections/' ELSE 'rules/' END || {_SLUG} || '.md' AS path FROM f)
"""


@query(
    "markdown_files",
    f"""WITH {_FILES} SELECT package, path, CASE WHEN kind = 'section' THEN '##' ELSE '#' END || ' ' || d || ': ' || title || chr(10) || chr(10) || CASE WHEN kind <> 'section' THEN '**ERules ID:** ' || e || chr(10) || chr(10) ELSE '' END ||
        CASE WHEN body = '' THEN '' ELSE replace(body, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) END AS content FROM g
        UNION ALL SELECT package, 'index.md', '# Rules of ' || package || chr(10) || chr(10) || '## Contents' || chr(10) || chr(10) || string_agg('- [' || d || ': ' || title || '](' || replace(replace(path, '(', '%28'), ')', '%29') || ')' || chr(10), '' ORDER BY p_partkey)
        || 'Table 1: of ' || package || chr(10) || chr(10) || 'To sitelost' || chr(10) || chr(10) FROM g GROUP BY package""",
)
def markdown_files(spark, sf_dir):
    """A file for each topic of each brand's publication, and one index a brand with what lies outside topics."""
    parts = pkg.volumes(spark, sf_dir)
    read = bodies.body_nodes(parts)
    nodes = pkg.of_brands(read, "ord", "topic")
    blocks = nodes.where("node_type = 'paragraph' and trim(text) <> ''").select("package", "topic", "ord", F.col("text").alias("markdown"))
    titles = nodes.select("package").distinct().withColumn("title", F.concat(F.lit("Rules of "), "package"))
    found = pkg.of_brands(topics.topics(read, topics.export_metadata(parts)).where("parent is null"), "ord")
    return markup.split_files(found, blocks, ["package"], titles)


@query(
    "preparation_counts",
    """SELECT p_brand AS package, count(*) AS n_outline, count(*) FILTER (p_partkey % 6 <> 4) AS n_navigable, count(*) FILTER (p_partkey % 6 IN (1, 2, 3)) AS n_materials, 1::BIGINT AS n_tables, 1::BIGINT AS n_figures, 2::BIGINT AS n_warnings FROM part GROUP BY p_brand""",
)
def preparation_counts(spark, sf_dir):
    """What is ready of each brand's publication: outline, navigable topics, materials, tables, figures, warnings."""
    parts = pkg.volumes(spark, sf_dir)
    read = bodies.body_nodes(parts)
    nodes = pkg.of_brands(read, "table_no")  # a table of each volume is one of its own
    found = pkg.of_brands(topics.topics(read, topics.export_metadata(parts))).groupBy("package").agg(F.count("*").alias("n_outline"), F.count_if(F.col("kind") != "section").alias("n_navigable"), F.count_if(F.col("kind").isin("acceptable_means", "guidance")).alias("n_materials"))
    drawings = F.sum(F.size(F.filter(F.coalesce("runs", F.array().cast(nodes.schema["runs"].dataType)), lambda r: r["kind"] == "drawing"))).cast("long")
    return found.join(nodes.groupBy("package").agg(F.count_distinct("table_no").alias("n_tables"), drawings.alias("n_figures"), F.count_if(F.col("node_type").isin("unknown", "unhandled", "error")).alias("n_warnings")), "package")


@query(
    "plain_text_topics",
    """WITH e AS (SELECT conv_id, turn * 10 + p AS o, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS t FROM (SELECT conv_id, turn, unnest([0, 1, 2]) AS p, unnest([role, '  ' || role || chr(10), text]) AS t FROM conversations)),
       d AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY o) AS l FROM e WHERE t <> '') SELECT conv_id, string_agg(t, chr(10) ORDER BY o) AS body FROM d WHERE l IS DISTINCT FROM t GROUP BY conv_id""",
)
def plain_text_topics(spark, sf_dir):
    """White space collapsed, repeats of the piece before left out."""
    pieces = F.array("role", F.concat(F.lit("  "), "role", F.lit("\n")), "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(pieces).alias("p", "t")).withColumn("o", F.col("turn") * 10 + F.col("p"))
    return markup.plain_text(rows, ["conv_id"], "o", F.col("t"))


@query("item_json", """SELECT p_partkey, '{"id":"E' || p_partkey || '","rule":"CS-' || p_partkey || '","title":"' || p_name || '","content":["' || p_type || '"],"references":["' || p_brand || '"]}' AS item FROM part""")
def item_json(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    item = markup.item_json(F.lit(""), F.concat(F.lit("E"), key), F.concat(F.lit("CS-"), key), F.col("p_name"), F.array("p_type"), F.array("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", item.alias("item"))


_EDGES = "(SELECT DISTINCT 'o' || l_orderkey AS s, 'p' || l_partkey AS t FROM lineitem)"


@query(
    "reference_lists",
    f"""SELECT coalesce(a.id, b.id) AS node_id, coalesce(a.l, '(none)') AS refers_to, coalesce(b.l, '(none)') AS referred_by FROM
        (SELECT s AS id, string_agg(t, ', ' ORDER BY t) AS l FROM {_EDGES} GROUP BY s) a FULL JOIN (SELECT t AS id, string_agg(s, ', ' ORDER BY s) AS l FROM {_EDGES} GROUP BY t) b ON a.id = b.id""",
)
def reference_lists(spark, sf_dir):
    """Both ends of each reference looked up, by designation or else by id, and the lists of each topic."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    own = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    named = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("CS-"), F.col("l_partkey").cast("string"))).otherwise(own("p", "l_partkey"))
    given = line.select(own("o", "l_orderkey").alias("source"), named.alias("target")).distinct()
    part = line.select(own("p", "l_partkey").alias("node_id"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("CS-"), F.col("l_partkey").cast("string"))).otherwise("").alias("designation"))
    nodes = part.unionByName(line.select(own("o", "l_orderkey").alias("node_id"), F.lit("").alias("designation"))).distinct()
    lists = refs.edge_lists(refs.edges(given, nodes))
    shown = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("(none)")
    return lists.select("node_id", shown("refers_to").alias("refers_to"), shown("referred_by").alias("referred_by"))


@query(
    "reference_trees",
    f"SELECT s AS node_id, s || chr(10) || '├── references → ' || string_agg(t, ', ' ORDER BY t) || chr(10) || '└── referenced-by → (none)' AS tree FROM {_EDGES} GROUP BY s",
)
def reference_trees(spark, sf_dir):
    own = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = table(spark, sf_dir, "lineitem").select(own("o", "l_orderkey").alias("source_id"), own("p", "l_partkey").alias("target_id"))
    lists = refs.edge_lists(edges).where("startswith(node_id, 'o')")
    return lists.select("node_id", markup.reference_tree(F.col("node_id"), F.col("refers_to"), F.col("referred_by")).alias("tree"))


@query("relation_map", "SELECT p_partkey AS material, p_partkey AS requirement FROM part")
def relation_map(spark, sf_dir):
    """Each material tells its requirement in one of four ways."""
    from codexframe.plans.scalar_queries import _column

    part = table(spark, sf_dir, "part")
    requirements = part.select(F.col("p_partkey").alias("requirement"), _column(["CS-VLA.{k}"]).alias("designation"), F.col("p_partkey").alias("ord"))
    materials = part.select(
        F.col("p_partkey").alias("material"), _column(["AMC VLA {k}(c)", "AMC1 CS-VLA.{k}", "GM x", "GM y"]).alias("designation"), _column(["", "", "Notes", ""]).alias("title"),
        F.array_compact(F.array(_column([None, None, "CS-VLA {k} Title of it", None]))).alias("targets"),
    )
    references = part.where("p_partkey % 4 = 3").select(F.col("p_partkey").alias("material"), _column(["cs vla {k}(a)"]).alias("target"))
    return refs.relation_map(materials, requirements, references)


_PUBS = """(SELECT p_brand, p_partkey AS ord, p_name AS title, CASE WHEN p_partkey % 7 = 0 THEN 'Initial issue' WHEN p_partkey % 3 = 0 THEN 'Issue ' || p_size ELSE 'Amendment ' || p_size END AS label,
           CASE WHEN p_partkey % 7 = 0 THEN 'initial-issue' WHEN p_partkey % 3 = 0 THEN 'issue-' || p_size ELSE 'amendment-' || p_size END || '-' || p_partkey AS slug, CASE p_partkey % 4 WHEN 0 THEN 'pdf' ELSE 'xml' END AS format FROM part)"""
_PUB_ORDER = "CASE WHEN label LIKE 'Initial%' THEN 0 ELSE 1 END DESC, CASE WHEN label LIKE 'Amendment%' THEN regexp_extract(label, '[0-9]+')::INTEGER ELSE -1 END DESC, CASE WHEN label LIKE 'Issue%' THEN regexp_extract(label, '[0-9]+')::INTEGER ELSE -1 END DESC, title DESC, slug"


def _publications(spark, sf_dir):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    label = F.when(F.col("p_partkey") % 7 == 0, "Initial issue").when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Issue "), size)).otherwise(F.concat(F.lit("Amendment "), size))
    slug = F.concat(F.when(F.col("p_partkey") % 7 == 0, "initial-issue").when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("issue-"), size)).otherwise(F.concat(F.lit("amendment-"), size)), F.lit("-"), key)
    return table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), label.alias("label"), slug.alias("slug"), F.when(F.col("p_partkey") % 4 == 0, "pdf").otherwise("xml").alias("format"))


@query("publication_newest", f"SELECT p_brand, slug, row_number() OVER w AS place, row_number() OVER w = 1 AS is_latest FROM {_PUBS} WHERE format = 'xml' WINDOW w AS (PARTITION BY p_brand ORDER BY {_PUB_ORDER})")
def publication_newest(spark, sf_dir):
    return catalog.newest_first(_publications(spark, sf_dir).where("format = 'xml'"), ["p_brand"]).select("p_brand", "slug", "place", "is_latest")


@query(
    "publication_selected",
    f"""SELECT 'newest' AS wanted, p_brand, slug FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY {_PUB_ORDER}) AS n FROM {_PUBS} WHERE format = 'xml') WHERE n = 1
        UNION ALL SELECT 'initial', p_brand, slug FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY ord) AS n FROM {_PUBS} WHERE format = 'xml' AND label = 'Initial issue') WHERE n = 1""",
)
def publication_selected(spark, sf_dir):
    pubs = _publications(spark, sf_dir)
    named = lambda wanted, df: df.select(F.lit(wanted).alias("wanted"), "p_brand", "slug")
    return named("newest", catalog.selected(pubs, ["p_brand"])).unionByName(named("initial", catalog.selected(pubs, ["p_brand"], "XML", "Initial Issue")))


@query(
    "version_inventory",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'source_missing' WHEN 1 THEN 'metadata_missing' WHEN 2 THEN 'metadata_unreadable' WHEN 3 THEN 'metadata_missing' WHEN 4 THEN 'ok' ELSE 'mismatch' END AS state,
       CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 4 THEN 7 ELSE strlen(p_name) END::BIGINT AS size FROM part""",
)
def version_inventory(spark, sf_dir):
    kind, source = F.col("p_partkey") % 6, F.encode("p_name", "UTF-8")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(kind != 0, source).alias("source"), (kind != 1).alias("has_meta"), (kind != 2).alias("meta_ok"),
        F.when(kind == 4, F.sha2(source, 256)).when(kind == 3, "").otherwise("x").alias("expected"), F.when(kind == 4, F.lit(7)).cast("long").alias("declared_size"),
    )
    return catalog.inventory(rows, verify=True).select("p_partkey", "state", "size")


@query("largest_entry", "SELECT p_brand, p_name || '.XML' AS name, p_size::BIGINT AS size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name DESC) AS n FROM part WHERE p_partkey % 2 = 0) WHERE n = 1")
def largest_entry(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select("p_brand", F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ".XML").otherwise(".pdf")).alias("name"), F.col("p_size").cast("long").alias("size"))
    return catalog.largest_entry(entries, ["p_brand"])


@query("missing_links", "SELECT 'rules/' || p_partkey || '.md' AS path, 'assets/' || p_partkey || ' (a).png' AS target, true AS is_image FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'rules/' || p_partkey || '.md', 'rules/lost' || p_partkey || '.md', false FROM part")
def missing_links(spark, sf_dir):
    """Local images and links that no file answers: every third image, and a link on every page."""
    from codexframe.plans.scalar_queries import _column

    part = table(spark, sf_dir, "part")
    pages = part.select(_column(["rules/{k}.md"]).alias("path"), _column(["![x](../assets/{k}%20%28a%29.png) [web](https://h/{k}) [here](#a) [other](./{k}.md#b) [gone](lost{k}.md)"]).alias("content"))
    images = part.where("p_partkey % 3 <> 0").select(_column(["assets/{k} (a).png"]).alias("path"))
    return catalog.missing_files(pages, pages.select("path").unionByName(images))


@query("catalog_health", "SELECT p_brand, count(*) FILTER (p_size > 10) AS n_ok, coalesce(string_agg(CASE WHEN p_size <= 10 THEN p_partkey::VARCHAR END, ',' ORDER BY p_partkey::VARCHAR), '') AS not_ok FROM part GROUP BY p_brand")
def catalog_health(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey").cast("string"))
    return catalog.health(rows, ["p_brand"], "id", F.col("p_size") > 10)


@query("catalog_merged", "SELECT 'n' || n_nationkey AS id, n_name AS title FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region")
def catalog_merged(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"))
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("title"))
    return catalog.merged([nation, region], "id")


@query("catalog_convertible", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1 AND n_nationkey % 3 <> 0")
def catalog_convertible(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    entries = nation.select("n_nationkey", F.when(F.col("n_regionkey") == 1, "Faa").otherwise("EASA").alias("authority"), F.when(F.col("n_nationkey") % 3 == 0, F.lit(False)).when(F.col("n_nationkey") % 3 == 1, F.lit(True)).alias("xml_available"))
    return catalog.convertible(entries, "faa").select("n_nationkey")


@query("index_upsert", "SELECT c_custkey, 'new' AS value FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey % 3 <> 0")
def index_upsert(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    third = keys.where("c_custkey % 3 = 0")
    changes = third.unionByName(third.select((-F.col("c_custkey")).alias("c_custkey"))).withColumn("value", F.lit("new"))
    return catalog.upserted(keys.withColumn("value", F.lit("old")), changes, "c_custkey")


@query("unique_ids", "SELECT p_brand, count(DISTINCT nullif(p_name, '')) AS n_ids, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS types FROM part GROUP BY p_brand")
def unique_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_distinct(F.nullif("p_name", F.lit(""))).alias("n_ids"), F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"))


@query(
    "nearest_designation",
    """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'C-' || c_custkey END, CASE WHEN n_nationkey % 2 = 0 THEN 'N-' || n_nationkey END, 'R-' || n_regionkey) AS designation FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def nearest_designation(spark, sf_dir):
    """A topic's designation, else that of its nearest ancestor that has one."""
    from codexframe.operators.navigation import nearest

    customers, nations = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    name = lambda letter, c, given: F.when(given, F.concat(F.lit(letter), F.col(c).cast("string")))
    path = F.array(name("R-", "n_regionkey", F.lit(True)), name("N-", "n_nationkey", F.col("n_nationkey") % 2 == 0), name("C-", "c_custkey", F.col("c_custkey") % 3 == 0))
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", nearest(path).alias("designation"))


@query(
    "list_numbers",
    """SELECT conv_id, turn, coalesce(CASE WHEN turn % 4 = 0 THEN 100 + turn END, 5 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS number FROM conversations""",
)
def list_numbers(spark, sf_dir):
    """Numbers from a list's start; explicit ones stay."""
    from codexframe.operators.navigation import item_numbers

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, F.col("turn") + 100).alias("given"))
    return rows.select("conv_id", "turn", item_numbers(["conv_id"], "turn", F.col("given"), F.lit(5)).alias("number"))


@query(
    "paragraph_edges",
    """SELECT conv_id, turn, CASE WHEN a = 1 AND z = 1 THEN trim(t) WHEN a = 1 THEN ltrim(t) WHEN z = 1 THEN rtrim(t) ELSE t END AS text FROM
       (SELECT conv_id, turn, '  ' || role || ' ' AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM conversations)""",
)
def paragraph_edges(spark, sf_dir):
    """White space at the ends of a paragraph's first and last text."""
    from codexframe.operators.navigation import trimmed_edges

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("  "), "role", F.lit(" ")).alias("text"))
    return rows.select("conv_id", "turn", trimmed_edges(["conv_id"], "turn", "text").alias("text"))


@query(
    "feature_flags",
    """SELECT r_regionkey, coalesce(bool_or(c_custkey % 400 = 0), false) AS has_table, coalesce(bool_or(c_custkey = 7), false) AS has_figure FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey""",
)
def feature_flags(spark, sf_dir):
    """Whether anything beneath a topic is a table or a figure."""
    from codexframe.operators.navigation import flags_beneath

    under = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("c_custkey") == 7, "figure").when(F.col("c_custkey") % 400 == 0, "table").otherwise("paragraph")
    closure = under.select(F.col("n_regionkey").alias("ancestor"), F.col("c_custkey").alias("node"))
    found = flags_beneath(closure, under.select(F.col("c_custkey").alias("node"), kind.alias("node_type")))
    return table(spark, sf_dir, "region").select("r_regionkey").join(found, F.col("r_regionkey") == F.col("ancestor"), "left").select("r_regionkey", F.coalesce("has_table", F.lit(False)).alias("has_table"), F.coalesce("has_figure", F.lit(False)).alias("has_figure"))


@query(
    "rule_context",
    """SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#13'""",
)
def rule_context(spark, sf_dir):
    """References of all occurrences of a rule, each payload once."""
    occurrences = table(spark, sf_dir, "part").where("p_brand = 'Brand#13'").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(occurrences, "l_partkey", "left_semi").dropDuplicates().select("l_orderkey", "l_partkey", "l_suppkey")


@query(
    "stored_names",
    """WITH a AS (SELECT p_partkey, p_brand || '.png' AS name, p_type AS digest FROM part), f AS (SELECT name, digest, min(p_partkey) AS first FROM a GROUP BY name, digest),
       r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY first) - 1 AS k FROM f)
       SELECT p_partkey, CASE WHEN k = 0 THEN name ELSE replace(name, '.png', '-' || k || '.png') END AS stored FROM a JOIN r USING (name, digest)""",
)
def stored_names(spark, sf_dir):
    """One name for equal bytes; bytes that differ from the first of a name get a suffix."""
    assets = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit(".png")).alias("name"), F.col("p_type").alias("sha256"))
    return bodies.stored_names(assets, [], order="p_partkey").select("p_partkey", "stored")


@query("graph_lookup", "SELECT p_partkey, p_partkey AS target, (p_partkey % 3)::BIGINT AS step FROM part")
def graph_lookup(spark, sf_dir):
    """A topic by its exact designation, else by the normalized one, else by its normalized id."""
    from codexframe.functions.text import query_designation
    from codexframe.plans.scalar_queries import _column

    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_partkey").alias("target"), F.explode(F.array(_column(["CS-23.{k}"]), _column(["Node-{k}"]), query_designation(_column(["Node-{k}"])))).alias("name")).distinct()
    wanted = part.select("p_partkey", _column(["CS-23.{k}", "cs 23.{k}", "node {k}"]).alias("wanted"))
    norm = query_designation(F.col("wanted"))
    keys = [F.col("wanted"), F.when(F.startswith(norm, F.lit("CS-")), norm), norm]
    return refs.resolve(wanted, names, keys, "name", "target", "target").select("p_partkey", "target", F.col("step").cast("long").alias("step"))


@query(
    "json_trees",
    """WITH s AS (SELECT s_nationkey, string_agg('{"type":"requirement","title":"' || s_name || '"}', ',' ORDER BY s_suppkey) AS c FROM supplier GROUP BY s_nationkey),
       n AS (SELECT n_regionkey, string_agg('{"type":"section","title":"' || n_name || '"' || coalesce(',"children":[' || c || ']', '') || '}', ',' ORDER BY n_nationkey) AS c FROM nation LEFT JOIN s ON s_nationkey = n_nationkey GROUP BY n_regionkey)
       SELECT r_regionkey, '{"type":"document","title":"' || r_name || '"' || coalesce(',"children":[' || c || ']', '') || '}' AS json FROM region LEFT JOIN n ON n_regionkey = r_regionkey""",
)
def json_trees(spark, sf_dir):
    """Regions as documents, nations as sections, suppliers as requirements."""
    from codexframe.operators.render import json_tree

    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    node = lambda doc, order, parent, depth, kind, title: [F.col(doc).alias("r_regionkey"), order.cast("long").alias("ord"), parent.cast("long").alias("parent"), F.lit(depth).alias("depth"), F.lit(kind).alias("type"), F.col(title).alias("title")]
    top = region.select(node("r_regionkey", F.lit(-1), F.lit(None), 0, "document", "r_name"))
    middle = nation.select(node("n_regionkey", F.col("n_nationkey"), F.lit(-1), 1, "section", "n_name"))
    held = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(node("n_regionkey", F.col("s_suppkey") + 1000, F.col("s_nationkey"), 2, "requirement", "s_name"))
    return json_tree(top.unionByName(middle).unionByName(held), "r_regionkey", ["type", "title"])
