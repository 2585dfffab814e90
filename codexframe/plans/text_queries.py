"""Scalar functions, markup and renderers over whole tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexframe.functions import text as fn
from codexframe.functions.versions import publication_format
from codexframe.operators import render
from codexframe.plans.registry import query
from codexframe.sources.markup import links, page_nodes
from codexframe.sources.tables import table
from codexframe.sources.work import dealt


@query("whitespace_normalize", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\f\\v]+', ' ', 'g'), ' *\\n *', chr(10), 'g') AS text FROM documents")
def whitespace_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.collapse_whitespace(F.col("text")).alias("text"))


@query(
    "slugify",
    """SELECT p_partkey, substring(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '^-|-$', '', 'g'), 1, 100) AS slug,
       lower(translate('CS ' || p_size || '.' || p_partkey, '. ', '--')) AS rule_slug FROM part""",
)
def slugify(spark, sf_dir):
    rule = F.concat(F.lit("CS "), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.slugify(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"), fn.slugify_rule(rule).alias("rule_slug"))


#: All forms of a designation around a key k, and their canonical ones.
DESIGNATIONS = (
    ("CS 23.", "k", "", "CS-23.", ""), ("cs-23.", "k", "(a)", "CS-23.", "(a)"), ("CS-VLA ", "k", "", "CS-VLA.", ""), ("cs  vla ", "k", "(b)", "CS-VLA.", "(b)"), ("CS-VLA.", "k", "", "CS-VLA.", ""),
    ("AMC1 23.", "k", "", "AMC1 CS-23.", ""), ("amc2  CS-23.", "k", "(c)", "AMC2 CS-23.", "(c)"), ("GM1 CS 23.", "k", "", "GM1 CS-23.", ""), ("AMC VLA ", "k", "(d)", "AMC VLA ", "(d)"),
    ("gm  lsa ", "k", "", "GM LSA ", ""), ("AMC1 CS-VLA.", "k", "", "AMC1 CS-VLA.", ""),
)


def _form_sql(at: int, after: int) -> str:
    cases = " ".join(f"WHEN {i} THEN '{form[at]}' || p_partkey || '{form[after]}'" for i, form in enumerate(DESIGNATIONS))
    return f"CASE p_partkey % {len(DESIGNATIONS)} {cases} END"


def given_designation() -> Column:
    key, out = F.col("p_partkey").cast("string"), F.lit(None).cast("string")
    for i, form in enumerate(DESIGNATIONS):
        out = F.when(F.col("p_partkey") % len(DESIGNATIONS) == i, F.concat(F.lit(form[0]), key, F.lit(form[2]))).otherwise(out)
    return out


def _canonical(spark, sf_dir, name):
    return table(spark, sf_dir, "part").select("p_partkey", fn.canonical_designation(given_designation()).alias(name))


@query("designation_normalize", f"SELECT p_partkey, {_form_sql(3, 4)} AS normal FROM part")
def designation_normalize(spark, sf_dir):
    return _canonical(spark, sf_dir, "normal")


@query("designation_extract", f"SELECT p_partkey, {_form_sql(3, 4)} AS designation FROM part")
def designation_extract(spark, sf_dir):
    title = F.concat(given_designation(), F.lit(" Title, see CS-23.1"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.leading_designation(title, require_number=True).alias("designation"))


@query("designation_canonical", f"SELECT p_partkey, {_form_sql(3, 4)} AS canonical FROM part")
def designation_canonical(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.canonical_designation(given_designation()).alias("canonical"))


@query("designation_leading", f"SELECT p_partkey, {_form_sql(3, 4)} AS designation, NULL::VARCHAR AS later FROM part")
def designation_leading(spark, sf_dir):
    title = F.concat(F.lit("  "), given_designation(), F.lit("  Title of CS-23.1"))
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", fn.leading_designation(title).alias("designation"), fn.leading_designation(F.concat(F.lit("On "), title)).alias("later"))


@query("html_escape", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.html_escape(F.col("html")).alias("escaped"))


@query("link_escape", "SELECT page_id, replace(replace(replace(replace(replace(replace(url || '(' || page_id || '%)', '%', '%25'), '(', '%28'), ')', '%29'), ' ', '%20'), '<', '%3C'), '>', '%3E') AS escaped FROM pages")
def link_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.link_escape(F.concat("url", F.lit("("), F.col("page_id").cast("string"), F.lit("%)"))).alias("escaped"))


@query(
    "metadata_split",
    """WITH t AS (SELECT p_partkey, p_name || '; n/a ;' || p_type || ';-; ' || p_name || ';' AS given FROM part),
       s AS (SELECT p_partkey, list_filter(list_transform(string_split(given, ';'), lambda x: trim(x)), lambda x: lower(x) NOT IN ('', 'n/a', 'n/a;', 'na', '-')) AS l FROM t)
       SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS items FROM s""",
)
def metadata_split(spark, sf_dir):
    given = F.concat("p_name", F.lit("; n/a ;"), "p_type", F.lit(";-; "), "p_name", F.lit(";"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(fn.split_list(given), "|").alias("items"))


@query(
    "url_format_detect",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'xml' WHEN 1 THEN 'zip' WHEN 2 THEN 'pdf' ELSE 'other' END AS format FROM pages""",
)
def url_format_detect(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("(XML)", "application/zip", "(pdf)", "zip file"))), (F.col("page_id") % 4 + 1).cast("int"))
    named = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", publication_format(named, F.lit(""), kind, F.lit("https://h.org/p")).alias("format"))


@query("json_decode", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_decode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "json_lists",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_brand || '|' || p_type WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '' ELSE 'é "' || p_name END AS items, CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 4 THEN 1 ELSE 0 END::BIGINT AS n FROM part""",
)
def json_lists(spark, sf_dir):
    """Lists written as JSON and read back; every fifth text each is null, cut off, and no list."""
    whole = F.to_json(F.array("p_brand", "p_type"))
    given = F.element_at(F.array(whole, F.lit(None), F.concat(F.lit("["), whole), F.to_json(F.struct("p_brand")), F.to_json(F.array(F.concat(F.lit('é "'), "p_name")))), (F.col("p_partkey") % 5 + 1).cast("int"))
    found = fn.decoded_list(given)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, "|").alias("items"), F.size(found).cast("long").alias("n"))


@query("base64_asset", "SELECT doc_id, base64(encode(text)) AS data, sha256(text) AS sha256 FROM documents")
def base64_asset(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", "").alias("data"), F.sha2("text", 256).alias("sha256"))


@query("link_extract", "SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages")
def link_extract(spark, sf_dir):
    return links(table(spark, sf_dir, "pages"), "page_id", "html")


@query("html_parse_nodes")
def html_parse_nodes(spark, sf_dir):
    return page_nodes(table(spark, sf_dir, "pages"), "page_id", "html")


@query("plain_text_render", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def plain_text_render(spark, sf_dir):
    return render.plain_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.concat("role", F.lit(": "), "text"))


@query("markdown_render", "SELECT conv_id, string_agg(repeat('#', CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END) || ' ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def markdown_render(spark, sf_dir):
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return render.markdown(table(spark, sf_dir, "conversations"), "conv_id", "turn", level, F.col("role"), F.col("text"))


@query(
    "html_fragment",
    """SELECT conv_id, string_agg('<p class="' || role || '">' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</p>', '' ORDER BY turn) AS body
       FROM conversations GROUP BY conv_id""",
)
def html_fragment(spark, sf_dir):
    return render.html(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role"), F.col("text"))
