"""Search queries: documents stand for topics, lang for their category, source for their structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexframe.functions.text import has_phrase, tokens
from codexframe.operators import index, search
from codexframe.plans.registry import query
from codexframe.sources.tables import table
from codexframe.sources.work import shared_path

_W = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
_BM25 = f"""
w AS (SELECT *, {_W} AS words FROM documents),
c AS (SELECT *, len(words) AS dl, len(list_filter(words, lambda x: x = 'with')) AS t0, len(list_filter(words, lambda x: x = 'from')) AS t1 FROM w),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c),
h AS (SELECT c.*, -greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / avgdl))
               - greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM c, s WHERE t0 > 0 AND t1 > 0)
"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _hits(spark, sf_dir):
    return search.bm25(_docs(spark, sf_dir), "text", ["with", "from"])


@query("search_bm25_page", f"WITH {_BM25} SELECT doc_id, lang, source, round(score, 6) AS score FROM h ORDER BY round(score, 6), doc_id LIMIT 20")
def search_bm25_page(spark, sf_dir):
    hits = _hits(spark, sf_dir).select("doc_id", "lang", "source", F.round("score", 6).alias("score"))
    return search.page(hits, ["score", "doc_id"])


@query("search_bm25_scores", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM h")
def search_bm25_scores(spark, sf_dir):
    return _hits(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


@query("search_total", f"WITH {_BM25} SELECT count(*) AS total FROM h")
def search_total(spark, sf_dir):
    return _hits(spark, sf_dir).agg(F.count("*").alias("total"))


@query("search_phrase", f"SELECT doc_id, length(text) AS size FROM documents WHERE contains(' ' || array_to_string({_W}, ' ') || ' ', ' of the ')")
def search_phrase(spark, sf_dir):
    return _docs(spark, sf_dir).where(has_phrase(tokens(F.col("text")), ["of", "the"])).select("doc_id", F.length("text").cast("long").alias("size"))


@query("search_field_scope", "SELECT p_partkey, p_name FROM part WHERE list_contains(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), 'red')")
def search_field_scope(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where(F.array_contains(tokens(F.col("p_name")), "red")).select("p_partkey", "p_name")


@query(
    "search_exact_boost",
    """SELECT p_partkey, p_brand, CASE WHEN p_brand = 'Brand#2' THEN 0 ELSE 1 END AS inexact FROM part WHERE starts_with(p_brand, 'Brand#2')
       ORDER BY inexact, p_partkey LIMIT 50""",
)
def search_exact_boost(spark, sf_dir):
    hits = table(spark, sf_dir, "part").where(F.startswith("p_brand", F.lit("Brand#2")))
    return search.page(hits.select("p_partkey", "p_brand", F.when(F.col("p_brand") == "Brand#2", 0).otherwise(1).alias("inexact")), ["inexact", "p_partkey"], 50)


@query(
    "browse_filtered",
    """SELECT doc_id, lang, source, 0.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)
       WHERE lang IN ('en', 'de') AND source IN ('src0', 'src1', 'src2') AND toxic = 0 ORDER BY doc_id LIMIT 100 OFFSET 5""",
)
def browse_filtered(spark, sf_dir):
    kept = search.all_of([search.one_of("lang", ["en", "de"], ("en", "de", "fr", "es")), search.one_of("source", ["src0", "src1", "src2"]), F.col("toxic") == 0])
    hits = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where(kept)
    return search.page(hits.select("doc_id", "lang", "source", F.lit(0.0).alias("score")), ["doc_id"], 100, 5)


@query("facet_category", f"WITH {_BM25} SELECT lang, count(*) AS n FROM h WHERE lang <> '' GROUP BY lang")
def facet_category(spark, sf_dir):
    return search.facet(_hits(spark, sf_dir), "lang")


@query("facet_structure", f"WITH {_BM25} SELECT source, count(*) AS n FROM h WHERE source <> '' GROUP BY source")
def facet_structure(spark, sf_dir):
    return search.facet(_hits(spark, sf_dir), "source")


@query("facet_flags", "SELECT coalesce(sum(quality), 0)::BIGINT AS n_quality, coalesce(sum(toxic), 0)::BIGINT AS n_toxic FROM documents LEFT JOIN labels USING (doc_id)")
def facet_flags(spark, sf_dir):
    both = _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.agg(F.coalesce(F.sum("quality"), F.lit(0)).alias("n_quality"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n_toxic"))


@query(
    "search_subtree",
    """SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey
       WHERE n_nationkey = c_nationkey AND r_name = 'EUROPE')""",
)
def search_subtree(spark, sf_dir):
    region = table(spark, sf_dir, "region").where("r_name = 'EUROPE'")
    nations = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "c_name")


@query("term_statistics", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_W}) AS term FROM documents) GROUP BY term")
def term_statistics(spark, sf_dir):
    return search.term_statistics(_docs(spark, sf_dir), "text")


@query("postings_build", f"SELECT doc_id, (unnest(range(len(w))))::BIGINT AS pos, unnest(w) AS term FROM (SELECT doc_id, {_W} AS w FROM documents)")
def postings_build(spark, sf_dir):
    return search.postings(_docs(spark, sf_dir), "doc_id", "text").withColumn("pos", F.col("pos").cast("long"))


@query("search_preview", "SELECT doc_id, substring(text, 1, 280) AS preview FROM documents")
def search_preview(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.substring("text", 1, 280).alias("preview"))


@query("search_snippet")
def search_snippet(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return hits.select("doc_id", search.snippet(F.col("text"), "with").alias("snippet"))


_PHRASED = f"""
w AS (SELECT *, {_W} AS words FROM documents),
c AS (SELECT *, len(words) AS dl, len(list_filter(words, lambda x: x = 'with')) AS t0, len(list_filter(range(1, len(words)), lambda i: words[i] = 'of' AND words[i + 1] = 'the')) AS t1 FROM w),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c),
h AS (SELECT c.*, -greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / avgdl))
               - greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM c, s WHERE t0 > 0 AND t1 > 0)
"""


#: Indexes of the tables stored in this session, by application, folder and kind: searches of one kind share one.
_stored: dict[tuple[str, str, str], index.Index] = {}


def _index_of(spark, sf_dir, kind, build):
    own = (spark.sparkContext.applicationId, sf_dir, kind)
    if own not in _stored:
        _stored[own] = build(shared_path(spark, "index"))
    return _stored[own]


def _doc_index(spark, sf_dir):
    return _index_of(spark, sf_dir, "documents", lambda at: index.write_index(_docs(spark, sf_dir).select("doc_id", "lang", "source", "text"), "doc_id", ["text"], at))


def _indexed(spark, sf_dir, text, filters=()):
    """A search of all documents through their stored index."""
    return _doc_index(spark, sf_dir).search(text, list(filters))


@query("search_index_build", f"SELECT count(*) AS n_rows, sum(len(w))::BIGINT AS n_words, sum(len(list_distinct(w)))::BIGINT AS n_postings FROM (SELECT {_W} AS w FROM documents)")
def search_index_build(spark, sf_dir):
    """Store the index of all documents anew; its rows, words and postings as read back from it."""
    at = shared_path(spark, "index")
    own = index.write_index(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id", ["text"], at)
    blocks = spark.read.parquet(*(f"{at}/data/{s['id']}/postings" for s in own.segments)).agg(F.sum("n").cast("long").alias("n_postings"))
    rows = spark.read.parquet(*(f"{at}/data/{s['id']}/rows" for s in own.segments)).agg(F.count("*").alias("n_rows"), F.sum("length").alias("n_words"))
    out = spark.createDataFrame([(*rows.first(), blocks.first()[0])], "n_rows long, n_words long, n_postings long")
    own.drop()
    return out


@query("search_indexed", f"WITH {_PHRASED} SELECT doc_id, lang, source, round(score, 6) AS score FROM h")
def search_indexed(spark, sf_dir):
    """A phrase and a word of a query text, through stored postings."""
    return _indexed(spark, sf_dir, 'WITH! "of  the"').hits.withColumn("score", F.round("score", 6))


@query(
    "search_counts",
    f"""WITH {_PHRASED}, f AS (SELECT * FROM h WHERE lang IN ('en', 'de')) SELECT 'total' AS facet, '' AS value, count(*) AS n FROM f
        UNION ALL SELECT 'lang', lang, count(*) FROM f WHERE lang <> '' GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM f WHERE source <> '' GROUP BY source""",
)
def search_counts(spark, sf_dir):
    """Total and facets of one filtered search in one pass."""
    return _indexed(spark, sf_dir, 'with "of the"', [search.one_of("lang", ["en", "de"])]).counts("lang", "source")


@query("search_nothing", "SELECT doc_id, lang, source, 0.0::DOUBLE AS score FROM documents WHERE false")
def search_nothing(spark, sf_dir):
    """No words and no filter: no hits, not all rows."""
    return _indexed(spark, sf_dir, ' "" !? ').hits


@query("browse_by_flags", "SELECT doc_id, lang, 0.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id) WHERE toxic = 0")
def browse_by_flags(spark, sf_dir):
    """Flags that are asked for, not asked for, and left open."""
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").withColumns({"t": F.col("toxic") == 1, "q": F.col("quality") == 1})
    return rows.where(index.is_state("t", False) & index.is_state("q", None)).select("doc_id", "lang", F.lit(0.0).alias("score"))


@query("document_scope", "SELECT doc_id, source FROM documents WHERE source = (SELECT arg_max(source, doc_id) FROM documents) UNION ALL SELECT doc_id, source FROM documents WHERE source = 'src1'")
def document_scope(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "source")
    return index.document_scope(docs, "source", "doc_id").unionByName(index.document_scope(docs, "source", "doc_id", "SRC1"))


@query("rule_lookup", "SELECT p_partkey, p_brand, (SELECT count(*) FROM part WHERE p_brand = 'Brand#13') AS occurrences FROM part WHERE p_brand = 'Brand#13'")
def rule_lookup(spark, sf_dir):
    """All occurrences of a rule by designation or id, and how many there are."""
    named = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.replace(F.lower("p_brand"), F.lit("#"), F.lit(" #")).alias("spaced"), F.lit(None).cast("string").alias("erules_id"))
    found = index.rules_named(named, "Brand-#13", "spaced", "erules_id")
    return found.join(F.broadcast(found.agg(F.count("*").alias("occurrences")))).select("p_partkey", "p_brand", "occurrences")  # one row


@query("field_scores", f"WITH w AS (SELECT p_partkey, p_name, regexp_extract_all(lower(p_name), '[\\p{{L}}\\p{{N}}]+') AS a, regexp_extract_all(lower(p_type), '[\\p{{L}}\\p{{N}}]+') AS b FROM part), c AS (SELECT *, len(a) + len(b) AS dl, len(list_filter(a, lambda x: x = 'red')) AS t FROM w), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (t > 0) AS d FROM c) SELECT p_partkey, round(-greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM c, s WHERE t > 0")
def field_scores(spark, sf_dir):
    """A search of one field; lengths are over all fields."""
    return _part_index(spark, sf_dir).search("red", fields=["p_name"]).hits.select("p_partkey", F.round("score", 6).alias("score"))


def _part_index(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_name", "p_type")
    return _index_of(spark, sf_dir, "part", lambda at: index.write_index(part, "p_partkey", ["p_name", "p_type"], at))


@query("search_page", f"WITH {_BM25} SELECT doc_id, lang, source, round(score, 6) AS score FROM h ORDER BY score, doc_id LIMIT 25 OFFSET 5")
def search_page(spark, sf_dir):
    """The second page of a ranked search, of whose postings only the blocks that can reach it are read."""
    return _doc_index(spark, sf_dir).page("with from", 25, 5).withColumn("score", F.round("score", 6))


@query(
    "search_page_exact",
    """WITH w AS (SELECT *, regexp_extract_all(lower(p_name || ' ' || p_type), '[\\p{L}\\p{N}]+') AS words FROM part),
       c AS (SELECT *, len(words) AS dl, len(list_filter(words, lambda x: x = 'red')) AS t FROM w), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (t > 0) AS d FROM c),
       h AS (SELECT *, -greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM c, s WHERE t > 0 AND p_size >= 10)
       SELECT p_partkey, p_brand, p_size, round(score, 6) AS score FROM h ORDER BY p_brand <> 'Brand#13', score, p_partkey LIMIT 40""",
)
def search_page_exact(spark, sf_dir):
    """A page in one order: rows of the designation asked for, then by score, then by key; filters count before the page."""
    return _part_index(spark, sf_dir).page("red", 40, filters=[F.col("p_size") >= 10], exact=F.col("p_brand") == "Brand#13").withColumn("score", F.round("score", 6))


_FORMS = ["Connected résumés", "connecting resume", "CONNECTIONS Resumé", "connective tissue", "reconnect resume", "connects", "", "plain résumé: connection"]


@query(
    "search_stemmed",
    f"""WITH f AS (SELECT doc_id, lang, regexp_extract_all(strip_accents(lower(coalesce(text, '') || ' ' || coalesce([{', '.join(f"'{x}'" for x in _FORMS)}][doc_id % 24 + 1], ''))), '[\\p{{L}}\\p{{N}}]+') AS words FROM documents),
        c AS (SELECT *, len(words) AS dl, len(list_filter(words, lambda x: x IN ('connect', 'connects', 'connected', 'connecting', 'connection', 'connections', 'connective'))) AS t0,
              len(list_filter(words, lambda x: x IN ('resume', 'resumes'))) AS t1 FROM f),
        s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c)
        SELECT doc_id, lang, round(-greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / avgdl))
               - greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM c, s WHERE t0 > 0 AND t1 > 0""",
)
def search_stemmed(spark, sf_dir):
    """Words of the same stem, with and without diacritics, through an index that files stems: all documents, a form of two words added to each of some."""
    form = F.get(F.array(*map(F.lit, _FORMS)), (F.col("doc_id") % 24).cast("int"))
    docs = _docs(spark, sf_dir).select("doc_id", "lang", F.concat_ws(" ", F.coalesce("text", F.lit("")), form).alias("text"))
    own = _index_of(spark, sf_dir, "stems", lambda at: index.write_index(docs, "doc_id", ["text"], at, analyzer="stem"))
    return own.search("connect RÉSUMÉ").hits.withColumn("score", F.round("score", 6))


@query(
    "search_incremental",
    "WITH changed AS (SELECT doc_id, lang, CASE WHEN doc_id % 10 = 3 THEN text || ' with and from' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 5), "
    + _BM25.replace("FROM documents", "FROM changed") + "SELECT doc_id, lang, round(score, 6) AS score FROM h",
)
def search_incremental(spark, sf_dir):
    """An index that took the documents in four parts, new texts for some keys, and some keys away."""
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "text")

    def build(at):
        own = index.create_index(spark, at, docs.schema, "doc_id", ["text"])
        for part in range(4):
            own = own.add(docs.where(F.pmod(F.hash("doc_id"), F.lit(4)) == part))
        own = own.add(docs.where("doc_id % 10 = 3").withColumn("text", F.concat("text", F.lit(" with and from"))))
        return own.remove(docs.where("doc_id % 7 = 5"))

    return _index_of(spark, sf_dir, "changed", build).search("with from").hits.withColumn("score", F.round("score", 6))


_PLAIN = "list_transform(p, lambda x: regexp_replace(lower(x), '[^\\p{L}\\p{N}]', '', 'g'))"


@query(
    "search_best_snippet",
    f"""WITH a AS (SELECT doc_id, string_split(text, ' ') AS p FROM documents), b AS (SELECT *, {_PLAIN} AS n FROM a),
        c AS (SELECT *, list_transform(list_filter(range(1, len(n) + 1), lambda i: n[i] IN ('with', 'from')), lambda i: greatest(i - 4, 1)) AS s FROM b),
        d AS (SELECT doc_id, p, n, unnest(s) AS w0 FROM c), e AS (SELECT *, len(list_distinct(list_filter(list_slice(n, w0, w0 + 23), lambda x: x IN ('with', 'from')))) AS k FROM d),
        f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, w0) = 1)
        SELECT doc_id, CASE WHEN w0 > 1 THEN '…' ELSE '' END || array_to_string(list_transform(range(w0, least(w0 + 24, len(p) + 1)), lambda i: CASE WHEN n[i] IN ('with', 'from') THEN '«' || p[i] || '»' ELSE p[i] END), ' ')
               || CASE WHEN w0 + 24 <= len(p) THEN '…' ELSE '' END AS snippet FROM f""",
)
def search_best_snippet(spark, sf_dir):
    """The window that holds most of the terms."""
    found = _docs(spark, sf_dir).select("doc_id", search.best_snippet(F.col("text"), ["with", "from"]).alias("snippet"))
    return found.where("snippet is not null")
