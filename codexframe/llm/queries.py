"""One named query an operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; every node has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexframe.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexframe.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=85, rows=7)


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from codexframe.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexframe.llm.secrets import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@query
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexframe.llm.urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op7_url_filters"] = r"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
         split_part(path, '/', 2) AS p1, split_part(path, '/', 3) AS p2 FROM parsed),
seg AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS v,
         CASE WHEN regexp_matches(p1, '[0-9]') THEN '*' ELSE p1 END AS s1, CASE WHEN regexp_matches(p2, '[0-9]') THEN '*' ELSE p2 END AS s2 FROM ruled),
c0 AS (SELECT host, s1, s2, count(*) AS n, count(v) AS l, count(*) FILTER (v = 'block') AS b FROM seg GROUP BY host, s1, s2),
c1 AS (SELECT *, CASE WHEN s1 <> '' AND host IN (SELECT host FROM c0 GROUP BY host HAVING count(DISTINCT s1) > 16 AND sum(n) < 4 * count(DISTINCT s1)) THEN '*' ELSE s1 END AS w1 FROM c0),
c2 AS (SELECT c1.*, CASE WHEN s2 <> '' AND wide THEN '*' ELSE s2 END AS w2 FROM c1 JOIN
       (SELECT host, w1, count(DISTINCT s2) > 16 AND sum(n) < 4 * count(DISTINCT s2) AS wide FROM c1 GROUP BY host, w1) USING (host, w1)),
t AS (SELECT host, w1, w2, sum(l) AS l, sum(b) AS b FROM c2 GROUP BY host, w1, w2),
b0 AS (SELECT host, w1, sum(l) AS l1, sum(b) AS b1 FROM t GROUP BY host, w1),
b1 AS (SELECT *, sum(l1) OVER (PARTITION BY host) AS l0, sum(b1) OVER (PARTITION BY host) AS b0 FROM b0),
b2 AS (SELECT *, coalesce(l1 > 0 AND (b1::DOUBLE / nullif(l1, 0) - b0::DOUBLE / nullif(l0, 0)) * (b1::DOUBLE / nullif(l1, 0) - b0::DOUBLE / nullif(l0, 0)) * l1
              > 3.84::DOUBLE * (b0::DOUBLE / nullif(l0, 0)) * (1 - b0::DOUBLE / nullif(l0, 0)), false) AS own FROM b1),
g AS (SELECT w1, sum(l1) AS lw, sum(b1) AS bw FROM b0 GROUP BY w1),
q AS (SELECT (sum(bw) + 1)::DOUBLE / (sum(lw) + 2) AS q0 FROM g),
g1 AS (SELECT w1, (bw + 4 * q0) / (lw + 4) AS q1 FROM g, q),
b3 AS (SELECT *, sum(CASE WHEN own THEN 0 ELSE l1 END) OVER (PARTITION BY host) AS lm, sum(CASE WHEN own THEN 0 ELSE b1 END) OVER (PARTITION BY host) AS bm FROM b2),
b4 AS (SELECT host, w1, l1, b1, ((CASE WHEN own THEN b1 ELSE bm END) + 4 * q1) / ((CASE WHEN own THEN l1 ELSE lm END) + 4) AS qb FROM b3 JOIN g1 USING (w1)),
t1 AS (SELECT t.host, t.w1, t.w2, CASE WHEN coalesce(l > 0 AND (b::DOUBLE / nullif(l, 0) - b1::DOUBLE / nullif(l1, 0)) * (b::DOUBLE / nullif(l, 0) - b1::DOUBLE / nullif(l1, 0)) * l
              > 3.84::DOUBLE * (b1::DOUBLE / nullif(l1, 0)) * (1 - b1::DOUBLE / nullif(l1, 0)), false) THEN (b + 4 * qb) / (l + 4) ELSE qb END AS share
       FROM t JOIN b4 ON t.host = b4.host AND t.w1 = b4.w1)
SELECT page_id, seg.host, path, rule, coalesce(v, CASE WHEN share > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM seg JOIN c2 ON seg.host = c2.host AND seg.s1 = c2.s1 AND seg.s2 = c2.s2 JOIN t1 ON t1.host = c2.host AND t1.w1 = c2.w1 AND t1.w2 = c2.w2
"""


@query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexframe.llm.topk import top_k
    from codexframe.llm.vectors import valid

    whole = table(spark, sf_dir, "embeddings").where(valid(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("embedding"))
    return top_k(whole, whole.where("vec_id % 50 = 0"))


@query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexframe.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexframe.llm.quality import score_documents, train

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexframe.llm.kneser_ney import score_corpus

    return score_corpus(table(spark, sf_dir, "documents"))


@query
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexframe.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexframe.llm.clustering import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _clustering_sql(rounds: int) -> str:
    """DuckDB SQL of the clustering: components as rows, one pair of tables a round."""
    parts = [
        """v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::HUGEINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
n AS (SELECT row_number() OVER () AS r, vec_id, q FROM v),
x AS (SELECT r, unnest(range(64)) AS d, unnest(q) AS x FROM n),
s AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id, q) - 1 AS c, r FROM n QUALIFY c < 16),
c0 AS (SELECT c, d, x AS m FROM s JOIN x USING (r))"""
    ]
    for k in range(rounds + 1):
        parts.append(f"""f{k} AS (SELECT r, c, sum((x - m) * (x - m)) AS far FROM x JOIN c{k} USING (d) GROUP BY r, c),
a{k} AS (SELECT r, arg_min(c, far * 16 + c) AS c, min(far) AS far FROM f{k} GROUP BY r)""")
        if k < rounds:
            parts.append(f"""t{k} AS (SELECT c, d, sum(x)::HUGEINT AS t, count(*)::HUGEINT AS n FROM a{k} JOIN x USING (r) GROUP BY c, d),
c{k + 1} AS (SELECT c, d, CASE WHEN t IS NULL THEN m ELSE (t - ((t % n) + n) % n) // n END AS m FROM c{k} LEFT JOIN t{k} USING (c, d))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, c::INTEGER AS cluster, far::BIGINT AS distance, (sum(far) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(far) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN n USING (r) JOIN (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c) USING (c)"""


ORACLES["op11_centroid_clustering"] = _clustering_sql(3)


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexframe.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_importance_resampling"] = r"""
WITH crc_step AS (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) AS r(b)),
crc AS MATERIALIZED (SELECT list(t ORDER BY b) AS t FROM crc_step),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM d) GROUP BY doc_id, w),
gw AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM g) GROUP BY w),
vocabulary AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
                 lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
               FROM (SELECT w FROM dw UNION SELECT w FROM gw), crc),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM dw JOIN vocabulary USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM gw JOIN vocabulary USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS g
         FROM s FULL JOIN t USING (bucket)),
w AS (SELECT doc_id, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM dw JOIN vocabulary USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT scored.*, CASE WHEN place <= (SELECT count(*) FROM placed) * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""


@query
def op13_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codexframe.llm.multi_index import nearest_vectors

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_vectors(rows, rows.where("vec_id % 100 = 0"))
