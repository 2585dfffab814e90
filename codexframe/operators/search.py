"""Ranked search: terms, phrases, fields, filters, facets and pages."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexframe.functions.text import count_of, count_of_phrase, tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row a token: key, pos (from 0), term."""
    return df.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "term"))


def term_statistics(df: DataFrame, text: str) -> DataFrame:
    """term, df (rows with the term), cf (occurrences): one shuffle of sums, added up in each task before."""
    words = tokens(F.col(text))
    each = F.concat(F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf"))), F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf"))))
    return df.select(F.explode(each).alias("t")).groupBy("t.term").agg(F.sum("t.df").alias("df"), F.sum("t.cf").alias("cf"))


def bm25(df: DataFrame, text: str, terms: list[str], phrases: list[list[str]] = (), fields: list[str] = (), stemmed: bool = False) -> DataFrame:
    """Rows that hold all terms and phrases, with score (lower is better).

    A phrase counts as one term, as often as it occurs. With stemmed, words, terms and phrases are folded and stemmed. The length of a row is over text, term counts over `fields` (text if none given).
    Statistics are one aggregated row, so the rows are scanned twice and never shuffled.
    """
    at = F.concat_ws(" ", *fields) if fields else F.col(text)
    words = tokens
    if stemmed:
        from codexframe.functions.stem import stem, stems_of

        def words(c: Column) -> Column:
            return stems_of(tokens(c, fold=True))

        def root(word: str) -> str:
            marks = unicodedata.normalize("NFD", word.lower())
            return stem("".join(c for c in marks if not unicodedata.combining(c)))

        terms, phrases = [root(t) for t in terms], [[root(w) for w in p] for p in phrases]
    found = df.withColumn("_all", words(F.col(text))).withColumn("_words", words(at))
    found = found.withColumn("_len", F.size("_all"))
    counts = [count_of(F.col("_words"), t) for t in terms] + [count_of_phrase(F.col("_words"), p) for p in phrases]
    for i, c in enumerate(counts):
        found = found.withColumn(f"_tf{i}", c)
    stats = found.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *(F.count(F.when(F.col(f"_tf{i}") > 0, 1)).alias(f"_df{i}") for i in range(len(counts))))
    hits = found.where(all_of([F.col(f"_tf{i}") > 0 for i in range(len(counts))])).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(counts)):
        n, tf = F.col(f"_df{i}"), F.col(f"_tf{i}")
        idf = F.greatest(F.ln((F.col("_n") - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
        score = score - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    helpers = ["_all", "_words", "_len", "_n", "_avg"] + [f"_{k}{i}" for k in ("tf", "df") for i in range(len(counts))]
    return hits.withColumn("score", score).drop(*helpers)


def page(df: DataFrame, order: list, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of ordered rows: a top-k operator, no full sort."""
    if limit < 1 or offset < 0:
        raise ValueError("limit is at least 1, offset at least 0")
    return df.orderBy(*order).offset(offset).limit(limit)


def one_of(column: str, values: list[str], domain: tuple[str, ...] | None = None) -> Column:
    """Membership in values, each of which must be of the domain if one is given; no values: no filter."""
    wrong = [v for v in values if domain and v not in domain]
    if wrong:
        raise ValueError(f"{column}: {', '.join(wrong)} is none of {', '.join(domain)}")
    return F.col(column).isin(*dict.fromkeys(values)) if values else F.lit(True)


def facet(df: DataFrame, column: str) -> DataFrame:
    """Rows a value, blank values dropped."""
    return df.where((F.col(column) != "") & F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def _once(value: Column, fn) -> Column:
    """fn of a value that is worked out once, however often fn names it, also inside of functions over arrays."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def best_snippet(text: Column, terms: list[str], words: int = 24, before: int = 4) -> Column:
    """The window of at most `words` words that holds most different terms, the first of equal ones, `before` words ahead of a hit.

    Terms are marked by guillemets, cut ends by ellipses; null where no term is in the text.
    """
    parts = F.split(text, " ")
    wanted = F.array(*map(F.lit, terms))

    def place(plain: Column) -> Column:
        places = F.filter(F.transform(plain, lambda w, i: F.when(F.array_contains(wanted, w), F.greatest(i + 1 - before, F.lit(1)))), lambda i: i.isNotNull())
        scored = F.transform(places, lambda at: F.struct(F.size(F.array_intersect(F.slice(plain, at, words), wanted)).alias("n"), (-at).alias("back")))
        return -F.array_max(scored)["back"]

    def shown(x: Column) -> Column:
        own, at = x["parts"], x["at"]
        marked = F.zip_with(F.slice(own, at, words), F.slice(x["plain"], at, words), lambda w, p: F.when(F.array_contains(wanted, p), F.concat(F.lit("«"), w, F.lit("»"))).otherwise(w))
        return F.concat(F.when(at > 1, "…").otherwise(""), F.array_join(marked, " "), F.when(at + words <= F.size(own), "…").otherwise(""))

    with_plain = lambda p: F.struct(p.alias("parts"), F.transform(p, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")).alias("plain"))
    with_place = lambda x: F.struct(x["parts"].alias("parts"), x["plain"].alias("plain"), place(x["plain"]).alias("at"))
    return _once(_once(_once(parts, with_plain), with_place), shown)


def snippet(text: Column, term: str, words: int = 24) -> Column:
    """At most `words` words around the first word that is the term, marked by guillemets, with ellipses."""
    parts = F.split(text, " ")
    place = F.greatest(F.array_position(F.transform(parts, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "")), term).cast("int") - words // 2, F.lit(1))
    cut = F.slice(parts, place, F.lit(words))
    marked = F.transform(cut, lambda w: F.when(F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", "") == term, F.concat(F.lit("«"), w, F.lit("»"))).otherwise(w))
    return F.concat(F.when(place > 1, "…").otherwise(""), F.array_join(marked, " "), F.when(place + words <= F.size(parts), "…").otherwise(""))
