"""A stored search index that describes itself, grows by segments, and gives ranked pages without reading all postings.

A segment is written once: its rows (what is stored beside the texts, their length and terms), and its postings, in
buckets by term. Postings come in blocks: of one term, best rows first, each with the most that any of its rows can add
to a score. Replacing or removing a row writes a line that its version in a segment is dead, and what the terms' counts
lose by that; segments of like size are merged, and nothing else is ever rewritten. The last manifest says what is there.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from codexframe.functions.text import tokens
from codexframe.operators.search import K1, LEAST_IDF, B, all_of

_PART = re.compile(r"[^\W_]+")
#: Postings a block, and a bucket; of a term beyond which it is dealt over tasks (or a ten-thousandth of all, if that is more); and a task that makes blocks.
BLOCK, BUCKET, HEAVY, TASK = 128, 4_000_000, 1_000_000, 500_000
#: Segments of like size (a power of four of rows) that are merged.
FANOUT = 4
_FIELD = 1 << 40
#: Words of whole texts that a task takes apart at once, and words whose stems it remembers.
PORTION, REMEMBERED = 100_000, 1 << 17


def query_units(text: str) -> list[list[str]]:
    """What a query asks for, all of it: quoted phrases, then words; a word with inner punctuation is a phrase of its parts.

    Operators and other characters have no meaning of their own. Nothing asked for gives no units.
    """
    phrases = re.findall(r'"([^"]+)"', text)
    words = re.sub(r"[^\w\s\-./]", " ", re.sub(r'"[^"]+"', " ", text)).split()
    return [unit for given in [*phrases, *words] if (unit := _PART.findall(given.lower()))]


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def folded_word(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def term_of(analyzer: str):
    """From a lower-cased word of a query to the term it is filed under."""
    if analyzer == "plain":
        return lambda word: word
    from codexframe.functions.stem import stem

    return lambda word: stem(folded_word(word))


def _root(analyzer: str):
    """From a word of a text (folded already) to its term; each of a task's words is stemmed once."""
    if analyzer == "plain":
        return lambda word: word
    from codexframe.functions.stem import stem

    known: dict[str, str] = {}

    def root(word: str) -> str:
        if (term := known.get(word)) is None:
            if len(known) >= REMEMBERED:
                known.clear()
            term = known[word] = stem(word)
        return term

    return root


def portions(batch: pa.RecordBatch, words: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices of about `most` words (lists of words by field in column `words`), at least a row each.

    What a task holds as Python objects goes with such a slice, whatever the rows of a batch and the length of their texts.
    """
    fields = batch.column(words)
    outer, inner = fields.offsets.to_numpy(), fields.values.offsets.to_numpy()
    before = inner[outer].astype("int64") - inner[outer[0]] if batch.num_rows else np.zeros(1, "int64")
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(before, before[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def in_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in the order of their groups (deal, term), and where blocks of `most` rows of a group begin; what a batch leaves open goes with the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.concat_batches([*held, batch])
        if not rows.num_rows:
            continue
        deal, term = rows.column("deal").to_numpy(), rows.column("term")
        other = (np.diff(deal) != 0) | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
        groups = np.append(0, np.flatnonzero(other) + 1)
        at = np.arange(rows.num_rows)
        begins = np.flatnonzero((at - np.repeat(groups, np.diff(np.append(groups, len(at))))) % most == 0)
        if begins[-1]:
            yield rows.slice(0, begins[-1]), begins[:-1]
        held = [rows.slice(begins[-1])]
    if held:
        yield held[0], np.zeros(1, "int64")


class Found(NamedTuple):
    """Hits of a query (key, columns of the index, score: lower is better), and functions of them."""

    hits: DataFrame
    asked: bool

    def counts(self, *columns: str) -> DataFrame:
        """Total and facets in one pass: (facet, value, n); the total's facet is total. Blank values are left out."""
        sets = F.array(F.struct(F.lit("total").alias("facet"), F.lit("").alias("value")), *(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
        rows = self.hits.select(F.explode(sets).alias("f")).select("f.*").where("facet = 'total' or value <> ''")
        return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


def _impact(average: float) -> Column:
    """What a row's count of a term adds to a score, but for constants: between 0 and 1."""
    return F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("length") / average))


class Index:
    """The index stored under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        last = spark.read.text(f"{self.path}/manifest").orderBy(F.desc("v")).first()
        self.version, self.about = last.v, json.loads(last.value)
        self.key, self.fields, self.analyzer = (self.about[k] for k in ("key", "fields", "analyzer"))
        self.columns = StructType.fromJson(self.about["columns"])

    # What is there

    @property
    def segments(self) -> list[dict]:
        return self.about["segments"]

    @property
    def size(self) -> int:
        """Rows that are alive."""
        return sum(s["rows"] - s["dead_rows"] for s in self.segments)

    @property
    def average(self) -> float:
        return sum(s["length"] - s["dead_length"] for s in self.segments) / max(self.size, 1)

    @property
    def _row_schema(self) -> StructType:
        return StructType([*self.columns.fields, StructField("length", LongType()), StructField("terms", ArrayType(StringType()))])

    def _all(self, frames: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], schema)

    def _dead(self, kind: str, schema: str) -> DataFrame:
        """Lines about dead versions in segments that are still there."""
        there = [s["id"] for s in self.segments if s["dead_rows"]]
        frames = [self.spark.read.schema(schema).parquet(f"{self.path}/data/{d}/{kind}") for d in self.about["dead"]] if there else []
        return self._all(frames, schema).where(F.col("of").isin(there))

    def _alive(self, df: DataFrame) -> DataFrame:
        """df (key, of) without dead versions."""
        if not any(s["dead_rows"] for s in self.segments):
            return df
        return df.join(self._dead("versions", f"{self.key} {self.columns[self.key].dataType.simpleString()}, of string"), [self.key, "of"], "left_anti")

    def _rows(self) -> DataFrame:
        frames = [self.spark.read.schema(self._row_schema).parquet(f"{self.path}/data/{s['id']}/rows").withColumn("of", F.lit(s["id"])) for s in self.segments]
        return self._alive(reduce(DataFrame.unionByName, frames)) if frames else self.spark.createDataFrame([], StructType([*self._row_schema.fields, StructField("of", StringType())]))

    def rows(self) -> DataFrame:
        """The rows that are alive: key and stored columns."""
        return self._rows().select(*self.columns.names)

    @property
    def _block_schema(self) -> str:
        return f"term string, n int, impact double, entries array<struct<key:{self.columns[self.key].dataType.simpleString()},length:int,places:array<bigint>>>, bucket int"

    def _stored_blocks(self, segment: dict) -> DataFrame:
        return self.spark.read.schema(self._block_schema).parquet(f"{self.path}/data/{segment['id']}/postings")

    def _blocks(self, terms: list[str], least: dict[str, float] | None = None) -> DataFrame:
        """Blocks of terms, with what they can add at most (reach); of a term with a bound in least, those that reach it.

        Of the files, only those of the terms' buckets are read, and of them only what can hold such blocks.
        """
        bound, frames = least or {}, []
        for s in self.segments:
            stretch = max(1.0, self.average * s["rows"] / max(s["length"], 1))  # longer rows on average make the same counts worth more
            wanted = []
            for t in terms:
                own = (F.col("bucket") == bucket_of(t, s["buckets"])) & (F.col("term") == t)
                wanted.append(own & (F.col("impact") >= bound[t] / stretch * (1 - 1e-9)) if bound.get(t, 0) > 0 else own)
            blocks = self._stored_blocks(s).where(reduce(lambda a, b: a | b, wanted))
            frames.append(blocks.select("term", "n", (F.col("impact") * stretch).alias("reach"), "entries", F.lit(s["id"]).alias("of")))
        return self._all(frames, self._block_schema.replace("impact", "reach").replace("bucket int", "of string"))

    def _entries(self, blocks: DataFrame) -> DataFrame:
        """Postings of blocks (term, of, entries) in rows that are alive: term, key, length, places."""
        each = blocks.select("term", "of", F.explode("entries").alias("e"))
        return self._alive(each.select("term", F.col("e.key").alias(self.key), "of", F.col("e.length").alias("length"), F.col("e.places").alias("places"))).drop("of")

    def entries(self, terms: list[str], least: dict[str, float] | None = None) -> DataFrame:
        """Postings of terms in rows that are alive: term, key, length, places."""
        return self._entries(self._blocks(terms, least))

    # Search

    def units(self, text: str) -> list[list[str]]:
        of = term_of(self.analyzer)
        return [[of(w) for w in unit] for unit in query_units(text)]

    def _counted(self, entries: DataFrame, units: list[list[str]], fields: list[str]) -> DataFrame:
        """Rows with any of the terms: key, length, and how often each unit occurs (in fields, if given)."""
        terms = sorted({t for unit in units for t in unit})
        own = [self.fields.index(f) for f in fields]
        places = F.filter("places", lambda p: F.floor(p / _FIELD).isin(own)) if own else F.col("places")
        one = lambda t: F.coalesce(F.first(F.when(F.col("term") == t, places), ignorenulls=True), F.array().cast("array<bigint>"))
        held = entries.groupBy(self.key).agg(F.first("length").alias("length"), *(one(t).alias(f"_p{i}") for i, t in enumerate(terms)))

        def starts(t: str, k: int) -> Column:
            """Where a phrase whose word k is t would start."""
            return F.transform(F.col(f"_p{terms.index(t)}"), lambda x: x - k)

        def times(unit: list[str]) -> Column:
            return F.size(reduce(F.array_intersect, (starts(t, k) for k, t in enumerate(unit))))

        return held.select(self.key, "length", *(times(unit).alias(f"_tf{i}") for i, unit in enumerate(units)))

    def _idf(self, df: int) -> float:
        return max(math.log((self.size - df + 0.5) / (df + 0.5)), LEAST_IDF)

    def _scored(self, counted: DataFrame, idf: list[float]) -> DataFrame:
        score = F.lit(0.0)
        for i, w in enumerate(idf):
            tf = F.col(f"_tf{i}")
            score = score - F.lit(w) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(self.average)))
        return counted.where(all_of([F.col(f"_tf{i}") > 0 for i in range(len(idf))])).select(self.key, score.alias("score"))

    def _with_columns(self, scored: DataFrame, filters: list[Column]) -> DataFrame:
        return self.rows().join(scored, self.key).where(all_of(filters)).select(*self.columns.names, "score")

    def _term_counts(self, terms: list[str]) -> dict[str, tuple[int, float]]:
        """Of each term: rows that are alive and hold it, and the most it can add to a score."""
        found = {r.term: (int(r.n), r.reach) for r in self._blocks(terms).groupBy("term").agg(F.sum("n").alias("n"), F.max("reach").alias("reach")).collect()}
        lost = {}
        if any(s["dead_rows"] for s in self.segments):
            lost = {r.term: int(r.n) for r in self._dead("lost", "term string, of string, n long").where(F.col("term").isin(terms)).groupBy("term").agg(F.sum("n").alias("n")).collect()}
        return {t: (found.get(t, (0, 0.0))[0] - lost.get(t, 0), found.get(t, (0, 0.0))[1]) for t in terms}

    def search(self, text: str, filters: list[Column] = (), fields: list[str] = ()) -> Found:
        """Rows that hold all that the query asks for (in `fields`, if given) and pass all filters, scored.

        Without a query, filtered rows have score 0; without either there are no hits. Counts and scores are over the
        whole index; only postings of the query's terms are read.
        """
        units = self.units(text)
        if not units:
            hits = self.rows().where(all_of(list(filters))) if filters else self.rows().where("false")
            return Found(hits.withColumn("score", F.lit(0.0)), bool(filters))
        counted = self._counted(self.entries(sorted({t for unit in units for t in unit})), units, list(fields))
        if all(len(unit) == 1 for unit in units) and not fields:
            of = self._term_counts([unit[0] for unit in units])
            many = [of[unit[0]][0] for unit in units]
        else:  # how many rows hold a phrase, or a word in some fields, only the places tell
            many = counted.agg(*(F.count(F.when(F.col(f"_tf{i}") > 0, 1)) for i in range(len(units)))).first()
        return Found(self._with_columns(self._scored(counted, [self._idf(n) for n in many]), list(filters)), True)

    def page(self, text: str, limit: int = 20, offset: int = 0, filters: list[Column] = (), exact: Column | None = None) -> DataFrame:
        """A page of the hits: those for which `exact` holds first, then by score, then by key.

        For queries of single words, the best blocks of each word give a first threshold: the score of the last row of the
        page among what they hold. A row in the page has at least that, so that blocks of a word are read only if what they
        can add, with the most that the other words can, comes to it. Phrases are counted from all their postings.
        """
        if limit < 1 or offset < 0:
            raise ValueError("limit is at least 1, offset at least 0")
        first = F.coalesce(exact, F.lit(False)) if exact is not None else F.lit(False)

        def shown(hits: DataFrame) -> DataFrame:
            best = hits.withColumn("_exact", first).orderBy(F.desc("_exact"), "score", self.key).offset(offset).limit(limit)
            return best.drop("_exact")

        units = self.units(text)
        if not units or any(len(unit) > 1 for unit in units):
            return shown(self.search(text, filters).hits)
        least, idf = self.bounds(text, offset + limit, filters)
        terms = [unit[0] for unit in units]
        hits = self._with_columns(self._scored(self._counted(self.entries(terms, least), units, []), idf), list(filters))
        if exact is not None and least:  # rows that come first whatever their score
            ahead = self.rows().where(first).where(all_of(list(filters))).select(self.key)
            counted = self._counted(self.entries(terms).join(ahead, self.key, "left_semi"), units, [])
            hits = hits.where(~first).unionByName(self._with_columns(self._scored(counted, idf), list(filters)).where(first))
        return shown(hits)

    def bounds(self, text: str, k: int, filters: list[Column] = ()) -> tuple[dict[str, float], list[float]]:
        """For a query of single words: what each word's blocks must reach to hold a row of the k best, and the words' weights."""
        units = self.units(text)
        terms = [unit[0] for unit in units]
        of = self._term_counts(terms)
        idf = [self._idf(of[t][0]) for t in terms]
        most = [w * of[t][1] for w, t in zip(idf, terms, strict=True)]
        blocks = self._blocks(terms).select("term", "reach")
        take = max(1, 4 * k // BLOCK)
        while take * BLOCK < 4 * max(n for n, _ in of.values()):
            best = {t: blocks.where(F.col("term") == t).orderBy(F.desc("reach")).limit(take).agg(F.min("reach")).first()[0] or 0.0 for t in set(terms)}
            some = self._with_columns(self._scored(self._counted(self.entries(terms, best), units, []), idf), list(filters))
            kept = [r.score for r in some.orderBy("score").limit(k).select("score").collect()]
            if len(kept) == k:
                worth, least = -kept[-1] / (K1 + 1), {}
                for t in set(terms):  # a word asked for twice counts twice
                    others = sum(m for m, u in zip(most, terms, strict=True) if u != t)
                    least[t] = (worth - others) / sum(w for w, u in zip(idf, terms, strict=True) if u == t)
                return least, idf
            take *= 16
        return {}, idf

    # Change

    def _commit(self, **changes) -> Index:
        """A manifest after this one; another that came meanwhile is an error."""
        self.spark.createDataFrame([(json.dumps(self.about | changes),)], "value string").coalesce(1).write.mode("error").text(f"{self.path}/manifest/v={self.version + 1}")
        return Index(self.spark, self.path)

    def _killed(self, keys: DataFrame) -> dict:
        """Write which versions of the keys are dead from now on; the changes to the manifest."""
        old = self._rows().join(keys.select(self.key).distinct(), self.key, "left_semi")
        at = uuid.uuid4().hex
        old.select(self.key, "of", "length", "terms").write.parquet(f"{self.path}/data/{at}/versions")
        dead = self.spark.read.schema(StructType([self.columns[self.key], StructField("of", StringType()), *self._row_schema.fields[-2:]])).parquet(f"{self.path}/data/{at}/versions")
        by = {r.of: (r.n, r.length) for r in dead.groupBy("of").agg(F.count("*").alias("n"), F.sum("length").alias("length")).collect()}  # a row a segment
        if not by:
            return {}
        dead.select("of", F.explode("terms").alias("term")).groupBy("of", "term").agg(F.count("*").alias("n")).sort("term").write.parquet(f"{self.path}/data/{at}/lost")
        segments = [s | {"dead_rows": s["dead_rows"] + by.get(s["id"], (0, 0))[0], "dead_length": s["dead_length"] + by.get(s["id"], (0, 0))[1]} for s in self.segments]
        return {"segments": segments, "dead": [*self.about["dead"], at]}

    def add(self, df: DataFrame) -> Index:
        """The index with the rows of df, in place of those of the same keys. A null or repeated key raises an error."""
        df = df.select(*self.columns.names, *self.fields)
        wrong = df.groupBy(self.key).count().where(F.col(self.key).isNull() | (F.col("count") > 1)).first()
        if wrong:
            raise ValueError(f"{self.key} {wrong[0]} is " + ("no key" if wrong[0] is None else f"the key of {wrong['count']} rows"))
        changes = self._killed(df) if self.segments else {}
        at_once = 2 * self.spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < at_once:  # a few large files would keep as few tasks busy
            df = df.repartition(at_once, self.key)
        words = F.array(*(tokens(F.col(f), fold=self.analyzer != "plain") for f in self.fields))
        own = uuid.uuid4().hex
        self._split(df.select(*self.columns.names, words.alias("_words"))).write.option("parquet.block.size", 32 << 20).parquet(f"{self.path}/data/{own}/raw")
        raw = self.spark.read.schema(self._raw_schema).parquet(f"{self.path}/data/{own}/raw")
        posted = raw.where("term is not null").select("term", F.col(self.key).alias("key"), F.col("length").cast("int").alias("length"), "places")
        new = self._written(own, raw.where("term is null").select(*self._row_schema.names), posted)
        _delete(self.spark, f"{self.path}/data/{own}/raw")
        return self._commit(**(changes | {"segments": [*changes.get("segments", self.segments), *new]}))._merged()

    def remove(self, keys: DataFrame) -> Index:
        """The index without the rows of keys."""
        changes = self._killed(keys)
        return self._commit(**changes) if changes else self

    @property
    def _raw_schema(self) -> StructType:
        return StructType([*self._row_schema.fields, StructField("term", StringType()), StructField("places", ArrayType(LongType()))])

    def _split(self, words: DataFrame) -> DataFrame:
        """Texts as words (key, columns, _words by field), once through.

        A line for each row (columns, length, terms), and one for each of its terms (term, key, length, places: field
        number and position). Words stay in Arrow columns: only a portion's different ones become Python objects.
        """
        analyzer, names, key = self.analyzer, self.columns.names, self.key
        schema = to_arrow_schema(self._raw_schema)

        def run(batches):
            root = _root(analyzer)
            for batch in (part for whole in batches for part in portions(whole, len(names), PORTION)):
                own = batch.column(len(names)).flatten()  # a list a row and field
                lens, words = own.value_lengths().to_numpy(zero_copy_only=False).astype("int64"), own.flatten().dictionary_encode()
                fields = len(own) // batch.num_rows
                begins = np.arange(len(own)) % fields * _FIELD - (np.cumsum(lens) - lens)
                # equal terms of a row side by side, in the order of their places
                filed = pa.array([root(w) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
                at = filed.indices.to_numpy()[words.indices.to_numpy()] + np.repeat(np.arange(len(own)) // fields, lens) * len(filed.dictionary)
                order = np.argsort(at, kind="stable")
                at = at[order]
                starts = np.flatnonzero(np.diff(at, prepend=-1))
                row, term = np.divmod(at[starts], max(len(filed.dictionary), 1))
                places = pa.ListArray.from_arrays(np.append(starts, len(at)).astype("int32"), (np.arange(len(at)) + np.repeat(begins, lens))[order])
                terms = filed.dictionary.take(pa.array(term))
                held = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype("int32"), terms)
                length = pa.array(lens.reshape(-1, fields).sum(axis=1), pa.int64())
                columns = {c: batch.column(k) for k, c in enumerate(names)}
                rows = columns | {"length": length, "terms": held}
                posted = {"term": terms, "places": places, "length": length.take(pa.array(row)), key: columns[key].take(pa.array(row))}
                for found, n in ((rows, batch.num_rows), (posted, len(row))):
                    yield pa.RecordBatch.from_arrays([found.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in schema], schema=schema)

        return words.mapInArrow(run, self._raw_schema)

    def _written(self, own: str, rows: DataFrame, raw: DataFrame) -> list[dict]:
        """Write a segment of rows and postings (term, key, length, places); what the manifest says of it (nothing for no rows)."""
        at = f"{self.path}/data/{own}"
        rows.write.parquet(f"{at}/rows")
        n, length = self.spark.read.schema(self._row_schema).parquet(f"{at}/rows").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if not n:
            return []
        counts = raw.groupBy("term").agg(F.count("*").alias("n"))
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        buckets, most = min(4096, 8 + total // BUCKET), max(HEAVY, total // 10_000)
        spread = math.ceil(max(total, 1) / buckets / TASK)
        light = F.pmod(F.xxhash64("term"), F.lit(spread))
        each = raw.withColumn("bucket", (F.crc32(F.encode("term", "UTF-8")) % buckets).cast("int")).withColumn("deal", light)
        if total > most:
            heavy = counts.where(F.col("n") > most).select("term", F.ceil(F.col("n") / most).alias("deals"))  # at most 10,000 terms
            each = each.join(F.broadcast(heavy), "term", "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64("key"), "deals"), "deal"))
        each = each.withColumn("tf", F.size("places")).withColumn("impact", _impact(max(length / n, 1e-9)))
        # one shuffle, over as many tasks as there are postings for: a task sorts its own, and sorts their blocks once more for the files
        tasks = buckets * spread
        dealt = each.select("bucket", "deal", "term", "impact", "key", "length", "places").repartitionById(tasks, F.pmod(F.col("bucket") * spread + F.col("deal"), F.lit(tasks)).cast("int"))
        blocks = self._made(dealt.sortWithinPartitions("bucket", "deal", "term", F.desc("impact"), "key")).sortWithinPartitions("bucket", "term", F.desc("impact"))
        blocks.write.partitionBy("bucket").option("parquet.block.size", 4 << 20).option("parquet.page.row.count.limit", 64).parquet(f"{at}/postings")
        return [{"id": own, "rows": n, "length": length, "dead_rows": 0, "dead_length": 0, "buckets": buckets}]

    def _made(self, postings: DataFrame) -> DataFrame:
        """Blocks of postings that lie in the order of bucket, deal and term, best rows first; a task holds a batch of them."""
        kind = StructType.fromDDL(self._block_schema)
        schema = to_arrow_schema(kind)

        def run(batches):
            entries = schema.field("entries").type
            for rows, begins in in_blocks(batches, BLOCK):
                first, many = pa.array(begins), np.diff(np.append(begins, rows.num_rows))
                held = pa.StructArray.from_arrays([rows.column(f.name).cast(f.type) for f in entries.value_type], fields=list(entries.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.append(begins, rows.num_rows), pa.int32()), held, type=entries)
                found = {"n": pa.array(many), "entries": lists}
                columns = (found[f.name] if f.name in found else rows.column(f.name).take(first) for f in schema)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return postings.mapInArrow(run, kind)

    def _merged(self) -> Index:
        """The index with segments of like size made one, until no FANOUT are alike."""
        tiers: dict[int, list[dict]] = {}
        for s in self.segments:
            tiers.setdefault(int(math.log(max(s["rows"] - s["dead_rows"], 1), 4)), []).append(s)
        alike = next((own for _, own in sorted(tiers.items()) if len(own) >= FANOUT), None)
        if not alike:
            return self
        ids = {s["id"] for s in alike}
        part = Index(self.spark, self.path)
        part.about = self.about | {"segments": alike}
        blocks = reduce(DataFrame.unionByName, (self._stored_blocks(s).select("term", F.lit(s["id"]).alias("of"), "entries") for s in alike))
        new = self._written(uuid.uuid4().hex, part._rows().select(*self._row_schema.names), part._entries(blocks).withColumnRenamed(self.key, "key"))
        return self._commit(segments=[s for s in self.segments if s["id"] not in ids] + new)._merged()

    def clean(self) -> None:
        """Delete what only earlier manifests speak of. Results that still read it must have been used before."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        at = hadoop.Path(f"{self.path}/data")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        there = {s["id"] for s in self.segments} | set(self.about["dead"])
        for own in files.listStatus(at) if files.exists(at) else ():
            if own.getPath().getName() not in there:
                files.delete(own.getPath(), True)

    def drop(self) -> None:
        """Delete the index. Results that still read it must have been used before."""
        _delete(self.spark, self.path)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def create_index(spark: SparkSession, path: str, columns: StructType, key: str, fields: list[str], analyzer: str = "plain") -> Index:
    """An empty index under path for rows of a schema: key, other columns kept with the hits, and the fields searched.

    analyzer: "plain" files words in lower case; "stem" files the stems of words without diacritics, and so for queries.
    """
    if analyzer not in ("plain", "stem"):
        raise ValueError(f"analyzer {analyzer} is none of plain, stem")
    kept = StructType([f for f in columns.fields if f.name not in fields])
    about = {"key": key, "fields": list(fields), "analyzer": analyzer, "columns": json.loads(kept.json()), "segments": [], "dead": []}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("error").text(f"{path.rstrip('/')}/manifest/v=0")
    return Index(spark, path)


def write_index(df: DataFrame, key: str, fields: list[str], path: str, analyzer: str = "plain") -> Index:
    """A new index of df under path; what is there is replaced."""
    _delete(df.sparkSession, path)
    return create_index(df.sparkSession, path, df.schema, key, fields, analyzer).add(df)


def search_index(spark: SparkSession, path: str, text: str, filters: list[Column] = (), fields: list[str] = ()) -> Found:
    """Search the index stored under path."""
    return Index(spark, path).search(text, filters, fields)


def document_scope(df: DataFrame, key: str, order: str, wanted: str | None = None) -> DataFrame:
    """Rows of one document: the one asked for (in any case), else the one inserted last."""
    if wanted:
        return df.where(F.col(key) == wanted.lower())
    last = df.agg(F.max_by(key, order).alias(key))  # one row
    return df.join(F.broadcast(last), key, "left_semi")


def rules_named(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """Rows whose designation or id is the name, in any case, with hyphens or spaces."""
    same = lambda c: F.upper(F.replace(c, F.lit(" "), F.lit("-"))) == name.replace(" ", "-").upper()
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(same(F.col(c)), F.lit(False))
    return df.where(out)


def is_state(column: str, wanted: bool | None) -> Column:
    """A flag as asked for; None: no filter."""
    return F.lit(True) if wanted is None else F.col(column) == wanted
