"""References that texts make: found in runs of text, resolved once, and stored by what they come from and lead to.

Nodes are those of `trees`: (keys, ord, depth, type, attributes) in pre-order. A document's nodes are sorted once; runs of
text beside each other are matched as one text, since publishers cut designations anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexframe.functions.citations import citations_of, found
from codexframe.functions.text import base_designation, canonical_designation
from codexframe.operators.references import resolve
from codexframe.operators.trees import TOPICS, ancestors, attributed
from codexframe.sources.work import shared_path

#: A reference as the body reader finds it in one run, whatever the case, and the formats whose runs it leaves alone (fixed values).
IN_RUN = r"(?iU)(?:AMC\d*|GM\d*)\s+CS[-\s]?[A-Z0-9]+(?:\.\d+)?|CS[-\s]?[A-Z0-9]+(?:\.\d+)+"
FORMATS = ["bold", "italic", "superscript", "subscript"]
#: What every citation in running text has in it.
_HINT = "CS|AMC|GM|§|CFR"


def _nearest(test) -> Column:
    return F.get(F.reverse(F.filter("_above", test)), F.lit(0))


def _laid(nodes: DataFrame, keys: list[str], outside: list[str], join_runs: bool, hint: str, find) -> DataFrame:
    """nodes with the hits that find(text, own designation) has in runs of text outside some types laid into them, numbered anew."""
    named = F.nullif(canonical_designation(F.coalesce("designation", F.lit(""))), F.lit(""))
    plain = attributed(nodes)
    columns = [c for c in plain.columns if c not in keys]
    kinds = {f.name: f.dataType for f in plain.schema.fields}
    own = plain.withColumn("_own", F.when(F.col("type").isin(TOPICS), named))
    placed, _ = ancestors(own, keys, F.struct("type", "_own"))
    order = Window.partitionBy(*keys).orderBy("ord")
    searched = (F.col("type") == "text") & ~F.exists("_above", lambda a: a["type"].isin(outside))
    beside = (F.lag("type").over(order) == "text") & (F.lag("depth").over(order) == F.col("depth")) if join_runs else F.lit(False)
    placed = placed.withColumns({"_text": F.when(searched, F.coalesce("text", F.lit(""))), "_starts": ~F.coalesce(searched & beside, F.lit(False)), "_own": _nearest(lambda a: a["_own"].isNotNull())["_own"]})
    run = F.last(F.when(F.col("_starts"), F.col("ord")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # a run is as long as its paragraph; any other node is a run by itself
    members = F.sort_array(F.collect_list(F.struct(F.col("ord").alias("_at"), "_text", F.struct(*columns).alias("n"))))
    runs = placed.withColumn("_run", run).groupBy(*keys, "_run").agg(members.alias("_members"), F.first("_own").alias("_own"))
    runs = runs.withColumn("_whole", F.array_join(F.transform("_members", lambda m: m["_text"]), ""))
    none = F.array().cast("array<struct<start:int,end:int,designation:string>>")
    runs = runs.withColumn("_hits", F.when(F.col("_whole").rlike(hint), find(F.col("_whole"), F.col("_own"))).otherwise(none))
    first = F.get("_members", F.lit(0))["n"]

    def piece(**values):
        return F.struct(*((values[c] if c in values else first[c] if c in ("ord", "depth") else F.lit(None)).cast(kinds[c]).alias(c) for c in columns))

    between = lambda a, b: piece(type=F.lit("text"), text=F.substring(F.col("_whole"), a + 1, b - a))
    before = lambda i: F.when(i == 0, 0).otherwise(F.get("_hits", i - 1)["end"])
    cited = lambda h: piece(type=F.lit("internal_reference"), text=F.substring(F.col("_whole"), h["start"] + 1, h["end"] - h["start"]), target_designation=h["designation"], detected=F.lit(True))
    pieces = F.flatten(F.transform("_hits", lambda h, i: F.array(between(before(i), h["start"]), cited(h))))
    tail = between(F.element_at("_hits", -1)["end"], F.length("_whole"))
    laid = F.filter(F.concat(pieces, F.array(tail)), lambda p: p["text"] != "")
    out = runs.select(*keys, "_run", F.posexplode(F.when(F.size("_hits") > 0, laid).otherwise(F.transform("_members", lambda m: m["n"]))).alias("_pos", "n"))
    return out.select(*keys, "_run", "_pos", "n.*").withColumn("ord", (F.row_number().over(Window.partitionBy(*keys).orderBy("_run", "_pos")) - 1).cast(kinds["ord"])).drop("_run", "_pos")


def detected(nodes: DataFrame, keys: list[str], authority: str = "") -> DataFrame:
    """nodes with the citations of running text as internal references, their text kept letter by letter.

    Neighbouring runs of plain text are matched as one. Headings and references given already are left alone, and what
    cites the topic that it lies in (the nearest with a designation) stays text. Nulls count as empty; no nodes give none.
    """
    return _laid(nodes, keys, ["heading", "internal_reference"], True, _HINT, lambda text, own: citations_of(text, authority, own))


def parsed(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """nodes with the references that the body reader finds, run by run, outside formats and references; also a topic's own."""

    def find(text, own):
        def hit(h):
            clean = F.trim(F.regexp_replace(h["text"], r"(?U)\s+", " "))
            material = F.regexp_replace(clean, r"(?i)^((?:AMC|GM)\d*) CS ", "$1 CS-")
            return F.struct(h["start"], h["end"], F.when(clean.rlike("(?i)^(?:AMC|GM)"), material).otherwise(F.replace(clean, F.lit(" "), F.lit("-"))).alias("designation"))

        return F.transform(found(text, IN_RUN), hit)

    return _laid(nodes, keys, [*FORMATS, "internal_reference"], False, "(?i)CS", find)


def reference_index(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One row a reference: keys, ord, the topic it lies in (source_ord, source_id, source_designation), text, target_designation,
    target_ord, target_id (null where nothing has that name), detected.

    A name is a designation or an ERules ID of the same document, the first declared; then upper-cased with hyphens for
    spaces (of such names, the last declared); then both without trailing groups.
    """
    placed, _ = ancestors(attributed(nodes), keys, F.struct("ord", "type", "node_id", "designation"))
    topic = _nearest(lambda a: a["type"].isin(TOPICS))
    is_ref = F.coalesce((F.col("type") == "internal_reference") & (F.col("target_designation") != ""), F.lit(False))
    named = F.filter(F.array("designation", "erules_id"), lambda n: n != "")
    # references and names are four times used: the nodes are gone through once, and what they say is written
    told = placed.select(
        *keys, "ord", "node_id", is_ref.alias("is_ref"), named.alias("names"), topic["ord"].alias("source_ord"), topic["node_id"].alias("source_id"), topic["designation"].alias("source_designation"),
        F.coalesce("text", F.lit("")).alias("text"), "target_designation", F.coalesce("detected", F.lit(False)).alias("detected"),
    ).where(F.col("is_ref") | (F.size("names") > 0))
    at = shared_path(nodes.sparkSession, "told")
    told.write.parquet(at)
    told = nodes.sparkSession.read.schema(told.schema).parquet(at)
    refs = told.where("is_ref").drop("is_ref", "names", "node_id")
    normal = lambda c: F.upper(F.replace(c, F.lit(" "), F.lit("-")))
    key = lambda kind, c: F.when(c.isNotNull(), F.struct(*keys, F.lit(kind).alias("kind"), c.alias("name")))
    said = told.select(*keys, F.struct("ord", "node_id").alias("target"), F.explode("names").alias("name"))
    first = said.groupBy(*keys, "name").agg(F.min("target").alias("target"))
    loose = first.groupBy(*keys, normal(F.col("name")).alias("name")).agg(F.max("target").alias("target"))
    names = first.select(key("exact", F.col("name")).alias("wanted"), "target").unionByName(loose.select(key("loose", F.col("name")).alias("wanted"), "target"))
    wanted = F.col("target_designation")
    base = F.nullif(F.trim(base_designation(wanted)), F.lit(""))
    tried = [key("exact", wanted), key("loose", normal(wanted)), key("exact", base), key("loose", normal(base))]
    return resolve(refs, names, tried, "wanted", "target", "target").drop("step").withColumns({"target_ord": F.col("target.ord"), "target_id": F.col("target.node_id")}).drop("target")


def linked(nodes: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """nodes whose references have the target_id that the index found."""
    known = index.where("target_id is not null").select(*keys, "ord", F.col("target_id").alias("_found"))
    return attributed(nodes).join(known, [*keys, "ord"], "left").withColumn("target_id", F.coalesce("_found", "target_id")).drop("_found")


class StoredReferences:
    """References in a shared folder: `edges` as they are, `sides` twice, by the topic they come from and the one they lead to.

    Sides lie in buckets by document and topic; how many there are is stored beside them. A bucket that one topic fills is
    split over files by range, so that no task writes or reads it whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        about = spark.read.parquet(f"{path}/about").first()
        self.spark, self.path, self.keys, self.buckets = spark, path, list(about["keys"]), about["buckets"]

    def edges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/edges")

    def context(self, occurrences: DataFrame, rule: str) -> DataFrame:
        """References of rules that occur at topics (keys, ord, rule): rule, side (outgoing or incoming) and what they say, each once.

        Only buckets of these topics are read.
        """
        asked = occurrences.select(*self.keys, F.col("ord").alias("at"), rule).withColumn("bucket", _bucket(self.keys, "at", self.buckets)).distinct()
        own = [r[0] for r in asked.select("bucket").distinct().collect()]  # as many as there are buckets at most
        sides = self.spark.read.parquet(f"{self.path}/sides").where(F.col("bucket").isin(own))
        said = sides.join(asked, [*self.keys, "at", "bucket"])
        return said.select(rule, "side", *self.keys, "source_id", "source_designation", "text", "target_designation", "target_id", "detected").distinct()


def _bucket(keys: list[str], at: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys, F.col(at).cast("long")), F.lit(buckets)).cast("int")


def store(spark: SparkSession, index: DataFrame, keys: list[str], path: str, rows_a_bucket: int = 2_000_000) -> StoredReferences:
    """Write an index of references; buckets come from its size. `about` is written last: without it there is no index."""
    index.write.parquet(f"{path}/edges")
    edges = spark.read.parquet(f"{path}/edges")
    buckets = max(1, math.ceil(2 * edges.count() / rows_a_bucket))
    ends = F.array(F.struct(F.lit("outgoing").alias("side"), F.col("source_ord").alias("at")), F.struct(F.lit("incoming").alias("side"), F.col("target_ord").alias("at")))
    sides = edges.withColumn("_end", F.explode(ends)).where("_end.at is not null").select(*edges.columns, "_end.*").withColumn("bucket", _bucket(keys, "at", buckets))
    sides.repartitionByRange("bucket", "side", *keys, "at", "ord").write.partitionBy("bucket").parquet(f"{path}/sides")
    spark.createDataFrame([(keys, buckets)], "keys array<string>, buckets int").coalesce(1).write.parquet(f"{path}/about")
    return StoredReferences(spark, path)
