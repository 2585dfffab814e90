"""References between topics: resolution with fallbacks, edges, degrees, and requirement-to-material relations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexframe.sources.work import dealt


def resolve(refs: DataFrame, targets: DataFrame, keys: list, wanted: str, target: str, order: str) -> DataFrame:
    """Left join of refs to the first target (in its order) that any of the keys, tried in turn, equals.

    keys: columns over refs, best first. The first-declared target of a name wins. One equi-join over the exploded keys.
    Neither side is broadcast: both grow with the references, and estimates from a small file don't see what it became.
    """
    named = targets.groupBy(F.col(wanted).alias("_key")).agg(F.min_by(target, order).alias("_target"))
    # equal references have equal targets: the keys themselves tell them apart, and no row number is needed
    tried = refs.withColumn("_keys", F.array(*keys))
    probes = tried.select("_keys").distinct().select("_keys", F.posexplode("_keys").alias("_step", "_key")).where("_key is not null")
    best = probes.join(named.hint("merge"), "_key").groupBy("_keys").agg(F.min_by("_target", "_step").alias(target), F.min("_step").alias("step"))
    return tried.join(best.withColumnRenamed("_keys", "_own").hint("merge"), F.col("_keys").eqNullSafe(F.col("_own")), "left").drop("_keys", "_own")


def unresolved(refs: DataFrame, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Distinct references whose target doesn't exist."""
    return refs.join(targets.select(F.col(target_key).alias(key)), key, "left_anti").distinct()


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Outgoing and incoming edges of every node that has any: node, n_out, n_in."""
    ends = edges.select(F.col(source).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col(target).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def prefix_matches(candidates: DataFrame, candidate: str, requirements: DataFrame, requirement: str, order: str) -> DataFrame:
    """First requirement (in its order) that a candidate starts with, at a boundary: an equi-join over its prefixes."""
    prefixes = F.transform(F.sequence(F.lit(1), F.length(candidate)), lambda n: F.substring(F.col(candidate), F.lit(1), n))
    ends = F.filter(prefixes, lambda p: (F.length(p) == F.length(candidate)) | ~F.substring(F.col(candidate), F.length(p) + 1, F.lit(1)).rlike("[0-9A-Za-z]"))
    probes = candidates.select(candidate, F.explode(ends).alias(requirement)).distinct()
    return probes.join(requirements, requirement).groupBy(candidate).agg(F.min_by(requirement, order).alias(requirement))


def siblings(pairs: DataFrame, material: str, requirement: str, rows: int = 500_000) -> DataFrame:
    """Materials of the same requirement, each other: material, sibling.

    A task gets about so many rows, before and after the join: it holds what it has seen of them. Pairs are made and
    compared one way round, and turned at the end.
    """
    known = pairs.where(F.col(material).isNotNull() & F.col(requirement).isNotNull()).select(material, requirement)
    known = dealt(known, requirement, rows=rows).distinct()
    n = F.count("*")
    made = known.groupBy(requirement).agg((n * (n - 1) / 2).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0]  # one row
    other = known.select(F.col(material).alias("sibling"), requirement)
    both = known.join(other, requirement).where(F.col(material) < F.col("sibling")).select(material, "sibling")
    # by number, not by bytes: a map of pairs is far larger than what was shuffled
    once = both.repartition(max(pairs.sparkSession.sparkContext.defaultParallelism, math.ceil(made / rows)), material, "sibling").distinct()
    ways = F.array(F.struct(F.col(material), F.col("sibling")), F.struct(F.col("sibling").alias(material), F.col(material).alias("sibling")))
    return once.select(F.explode(ways).alias("w")).select(f"w.{material}", "w.sibling")


def without_overlaps(spans, start: str = "start", end: str = "end"):
    """Spans (array of structs) by start, longest first, without those that overlap one already taken."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s[start].alias("start"), (-s[end]).alias("back"))))
    taken = F.aggregate(
        ordered,
        F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("kept")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct((-s["back"]).alias("at"), F.concat(acc["kept"], F.array(F.struct(s["start"].alias("start"), (-s["back"]).alias("end")))).alias("kept"))).otherwise(acc),
    )
    return taken["kept"]


def edges(refs: DataFrame, topics: DataFrame) -> DataFrame:
    """References (source, target: designations or ids) with both ends looked up in topics (node_id, designation): source_id, target_id.

    A designation goes before an id, and the first declared topic (least node_id) before others; ends not found are null.
    """
    named = topics.where("designation <> ''").groupBy(F.col("designation").alias("_key")).agg(F.min("node_id").alias("_by_name"))
    ids = topics.select(F.col("node_id").alias("_key"), F.col("node_id").alias("_by_id")).distinct()
    out = refs
    for end in ("source", "target"):
        found = named.join(ids, "_key", "full").select(F.col("_key").alias(end), F.coalesce("_by_name", "_by_id").alias(f"{end}_id"))
        out = out.join(found, end, "left")
    return out


def edge_lists(found: DataFrame) -> DataFrame:
    """Of every topic with an edge (source_id, target_id): node_id, and the sorted topics it refers to and is referred to by."""
    ends = found.where("source_id is not null and target_id is not null").select(F.explode(F.array(F.struct(F.col("source_id").alias("node_id"), F.col("target_id").alias("to"), F.lit(None).cast("string").alias("by")), F.struct(F.col("target_id").alias("node_id"), F.lit(None).cast("string").alias("to"), F.col("source_id").alias("by")))).alias("e")).select("e.*")
    return ends.groupBy("node_id").agg(F.sort_array(F.collect_set("to")).alias("refers_to"), F.sort_array(F.collect_set("by")).alias("referred_by"))


def relation_map(materials: DataFrame, requirements: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Pairs (material, requirement) by all evidence.

    materials: (material, designation, title, targets array); requirements: (requirement, designation, ord);
    references: (material, target). Targets that metadata, designation, title or references name are compared in one
    form, as a whole or as what starts with a requirement (at a boundary, the first declared one); a material's suffix
    must be a requirement exactly.
    """
    from codexframe.functions.relations import named_requirements, relation_key, requirement_by_suffix

    known = requirements.select(relation_key(F.col("designation")).alias("key"), "requirement", "ord").where("key <> ''").groupBy("key").agg(F.min_by("requirement", "ord").alias("requirement"), F.min("ord").alias("ord"))
    named = F.concat(F.coalesce("targets", F.array().cast("array<string>")), named_requirements(F.concat_ws(" ", "designation", "title")))
    candidates = materials.select("material", F.explode(named).alias("c"))
    if references is not None:
        candidates = candidates.unionByName(references.select("material", F.col("target").alias("c")))
    candidates = candidates.select("material", relation_key(F.col("c")).alias("c")).where("c <> ''").distinct()
    prefixes = F.transform(F.sequence(F.lit(1), F.length("c")), lambda n: F.substring(F.col("c"), F.lit(1), n))
    whole = F.filter(prefixes, lambda p: ~F.substring(F.col("c"), F.length(p) + 1, F.lit(1)).rlike("[0-9]"))
    probes = candidates.select("material", "c", F.explode(whole).alias("key"))
    hit = probes.join(known, "key").groupBy("material", "c").agg(F.min_by("requirement", F.struct(F.when(F.col("key") == F.col("c"), 0).otherwise(1), "ord")).alias("requirement"))
    suffix = materials.select("material", requirement_by_suffix(F.col("designation")).alias("key")).join(known, "key")
    return hit.select("material", "requirement").unionByName(suffix.select("material", "requirement")).distinct()
