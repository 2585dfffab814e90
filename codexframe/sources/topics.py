"""Topics of word-processor packages: type, designation, title and text from their own and the export's metadata."""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexframe.functions import metadata
from codexframe.functions.text import designation_of_lines, ed_decision, leading_designation
from codexframe.sources import bodies, packages, sections

_EXPORT = bodies.PUBLISHER[1]


def export_metadata(parts: DataFrame) -> DataFrame:
    """Attributes of the export document and its topics: package, sdt_id (null for the document), ord, name, value.

    Read from the custom XML parts whose root is the export's; those of properties and relationships are left out.
    """
    schema = pa.schema([("package", pa.string()), ("part", pa.string()), ("sdt_id", pa.string()), ("ord", pa.int64()), ("name", pa.string()), ("value", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for package, part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    root = ElementTree.fromstring(raw)
                except ElementTree.ParseError:
                    continue
                if root.tag != f"{_EXPORT}document":
                    continue
                held = [(None, root), *((e.get("sdt-id") or e.get("sdt_id"), e) for e in root.iter(f"{_EXPORT}topic"))]
                for sdt_id, element in held:
                    if element is root or sdt_id:
                        rows += [(package, part, sdt_id, len(rows) + k, name, value) for k, (name, value) in enumerate(element.attrib.items())]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    low = F.lower("part")
    custom = F.contains(low, F.lit("customxml")) & ~F.contains(low, F.lit("props")) & ~F.endswith(low, F.lit(".rels"))
    rows = parts.where(custom & F.col("data").isNotNull()).select("package", "part", "data").mapInArrow(run, "package string, part string, sdt_id string, ord long, name string, value string")
    one = rows.groupBy("package").agg(F.min("part").alias("part"))  # one export document a package
    return rows.join(one, ["package", "part"]).select("package", "sdt_id", "ord", "name", "value")


def core_properties(parts: DataFrame) -> DataFrame:
    """Title, dates, revision and company of every package: package and a column each."""
    names = ("title", "created", "modified", "revision", "company")
    schema = pa.schema([("package", pa.string()), ("name", pa.string()), ("value", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for package, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    root = ElementTree.fromstring(raw)
                except ElementTree.ParseError:
                    continue
                rows += [{"package": package, "name": local, "value": e.text.strip()} for e in root.iter() if (local := e.tag.rpartition("}")[2].lower()) in names and e.text]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = parts.where(F.col("part").isin("docProps/core.xml", "docProps/app.xml") & F.col("data").isNotNull()).select("package", "data").mapInArrow(run, "package string, name string, value string")
    return rows.groupBy("package").agg(*(F.min(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))


def topic_kind(content_types: Column, title: Column, designation: Column, erules_id: Column) -> Column:
    """acceptable_means, guidance, requirement or section: by content types in their order, then by names, then by a designation."""
    def of_type(t):
        low = F.lower(t)
        starts = lambda *words: F.coalesce(*(F.when(F.startswith(low, F.lit(w)), True) for w in words), F.lit(False))
        return (
            F.when(F.contains(low, F.lit("acceptable means")) | starts("amc"), "acceptable_means").when(F.contains(low, F.lit("guidance")) | starts("gm"), "guidance")
            .when(F.contains(low, F.lit("certification")) | (low == "cs") | starts("cs ", "cs ("), "requirement")
        )

    typed = F.get(F.array_compact(F.transform(F.coalesce(content_types, F.array().cast("array<string>")), of_type)), F.lit(0))
    names = F.array(*(F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in (title, designation, erules_id)))
    named = F.get(F.array_compact(F.transform(names, lambda n: F.when(F.startswith(n, F.lit("AMC")), "acceptable_means").when(F.startswith(n, F.lit("GM")), "guidance"))), F.lit(0))
    coded = (F.coalesce(designation, F.lit("")) != "") | leading_designation(title, require_number=True).isNotNull() | (leading_designation(title).isNotNull() & F.startswith(F.upper(title), F.lit("CS")))
    return F.coalesce(typed, named, F.when(coded, "requirement"), F.lit("section"))


def topics(nodes: DataFrame, export: DataFrame) -> DataFrame:
    """One row a topic or section of body nodes: package, ord, parent, kind, designation, title, erules_id, regulatory_source, body.

    A structured tag takes title and id from the export topic of its number, else from its first lines; its designation
    is that of the title, of one of its first three lines, or a bare code that is hardly shorter than the title.
    """
    own = nodes.where("node_type in ('topic', 'section')").select("package", "ord", F.col("topic").alias("parent"), "node_type", "sdt_id", "erules_id", "title", "lines", "meta")
    exported = metadata.normalized(export.where("sdt_id is not null").withColumnRenamed("sdt_id", "tag"), ["package", "tag"])
    exported = exported.select("package", F.col("tag").alias("sdt_id"), F.trim(F.replace("source_title", F.lit("\u00a0"), F.lit(" "))).alias("x_title"), F.col("erules_id").alias("x_id"), F.col("type_of_content").alias("x_types"), F.col("regulatory_source").alias("x_source"))
    inline = own.where(F.size("meta") > 0).select("package", "ord", F.posexplode("meta").alias("o", "m")).select("package", F.col("ord").alias("topic"), F.col("o").alias("ord"), "m.name", "m.value")
    inline = metadata.normalized(inline, ["package", "topic"]).select("package", F.col("topic").alias("ord"), F.col("type_of_content").alias("i_types"), F.col("regulatory_source").alias("i_source"))
    both = own.join(exported, ["package", "sdt_id"], "left").join(inline, ["package", "ord"], "left")
    given = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c))
    first = F.get("lines", F.lit(0))
    tagged, heading = F.col("lines").isNotNull(), F.col("node_type") == "section"
    title = F.when(heading, given(F.substring(first, 1, 200), F.lit("Heading"))).when(tagged, given(F.col("x_title"), F.substring(first, 1, 300), F.lit("Untitled topic"))).otherwise(F.coalesce("title", F.lit("")))
    both = both.withColumn("title", title).withColumn("bare", leading_designation(F.col("title")))
    numbered = leading_designation(F.col("title"), require_number=True)
    of_tag = F.coalesce(numbered, designation_of_lines(F.slice("lines", 1, 3)), F.when(F.length("title") <= F.length("bare") + 8, F.col("bare")))
    of_element = F.coalesce(numbered, F.col("bare"), F.when(~F.startswith(F.upper("erules_id"), F.lit("ERULES")), F.nullif(F.col("erules_id"), F.lit(""))))
    both = both.withColumn("designation", F.coalesce(F.when(heading, numbered).when(tagged, of_tag).otherwise(of_element), F.lit("")))
    both = both.withColumn("erules_id", F.coalesce(F.when(tagged, given(F.col("x_id"), F.col("designation"))).otherwise(F.col("erules_id")), F.lit("")))
    hint = F.when(tagged, F.col("designation"))  # an element's designation may be its id, which proves nothing
    kind = F.when(heading, "section").otherwise(topic_kind(F.coalesce(F.when(F.size("x_types") > 0, F.col("x_types")), F.col("i_types")), F.col("title"), hint, F.col("erules_id")))
    decision = F.get(F.array_compact(F.transform(F.slice("lines", 1, 3), ed_decision)), F.lit(0))
    source = F.coalesce(*(F.when(F.size(c) > 0, F.array_join(c, "; ")) for c in ("x_source", "i_source")), decision)
    held = nodes.where("node_type in ('paragraph', 'heading', 'list_item', 'cell') and topic is not null").groupBy("package", F.col("topic").alias("ord"))
    body = held.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("body"))
    out = both.withColumns({"kind": kind, "regulatory_source": source}).join(body, ["package", "ord"], "left")
    return out.select("package", "ord", "parent", "kind", "designation", "title", "erules_id", "regulatory_source", F.coalesce("body", F.lit("")).alias("body"))


def all_topics(files: DataFrame) -> DataFrame:
    """Topics of packages of any kind (package, content), each by its own parser: package, ord, kind, designation, title, body."""
    kind = packages.source_kind(F.col("content"))
    numbered = sections.topics(sections.section_nodes(files.where(kind == "ecfr"))).withColumn("kind", F.lit("requirement"))
    parts = packages.stored_parts(files.where(kind != "ecfr"))
    columns = ["package", "ord", "kind", "designation", "title", "body"]
    main = packages.role_parts(parts, packages.relationships(parts)).where("role = 'main'")
    return topics(bodies.body_nodes(parts, main), export_metadata(parts)).select(columns).unionByName(numbered.select(columns))


def publication_metadata(nodes: DataFrame, export: DataFrame, core: DataFrame | None = None) -> DataFrame:
    """Metadata of every package: the export document's, overlaid by the body's own.

    With core properties (as core_properties gives them), their columns are added, and packages that have no more than these are
    there as well; title is the source's title, else theirs.
    """
    inline = nodes.where("node_type = 'metadata' and topic is null").select("package", "ord", F.posexplode("meta").alias("o", "m")).select("package", (F.col("ord") * 1000 + F.col("o")).alias("ord"), "m.name", "m.value")
    document = export.where("sdt_id is null").select("package", "ord", "name", "value")
    found = metadata.overlaid(metadata.normalized(document, ["package"]), metadata.normalized(inline, ["package"]), ["package"])
    if core is None:
        return found
    both = found.join(core.withColumnRenamed("title", "_title"), "package", "full").withColumn("title", F.coalesce(F.nullif("source_title", F.lit("")), "_title")).drop("_title")
    return both.withColumns({f: F.coalesce(f, F.array().cast("array<string>")) for f in metadata.LISTS})
