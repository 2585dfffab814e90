"""Document packages as tables: flat XML packages and ZIP packages, one row a part, with content types and relationships.

Packages are read with Spark's binaryFile source, so that a task holds one package at a time; everything that relates
parts to each other is a join afterwards.
"""

from __future__ import annotations

import base64
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexframe.sources.work import shared_path

_PKG = "{http://schemas.microsoft.com/office/2006/xmlPackage}"
_TYPES = "[Content_Types].xml"
#: Content types by file name suffix where a package declares none (fixed values).
SUFFIX_TYPES = {"xml": "application/xml", "rels": "application/vnd.openxmlformats-package.relationships+xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "emf": "image/x-emf", "wmf": "image/x-wmf"}
PARTS = "package string, part string, declared string, data binary, error string"


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path or glob: package (its path), content."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("package"), "content")


def source_kind(content: Column) -> Column:
    """ecfr where the first 512 bytes open a DIV element, zip for ZIP archives, else flat."""
    start = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    return F.when(F.contains(start, F.lit("<DIV")), "ecfr").when(F.startswith(start, F.lit("PK")), "zip").otherwise("flat")


def _zip_parts(raw: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        for entry in archive.infolist():
            if not entry.is_dir():
                yield entry.filename.lstrip("/"), None, archive.read(entry)


def _flat_parts(raw: bytes) -> Iterator[tuple]:
    for part in ElementTree.fromstring(raw).iter(f"{_PKG}part"):
        name, declared = part.get(f"{_PKG}name", "").lstrip("/"), part.get(f"{_PKG}contentType") or "application/xml"
        data, binary = part.find(f"{_PKG}xmlData"), part.find(f"{_PKG}binaryData")
        if data is not None:
            yield name, declared, b"".join(ElementTree.tostring(x, encoding="utf-8") for x in data)
        elif binary is not None:
            yield name, declared, base64.b64decode("".join((binary.text or "").split()))


def parts(packages: DataFrame) -> DataFrame:
    """One row a part of every package (package, content): package, part, declared type, data, error.

    A package that can't be read gives one row with an error and no part; a null content counts as such.
    """
    schema = pa.schema([("package", pa.string()), ("part", pa.string()), ("declared", pa.string()), ("data", pa.binary()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            for package, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(package, *p, None) for p in (_zip_parts(raw) if raw[:2] == b"PK" else _flat_parts(raw))]
                except (ElementTree.ParseError, zipfile.BadZipFile, ValueError, TypeError) as error:
                    rows = [(package, None, None, None, f"{type(error).__name__}: {error}")]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return packages.select("package", "content").mapInArrow(run, PARTS)


def stored_parts(packages: DataFrame) -> DataFrame:
    """Parts as parts() gives them, taken out of the packages once and written to the shared folder.

    Readers look at some parts each; over stored parts their conditions on names reach the scan, and payloads of other parts
    are not read.
    """
    spark, at = packages.sparkSession, shared_path(packages.sparkSession, "parts")
    found = parts(packages)
    found.write.parquet(at)
    return spark.read.schema(found.schema).parquet(at)


def _xml_rows(df: DataFrame, where: Column, tags: dict[str, tuple[str, ...]], ddl: str) -> DataFrame:
    """Attributes of the elements of small XML parts: package, part, tag and the attributes by tag."""
    width = max(map(len, tags.values()))
    names = [c.split()[0] for c in ddl.split(", ")]
    schema = pa.schema([(n, pa.string()) for n in names])

    def run(batches):
        for batch in batches:
            rows = []
            for package, part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    root = ElementTree.fromstring(raw)
                except ElementTree.ParseError:
                    continue
                for e in root.iter():
                    tag = e.tag.rpartition("}")[2]
                    if tag in tags:
                        own = [e.get(a) for a in tags[tag]]
                        rows.append((package, part, tag, *own, *[None] * (width - len(own))))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=schema)

    return df.where(where & F.col("data").isNotNull()).select("package", "part", "data").mapInArrow(run, ddl)


def content_types(parts: DataFrame) -> DataFrame:
    """Content type of every part: its override, else its suffix's default, else the declared one, else by suffix."""
    rows = _xml_rows(parts, F.col("part") == _TYPES, {"Override": ("PartName", "ContentType"), "Default": ("Extension", "ContentType")}, "package string, part string, tag string, name string, type string")
    rows = rows.where("name is not null and type is not null")
    override = rows.where("tag = 'Override'").groupBy("package", F.regexp_replace("name", "^/+", "").alias("part")).agg(F.first("type").alias("override"))
    default = rows.where("tag = 'Default'").groupBy("package", F.lower("name").alias("suffix")).agg(F.first("type").alias("default"))
    named = parts.where("part is not null").select("package", "part", "declared").withColumn("suffix", F.lower(F.regexp_extract("part", r"\.([^./]*)$", 1)))
    guess = F.lit("application/octet-stream")
    for suffix, kind in SUFFIX_TYPES.items():
        guess = F.when(F.col("suffix") == suffix, F.lit(kind)).otherwise(guess)
    both = named.join(override, ["package", "part"], "left").join(default, ["package", "suffix"], "left")
    return both.select("package", "part", F.coalesce("override", "default", "declared", guess).alias("content_type"))


def rels_path(part: Column) -> Column:
    """Where a part's relationships are: dir/_rels/name.rels."""
    return F.concat(F.regexp_replace(part, "[^/]*$", ""), F.lit("_rels/"), F.regexp_extract(part, "([^/]*)$", 1), F.lit(".rels"))


def relationships(parts: DataFrame) -> DataFrame:
    """Relationships of every part: package, source_part (empty for the package), rel_id, type, target, target_mode.

    Rows without id, type or target are left out.
    """
    rows = _xml_rows(parts, F.endswith("part", F.lit(".rels")), {"Relationship": ("Id", "Type", "Target", "TargetMode")}, "package string, part string, tag string, rel_id string, type string, target string, target_mode string")
    owner = F.regexp_replace(F.regexp_replace("part", r"(^|/)_rels/([^/]*)\.rels$", "$1$2"), "^/", "")
    rows = rows.where("rel_id is not null and type is not null and target is not null")
    return rows.select("package", owner.alias("source_part"), "rel_id", "type", "target", F.coalesce("target_mode", F.lit("Internal")).alias("target_mode"))


def _clean(path: Column) -> Column:
    """A path without empty, "." and ".." steps."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(kept, "/")


def resolved(rels: DataFrame, parts: DataFrame) -> DataFrame:
    """Internal relationships with the part they lead to: absolute, then beside the owner, then beside its relationships."""
    own = rels.where("target_mode = 'Internal'")
    folder = F.regexp_replace("source_part", "[^/]*$", "")
    tries = F.array(F.when(F.startswith("target", F.lit("/")), _clean(F.col("target"))), _clean(F.concat(folder, "target")), _clean(F.concat(folder, F.lit("_rels/"), "target")), _clean(F.col("target")))
    probes = own.select("package", "source_part", "rel_id", "type", F.posexplode(tries).alias("step", "part")).where("part is not null")
    there = parts.where("part is not null").select("package", "part").distinct()
    keys = ["package", "source_part", "rel_id", "type"]
    return probes.join(there, ["package", "part"]).groupBy(*keys).agg(F.min_by("part", "step").alias("part"))


_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: Parts with a role: the relationship of the package that leads to them, and where they are by the standard (fixed values).
ROLES = {"main": (f"{_OFFICE}/officeDocument", "word/document.xml"), "styles": (f"{_OFFICE}/styles", "word/styles.xml"), "numbering": (f"{_OFFICE}/numbering", "word/numbering.xml")}


def role_parts(parts: DataFrame, rels: DataFrame) -> DataFrame:
    """The part of each role a package has (package, role, part): by the package's own relationship, else at its standard place.

    Of several relationships of one type that lead to parts, the one of the smallest id counts. A package without such
    a part has no row.
    """
    role = lambda column, at: F.try_element_at(F.create_map(*(F.lit(x) for name, known in ROLES.items() for x in (known[at], name))), F.col(column))
    led = resolved(rels.where("source_part = ''").where(role("type", 0).isNotNull()), parts)
    led = led.select("package", role("type", 0).alias("role"), "rel_id", "part").groupBy("package", "role").agg(F.min_by("part", "rel_id").alias("_led"))
    usual = parts.select("package", role("part", 1).alias("role"), F.col("part").alias("_usual")).where("role is not null").distinct()
    return led.join(usual, ["package", "role"], "full").select("package", "role", F.coalesce("_led", "_usual").alias("part"))


def chosen(df: DataFrame, part: str | DataFrame, column: str = "part") -> DataFrame:
    """Rows of one part of each package: that of a name, or that which a table (package, part) tells."""
    if isinstance(part, str):
        return df.where(F.col(column) == part)
    own = part.select(F.col("package"), F.col("part").alias(column)).distinct()
    return df.join(own, ["package", column], "left_semi")


def media(parts: DataFrame) -> DataFrame:
    """Image parts with the digest, size and default name of their bytes."""
    kinds = content_types(parts).where(F.startswith("content_type", F.lit("image/")))
    rows = parts.where("part is not null").select("package", "part", "data").join(kinds, ["package", "part"])
    digest = F.sha2("data", 256)
    return rows.select("package", "part", "content_type", digest.alias("sha256"), F.octet_length("data").cast("long").alias("size"), F.concat(F.lit("asset-"), F.substring(digest, 1, 8)).alias("name"), "data")
