"""Catalogs, publications, stored versions and output folders as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexframe.functions import versions
from codexframe.functions.text import joined_url

#: States of a stored version (fixed values).
STATES = ("unchecked", "ok", "mismatch", "metadata_missing", "metadata_unreadable", "source_missing")


def merged(catalogs: list[DataFrame], key: str) -> DataFrame:
    """All entries of some catalogs; an id that comes twice is an error, whatever is read of the rows."""
    every = reduce(DataFrame.unionByName, catalogs)
    n = F.count("*").over(Window.partitionBy(key))
    # the check is a filter: an action that reads no id, or only counts, cannot leave it out as it could a column
    once = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("catalog id comes twice: "), F.col(key).cast("string"))).cast("boolean"))
    return every.withColumn("_n", n).where(once).drop("_n")


def upserted(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the rows of changes in place of those of the same key, and its new ones."""
    return base.join(changes, key, "left_anti").unionByName(changes)


def convertible(entries: DataFrame, authority: str | None = None, flag: str = "xml_available") -> DataFrame:
    """Entries of an authority (in any case; none: of all) that are not marked as having no XML."""
    own = F.lit(True) if authority is None else F.upper("authority") == authority.upper()
    return entries.where(own & F.coalesce(F.col(flag), F.lit(True)))


def publications(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Downloads that landing pages link to: key, ord, url, title, label, slug, format, size, file.

    A link counts if its class or path marks a download, once for each absolute url, the first one on the page; links of
    no known format count only if they look like documents.
    """
    pattern, attribute = r"(?is)<a\b([^>]*)>(.*?)</a\s*>", lambda a: F.coalesce(F.regexp_extract("attributes", rf"(?is)\b{a}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("attributes"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("inside"))
    rows = pages.select(key, F.col(url).alias("_base"), F.posexplode(pairs).alias("ord", "a")).select(key, "_base", "ord", F.col("a.attributes").alias("attributes"), F.col("a.inside").alias("inside"))
    text = F.trim(F.regexp_replace(F.regexp_replace("inside", r"(?s)<[^>]*>", ""), r"(?U)\s+", " "))
    rows = rows.select(key, "_base", "ord", attribute("href").alias("href"), F.trim(attribute("title")).alias("title_attr"), F.trim(attribute("type")).alias("kind"), attribute("class").alias("class"), text.alias("text"))
    marked = F.contains("class", F.lit("matomo_download")) | F.contains("href", F.lit("/downloads/"))
    rows = rows.where(marked & (F.col("href") != "") & ~F.startswith("href", F.lit("#"))).withColumn("url", joined_url(F.col("_base"), F.col("href")))
    rows = rows.withColumn("format", versions.publication_format(F.col("title_attr"), F.col("text"), F.col("kind"), F.col("url")))
    title = F.coalesce(*(F.nullif(c, F.lit("")) for c in (F.col("text"), F.col("title_attr"))), versions.file_name(F.col("title_attr"), F.col("url")), F.col("url"))
    looks = F.concat(title, "url").rlike(r"(?i)easy.?access|cs[- ]|/en/downloads/")
    rows = rows.where((F.col("format") != "other") | (((F.col("title_attr") != "") | F.contains("href", F.lit("/downloads/"))) & looks))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key, "url").orderBy("ord"))).where("_n = 1")
    label = F.coalesce(versions.version_label(F.col("text")), versions.version_label(F.col("title_attr")))
    named = F.coalesce(label, *(F.nullif(c, F.lit("")) for c in (F.col("text"), F.col("title_attr"))), F.lit("unknown"))
    return first.select(key, "ord", "url", title.alias("title"), F.coalesce(label, F.lit("unknown")).alias("label"), versions.version_slug(named).alias("slug"), "format", versions.reported_size(F.col("kind")).alias("size"), versions.file_name(F.col("title_attr"), F.col("url")).alias("file"))


def newest_first(rows: DataFrame, keys: list[str], label: str = "label", format_: str = "format", title: str = "title", slug: str = "slug") -> DataFrame:
    """Publications with their place (place, 1: newest) and whether their slug is the newest one's (is_latest)."""
    order = Window.partitionBy(*keys).orderBy(F.desc(versions.publication_order(F.col(label), F.col(format_), F.col(title))), slug)
    return rows.withColumns({"place": F.row_number().over(order).cast("long"), "is_latest": F.col(slug) == F.first(slug).over(order)})


def selected(rows: DataFrame, keys: list[str], format_: str = "xml", version: str | None = None, order: str = "ord") -> DataFrame:
    """The publication of each key to take: of that format only; of a version the first that fits, else the newest."""
    own = rows.where(F.col("format") == format_.lower())
    if version:
        own = own.where(versions.fits_version(version, F.col("title"), F.col("label"), F.col("slug")))
        return own.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
    return newest_first(own, keys).where("place = 1").drop("place", "is_latest")


def inventory(stored: DataFrame, verify: bool = False) -> DataFrame:
    """Stored versions (slug, source binary or null, has_meta, meta_ok, expected, declared_size): adds state and size."""
    actual = F.sha2("source", 256)
    state = (
        F.when(F.col("source").isNull(), "source_missing").when(~F.col("has_meta"), "metadata_missing").when(~F.col("meta_ok"), "metadata_unreadable").when(F.coalesce(F.col("expected"), F.lit("")) == "", "metadata_missing")
        .otherwise(F.when(actual == F.col("expected"), "ok").otherwise("mismatch") if verify else F.lit("unchecked"))
    )
    return stored.withColumns({"state": state, "size": F.coalesce("declared_size", F.octet_length("source").cast("long"))}).drop("source")


def largest_entry(entries: DataFrame, keys: list[str], name: str = "name", size: str = "size") -> DataFrame:
    """The largest XML entry of each archive: keys, name, size."""
    best = F.max_by(F.struct(name, size), F.struct(size, name))
    return entries.where(F.endswith(F.lower(name), F.lit(".xml"))).groupBy(*keys).agg(best.alias("b")).select(*keys, f"b.{name}", f"b.{size}")


def missing_files(pages: DataFrame, files: DataFrame, file: str = "path", content: str = "content") -> DataFrame:
    """Local images and links of Markdown files that no file answers: path, target (decoded), is_image."""
    pattern = r"(!?)\[[^\]]*\]\(([^)\s]+)\)"
    found = F.arrays_zip(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)).alias("mark"), F.regexp_extract_all(content, F.lit(pattern), F.lit(2)).alias("target"))
    rows = pages.select(file, F.explode(found).alias("l")).select(file, (F.col("l.mark") == "!").alias("is_image"), F.col("l.target").alias("target"))
    rows = rows.where(~F.col("target").rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:|#)")).withColumn("target", F.regexp_replace("target", "[#?].*$", ""))
    decoded = F.try_url_decode(F.replace("target", F.lit("+"), F.lit("%2B")))
    folder = F.regexp_replace(file, "[^/]*$", "")
    steps = F.split(F.concat(folder, F.coalesce(decoded, F.col("target"))), "/")
    kept = F.aggregate(F.filter(steps, lambda s: (s != "") & (s != ".")), F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    rows = rows.withColumn("target", F.array_join(kept, "/"))
    return rows.join(files.select(F.col(file).alias("target")), "target", "left_anti").select(file, "target", "is_image").distinct()


def health(rows: DataFrame, keys: list[str], name: str, ok: Column) -> DataFrame:
    """How many are well, and the sorted names of the others."""
    return rows.groupBy(*keys).agg(F.count_if(ok).alias("n_ok"), F.array_join(F.sort_array(F.collect_list(F.when(~ok, F.col(name)))), ",").alias("not_ok"))
