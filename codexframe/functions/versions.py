"""Versions and publications: labels, slugs, formats and what orders them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of a version label, the first that a text holds (fixed values).
LABELS = (r"Amendment\s+\d+(?:\s*/\s*Issue\s+\d+)?", r"Amdt\.?[\s_-]*\d+", r"Initial\s+issue", r"Issue\s+\d+", r"CS\d+-AMC\d+", r"Revision\s+\d+")


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def version_label(text: Column) -> Column:
    """The version that a text names, Amdt as Amendment; null where it names none."""
    label = F.coalesce(*(_first(text, f"(?iU){p}") for p in LABELS))
    return F.trim(F.regexp_replace(F.regexp_replace(label, r"(?i)^Amdt\.?[\s_-]*", "Amendment "), r"\s+", " "))


def version_slug(text: Column) -> Column:
    """Lower case, "and" for &, hyphens between words; unknown where nothing is left."""
    plain = F.regexp_replace(F.replace(F.lower(F.trim(text)), F.lit("&"), F.lit(" and ")), r"(?U)[^\w\s.-]+", "")
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"(?U)[\s._]+", "-"), "-+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown"))


def version_fields(*texts: Column) -> Column:
    """Issue and amendment that a label and further hints name; the label itself where none names an amendment."""
    named = lambda word: F.coalesce(*(F.coalesce(_first(t, rf"(?iU)\b{word}\s+(\d+)\b", 1), F.when(t.rlike(r"(?iU)\bInitial\s+issue\b"), "")) for t in texts))
    shown = lambda word: F.when(named(word) == "", "Initial issue").otherwise(F.concat(F.lit(f"{word} "), named(word)))
    return F.struct(F.coalesce(shown("Issue"), F.lit("")).alias("issue"), F.coalesce(shown("Amendment"), F.trim(texts[0])).alias("amendment"))


def publication_format(title: Column, text: Column, kind: Column, url: Column) -> Column:
    """xml, zip, pdf or other, by labels, media type and suffix, in that order."""
    blob = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (title, text, kind, url))))
    has = lambda word: F.contains(blob, F.lit(word))
    ends = lambda word: F.endswith(blob, F.lit(word))
    packed = has("application/zip") | ends(".zip")
    return (
        F.when(has("xml)") | ends(".xml"), "xml").when(packed & has("xml"), "xml").when(packed, "zip")
        .when(has("application/pdf") | ends(".pdf") | has("(pdf)"), "pdf").when(has("/downloads/") & has("xml"), "xml").otherwise("other")
    )


def reported_size(kind: Column) -> Column:
    """Bytes that a media type's length parameter gives, or null."""
    return _first(kind, r"length=(\d+)", 1).cast("long")


def file_name(title: Column, url: Column) -> Column:
    """File name from a title that ends like one, else from the url's path, else null."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    path = F.regexp_replace(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    return F.coalesce(F.when(title.rlike(r"(?i)\.(pdf|zip|xml)$"), last(title)), F.when(F.contains(last(path), F.lit(".")), last(path)))


def publication_order(label: Column, kind: Column, title: Column) -> Column:
    """What orders publications, the newest highest: format, not the initial issue, amendment, issue, title."""
    low = F.lower(label)
    number = lambda pattern: F.coalesce(_first(low, pattern, 1).cast("int"), F.lit(-1))
    return F.struct(F.when(kind == "xml", 2).when(kind == "zip", 1).otherwise(0).alias("format"), F.when(F.contains(low, F.lit("initial")), 0).otherwise(1).alias("later"), number(r"(?:amendment|amdt)\s*(\d+)").alias("amendment"), number(r"issue\s*(\d+)").alias("issue"), title.alias("title"))


def fits_version(wanted: str, title: Column, label: Column, slug: Column) -> Column:
    """Whether a publication is of a version, by its slug, label or title."""
    needle, low = version_slug(F.lit(wanted)), F.lit(wanted.lower())
    return F.contains(slug, needle) | F.contains(version_slug(label), needle) | F.contains(version_slug(title), needle) | F.contains(F.lower(title), low) | F.contains(F.lower(label), low)


def document_code(regulation: Column, title: Column) -> Column:
    """Short designation of a document: its id in upper case, else the code in parentheses in its title."""
    return F.coalesce(F.nullif(F.upper(regulation), F.lit("")), F.regexp_extract(title, r"\(([A-Z][A-Z0-9-]{1,15})\)", 1))


def iso_date(text: Column) -> Column:
    """The date of a text that is one as year-month-day, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
