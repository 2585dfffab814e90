"""What a material (AMC or GM) says about the requirements it belongs to, as column expressions.

A designation is parsed once into its code (VLA) and number (21); comparison forms are built from these columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code and number of a requirement, lettered or numbered groups behind it, and how a material begins (fixed values).
_CODE, _NUMBER, _GROUPS, _MATERIAL = r"\bCS[\s-]*([A-Z0-9]+)[\s.-]+", r"(\d+(?:\.\d+)?)", r"(?:\([A-Z0-9]+\))*", r"\b(?:AMC|GM)\d*\s+([A-Z0-9-]+)\s+"


def _parsed(text: Column, form: str) -> Column:
    """Codes and numbers of all designations of a form: an array of (code, number)."""
    part = lambda k: F.regexp_extract_all(text, F.lit(f"(?i){form}"), F.lit(k))
    return F.arrays_zip(part(1).alias("code"), part(2).alias("number"))


def _written(designation: Column) -> Column:
    return F.concat(F.lit("CS-"), designation["code"], F.lit("."), designation["number"])


def relation_key(text: Column) -> Column:
    """Form in which designations are compared: upper case, without spaces, one trailing group dropped, CS-X.n."""
    given = F.trim(F.translate(F.upper(text), "\u00a0", " "))
    last = F.regexp_extract(given, r"\([A-Z0-9]+\)$", 0)
    bare = F.left(given, F.length(given) - F.length(last))
    coded = F.zip_with(F.split(bare, _CODE), F.regexp_extract_all(bare, F.lit(_CODE), F.lit(1)), lambda own, code: F.concat(own, F.coalesce(F.concat(F.lit("CS-"), code, F.lit(".")), F.lit(""))))
    return F.array_join(F.regexp_extract_all(F.array_join(coded, ""), F.lit("[A-Z0-9.-]+"), F.lit(0)), "")


def named_requirements(text: Column) -> Column:
    """All CS- designations that a text names, as CS-code.number."""
    return F.transform(_parsed(text, _CODE + _NUMBER + _GROUPS), _written)


def requirement_by_suffix(designation: Column) -> Column:
    """The requirement that a material such as "AMC VLA 21(c)" ends with, as CS-code.number; null where there is none."""
    return relation_key(_written(F.get(_parsed(designation, _MATERIAL + _NUMBER + _GROUPS + "$"), F.lit(0))))
