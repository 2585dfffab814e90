"""Citations with their places in a text, of both authorities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexframe.functions.text import BEFORE, CITATION, GROUPS, canonical_designation

#: Number of a section of the second authority (fixed value).
_NUMBER = r"\d+\.\d+[a-z]?"
#: Further numbers of a list (a comma or a word between, never both), and the forms that open one (fixed values).
_TAIL = rf"(?:(?>\s*(?:,|and|or)\s*){BEFORE}{_NUMBER}{GROUPS}(?![\w.]))*"
_MARKED, _NAMED = rf"§\s*{_NUMBER}{GROUPS}", rf"(?:14\s+CFR\s+)?§§\s*{_NUMBER}{GROUPS}{_TAIL}|14\s+CFR\s+(?:§\s*)?{_NUMBER}{GROUPS}{_TAIL}"


def found(text: Column, pattern: str) -> Column:
    """All matches with their places: an array of (start, end, text), places from 0."""
    gaps, own = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("hits"))

    def step(state, pair):
        begin = state["at"] + F.length(pair["gap"])
        hit = F.struct(begin.alias("start"), (begin + F.length(pair["own"])).alias("end"), pair["own"].alias("text"))
        return F.when(pair["own"].isNull(), state).otherwise(F.struct(hit["end"].alias("at"), F.concat(state["hits"], F.array(hit)).alias("hits")))

    pairs = F.zip_with(gaps, own, lambda g, m: F.struct(g.alias("gap"), m.alias("own")))
    return F.aggregate(pairs, start, step)["hits"]


def of_first_authority(text: Column) -> Column:
    """CS-, AMC and GM citations: an array of (start, end, designation in canonical form)."""
    hits = found(text, CITATION)
    return F.transform(hits, lambda h: F.struct(h["start"], h["end"], canonical_designation(h["text"]).alias("designation")))


def of_second_authority(text: Column) -> Column:
    """14 CFR citations with the tails of their lists: an array of (start, end, designation).

    A list goes on after a double section sign or a 14 CFR, and after a single sign that any double one precedes.
    """
    double = F.instr(text, "§§") - 1
    alone = F.filter(found(text, rf"(?U){BEFORE}(?:{_NAMED}|{_MARKED})"), lambda h: (double < 0) | (h["start"] < double))
    listed = F.filter(found(text, rf"(?U){BEFORE}(?:{_NAMED}|{_MARKED}{_TAIL})"), lambda h: (double >= 0) & (h["start"] >= double))

    def numbers(hit):
        own = F.zip_with(found(hit["text"], rf"(?U){_NUMBER}{GROUPS}"), F.array(F.lit(True)), lambda n, first: F.struct(n.alias("n"), first.alias("first")))
        begin = lambda x: F.when(x["first"], hit["start"]).otherwise(hit["start"] + x["n"]["start"])
        return F.transform(own, lambda x: F.struct(begin(x).alias("start"), (hit["start"] + x["n"]["end"]).alias("end"), F.concat(F.lit("14 CFR "), x["n"]["text"]).alias("designation")))

    return F.flatten(F.transform(F.concat(alone, listed), numbers))


def without_overlaps(hits: Column) -> Column:
    """Hits by start, the longest first, without those that begin inside one already taken."""
    kind = "array<struct<start:int,end:int,designation:string>>"
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (h["start"] - h["end"]).alias("back"), h["designation"].alias("designation"))))
    state = F.struct(F.lit(-1).alias("at"), F.array().cast(kind).alias("kept"))

    def step(acc, h):
        end = h["start"] - h["back"]
        hit = F.struct(h["start"].alias("start"), end.alias("end"), h["designation"].alias("designation"))
        return F.when(h["start"] >= acc["at"], F.struct(end.alias("at"), F.concat(acc["kept"], F.array(hit)).alias("kept"))).otherwise(acc)

    return F.aggregate(ordered, state, step)["kept"]


def citations_of(text: Column, authority: str = "", own: Column | None = None) -> Column:
    """Citations of one authority ("EASA" or "FAA") or both, without overlaps and without the enclosing rule's own."""
    if authority.upper() not in ("", "EASA", "FAA"):
        raise ValueError(f"{authority} is no authority")
    sides = [side(text) for name, side in (("EASA", of_first_authority), ("FAA", of_second_authority)) if authority.upper() in ("", name)]
    hits = without_overlaps(F.concat(*sides))
    return hits if own is None else F.filter(hits, lambda h: ~h["designation"].eqNullSafe(own))


def second_designation(text: Column) -> Column:
    """"§ 23.2000" and "FAR 23.2000" as 14 CFR 23.2000; empty where nothing is left."""
    clean = F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("§"), F.lit("")), r"(?U)\s+", " "))
    number = F.regexp_replace(clean, r"(?i)^(?:FAR|14\s*CFR)\s*", "")
    return F.when(number == "", "").otherwise(F.concat(F.lit("14 CFR "), number))
