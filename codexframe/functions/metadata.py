"""Publisher metadata: one spelling of its field names, clean values, merged sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexframe.functions.text import MISSING

#: Fields that hold lists and fields that hold one value (fixed values).
LISTS = ("regulatory_source", "regulatory_subject", "type_of_content", "technical_subject_matter", "aircraft_category", "aircraft_use", "amended_by", "keywords")
SCALARS = (
    "erules_id", "applicability_date", "source_title", "domain", "parent_ir", "entry_into_force_date", "sdt_id", "easa_category", "activity_type",
    "equivalent_foreign_regulation", "icao_reference", "registry_state", "regulated_entity", "guid", "pub_time",
)
#: All spellings of each field's name in publications (fixed values).
SPELLINGS = {
    "erules_id": ("erules_id", "id", "ERulesId"),
    "regulatory_source": ("regulatory_source", "regulatorySource", "RegulatorySource"),
    "regulatory_subject": ("regulatory_subject", "regulatorySubject", "RegulatorySubject"),
    "type_of_content": ("type_of_content", "typeOfContent", "TypeOfContent"),
    "technical_subject_matter": ("technical_subject_matter", "technicalSubjectMatter", "TechnicalSubjectMatter"),
    "aircraft_category": ("aircraft_category", "aircraftCategory", "AircraftCategory"),
    "aircraft_use": ("aircraft_use", "aircraftUse", "AircraftUse"),
    "applicability_date": ("applicability_date", "applicabilityDate", "ApplicabilityDate"),
    "amended_by": ("amended_by", "amendedBy", "AmendedBy"),
    "source_title": ("source_title", "title", "sourceTitle", "source-title"),
    "domain": ("domain", "Domain"),
    "parent_ir": ("parent_ir", "ParentIR"),
    "entry_into_force_date": ("entry_into_force_date", "EntryIntoForceDate"),
    "keywords": ("keywords", "Keywords"),
    "sdt_id": ("sdt_id", "sdt-id"),
    "easa_category": ("easa_category", "EASACategory"),
    "activity_type": ("activity_type", "ActivityType"),
    "equivalent_foreign_regulation": ("equivalent_foreign_regulation", "EquivalentForeignRegulation"),
    "icao_reference": ("icao_reference", "ICAOReference"),
    "registry_state": ("registry_state", "RegistryState"),
    "regulated_entity": ("regulated_entity", "RegulatedEntity"),
    "guid": ("guid",),
    "pub_time": ("pub_time", "pub-time"),
}
#: Fields of which any makes metadata more than empty (fixed values).
TELLING = (*LISTS, "erules_id", "applicability_date", "source_title", "domain", "parent_ir", "entry_into_force_date", "sdt_id", "guid", "pub_time")


def spellings() -> dict[str, str]:
    """The field of each spelling."""
    return {spelling: name for name, known in SPELLINGS.items() for spelling in known}


def items(text: Column) -> Column:
    """Items between semicolons, trimmed, without missing values."""
    return F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: ~F.lower(x).isin(*MISSING))


def scalar(text: Column) -> Column:
    """A single value, trimmed, without a trailing semicolon; null where it stands for a missing one."""
    given = F.trim(text)
    cut = F.trim(F.regexp_replace(given, ";$", ""))
    return F.when(~F.lower(given).isin(*MISSING), F.nullif(cut, F.lit("")))


def normalized(rows: DataFrame, keys: list[str], name: str = "name", value: str = "value", order: str = "ord") -> DataFrame:
    """Metadata rows (keys, name, value, order) as one row a key: lists, scalars and raw (unknown names and their values).

    Lists take the items of all spellings in order, each once; of a scalar the last value that is not missing counts.
    """
    field = F.try_element_at(F.create_map(*(F.lit(x) for pair in spellings().items() for x in pair)), F.col(name))
    own = rows.withColumns({"_field": field, "_items": items(F.col(value)), "_scalar": scalar(F.col(value))})
    entry = lambda f, v: F.sort_array(F.collect_list(F.when(F.col("_field") == f, F.struct(F.col(order).alias("o"), v.alias("v")))))
    lists = [F.array_distinct(F.flatten(F.transform(entry(f, F.col("_items")), lambda e: e["v"]))).alias(f) for f in LISTS]
    scalars = [F.max_by("_scalar", F.when((F.col("_field") == f) & F.col("_scalar").isNotNull(), F.col(order))).alias(f) for f in SCALARS]
    unknown = F.sort_array(F.collect_list(F.when(F.col("_field").isNull(), F.struct(F.col(order).alias("o"), F.col(name).alias("n"), F.col(value).alias("v")))))
    raw = F.map_from_entries(F.transform(unknown, lambda e: F.struct(e["n"], e["v"]))).alias("raw")
    return own.groupBy(*keys).agg(*lists, *scalars, raw)


def overlaid(base: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """Metadata of two sources (as normalized gives them): lists united, base first; other values of `over` win where it has any."""
    both = base.select(*keys, F.struct(*LISTS, *SCALARS).alias("_b")).join(over.select(*keys, F.struct(*LISTS, *SCALARS).alias("_o")), keys, "full")
    none = F.array().cast("array<string>")
    united = [F.array_distinct(F.concat(F.coalesce(F.col("_b")[f], none), F.coalesce(F.col("_o")[f], none))).alias(f) for f in LISTS]
    return both.select(*keys, *united, *(F.coalesce(F.col("_o")[f], F.col("_b")[f]).alias(f) for f in SCALARS))


def is_empty() -> Column:
    """Whether metadata (as normalized gives it) has no telling field."""
    filled = [F.coalesce(F.size(f) > 0, F.lit(False)) if f in LISTS else F.coalesce(F.col(f) != "", F.lit(False)) for f in TELLING]
    out = filled[0]
    for f in filled[1:]:
        out = out | f
    return ~out
