"""Scalar functions over forms of their input around each part's key; the SQL spells what each form must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexframe.functions import citations, metadata, relations, versions
from codexframe.functions import text as fn
from codexframe.operators import navigation as nav
from codexframe.plans.registry import query
from codexframe.sources.tables import table
from codexframe.sources.work import dealt

_KEY = "{k}"


def _column(values: list[str | None]) -> Column:
    key, out = F.col("p_partkey").cast("string"), F.lit(None).cast("string")
    for i, v in enumerate(values):
        own = F.lit(None).cast("string") if v is None else F.replace(F.lit(v), F.lit(_KEY), key)
        out = F.when(F.col("p_partkey") % len(values) == i, own).otherwise(out)
    return out


def _sql(values: list[str | None]) -> str:
    shown = ["NULL" if v is None else "replace('" + v.replace("'", "''") + f"', '{_KEY}', p_partkey::VARCHAR)" for v in values]
    return "(CASE p_partkey % " + str(len(values)) + "".join(f" WHEN {i} THEN {s}" for i, s in enumerate(shown)) + " END)::VARCHAR"


def forms(name: str, outputs: tuple[str, ...], rows: list[tuple[tuple, tuple]], apply: Callable[..., tuple]) -> None:
    """Register a query: every part takes one of the forms (inputs, expected outputs), by its key."""
    given, expected = [list(c) for c in zip(*(r[0] for r in rows), strict=True)], [list(c) for c in zip(*(r[1] for r in rows), strict=True)]
    oracle = "SELECT p_partkey, " + ", ".join(f"{_sql(e)} AS {o}" for o, e in zip(outputs, expected, strict=True)) + " FROM part"

    def run(spark, sf_dir):
        results = apply(*map(_column, given))
        return dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", *(r.cast("string").alias(o) for o, r in zip(outputs, results, strict=True)))

    run.__name__ = name
    query(name, oracle)(run)


def _one(fn_: Callable[..., Column]) -> Callable[..., tuple]:
    return lambda *c: (fn_(*c),)


forms("slugify_forms", ("slug",), [(("Überflug  Straße_{k}!",), ("uberflug-strae-{k}",)), (("½ ﬁne №{k}",), ("12-fine-no{k}",)), (("--A&B - C{k}--",), ("ab-c{k}",)), (("ÀÉÎ ø{k} 日本",), ("aei-{k}",))], _one(fn.slugify))
forms(
    "rule_file_slug", ("slug",),
    [(("CS-VLA.{k}", "E1", "T", "n"), ("cs-vla-{k}",)), (("", "ERULES 1.{k}", "T", "n"), ("erules-1-{k}",)), (("", "", "Général Title {k}", "n"), ("general-title-{k}",)), (("", "", "", "n/{k}"), ("n{k}",)), (("", "", "", ""), ("rule",))],
    _one(fn.rule_file_slug),
)
forms("stable_node_id", ("node_id",), [(("section", "General Rules {k}"), ("section-general-rules-{k}",)), (("", "A {k}"), ("a-{k}",)), (("", "!"), ("node",))], _one(fn.stable_node_id))
forms(
    "designation_of_lines", ("designation",),
    [(("Preamble|CS 23.{k} Title",), ("CS-23.{k}",)), (("CS-VLA|CS 23.{k}",), ("CS-VLA",)), (("CS-VLA and more {k}|Note",), (None,)), (("Text|AMC VLA {k}(c) Sub|CS-23.1",), ("AMC VLA {k}(c)",))],
    _one(lambda t: fn.designation_of_lines(F.split(t, r"\|"))),
)
forms("ed_decision", ("decision",), [(("Annex to ED  Decision 2003/{k}/RM of then",), ("ED Decision 2003/{k}/RM",)), (("ed decision 2017/{k}R.",), ("ed decision 2017/{k}R",)), (("ED Decision 17/{k}",), (None,))], _one(fn.ed_decision))
forms("second_designation", ("designation",), [(("§ 23.{k}",), ("14 CFR 23.{k}",)), (("FAR  23.{k}(a)",), ("14 CFR 23.{k}(a)",)), (("14 cfr 23.{k}",), ("14 CFR 23.{k}",)), ((" § ",), ("",))], _one(citations.second_designation))
forms("query_designation", ("designation",), [((" cs vla {k} ",), ("CS-VLA.{k}",)), (("amc1 cs-23.{k}",), ("AMC1-CS-23.{k}",)), (("CS-23.{k}",), ("CS-23.{k}",))], _one(fn.query_designation))


def _shown(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda h: F.concat(h["start"].cast("string"), F.lit(":"), h["designation"])), "|")


_TEXTS = [
    ("§ 25.{k}", "0:14 CFR 25.{k}", "", "0:14 CFR 25.{k}"),
    ("see §§ 25.13, 25.1x and 25.{k}(a)(1); 9.9", "4:14 CFR 25.13|14:14 CFR 25.1x|24:14 CFR 25.{k}(a)(1)", "", "4:14 CFR 25.13|14:14 CFR 25.1x|24:14 CFR 25.{k}(a)(1)"),
    ("§ 25.13, 25.{k}", "0:14 CFR 25.13", "", "0:14 CFR 25.13"),
    ("14 CFR 25.13 or 25.{k}, and 25.7", "0:14 CFR 25.13|16:14 CFR 25.{k}", "", "0:14 CFR 25.13|16:14 CFR 25.{k}"),
    ("§§ 1.1; § 25.13, 25.{k}", "0:14 CFR 1.1|8:14 CFR 25.13|17:14 CFR 25.{k}", "", "0:14 CFR 1.1|8:14 CFR 25.13|17:14 CFR 25.{k}"),
    ("CS 23.{k} and § 25.1", "0:x", "0:CS-23.{k}", None),
    ("AMC1 CS-VLA 21(a); GM LSA {k}", "", "0:AMC1 CS-VLA.21(a)|19:GM LSA {k}", "0:AMC1 CS-VLA.21(a)|19:GM LSA {k}"),
    ("X/CS-9.9 a.§ 1.1 cs 23.{k}", "", "", ""),
]
forms(
    "citations_by_authority", ("second", "first", "either"),
    [((t,), (a, b, c)) for t, a, b, c in _TEXTS if c is not None], lambda t: (_shown(citations.citations_of(t, "FAA")), _shown(citations.citations_of(t, "EASA")), _shown(citations.citations_of(t))),
)
forms(
    "citations_of_others", ("cited",),
    [(("CS-VLA {k} and CS 23.1(a)", "CS-VLA.{k}"), ("CS-23.1(a)",)), (("CS-VLA {k}, § 23.5", "CS-23.5"), ("CS-VLA.{k}|14 CFR 23.5",)), (("CS-VLA {k}", "CS-VLA.{k}"), ("",))],
    _one(lambda t, own: F.array_join(F.transform(citations.citations_of(t, own=own), lambda h: h["designation"]), "|")),
)
forms("relation_key", ("compared",), [(("CS-VLA {k}(a)",), ("CS-VLA.{k}",)), (("cs 23.{k}",), ("CS-23.{k}",)), ((" AMC VLA {k} ",), ("AMCVLA{k}",)), (("CS 23-{k}(b)(c)",), ("CS-23.{k}B",))], _one(relations.relation_key))
forms("named_requirements", ("named",), [(("AMC to CS 23.{k} and CS-VLA {k}(b)(1).",), ("CS-23.{k}|CS-VLA.{k}",)), (("AMC VLA {k}",), ("",)), (("cs-23 - {k}.5",), ("CS-23.{k}.5",))], _one(lambda t: F.array_join(relations.named_requirements(t), "|")))
forms("requirement_by_suffix", ("requirement",), [(("AMC VLA {k}(c)",), ("CS-VLA.{k}",)), (("to gm1 23 {k}",), ("CS-23.{k}",)), (("CS-VLA.{k}",), (None,)), (("AMC VLA {k} on it",), (None,))], _one(relations.requirement_by_suffix))
forms(
    "version_label_forms", ("label", "slug"),
    [(("Amendment 5  / Issue {k}",), ("Amendment 5 / Issue {k}", "amendment-5-issue-{k}")), (("CS-23 amdt_{k}",), ("Amendment {k}", "cs-23-amdt-{k}")), (("Amdt. {k} & more",), ("Amendment {k}", "amdt-{k}-and-more")),
     (("The  Initial  Issue",), ("Initial Issue", "the-initial-issue")), (("Issue {k} Revision 2",), ("Issue {k}", "issue-{k}-revision-2")), (("CS6-AMC{k}",), ("CS6-AMC{k}", "cs6-amc{k}")), (("Revision {k}!",), ("Revision {k}", "revision-{k}")), (("?!",), (None, "unknown"))],
    lambda t: (versions.version_label(t), versions.version_slug(t)),
)
forms(
    "version_fields", ("issue", "amendment"),
    [(("Amendment {k}", "Issue 3"), ("Issue 3", "Amendment {k}")), (("eCFR as of 2025-01-{k}", "x"), ("", "eCFR as of 2025-01-{k}")), (("Initial issue of {k}", "Amendment 4"), ("Initial issue", "Initial issue")), ((" v{k} ", "amendment 2, initial issue"), ("Initial issue", "Amendment 2"))],
    lambda label, hint: ((f := versions.version_fields(label, hint))["issue"], f["amendment"]),
)
forms(
    "publication_format", ("format", "size", "file"),
    [(("CS-23 (XML)", "", "application/zip; length={k}", "https://h/d/{k}"), ("xml", "{k}", None)), (("a/b_{k}.zip", "", "", "https://h/x.pdf?y=1"), ("other", None, "b_{k}.zip")), (("", "", "", "https://h/p/{k}.zip"), ("zip", None, "{k}.zip")),
     (("", "as xml", "application/zip", "https://h/{k}"), ("xml", None, None)), (("", "Text (PDF) {k}", "", "https://h/q/#a.b"), ("pdf", None, None)), (("XML of {k}", "", "", "/en/downloads/{k}"), ("xml", None, None)), (("gzip {k}", "", "", "https://h/zipper/"), ("other", None, None))],
    lambda title, text, kind, url: (versions.publication_format(title, text, kind, url), versions.reported_size(kind), versions.file_name(title, url)),
)
forms("document_code", ("code",), [(("cs-{k}", "T"), ("CS-{k}",)), (("", "Rules for sailplanes (CS-22{k})"), ("CS-22{k}",)), (("", "Rules (see {k})"), ("",))], _one(versions.document_code))
forms("iso_date", ("day",), [(("2024-02-29",), ("2024-02-29",)), (("2023-02-29",), (None,)), (("2023-2-9",), (None,)), (("x{k}",), (None,))], _one(versions.iso_date))
forms("metadata_scalar", ("value",), [((" CS-{k} ; ",), ("CS-{k}",)), (("N/A;",), (None,)), (("-",), (None,)), ((" ",), (None,)), (("a; b {k};",), ("a; b {k}",))], _one(metadata.scalar))
forms("safe_names", ("name", "slug"), [(("a-{k}.png",), ("true", "true")), (("../{k}",), ("false", "false")), (("..",), ("false", "false")), (("A {k}",), ("true", "false")), (("x\\{k}",), ("false", "false")), (("_{k}",), ("true", "false"))], lambda t: (fn.safe_name(t), fn.safe_slug(t)))
forms("extension_of", ("extension",), [(("image/jpeg",), ("jpg",)), (("image/webp",), ("webp",)), (("image/x-{k}",), ("png",))], _one(fn.extension_of))
forms(
    "url_join", ("url", "followed"),
    [(("https://h.org/a/b?q", "c/{k}"), ("https://h.org/a/c/{k}", "true")), (("https://h.org/a/b", "/{k}"), ("https://h.org/{k}", "true")), (("http://h.org", "{k}"), ("http://h.org/{k}", "true")), (("https://h.org/a/b?q", "?{k}"), ("https://h.org/a/b?{k}", "true")),
     (("https://h.org/a", "//i.net/{k}"), ("https://i.net/{k}", "true")), (("https://h.org/a", "mailto:{k}@x"), ("mailto:{k}@x", "false"))],
    lambda base, link: ((u := fn.joined_url(base, link)), fn.web_scheme(u)),
)
forms("link_target", ("target",), [(("x-613(c) {k}%.png",), ("x-613%28c%29%20{k}%25.png",)), (("<{k}>[a]",), ("%3C{k}%3E[a]",))], _one(fn.link_escape))
forms(
    "structure_levels", ("kind", "level"),
    [(("", "SUBPART {k}", "", "1"), ("subpart", "2")), (("", "Chapter {k}", "", "1"), ("chapter", "3")), (("", "Appendices {k}", "", "0"), ("appendix", "1")), (("", "Preamble", "", "1"), ("front_matter", "1")), (("", "TOC of {k}", "", "1"), ("front_matter", "1")),
     (("Book", "{k}", "", "4"), ("book", "4")), (("", "The definition {k}", "", "1"), ("definitions", "2")), (("", "Part {k}", "Appendix text", "1"), ("appendix", "1")), (("", "Partial {k}", "", "1"), ("section", "3")), (("", "Redefinitions {k}", "", "2"), ("section", "2"))],
    lambda d, t, types, level: ((k := nav.structure_kind(t, d, types)), nav.structure_level(level.cast("int"), k)),
)
