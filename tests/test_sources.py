"""Packages and publications of our own making, read back as tables."""

import base64
import io
import zipfile

from codexframe.sources import packages as pk
from codexframe.sources import sections

PKG = "http://schemas.microsoft.com/office/2006/xmlPackage"
TYPES = '<Types><Default Extension="png" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="application/main+xml"/></Types>'
RELS = '<Relationships><Relationship Id="r1" Type="image" Target="media/a.png"/><Relationship Id="r2" Type="link" Target="http://x.org" TargetMode="External"/><Relationship Id="r3" Type="up" Target="../top.xml"/><Relationship Id="r4" Target="broken"/></Relationships>'
PNG = b"\x89PNG\r\n\x1a\n not really"


def flat():
    part = lambda name, kind, body: f'<pkg:part pkg:name="{name}" pkg:contentType="{kind}">{body}</pkg:part>'
    xml = lambda body: f"<pkg:xmlData>{body}</pkg:xmlData>"
    body = part("/[Content_Types].xml", "application/xml", xml(TYPES)) + part("/word/_rels/document.xml.rels", "rels", xml(RELS)) + part("/word/document.xml", "x", xml("<doc>hi</doc>"))
    body += part("/word/media/a.png", "image/x", f"<pkg:binaryData>{base64.b64encode(PNG).decode()}</pkg:binaryData>") + part("/top.xml", "application/top", xml("<t/>"))
    return f'<pkg:package xmlns:pkg="{PKG}">{body}</pkg:package>'.encode()


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in (("[Content_Types].xml", TYPES), ("word/_rels/document.xml.rels", RELS), ("word/document.xml", "<doc>hi</doc>"), ("word/media/a.png", PNG), ("top.xml", "<t/>")):
            z.writestr(name, data)
    return out.getvalue()


def given(spark, **files):
    return spark.createDataFrame([(n, bytearray(b) if b is not None else None) for n, b in files.items()], "package string, content binary")


def test_both_formats_give_the_same_parts(spark):
    found = pk.parts(given(spark, flat=flat(), zip=zipped(), bad=b"<x", none=None, cut=b"PK\x03\x04"))
    rows = found.collect()
    names = {(r.package, r.part) for r in rows if r.part}
    assert {p for k, p in names if k == "flat"} == {p for k, p in names if k == "zip"} and len(names) == 10
    assert sorted(r.package for r in rows if r.error) == ["bad", "cut", "none"]
    kinds = {(r.package, r.part): r.content_type for r in pk.content_types(found).collect()}
    for k in ("flat", "zip"):
        assert kinds[k, "word/document.xml"] == "application/main+xml" and kinds[k, "word/media/a.png"] == "image/png"
    assert kinds["flat", "top.xml"] == "application/top" and kinds["zip", "top.xml"] == "application/xml"


def test_relationships_lead_to_parts(spark):
    found = pk.parts(given(spark, flat=flat(), zip=zipped()))
    rels = pk.relationships(found)
    assert {(r.package, r.source_part, r.rel_id, r.target_mode) for r in rels.collect()} == {(k, "word/document.xml", i, m) for k in ("flat", "zip") for i, m in (("r1", "Internal"), ("r2", "External"), ("r3", "Internal"))}
    assert {(r.package, r.rel_id, r.part) for r in pk.resolved(rels, found).collect()} == {(k, i, p) for k in ("flat", "zip") for i, p in (("r1", "word/media/a.png"), ("r3", "top.xml"))}
    images = pk.media(found).collect()
    assert len(images) == 2 and all(bytes(r.data) == PNG and r.size == len(PNG) and r.name == f"asset-{r.sha256[:8]}" for r in images)


def test_files_are_read_and_told_apart(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(flat())
    (tmp_path / "b.docx").write_bytes(zipped())
    (tmp_path / "c.xml").write_bytes(b"<DIV5/>")
    read = pk.read_packages(spark, f"file://{tmp_path}/*")
    assert sorted(r.k for r in read.select(pk.source_kind(read.content).alias("k")).collect()) == ["ecfr", "flat", "zip"]


def test_rels_path(spark):
    frame = spark.createDataFrame([("word/document.xml",), ("a.xml",)], "p string")
    assert [r.r for r in frame.select(pk.rels_path(frame.p).alias("r")).collect()] == ["word/_rels/document.xml.rels", "_rels/a.xml.rels"]


PART = """<DIV5 N="25"><HEAD>PART 25</HEAD><DIV6 N="A"><HEAD>Subpart A</HEAD><DIV8 N="§ 25.1" hierarchy_metadata='{"citation":"14 CFR 25.1"}'><HEAD>§ 25.1 Scope.</HEAD>
<P>First <I>one</I>  text.</P><TABLE><TR><TH>a</TH><TH>b</TH></TR><TR><TD>1</TD><TD>2</TD></TR></TABLE><P>Last.</P><img src="x.gif"/></DIV8><DIV7 N="g"><HEAD>Group</HEAD><DIV8 N="25.3"><HEAD>Other</HEAD></DIV8></DIV7></DIV6></DIV5>"""


def test_divisions_become_nodes_and_topics(spark):
    nodes = sections.section_nodes(given(spark, p=PART.encode(), bad=b"<DIV5>", none=None))
    rows = sorted((r for r in nodes.collect() if r.error is None), key=lambda r: r.ord)
    assert [(r.node_type, r.parent, r.depth, r.level) for r in rows] == [
        ("document", None, 0, None), ("section", 0, 1, 1), ("requirement", 1, 2, None), ("paragraph", 2, 3, None), ("table_row", 2, 3, None),
        ("table_row", 2, 3, None), ("warning", 2, 3, None), ("paragraph", 2, 3, None), ("image", 2, 3, None), ("warning", 2, 3, None), ("section", 1, 2, 2), ("requirement", 10, 3, None),
    ]
    assert nodes.where("error is not null").count() == 2
    got = {r.designation: (r.title, r.body) for r in sections.topics(nodes).collect()}
    assert got == {"14 CFR 25.1": ("Scope", "First one text.\na | b\n1 | 2\nLast."), "14 CFR 25.3": ("Other", "")}


def test_parts_of_a_role_are_led_to_or_lie_at_their_place(spark):
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rel = lambda i, kind, target: f'<Relationship Id="{i}" Type="{office}/{kind}" Target="{target}"/>'
    own = f"<Relationships>{rel('r2', 'officeDocument', 'b.xml')}{rel('r1', 'officeDocument', 'a.xml')}{rel('r3', 'styles', 'gone.xml')}{rel('r4', 'image', 'a.xml')}</Relationships>"
    rows = [("led", "_rels/.rels", own), ("led", "a.xml", ""), ("led", "b.xml", ""), ("led", "word/document.xml", ""), ("led", "word/styles.xml", ""), ("usual", "word/document.xml", ""), ("usual", "word/numbering.xml", ""), ("none", "x.xml", ""), ("none", None, None)]
    parts = spark.createDataFrame([(p, n, None, d.encode() if d is not None else None, None) for p, n, d in rows], pk.PARTS)
    found = pk.role_parts(parts, pk.relationships(parts))
    assert {tuple(r) for r in found.collect()} == {("led", "main", "a.xml"), ("led", "styles", "word/styles.xml"), ("usual", "main", "word/document.xml"), ("usual", "numbering", "word/numbering.xml")}
    main = found.where("role = 'main'")
    assert {(r.package, r.part) for r in pk.chosen(parts, main).collect()} == {("led", "a.xml"), ("usual", "word/document.xml")}
    assert pk.chosen(parts, "word/document.xml").count() == 2


def test_publications_of_brands_are_whole(spark, sf_dir):
    """Volumes are read as one publication: topics are numbered through, files have one index, and what follows the topics counts once."""
    from codexframe.plans import output_queries, package_queries  # noqa: F401  (they register)
    from codexframe.plans.registry import QUERIES

    brands = {r.p_brand: r["count"] for r in spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").count().collect()}
    numbers = {}
    for r in QUERIES["package_topics"](spark, sf_dir).collect():
        numbers.setdefault(r.package, []).append(r.n)
    assert {b: sorted(own) for b, own in numbers.items()} == {b: list(range(1, n + 1)) for b, n in brands.items()}
    assert {r.package for r in QUERIES["numbered_sections"](spark, sf_dir).collect()} == {f"n:{b}" for b in brands}
    ready = QUERIES["preparation_counts"](spark, sf_dir).collect()
    assert {r.package: (r.n_outline, r.n_tables, r.n_warnings) for r in ready} == {b: (n, 1, 2) for b, n in brands.items()}


def test_places_go_on_from_volume_to_volume(spark):
    from codexframe.plans.package_queries import of_brands

    rows = spark.createDataFrame([("B#1.0", 5, None), ("B#1.10", 1, 1), ("B#1.9", 7, 2)], "package string, ord long, topic long")
    found = of_brands(rows, "ord", "topic").orderBy("ord").collect()
    assert [(r.package, r.ord & 0xFFFFFFFF, r.topic and r.topic >> 32) for r in found] == [("B#1", 5, None), ("B#1", 7, 9), ("B#1", 1, 10)]


def test_packages_lie_with_many_tasks_however_few_their_bytes(spark, sf_dir):
    from codexframe.plans import package_queries

    for packages in (package_queries._packages(spark, sf_dir), package_queries._numbered(spark, sf_dir)):
        assert packages.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
