"""Publications read by byte ranges against the whole-file parse, at several split sizes."""

import random

import pytest

from codexframe.sources import packages, sections, split_sections

TAILS = ("", "<P>after é</P>", "<img src='a.gif'/>", "<!-- a > b --><P>x &amp; y</P>", "<NOTE>n <E>b</E></NOTE>", "text", "<TABLE><TR><TD>1</TD><TD>2</TD></TR></TABLE>", "<FP>q<![CDATA[ <b> ]]></FP>")


def division(draw, level):
    tag = f"DIV{level}"
    own = f'<{tag} N="§ 25.{draw.randint(1, 999)}" TYPE="a>b">' + draw.choice(["", "<HEAD>§ 25.7 Über uns.</HEAD>"])
    own += "".join(f"<P>p{draw.randint(0, 9)} <I>i</I></P>" for _ in range(draw.randint(0, 3)))
    if level < 9:
        for _ in range(draw.randint(0, 3)):
            wrap = draw.random() < 0.2
            own += ("<EXTRACT>held" if wrap else "") + division(draw, draw.choice([k for k in (6, 7, 8, 9) if k >= level])) + draw.choice(TAILS) + ("</EXTRACT>" if wrap else "") + draw.choice(TAILS)
    return f"{own}</{tag}>"


def publication(draw, n):
    parts = "".join(division(draw, 6) + draw.choice(TAILS) for _ in range(n))
    later = '<DIV5 N="26"><HEAD>Later</HEAD><DIV8 N="26.1"/></DIV5>' if n % 2 else ""
    return f'<?xml version="1.0"?>\n<!DOCTYPE ECFR [<!ELEMENT a ANY>]>\n<ECFR><DIV1 N="1"><HEAD>T</HEAD><P>before</P><DIV5 N="25" hierarchy_metadata=\'{{"citation":"14 CFR Part 25"}}\'><HEAD>PART 25</HEAD>{parts}</DIV5>{later}<P>behind</P></DIV1></ECFR>\n'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, draw = tmp_path_factory.mktemp("publications"), random.Random(3)
    for n in (0, 1, 4, 6):
        (at / f"p{n}.xml").write_text(publication(draw, n), encoding="utf-8")
    (at / "bare.xml").write_text('<DIV5 N="1"><DIV8 N="1.1"><P>x</P></DIV8></DIV5>')
    return at


def told(nodes):
    return sorted((r.package.rsplit("/", 1)[1], *r[1:]) for r in nodes.collect())


@pytest.mark.parametrize("size", [61, 500, 1 << 20])
def test_splits_of_any_size_give_the_rows_of_the_whole_file(spark, folder, size):
    whole = told(sections.section_nodes(packages.read_packages(spark, f"file://{folder}/*.xml")))
    assert all(r[-1] is None for r in whole) and len(whole) > 100
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert told(split_sections.section_nodes_of_files(spark, f"file://{folder}/*.xml", size)) == whole
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == kept


def test_broken_files_give_one_row_with_an_error(spark, tmp_path):
    bad = {
        "open": '<DIV5 N="1"><DIV8 N="1"><P>a</P></DIV8>', "crossed": '<DIV5 N="1"><DIV8 N="1"></DIV5></DIV8>', "extra": '<DIV5 N="1"></DIV5></ECFR>', "comment": '<DIV5 N="1"><!-- <DIV8 N="1"/> --></DIV5>',
        "inside": '<DIV5 N="1"><P>a<DIV8 N="1"/></P></DIV5>', "nested": '<DIV5 N="1"><DIV5 N="2"/></DIV5>', "none": "<ECFR><P>a</P></ECFR>", "entity": '<DIV5 N="1"><P>&nope;</P></DIV5>'
    }
    for name, text in bad.items():
        (tmp_path / f"{name}.xml").write_text(text)
    (tmp_path / "empty.xml").write_text("")
    (tmp_path / "good.xml").write_text('<DIV5 N="1"></DIV5>')
    for size in (16, 1 << 20):
        rows = told(split_sections.section_nodes_of_files(spark, f"file://{tmp_path}/*.xml", size))
        assert [r[0] for r in rows if r[-1]] == sorted(f"{n}.xml" for n in bad) and all(r[1] is None for r in rows if r[-1])
        assert [r[0] for r in rows if not r[-1]] == ["good.xml"]
