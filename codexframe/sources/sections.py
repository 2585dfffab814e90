"""Numbered-division XML (parts, subparts, sections) as flattened nodes: one task parses one publication at a time."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "package string, ord long, parent long, depth int, node_type string, level int, designation string, title string, text string, runs array<struct<kind:string,text:string>>, error string"
#: Divisions that hold others, with their outline level; a section is division 8 (fixed values).
CONTAINERS = {"DIV6": 1, "DIV7": 2}
SECTION, ROOT = "DIV8", "DIV5"
_TABLES = ("TABLE", "GPOTABLE", "BOXTXT")
#: A section's head: its number after the section sign, then its title up to a final full stop.
_HEAD = re.compile(r"\s*§+\s*([\d.]+[A-Za-z]?)\s*(.*?)\.?\s*")
#: Inline elements that carry a format (fixed values).
FORMATS = {"I": "italic", "E": "bold"}


def _flat(element) -> str:
    return " ".join("".join(element.itertext()).split())


def _citation(element) -> str:
    """The citation in an element's metadata, escaped once or twice."""
    own = re.search(r'citation"?\s*:\s*"?([^",}]+)', (element.get("hierarchy_metadata") or "").replace("&quot;", '"').replace("\\", ""))
    return own[1].replace("§", "").strip() if own else ""


def _runs(element) -> list[dict]:
    """Text and formatted text of a paragraph, in order."""
    found = [("", element.text)]
    for child in element:
        found += [(FORMATS.get(child.tag, ""), "".join(child.itertext())), ("", child.tail)]
    return [{"kind": kind, "text": text} for kind, text in found if text]


class _Walk:
    """Rows of one publication in document order."""

    def __init__(self):
        self.rows: list[tuple] = []
        #: Rows that were taken away already.
        self.taken = 0

    def add(self, parent: int | None, depth: int, kind: str, level: int | None = None, designation: str = "", title: str = "", text: str = "", runs: list[dict] | None = None) -> int:
        own = self.taken + len(self.rows)
        self.rows.append((own, parent, depth, kind, level, designation, title, text, runs, None))
        return own

    def part(self, element, parent: int | None = None, depth: int = 0) -> None:
        head = element.find("HEAD")
        own = self.add(parent, depth, "document", None, _citation(element) or f"14 CFR {element.get('N') or ''}".strip(), _flat(head) if head is not None else "")
        self.visit(element, own, depth + 1)

    def visit(self, element, parent: int | None, depth: int) -> None:
        for child in element:
            tag = child.tag
            if tag in CONTAINERS or tag == SECTION:
                head = child.find("HEAD")
                title = _flat(head) if head is not None else ""
                cited = _citation(child)
                if tag == SECTION:
                    named = _HEAD.fullmatch(title)
                    number = (child.get("N") or (named[1] if named else "")).replace("§", "").strip()
                    own = self.add(parent, depth, "requirement", None, cited or f"14 CFR {number}", named[2].strip() if named else title)
                else:
                    own = self.add(parent, depth, "section", CONTAINERS[tag], cited, title)
                self.visit(child, own, depth + 1)
            elif tag == "HEAD":
                continue
            elif tag.startswith(("P", "FP")):
                if own := _flat(child):
                    self.add(parent, depth, "paragraph", text=own, runs=_runs(child))
            elif tag in _TABLES:
                rows = [[_flat(c) for c in row if c.tag in ("TD", "TH", "ENT")] for row in child.iter() if row.tag in ("TR", "ROW")]
                for cells in rows:
                    self.add(parent, depth, "table_row", text=" | ".join(cells))
                self.add(parent, depth, "warning", text=f"{tag}: {len(rows)} rows of at most {max(map(len, rows), default=0)} cells as paragraphs")
            elif tag == "img":
                self.add(parent, depth, "image", text=child.get("src") or "")
                self.add(parent, depth, "warning", text="img: image not extracted")
            elif len(child):
                self.visit(child, parent, depth)
            elif own := _flat(child):
                self.add(parent, depth, "paragraph", text=own, runs=_runs(child))


def section_nodes(packages: DataFrame) -> DataFrame:
    """Nodes of every publication (package, content): pre-order, parent, depth, type, level, designation, title, text.

    Table rows become one node each, cells joined by a spaced bar; flattened tables and images left out are warnings. A
    paragraph's runs tell bold and italic text apart. A publication that can't be parsed gives one row
    with an error.
    """
    names = [c.split()[0] for c in NODES.split(", ")]
    run_type = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[1], run_type)) for c in NODES.split(", ")])

    def run(batches):
        for batch in batches:
            for package, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                walk, error = _Walk(), None
                try:
                    root = ElementTree.fromstring(raw or b"")
                except ElementTree.ParseError as e:
                    error = f"ParseError: {e}"
                else:
                    walk.part(root if root.tag == ROOT else next(root.iter(ROOT), root))
                rows = [(package, *r) for r in walk.rows] if error is None else [(package, *[None] * (len(names) - 2), error)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return packages.select("package", "content").mapInArrow(run, NODES)


def topics(nodes: DataFrame) -> DataFrame:
    """One row a requirement: package, ord, designation, title, body (its paragraphs and table rows in order)."""
    held = nodes.where("node_type in ('paragraph', 'table_row')").groupBy("package", F.col("parent").alias("ord"))
    pieces = F.sort_array(F.collect_list(F.struct(F.col("ord").alias("o"), F.col("text").alias("t"))))
    bodies = held.agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "\n").alias("body"))
    own = nodes.where("node_type = 'requirement'").select("package", "ord", "designation", "title")
    return own.join(bodies, ["package", "ord"], "left").select("package", "ord", "designation", "title", F.coalesce("body", F.lit("")).alias("body"))
