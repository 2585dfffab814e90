"""Word-processor bodies as flattened nodes: topics, paragraphs, headings, list items and table cells in document order.

A task parses one body at a time into rows; lists, merged cells, captions, links and figures, which depend on other
rows, are windows and joins over them.
"""

from __future__ import annotations

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexframe.sources import packages

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
#: Namespaces of the publisher's own elements, and body elements without content (fixed values).
PUBLISHER = ("{http://www.easa.europa.eu/erules}", "{http://www.easa.europa.eu/erules-export}")
_NOISE = ("sectPr", "bookmarkStart", "bookmarkEnd", "proofErr")
#: Lines that a topic's title and designation may come from.
LINES = 12
NODES = (
    "package string, ord long, topic long, node_type string, style string, level int, num_id string, table_no long, row_no long, col_no long, colspan int, vmerge string, text string, "
    "runs array<struct<kind:string,text:string,rel_id:string,title:string>>, sdt_id string, erules_id string, title string, lines array<string>, meta array<struct<name:string,value:string>>"
)
_RUN = pa.struct([(n, pa.string()) for n in ("kind", "text", "rel_id", "title")])
_META = pa.struct([("name", pa.string()), ("value", pa.string())])
_SCHEMA = pa.schema(
    [("package", pa.string()), ("ord", pa.int64()), ("topic", pa.int64()), ("node_type", pa.string()), ("style", pa.string()), ("level", pa.int32()), ("num_id", pa.string()), ("table_no", pa.int64()), ("row_no", pa.int64()), ("col_no", pa.int64()),
     ("colspan", pa.int32()), ("vmerge", pa.string()), ("text", pa.string()), ("runs", pa.list_(_RUN)), ("sdt_id", pa.string()), ("erules_id", pa.string()), ("title", pa.string()), ("lines", pa.list_(pa.string())), ("meta", pa.list_(_META))]
)


def _text(element) -> str:
    out = []
    for e in element.iter():
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag == f"{_W}tab":
            out.append("\t")
        elif e.tag == f"{_W}br":
            out.append("\n")
    return "".join(out)


def _value(element, path: str) -> str | None:
    found = element.find("/".join(f"{_W}{step}" for step in path.split("/")))
    return None if found is None else found.get(f"{_W}val", "")


def _format(run) -> str:
    """Formats of a run from the inside out, joined by a plus."""
    props = run.find(f"{_W}rPr")
    if props is None:
        return ""
    raised = _value(props, "vertAlign")
    kinds = [raised] if raised in ("superscript", "subscript") else []
    return "+".join(kinds + [kind for kind, tag in (("bold", "b"), ("italic", "i")) if props.find(f"{_W}{tag}") is not None])


def _runs(paragraph) -> list[dict]:
    """Inline content of a paragraph: formatted text, links and drawings, neighbours of one format as one."""
    out: list[dict] = []

    def add(kind, text, rel_id=None, title=None):
        if out and rel_id is None and out[-1]["kind"] == kind and out[-1]["rel_id"] is None:
            out[-1]["text"] += text
        elif text or rel_id:
            out.append({"kind": kind, "text": text, "rel_id": rel_id, "title": title})

    def visit(element):
        for child in element:
            if child.tag == f"{_W}r":
                add(_format(child), _text(child))
                for drawing in child.iter(f"{_W}drawing"):
                    blip, shown = drawing.find(f".//{_A}blip"), drawing.find(f".//{_WP}docPr")
                    if blip is not None and blip.get(f"{_R}embed"):
                        described = "" if shown is None else shown.get("descr") or ""
                        add("drawing", described, blip.get(f"{_R}embed"), (None if shown is None else shown.get("title")) or described)
            elif child.tag == f"{_W}hyperlink":
                add("link", _text(child), child.get(f"{_R}id"), child.get(f"{_W}anchor"))
            elif child.tag != f"{_W}pPr":
                visit(child)

    visit(paragraph)
    return out


def _lines(element) -> list[str]:
    """First lines of an element that are not blank."""
    lines = []
    for p in element.iter(f"{_W}p"):
        if own := " ".join("".join(p.itertext()).split()):
            lines.append(own)
            if len(lines) == LINES:
                break
    return lines


class _Body:
    """Rows of one body; nested tables follow the cell that holds them, under a number of their own."""

    def __init__(self):
        self.rows: list[dict] = []
        self.tables = 0

    def add(self, kind: str, topic: int | None, **values) -> int:
        self.rows.append({"ord": len(self.rows), "topic": topic, "node_type": kind, "text": "", **values})
        return len(self.rows) - 1

    def paragraph(self, p, topic) -> None:
        style, num_id = _value(p, "pPr/pStyle"), _value(p, "pPr/numPr/numId")
        low, held = (style or "").lower(), {"text": _text(p), "runs": _runs(p)}
        if "head" in low or low in ("title", "subtitle"):
            digits = "".join(c for c in low.rpartition("head")[2] if c.isdigit())
            self.add("heading", topic, style=style, level=min(max(int(digits or 1), 1), 6), **held)
        elif num_id is not None:
            self.add("list_item", topic, style=style, num_id=num_id, **held)
        else:
            self.add("paragraph", topic, style=style, **held)

    def table(self, t, topic) -> None:
        self.tables += 1
        number = self.tables
        for r, row in enumerate(t.findall(f"{_W}tr")):
            col, header = 0, _value(row, "trPr/tblHeader") is not None
            for cell in row.findall(f"{_W}tc"):
                span = int(_value(cell, "tcPr/gridSpan") or 1)
                merge = _value(cell, "tcPr/vMerge")
                state = None if merge is None else ("restart" if merge == "restart" else "continue")
                own = cell.findall(f"{_W}p")
                self.add("cell", topic, style="header" if header else None, table_no=number, row_no=r, col_no=col, colspan=span, vmerge=state, text="\n".join(map(_text, own)), runs=[run for p in own for run in _runs(p)])
                for inner in cell.findall(f"{_W}tbl"):
                    self.table(inner, topic)
                col += span

    def tag(self, sdt, topic) -> None:
        """A structured tag: a topic, a heading or, of any other kind, its content only."""
        content = next(sdt.iter(f"{_W}sdtContent"), None)
        if content is None:
            return
        names = [e.get(f"{_W}val", "").strip().lower() for local in ("alias", "tag") if (e := next(sdt.iter(f"{_W}{local}"), None)) is not None]
        kind = next((n for n in names if n in ("topic", "heading")), None)
        if kind is None:
            return self.visit(content, topic)
        number = next(sdt.iter(f"{_W}id"), None)
        own = self.add("topic" if kind == "topic" else "section", topic, level=1, sdt_id=None if number is None else number.get(f"{_W}val"), lines=_lines(content))
        inner = [e for e in content if e.tag == f"{_W}sdt"] if kind == "topic" else []
        self.visit([e for e in content if e not in inner], own)
        self.visit(inner, topic)  # nested topics follow the one that holds them

    def own_element(self, element, topic) -> None:
        """An element of the publisher's: a topic, metadata, or an unknown one."""
        space, local = element.tag.rpartition("}")[0] + "}", element.tag.rpartition("}")[2]
        if local == "topic":
            part = lambda name: next((e for e in element.iter(f"{space}{name}")), None)
            meta, given = part("metadata"), lambda e: None if e is None else e.text or ""
            own = self.add("topic", topic, level=1, erules_id=given(part("id")), title=given(part("title")), meta=[] if meta is None else self.pairs(meta))
            self.visit([e for e in element if e.tag not in {f"{n}{x}" for n in PUBLISHER for x in ("id", "title", "metadata")}], own)
        elif local == "metadata":
            self.add("metadata", topic, meta=self.pairs(element))
        else:
            self.add("unknown", topic, title=local)

    @staticmethod
    def pairs(meta) -> list[dict]:
        return [{"name": e.tag.rpartition("}")[2], "value": e.text} for e in meta if e.text]

    def visit(self, elements, topic=None) -> None:
        for child in elements:
            local = child.tag.rpartition("}")[2]
            if child.tag.startswith(PUBLISHER):
                self.own_element(child, topic)
            elif local == "p":
                self.paragraph(child, topic)
            elif local == "tbl":
                self.table(child, topic)
            elif local == "body":
                self.visit(child, topic)
            elif local == "sdt":
                self.tag(child, topic)
            elif local not in _NOISE:
                self.add("unhandled", topic, title=local)


def body_nodes(parts: DataFrame, part: str | DataFrame = "word/document.xml") -> DataFrame:
    """Nodes of the main part of every package (by name, or by a table as packages.role_parts gives it).

    A part that isn't well-formed gives one error node.

    Topics and sections come before what they hold, whose `topic` is their number. Metadata, unknown elements of the
    publisher and unhandled ones are nodes of these types.
    """

    def run(batches):
        for batch in batches:
            for package, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = _Body()
                try:
                    body.visit(ElementTree.fromstring(raw))
                except ElementTree.ParseError as error:
                    body.rows = [{"ord": 0, "node_type": "error", "text": f"ParseError: {error}"}]
                yield pa.RecordBatch.from_pylist([{"package": package, **r} for r in body.rows], schema=_SCHEMA)

    return packages.chosen(parts, part).where("data is not null").select("package", "data").mapInArrow(run, NODES)


def lists(nodes: DataFrame) -> DataFrame:
    """List items with the list they belong to (adjacent items form one) and their number in it: package, ord, list_no, number, text."""
    own = nodes.where("node_type <> 'cell'")  # a topic or any other block between ends a list
    order = Window.partitionBy("package").orderBy("ord")
    starts = (F.col("node_type") == "list_item") & ~F.coalesce(F.lag("node_type").over(order) == "list_item", F.lit(False))
    counted = own.withColumn("starts", starts).withColumn("list_no", F.sum(F.when(F.col("starts"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    number = F.row_number().over(Window.partitionBy("package", "list_no").orderBy("ord")).cast("long")
    return counted.where("node_type = 'list_item'").select("package", "ord", "list_no", number.alias("number"), "text")


def cells(nodes: DataFrame) -> DataFrame:
    """Table cells with their row spans; cells that a merge continues are left out: a restart spans what follows it in its column."""
    column = Window.partitionBy("package", "table_no", "col_no").orderBy("row_no")
    heads = F.sum(F.when(F.coalesce(F.col("vmerge"), F.lit("")) != "continue", 1).otherwise(0)).over(column.rowsBetween(Window.unboundedPreceding, 0))
    runs = nodes.where("node_type = 'cell'").withColumn("head", heads)
    span = F.count("*").over(Window.partitionBy("package", "table_no", "col_no", "head"))
    spans = runs.withColumn("rowspan", F.when(F.col("vmerge") == "restart", span).otherwise(F.lit(1)).cast("long"))
    return spans.where("vmerge is null or vmerge <> 'continue'").select("package", "table_no", "row_no", "col_no", "colspan", "rowspan", "text")


def captions(nodes: DataFrame) -> DataFrame:
    """Caption of every table: the nearest paragraph of its topic before it that starts with table or figure, else the first after it."""
    order = Window.partitionBy("package", "topic").orderBy("ord")
    is_caption = F.lower(F.trim("text")).rlike("^(table|figure|fig\\.)") & (F.col("node_type") == "paragraph")
    text = F.when(is_caption, F.col("text"))
    before = F.last(text, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(text, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    both = nodes.withColumn("caption", F.coalesce(before, after))
    return both.where("node_type = 'cell'").groupBy("package", "table_no").agg(F.min_by("caption", "ord").alias("caption"))


def numbering(parts: DataFrame, part: str | DataFrame = "word/numbering.xml") -> DataFrame:
    """Format of every list of a package (package, num_id, format): that of the first level it is defined by, else decimal."""
    schema = pa.schema([(n, pa.string()) for n in ("package", "tag", "id", "value")])

    def run(batches):
        for batch in batches:
            rows = []
            for package, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    root = ElementTree.fromstring(raw)
                except ElementTree.ParseError:
                    continue
                for e in root.iter(f"{_W}abstractNum"):
                    rows.append((package, "abstract", e.get(f"{_W}abstractNumId"), _value(e, "lvl/numFmt")))
                for e in root.iter(f"{_W}num"):
                    rows.append((package, "num", e.get(f"{_W}numId"), _value(e, "abstractNumId")))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    rows = packages.chosen(parts, part).where("data is not null").select("package", "data").mapInArrow(run, "package string, tag string, id string, value string")
    formats = rows.where("tag = 'abstract'").groupBy("package", F.col("id").alias("value")).agg(F.first("value").alias("format"))
    lists_ = rows.where("tag = 'num' and id is not null").select("package", F.col("id").alias("num_id"), "value")
    return lists_.join(formats, ["package", "value"], "left").select("package", "num_id", F.coalesce("format", F.lit("decimal")).alias("format"))


def is_ordered(format_: str = "format"):
    """Whether a list of that format is numbered."""
    return ~F.coalesce(F.col(format_), F.lit("decimal")).isin("bullet", "none")


def links(nodes: DataFrame, rels: DataFrame, part: str | DataFrame = "word/document.xml") -> DataFrame:
    """Hyperlinks with their urls (package, ord, text, url): the main part's relationship, else the package's; others are left out."""
    found = nodes.select("package", "ord", F.explode("runs").alias("run")).where("run.kind = 'link'").select("package", "ord", "run.text", "run.rel_id")
    kind = rels.where(F.endswith("type", F.lit("/hyperlink")))
    own = packages.chosen(kind, part, "source_part").unionByName(kind.where("source_part = ''")).groupBy("package", "rel_id").agg(F.min_by("target", F.col("source_part") == "").alias("url"))
    return found.join(own, ["package", "rel_id"]).select("package", "ord", "text", "url")


def figures(nodes: DataFrame, targets: DataFrame, media_: DataFrame, topics: DataFrame, part: str | DataFrame = "word/document.xml") -> DataFrame:
    """Drawings with their images: package, ord, image_path, caption, alt_text, sha256.

    targets: relationships with the parts they lead to; topics: (package, ord, designation, erules_id). Images are named
    by their rule and numbered in it; where a name comes again with other bytes, it gets a suffix.
    """
    from codexframe.functions.text import extension_of, slugify_rule

    found = nodes.where("runs is not null").select("package", "ord", "topic", F.posexplode("runs").alias("pos", "run")).where("run.kind = 'drawing'")
    found = found.select("package", "ord", "topic", "pos", "run.rel_id", F.col("run.title").alias("caption"), F.col("run.text").alias("alt_text"))
    image = packages.chosen(targets, part, "source_part").select("package", "rel_id", "part").join(media_.select("package", "part", "content_type", "sha256"), ["package", "part"])
    name = lambda c: F.when(~F.startswith(F.upper(c), F.lit("ERULES")), F.nullif(F.col(c), F.lit("")))
    rule = topics.select("package", F.col("ord").alias("topic"), slugify_rule(F.coalesce(name("designation"), name("erules_id"))).alias("rule"))
    both = found.join(image, ["package", "rel_id"]).join(rule, ["package", "topic"], "left").withColumn("rule", F.coalesce("rule", F.lit("doc")))
    number = F.row_number().over(Window.partitionBy("package", "rule").orderBy("ord", "pos"))
    named = both.withColumn("image_path", F.concat("rule", F.lit("-fig-"), F.lpad(number.cast("string"), 2, "0"), F.lit("."), extension_of(F.col("content_type"))))
    return named.select("package", "ord", "image_path", "caption", "alt_text", "sha256")


def stored_names(assets: DataFrame, keys: list[str], name: str = "name", digest: str = "sha256", order: str = "ord") -> DataFrame:
    """Adds stored: the name, with -1, -2 and so on before its extension for bytes that differ from the first of that name."""
    first = assets.groupBy(*keys, name, digest).agg(F.min(order).alias("_first"))
    rank = (F.row_number().over(Window.partitionBy(*keys, name).orderBy("_first")) - 1).cast("string")  # a name has few contents
    suffixed = F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("-"), rank, F.regexp_extract(name, r"(\.[^.]*)?$", 1))
    stored = first.withColumn("stored", F.when(rank == "0", F.col(name)).otherwise(suffixed)).drop("_first")
    return assets.join(stored, [*keys, name, digest])
