"""Web pages as rows: links by pattern, nodes by a tolerant tokenizer."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = {"br", "hr", "img", "input", "link", "meta"}


def links(df: DataFrame, key: str, html: str) -> DataFrame:
    """href of every anchor of every page, in order."""
    return df.select(key, F.explode(F.regexp_extract_all(F.col(html), F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href"))


class _Nodes(HTMLParser):
    """Elements and text runs in document order, with the place of their parent; unclosed tags end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int | None, int, str, str]] = []
        self.open: list[tuple[int, str]] = []

    def _add(self, kind: str, text: str) -> int:
        self.rows.append((len(self.rows), self.open[-1][0] if self.open else None, len(self.open), kind, text))
        return len(self.rows) - 1

    def handle_starttag(self, tag, attrs):
        place = self._add(tag, "")
        if tag not in _VOID:
            self.open.append((place, tag))

    def handle_startendtag(self, tag, attrs):
        self._add(tag, "")

    def handle_endtag(self, tag):
        if any(t == tag for _, t in self.open):
            while self.open.pop()[1] != tag:
                pass

    def handle_data(self, data):
        if data.strip():
            self._add("text", " ".join(data.split()))


def page_nodes(df: DataFrame, key: str, html: str) -> DataFrame:
    """Flattened nodes of every page: key, ord (pre-order), parent, depth, node_type, text."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, ord long, parent long, depth int, node_type string, text string"

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in (key, "ord", "parent", "depth", "node_type", "text")}
            for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parser = _Nodes()
                parser.feed(page or "")
                parser.close()
                for row in parser.rows:
                    for column, value in zip(out.values(), (k, *row), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(key, batch.schema.field(0).type), ("ord", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("node_type", pa.string()), ("text", pa.string())]))

    return df.select(key, html).mapInArrow(run, schema)
