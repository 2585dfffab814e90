"""Numbered-division XML of any size: files are split at byte ranges, and open containers are carried from split to split.

Spark's text source cuts a file into records that begin at a division (`<DIV`), whichever split they start in. A task walks the
records of a split with a stack of its own; what the split closes of the splits before it, and what it leaves open, is all
that is told of it. One pass over these facts, a row a split, gives what is open at each split's start.
"""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexframe.sources import sections
from codexframe.sources.work import shared_path

_OPENING = "<DIV"
#: Comments, character data, instructions, document types, and tags (closing slash, name, slash of an empty element).
_TOKEN = re.compile(r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE(?:[^>\[]|\[.*?\])*>|<(/?)([^\s/>!?"'<]+)(?:[^>"'<]|"[^"<]*"|'[^'<]*')*?(/?)>""", re.DOTALL)
_NUMBERED = {*sections.CONTAINERS, sections.SECTION, sections.ROOT}
_FACTS = "package string, split long, ends boolean, closed array<string>, opened array<struct<name:string,ord:long>>, below long"
_ROWS = f"{_FACTS}, {sections.NODES.removeprefix('package string, ')}"


class _Malformed(ValueError):
    pass


class _Split(sections._Walk):
    """Rows of one split in document order; a parent below zero is the split's surroundings."""

    def __init__(self, package: str, split: int):
        super().__init__()
        self.package, self.split, self.error = package, split, None
        self.stack: list[tuple[str, int | None]] = []
        self.closed: list[str] = []

    def pop(self, name: str) -> None:
        if not self.stack:
            self.closed.append(name)
        elif (own := self.stack.pop()[0]) != name:
            raise _Malformed(f"</{name}> closes {own}")

    def content(self, fragment: str) -> None:
        """Rows of whole elements that lie at the present place."""
        if "<" not in fragment:
            return
        holding = [n for _, n in self.stack if n is not None]
        parent, depth = (holding[-1] if holding else -1), len(holding)
        for child in ElementTree.fromstring(f"<x>{fragment}</x>"):
            if child.tag == sections.ROOT:
                self.part(child, parent, depth)
            else:
                self.visit([child], parent, depth)

    def piece(self, text: str, is_first: bool) -> list[tuple[int, tuple]]:
        """Rows of one record, each with the number of surroundings closed before it."""
        text = text if is_first else _OPENING + text
        inner, start, rest, found = [], 0, 0, []
        first_row = self.taken

        def take() -> None:
            found.extend((len(self.closed), row) for row in self.rows)
            self.taken, self.rows = self.taken + len(self.rows), []

        for token in _TOKEN.finditer(text):
            if "<" in text[rest : token.start()]:
                raise _Malformed("a tag, a comment or character data is cut or not closed")
            rest = token.end()
            slash, name, empty = token.groups()
            if not name or empty:
                continue
            if not slash:
                inner.append(name)
            elif inner:
                if (own := inner.pop()) != name:
                    raise _Malformed(f"</{name}> closes {own}")
            else:
                if not is_first:
                    self.content(text[start : token.start()])
                    take()
                self.pop(name)
                start = token.end()
        if "<" in text[rest:]:
            raise _Malformed("a tag, a comment or character data is cut or not closed")
        for name in inner:
            if name == "HEAD" or name == "img" or name.startswith(("P", "FP")) or name in sections._TABLES:
                raise _Malformed(f"a division in {name}")
        if not is_first:
            self.content(text[start:] + "".join(f"<HEAD/></{name}>" for name in reversed(inner)))
        take()
        self.stack += [(name, first_row if k == 0 and name in _NUMBERED else None) for k, name in enumerate(inner)]
        return found

    def facts(self) -> tuple:
        opened = [{"name": name, "ord": n} for name, n in self.stack]
        return (self.package, self.split, True, self.closed, opened, None, self.taken, *[None] * 8, self.error)


def _walked(batches):
    """Rows of the splits of one task, and behind each split's rows the facts of it."""
    schema, own = _arrow(_ROWS), None
    for batch in batches:
        rows = []
        for package, split, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            is_first = False
            if own is None or (own.package, own.split) != (package, split):
                if own:
                    rows.append(own.facts())
                own, is_first = _Split(package, split), split == 0
            if own.error is None:
                try:
                    rows += [(package, split, False, None, None, below, *row) for below, row in own.piece(text, is_first)]
                except (_Malformed, ElementTree.ParseError) as e:
                    own.error = f"{'ParseError' if isinstance(e, ElementTree.ParseError) else 'Malformed'}: {e}"
        yield _batch(rows, schema)
    if own:
        yield _batch([own.facts()], schema)


def _arrow(ddl: str) -> pa.Schema:
    pair = lambda a, b: pa.list_(pa.struct([(a[0], a[1]), (b[0], b[1])]))
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    kinds |= {"array<struct<name:string,ord:long>>": pair(("name", pa.string()), ("ord", pa.int64())), "array<struct<kind:string,text:string>>": pair(("kind", pa.string()), ("text", pa.string()))}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_STARTS = "package string, split long, before long, around array<long>, error string"


def _carried(facts: pa.Table) -> pa.Table:
    """For each split of one file: rows before it, and the rows of the elements open at its start (null: has no row)."""
    rows, stack, before, error = [], [], 0, None
    for fact in sorted(facts.to_pylist(), key=lambda f: f["split"]):
        error = error or fact["error"]
        rows.append((fact["package"], fact["split"], before, [n for _, n in stack]))
        for name in fact["closed"]:
            if not stack or stack[-1][0] != name:
                error = error or f"Malformed: </{name}> closes {stack[-1][0] if stack else 'nothing'}"
                break
            stack.pop()
        stack += [(o["name"], None if o["ord"] is None else before + o["ord"]) for o in fact["opened"]]
        before += fact["ord"]
    if stack:
        error = error or f"Malformed: {stack[-1][0]} is not closed"
    return pa.Table.from_batches([_batch([(*r, error) for r in rows], _arrow(_STARTS))])


def section_nodes_of_files(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """Nodes of publications in files under a path or glob, as sections.section_nodes gives them; a file's path is its package.

    A file is read by as many tasks as it has splits (split_bytes, else spark.sql.files.maxPartitionBytes). Files are UTF-8
    and use no names of entities or name spaces of their own. A file that is not well formed, holds no part or a part within a
    part, or holds a division in a paragraph, a table, a comment or character data gives one row with an error and nothing
    else. Empty files give no row: Spark's file sources list none. Rows are written once to the shared folder.
    """
    at, key = shared_path(spark, "split-sections"), "spark.sql.files.maxPartitionBytes"
    pieces = spark.read.option("lineSep", _OPENING).text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("package"), F.col("_metadata.file_block_start").alias("split"), "value")
    kept = spark.conf.get(key)
    try:
        spark.conf.set(key, split_bytes or kept)
        pieces.mapInArrow(_walked, _ROWS).write.parquet(at)
    finally:
        spark.conf.set(key, kept)
    walked = spark.read.schema(_ROWS).parquet(at)
    facts = walked.where("ends").select("package", "split", "closed", "opened", "ord", "error")
    starts = facts.groupBy("package").applyInArrow(_carried, _STARTS)
    rows = walked.where("not ends").drop("error").join(starts, ["package", "split"])
    around = F.filter(F.slice("around", F.lit(1), F.size("around") - F.col("below").cast("int")), lambda n: n.isNotNull())
    placed = rows.withColumn("around", around).select(
        "package", (F.col("before") + F.col("ord")).alias("ord"), F.when(F.col("parent") >= 0, F.col("before") + F.col("parent")).otherwise(F.try_element_at("around", F.lit(-1))).alias("parent"),
        (F.col("depth") + F.size("around")).alias("depth"), "node_type", "level", "designation", "title", "text", "runs",
    )
    begun = placed.where("node_type = 'document'").groupBy("package").agg(F.min("ord").alias("_first"), F.bool_or(F.col("depth") > 0).alias("_nested"))
    tops = placed.where("depth = 0").select("package", "ord").join(begun, "package").where("ord > _first").groupBy("package").agg(F.min("ord").alias("_end"))
    failed = starts.groupBy("package").agg(F.first("error", ignorenulls=True).alias("error")).join(begun, "package", "left")
    failed = failed.select("package", F.coalesce("error", F.when(F.col("_first").isNull(), "Malformed: no part").when(F.col("_nested"), "Malformed: a part within a part")).alias("error")).where("error is not null")
    inside = placed.join(begun, "package").join(tops, "package", "left").where("ord >= _first and (_end is null or ord < _end)").join(failed, "package", "left_anti")
    nodes = inside.select("package", (F.col("ord") - F.col("_first")).alias("ord"), (F.col("parent") - F.col("_first")).alias("parent"), F.col("depth").cast("int").alias("depth"), "node_type", "level", "designation", "title", "text", "runs", F.lit(None).cast("string").alias("error"))
    return nodes.unionByName(failed, allowMissingColumns=True)
