"""Outlines of any depth in documents longer than a task: rows are cut into chunks, and what is open is carried across cuts."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from codexframe.sources.work import shared_path


class _Open:
    """Rows of one document that are open at some place of a chunk: their orders and levels, topmost first."""

    def __init__(self, doc):
        self.doc, self.orders, self.levels, self.least = doc, [], [], None

    def close(self, level: int) -> None:
        while self.levels and self.levels[-1] >= level:
            self.orders.pop(), self.levels.pop()

    def open(self, order, level: int) -> None:
        self.orders.append(order), self.levels.append(level)
        self.least = level if self.least is None else min(self.least, level)


def _lists(orders: list, levels: list, offsets: list, kind: pa.DataType) -> pa.Array:
    inner = pa.StructArray.from_arrays([pa.array(orders, kind), pa.array(levels, pa.int64())], ["order", "level"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)


def _within_chunks(batches):
    """Rows of one chunk with what is open above them in it; then what its first and its last document leave open."""
    chunk, own, ends, schema = TaskContext.get().partitionId(), None, [], None
    for batch in batches:
        row, docs, at, level = batch.columns
        orders, levels, offsets = [], [], [0]
        for d, o, k in zip(docs.to_pylist(), at.to_pylist(), level.to_pylist(), strict=True):
            if own is None or own.doc != d:
                own = _Open(d)
                ends = [*ends[:1], own]
            if k is not None:
                own.close(k)
                orders += own.orders
                levels += own.levels
                own.open(o, k)
            offsets.append(len(orders))
        n = batch.num_rows
        columns = [row, docs, level, pa.array([chunk] * n, pa.int64()), _lists(orders, levels, offsets, at.type), pa.array([False] * n)]
        schema = schema or (pa.schema(list(zip(("row", "doc", "level", "chunk", "above", "ends"), (c.type for c in columns), strict=True))), at.type)
        yield pa.RecordBatch.from_arrays(columns, schema=schema[0])
    if ends:
        types, n = schema[0], len(ends)
        orders, levels = [o for e in ends for o in e.orders], [k for e in ends for k in e.levels]
        offsets = [sum(len(e.orders) for e in ends[:i]) for i in range(n + 1)]
        columns = [pa.nulls(n, types.field("row").type), pa.array([e.doc for e in ends], types.field("doc").type), pa.array([e.least for e in ends], pa.int64()), pa.array([chunk] * n, pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, _lists(orders, levels, offsets, schema[1]), pa.array([True] * n)], schema=types)


def _across_chunks(ends: pa.Table) -> pa.Table:
    """What is open at the start of each chunk of one document, from what each of its chunks leaves open and closes."""
    order = sorted(range(ends.num_rows), key=ends["chunk"].to_pylist().__getitem__)
    least, left = ends["level"].to_pylist(), ends["above"].to_pylist()
    stack, found = [], []
    for i in order:
        found.append(list(stack))
        if least[i] is not None:
            stack = [x for x in stack if x["level"] < least[i]]
        stack += left[i]
    taken = ends.take(pa.array(order, pa.int64()))
    return pa.table({"doc": taken["doc"], "chunk": taken["chunk"], "above": pa.array(found, ends["above"].type)})


def open_above(df: DataFrame, doc: str, order: str, level: str, chunks: int | None = None, name: str = "path") -> DataFrame:
    """Adds an array (order, level) of the rows that are open above each row, topmost first; levels are any whole numbers.

    A row closes all rows of its level and below it in the outline. Rows are cut into chunks by ranges of document and
    order, so that a document of any length is spread over tasks; a chunk tells no more than what its first and its last
    document leave open. A row without a level closes nothing and has nothing above it. Rows of one order are taken by level;
    rows of no document are one document. No rows give no rows. A column of the added name is replaced. Rows are written
    once to the shared folder.
    """
    keys = [F.col(doc), F.col(order), F.col(level).cast("long")]
    named = df.select(F.struct(*df.columns).alias("row"), keys[0].alias("doc"), keys[1].alias("order"), keys[2].alias("level"))
    by = ["doc", "order", "level"]
    dealt = named.repartitionByRange(chunks, *by) if chunks else named.repartitionByRange(*by)
    kind = dict(zip(named.columns, named.schema.fields, strict=True))
    above = ArrayType(StructType([StructField("order", kind["order"].dataType), StructField("level", LongType())]))
    schema = StructType([StructField("row", kind["row"].dataType), StructField("doc", kind["doc"].dataType), StructField("level", LongType()), StructField("chunk", LongType()), StructField("above", above), StructField("ends", BooleanType())])
    at = shared_path(df.sparkSession, "open-above")
    dealt.sortWithinPartitions(*by).mapInArrow(_within_chunks, schema).write.parquet(at)
    rows = df.sparkSession.read.schema(schema).parquet(at)
    ends = rows.where("ends").select("doc", "chunk", "level", "above")
    carried = ends.groupBy("doc").applyInArrow(_across_chunks, StructType([schema["doc"], schema["chunk"], schema["above"]])).where(F.size("above") > 0)
    carried = carried.select(F.col("doc").alias("_doc"), F.col("chunk").alias("_chunk"), F.col("above").alias("_above"))
    both = rows.where("not ends").join(carried, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("chunk") == F.col("_chunk")), "left")
    top = F.coalesce(F.try_element_at("above", F.lit(1))["level"], F.col("level"))
    whole = F.when(F.col("_above").isNull() | F.col("level").isNull(), F.col("above")).otherwise(F.concat(F.filter("_above", lambda x: x["level"] < top), "above"))
    whole = both.select("row", whole.alias("_whole"))
    return whole.select(*(F.col("row")[c].alias(c) for c in df.columns if c != name), F.col("_whole").alias(name))


def parents(df: DataFrame, doc: str, order: str, level: str, chunks: int | None = None) -> DataFrame:
    """Adds parent: the order of the nearest earlier row of a lower level, null where there is none; else as open_above."""
    found = open_above(df, doc, order, level, chunks, name="_path")
    return found.withColumn("parent", F.try_element_at("_path", F.lit(-1))["order"]).drop("_path")
