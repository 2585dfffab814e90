"""Helpers that several operators share: the shared work folder, materialised tables, Arrow batches, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Work tables written so far in this session, by their own folder.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where it is unset and all run on one machine."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="work-"))
        at = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one intermediate result."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(at)
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and lost executors lose nothing."""
    spark = df.sparkSession
    at = work_path(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def anew(df: DataFrame) -> DataFrame:
    """df with columns of their own, for a cogroup with a table of the same origin."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


#: The cache of the operator that a worker process last worked for.
_cache: dict = {}


def give_back() -> None:
    """Memory that this process no longer uses, to the system: workers go on from stage to stage and would keep it beside the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def own_cache(name: object, make: Callable):
    """The worker's cache of that name; another operator's is dropped first, so that those of several stages don't add up."""
    if name not in _cache:
        _cache.clear()
        give_back()
        _cache[name] = make()
    return _cache[name]


def written_since(mark: int = 0) -> list[str]:
    """Work tables written since there were `mark` of them."""
    return _written[mark:]


def release(spark: SparkSession, tables: list[str]) -> None:
    """Delete work tables; results that still read them must have been written before."""
    for at in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str) -> DataFrame:
    """mapInArrow with a function from one record batch to one dict of columns (or None)."""
    spark = df.sparkSession
    target = arrow_schema(spark, schema)

    def run(batches):
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_pydict(out, schema=target)

    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The bytes of a column of texts, which need not be UTF-8."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def texts(column: pa.Array) -> list[str | None]:
    """A column of texts; a byte that is not UTF-8 counts as U+FFFD."""
    return [None if t is None else t.decode("utf-8", "replace") for t in raw_texts(column)]


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node with a link: (node, component).

    edges: (a, b) longs, in any direction, repeats and loops allowed. Alternating large-star and
    small-star rounds (each a grouped minimum and a join on the node, so a hub with very many links is
    split by the adaptive skew join), until a round changes nothing. Each round is written to the shared folder.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")  # no aggregate beside the join
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = materialize(small.where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum("u"), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
