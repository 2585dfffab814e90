"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexframe.llm import common
from codexframe.llm.minhash import one_of_each_group
from codexframe.llm.packing import pack_documents
from codexframe.llm.quality import accepted_documents, train
from codexframe.llm.queries import table, tokenizer_path
from codexframe.llm.secrets import redact_documents
from codexframe.llm.substrings import without_repeats

#: Work tables by the stage that wrote them last.
_written_by: dict[str, list[str]] = {}


def _stage(after: str | None):
    """A stage whose work tables go when the stage after it begins: what it returned has been written by then."""

    def wrap(fn):
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            common.release(spark, _written_by.pop(after, []))
            mark = len(common.written_since())
            out = fn(spark, docs, sf_dir)
            _written_by[fn.__name__] = common.written_since(mark)
            return out

        run.__doc__ = fn.__doc__
        return run

    return wrap


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the text is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@_stage(None)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learned from the labelled ones among them, accepts."""
    return accepted_documents(docs, train(docs, table(spark, sf_dir, "labels")))


@_stage("quality")
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, similarity 0.8 or more."""
    return one_of_each_group(docs)


@_stage("near_dedup")
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur elsewhere as well."""
    return _measured(without_repeats(docs))


@_stage("substring_dedup")
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with all found secrets masked."""
    return _measured(redact_documents(docs))


@_stage("secrets")
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("secrets", secrets), ("packing", packing)]

#: Models, shingle classes and token ids are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    last = None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        at = f"{common.shared_dir(spark)}/pipeline-{name}-{common.uuid.uuid4().hex}"
        out.write.parquet(at)
        if last:
            common.release(spark, [last])
        docs, last = spark.read.schema(out.schema).parquet(at), at
    raise AssertionError("no stages")
