"""Importance resampling towards a target distribution, over hashed runs of words.

Identical texts are one row from the start: features are made once a text and kept as bucket counts, sums count a text
as often as it comes, and its weight is made once and joined back to the documents by the text's digest. Only then does
each document get its own noise. What the tasks share are the gains, one number a bucket. Documents are drawn by a
global sort: tasks number the rows of their range, and a count a range tells where each begins.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexframe.llm.common import arrow_schema, map_batches, materialize, raw_texts

#: Bytes as they count in words: A-Z in lower case, anything but digits, letters and what lies beyond ASCII as a space.
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FEATURES = "digest binary, copies long, n_words long, n_features long, buckets binary, counts binary"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LETTERS).split()


def _text_features(grams: int, buckets: int):
    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_words", "n_features", "buckets", "counts")}
        for text in raw_texts(batch.column(2)):
            words = words_of(text)
            runs = [words] + [[b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] for n in range(2, grams + 1)]
            size = sum(map(len, runs))
            own, many = np.unique(np.fromiter((zlib.crc32(r) for some in runs for r in some), np.uint32, size) % buckets, return_counts=True)
            out["n_words"].append(len(words)), out["n_features"].append(size)
            out["buckets"].append(own.astype("<u4").tobytes()), out["counts"].append(many.astype("<u8" if size >> 32 else "<u4").tobytes())
        return {"digest": batch.column(0), "copies": batch.column(1), **out}

    return run


def _numbers(size: int, buckets: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(buckets, "<u4").astype(np.int64), np.frombuffer(counts, "<u8" if size >> 32 else "<u4").astype(np.int64)


def distinct_features(texts: DataFrame, grams: int, buckets: int) -> DataFrame:
    """Features of every distinct text of texts (text): digest, copies, n_words, n_features, buckets and their counts."""
    once = texts.groupBy(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).agg(F.count("*").alias("copies"))
    return materialize(map_batches(once.select(F.unhex(F.sha2("text", 256)), "copies", "text"), _text_features(grams, buckets), _FEATURES), "features")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs, copies counted: a number a bucket and task is all that moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for copies, size, own, many in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own, many = _numbers(size, own, many)
                total[own] += many * copies
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    part = features.select("copies", "n_features", "buckets", "counts").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in part.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both smoothed shares of every bucket, floored."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """rows with their place (from 1) in a total order; no task holds more than its range of the sort."""
    line = materialize(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")  # task << 33 | place in it
    line = line.withColumn("_task", F.shiftright("_at", 33))
    tasks = line.groupBy("_task").agg(F.count("*").alias("_n"))
    begins = tasks.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))  # a row a task
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return line.join(F.broadcast(begins), "_task").withColumn("place", place).drop("_task", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, grams: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Draw the documents (doc_id, text) that most resemble target (text), with noise by document.

    A word is a run of digits, letters (A-Z in lower case) and characters beyond ASCII; features are all runs of 1 to
    `grams` words, hashed into `buckets`. A document's weight is the floored mean of its features' gains (none: 0), its
    score the weight and its noise. Of the documents with at least `least_words` words, `percent` of a hundred are drawn,
    those of the highest scores, ties to the smaller doc_id. Returns a row per row: doc_id, n_features, weight, score,
    rank (from 1; null if not drawn).

    Null texts count as empty. A repeated row is drawn as often as it wins; rows of one doc_id have one noise. A null
    doc_id has no noise: its score and rank are null, and it is not counted among those to draw from. Empty tables give
    no rows, or gains that only smoothing makes; other columns are ignored. Texts are read whole, and need not be UTF-8.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    features = distinct_features(docs.select("text"), grams, buckets)
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(distinct_features(target.select("text"), grams, buckets), buckets))

    def weigh(batch: pa.RecordBatch) -> dict:
        weights = []
        for size, own, many in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
            own, many = _numbers(size, own, many)
            weights.append(int((gains[own] * many).sum()) // size if size else 0)
        return {"digest": batch.column(0), "n_words": batch.column(2), "n_features": batch.column(3), "weight": weights}

    weights = map_batches(features, weigh, "digest binary, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    of_row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    scored = of_row.join(weights, "digest").select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))
    scored = materialize(scored, "scored")
    takes_part = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    drawn = scored.where(takes_part).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    line = numbered(scored.where(takes_part).select(*columns), [F.desc("score"), F.asc("doc_id"), F.asc("n_features")])
    rest = scored.where(~takes_part).select(*columns, F.lit(None).cast("long").alias("rank"))
    return line.select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank")).unionByName(rest)
