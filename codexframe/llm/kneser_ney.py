"""Interpolated modified Kneser-Ney bigram model, counted in Spark and read through memory maps.

Words are counted over the whole training corpus and numbered by the order of their 63-bit hashes; bigrams are
counted by the pair of numbers. Tasks add up their own counts, one shuffle by key range adds up the rest, and the task
of a range writes its part of the model: sorted hash arrays in the shared folder. Workers map the parts into memory
and look up whole batches of keys at once, so that a worker needs no memory of its own for the model.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexframe.llm.arrays import Arrays, count_keys
from codexframe.llm.common import map_batches

#: The token after the last word of every text; no word can hold a space.
END = b" end"
#: The context before the first word of every text.
START_ID = (1 << 31) - 1
UNKNOWN_ID = START_ID - 1


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "big") >> 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 800_000:
            self.clear()
        got = self[word] = word_hash(word)
        return got


_hashes = _Hashes()


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space with A-Z lower-cased, then one end."""
    return [*(text or b"").lower().split(), END]


def hashed(text: bytes | None) -> np.ndarray:
    words = tokens(text)
    return np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words))


def discounts(totals: dict[str, int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many n-grams occur once, twice, three and four times."""
    n1, n2, n3, n4 = (totals[k] for k in ("once", "twice", "thrice", "four"))
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 0.75, 0.9])  # too little data to estimate
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0] + [min(max(d, 0.0), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))])


class Model:
    """Sorted arrays of words (their places are their numbers), bigrams, contexts and continuations, and what sums them up."""

    def __init__(self, words: Arrays, bigrams: Arrays, contexts: Arrays, follows: Arrays, totals: list[dict[str, int]]):
        self.words, self.bigrams, self.contexts, self.follows = words, bigrams, contexts, follows
        of_words, of_bigrams, of_follows = totals
        self.total, self.distinct, self.kinds = of_words["total"], of_words["rows"], max(1, of_bigrams["rows"])
        self.d, self.e = discounts(of_bigrams), discounts(of_follows)
        oftener = of_follows["rows"] - of_follows["once"] - of_follows["twice"]
        mass = self.e[1] * of_follows["once"] + self.e[2] * of_follows["twice"] + self.e[3] * oftener if of_follows["rows"] else 1.0
        self.floor = mass / self.kinds / (self.distinct + 1)

    def score(self, texts: list[bytes | None]) -> dict[str, list]:
        """Token counts, known tokens, smoothed unigram score and log10 probability of each text."""
        given = [hashed(t) for t in texts]
        sizes = np.fromiter(map(len, given), np.int64, len(given))
        flat = np.concatenate(given) if given else np.zeros(0, np.int64)
        starts = np.cumsum(sizes) - sizes
        unique, back = np.unique(flat, return_inverse=True)
        known, (count,) = self.words.look_up(unique, ("c",))
        ids = np.full(len(unique), UNKNOWN_ID)
        ids[known] = self.words.rank(unique[known])
        _, (after,) = self.follows.look_up(ids, ("c",))
        lower = np.maximum(after - self.e[np.minimum(after, 3)], 0) / self.kinds + self.floor
        known, count, ids, lower = known[back], count[back], ids[back], lower[back]
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        before[starts] = START_ID
        _, (own,) = self.bigrams.look_up((before << 32) | ids, ("c",))
        seen, (total, once, twice, more) = self.contexts.look_up(before, ("total", "once", "twice", "more"))
        total = np.maximum(total, 1)
        back_off = np.where(seen, (self.d[1] * once + self.d[2] * twice + self.d[3] * more) / total, 1.0)
        p = np.maximum(own - self.d[np.minimum(own, 3)], 0) / total + back_off * lower
        base = np.log10((count + 0.5) / (self.total + 0.5 * (self.distinct + 1)))
        sums = lambda x: np.add.reduceat(x, starts).tolist() if len(starts) else []
        return {"n_tokens": sizes.tolist(), "n_known": sums(known.astype(np.int64)), "base_score": sums(base), "score": sums(np.log10(p))}


def train(docs: DataFrame, bucket_tokens: int = 2_000_000) -> Model:
    """Learn from all texts of docs (text as binary); nothing is pruned, and a task holds one bucket's keys at a time.

    Buckets grow in number with the input. All bigrams of one context are in one bucket: at most one for each word.
    More than 2^31 - 3 different words raise an error: a bigram's key has no room for more.
    """
    spark = docs.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def word_keys(batch: pa.RecordBatch):
        given = [hashed(t) for t in batch.column(0).to_pylist()]
        return (np.concatenate(given) if given else np.zeros(0, np.int64)), None

    words, _, of_words = count_keys(docs.select("text"), word_keys, "words", 1 << 63, least)
    if of_words["rows"] >= UNKNOWN_ID:
        raise ValueError(f"{of_words['rows']} different words do not fit the numbers of a bigram's key")
    buckets = max(least, of_words["total"] // bucket_tokens)

    def bigram_keys(batch: pa.RecordBatch):
        given = [hashed(t) for t in batch.column(0).to_pylist()]
        if not given:
            return np.zeros(0, np.int64), None
        ids = words.rank(np.concatenate(given))
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        n = np.fromiter(map(len, given), np.int64, len(given))
        before[np.cumsum(n) - n] = START_ID
        return (before << 32) | ids, None

    bigrams, contexts, of_bigrams = count_keys(docs.select("text"), bigram_keys, "bigrams", of_words["rows"] << 32, buckets, groups=True)

    def ends(batch: pa.RecordBatch):
        found = [np.unique(bigrams.part(i)["key"] & 0xFFFFFFFF, return_counts=True) for i in batch.column(0).to_pylist()]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    parts = spark.range(0, len(bigrams.parts), 1, max(1, len(bigrams.parts)))
    follows, _, of_follows = count_keys(parts, ends, "follows", of_words["rows"], least)
    return Model(words, bigrams, contexts, follows, [of_words, of_bigrams, of_follows])


def score_documents(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Scores of every whole text (doc_id, text).

    Returns a row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigrams) and score
    (log10 probability of the words and the end under the model). Null and empty texts are one end token. Repeated
    rows stay; a null doc_id stays null; other columns are ignored; an empty table gives no rows. Without training
    texts every token is unknown and has the uniform probability.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        texts, out = batch.column(2).to_pylist(), {}
        for at in range(0, max(1, len(texts)), 2000):
            for k, v in model.score(texts[at : at + 2000]).items():
                out.setdefault(k, []).extend(v)
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "train_tokens": [model.total] * len(texts), **out}

    return map_batches(source, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def in_training(doc_id: str = "doc_id") -> Column:
    """Rows the model learns from: the checksum of doc_id as text leaves no remainder 1 by 5 (nor is it null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 1


def score_corpus(docs: DataFrame) -> DataFrame:
    """Learn from the rows in training and score all rows."""
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return score_documents(docs, train(texts.where(in_training())), ~in_training())
