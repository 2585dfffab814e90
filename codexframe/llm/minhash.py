"""Near-duplicate documents by b-bit MinHash.

Every document becomes the set of its word shingles. Equal sets collapse to one class. Each class gets minima of
`bands * rows` hash functions; bands of whole minima propose candidates, the low bits of the minima, packed, give a
collision-corrected estimate of similarity by bit counts, and what passes is confirmed on the full sets.

Candidates of a band bucket are not all its pairs. A class that shares too few of its shingles with all other
candidates can have no link and goes first. Then every member meets the hub of its bucket, the one that shares most,
and confirmed links merge components. Only members that share buckets, at any remove, but still lie in different
components are then compared with each other, by longer signatures and in blocks of bounded size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexframe.llm.common import arrow_schema, connected_components, map_batches, materialize, own_cache

_MASK = (1 << 64) - 1


class _WordHashes(dict):
    """64-bit hashes of words; at most 400,000 are kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        got = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return got


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit numbers (shifts and odd multipliers)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `size` words; fewer words make one shingle, none no shingle."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(own_cache("word hashes", _WordHashes).__getitem__, words), np.uint64, n)
    count = max(1, n - size + 1)
    out = np.full(count, min(n, size), np.uint64)
    for k in range(min(n, size)):
        out = mix(out + h[k : k + count])
    return np.unique(out)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each multiply-add hash function (its upper 32 bits), over blocks of shingles."""
    best = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        np.minimum(best, ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).min(axis=1), out=best)
    return best


def coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:count] | np.uint64(1), seeds[count:]


def pack_bits(low: np.ndarray, bits: int) -> bytes:
    """Low `bits` bits of every minimum, one after another."""
    planes = ((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(planes.reshape(-1)).tobytes()


def estimates(left: np.ndarray, right: np.ndarray, count: int, bits: int) -> np.ndarray:
    """Similarity estimates of rows of packed signatures: matching b-bit fields, less chance matches."""
    differing = left ^ right
    fields = np.unpackbits(differing, axis=1)[:, : count * bits].reshape(len(left), count, bits).any(axis=2)
    match = 1 - fields.mean(axis=1)
    chance = 0.5**bits
    return (match - chance) / (1 - chance)


_SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, packed binary"


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int, bits: int) -> DataFrame:
    """Set size, digest, band keys and packed low bits of every document (doc_id, text as binary)."""

    def run(batch: pa.RecordBatch) -> dict:
        a, b = coefficients(bands * rows)
        number = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out: dict[str, list] = {"doc_id": batch.column(0).to_pylist(), "n_shingles": [], "digest": [], "bands": [], "packed": []}
        for text in batch.column(1).to_pylist():
            h = shingle_hashes(text, shingle)
            out["n_shingles"].append(len(h))
            if not len(h):
                out["digest"].append(None), out["bands"].append(None), out["packed"].append(None)
                continue
            least = minima(h, a, b)
            key = number.copy()
            for k in range(rows):
                key = mix(key + least[k::rows])
            out["digest"].append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
            out["bands"].append(key.view(np.int64).tolist())
            out["packed"].append(pack_bits(least, bits))
        return out

    return map_batches(docs, run, _SIGNED)


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = 80, bands: int = 24, rows: int = 6, bits: int = 4, margin: float = 0.12) -> DataFrame:
    """Classes of near-duplicate documents (doc_id, text): Jaccard similarity of word shingles, threshold in hundredths.

    Returns a row per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)
    and kept (doc_id = component_id). Words are runs of bytes other than ASCII white space, A-Z lower-cased. A null,
    empty or blank text has no shingles and links with nothing; a text shorter than a shingle is one shingle. Rows
    that repeat a doc_id stay, in one component with all that either text links to; a null doc_id links with nothing and
    has null in the last two columns. Other columns are ignored. `margin` is how far below the threshold an estimate may lie and still be
    confirmed on full sets.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = materialize(signatures(source, shingle, bands, rows, bits), "signed")
    named = signed.where("digest is not null and doc_id is not null")
    # rep numbers the classes as they are written; a doc_id would not do, rows may share one
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("packed").alias("packed"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    of_row = materialize(signed.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "rep", F.col("doc_id").alias("of_class")), "digest", "left").drop("digest"), "class-of-row")
    members = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = materialize(members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "buckets")
    members = materialize(members.join(shared, "bucket"), "members")

    sets = materialize(_shingle_sets(classes.join(members.select("rep").distinct(), "rep").select("rep", "doc_id", "digest"), source, shingle), "sets")
    # what a class shares with any other candidate bounds its similarity to all of them
    able = materialize(_shared_sizes(sets).where(100 * F.col("s") >= threshold * F.col("n")), "able")
    members = materialize(members.select("bucket", "rep").join(able, "rep"), "able-members")

    # first every member of a bucket meets its hub, the member that shares most
    by = F.struct(F.col("n") / F.col("s"), F.xxhash64("rep"))
    hub = members.groupBy("bucket").agg(F.count("*").alias("c"), F.min_by(F.struct("rep", "n", "s"), by).alias("h"), F.min("rep").alias("least")).where("c > 1")
    hub = materialize(hub.select("bucket", F.col("h.rep").alias("a"), F.col("h.n").alias("na"), F.col("h.s").alias("sa"), "least"), "hubs")
    can = (100 * F.least("n", "na") >= threshold * F.greatest("n", "na")) & ((100 + threshold) * F.least("s", "sa") >= threshold * (F.col("n") + F.col("na")))
    met = members.join(hub, "bucket")
    pairs = met.where((F.col("rep") != F.col("a")) & can).select(F.least("rep", "a").alias("a"), F.greatest("rep", "a").alias("b")).distinct()
    links = materialize(_confirmed(_likely(pairs, classes, bands * rows, bits, threshold / 100 - margin), sets, threshold), "links")
    label = materialize(_labels(able, links), "label")
    # then members that share buckets, at any remove, and still differ in component meet each other
    cluster = connected_components(met.select(F.col("rep").alias("a"), F.col("least").alias("b"))).toDF("rep", "cluster")
    rest = able.join(cluster, "rep").join(label, "rep")
    mixed = rest.groupBy("cluster").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).where("x <> y").select("cluster", "size")
    likely = materialize(_across(rest.join(mixed, "cluster"), sets, threshold, margin), "likely")
    if not likely.isEmpty():
        links = links.unionByName(materialize(_confirmed(likely, sets, threshold), "links"))
    # rows of one doc_id are one document to whoever reaches it
    ids = of_row.where("rep is not null and doc_id is not null").select("doc_id", "rep").distinct()
    first = ids.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    links = links.unionByName(materialize(ids.join(first, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")), "same-ids"))
    component = connected_components(links).toDF("rep", "component")
    least = component.join(classes.select("rep", "doc_id"), "rep").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = of_row.join(component.join(least, "component").select("rep", "least"), "rep", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "of_class", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _likely(pairs: DataFrame, classes: DataFrame, count: int, bits: int, least: float) -> DataFrame:
    """Pairs (a, b) whose packed signatures estimate a similarity of `least` or more."""
    packed = classes.select(F.col("rep"), F.col("packed"))
    both = pairs.join(packed.toDF("a", "pa"), "a").join(packed.toDF("b", "pb"), "b").select("a", "b", "pa", "pb")

    def run(batch: pa.RecordBatch) -> dict:
        rows = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3)]
        keep = pa.array(estimates(*rows, count, bits) >= least) if batch.num_rows else pa.array([], pa.bool_())
        return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    return map_batches(both, run, "a long, b long")


def _labels(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Component of every class: (rep, label)."""
    component = connected_components(links).toDF("rep", "component")
    return classes.select("rep").join(component, "rep", "left").select("rep", F.coalesce("component", "rep").alias("label"))


def _across(rest: DataFrame, sets: DataFrame, threshold: int, margin: float, block: int = 1024, count: int = 1024) -> DataFrame:
    """Likely pairs (a, b) of one cluster and different labels, by longer signatures: rest (rep, n, s, cluster, label, size).

    A cluster is dealt into chunks of about `block` classes and every two chunks meet in a task of their own; only
    pairs within half the margin of the threshold leave it.
    """
    spark = rest.sparkSession
    ids = rest.select("rep").distinct()

    def sign(batch: pa.RecordBatch) -> dict:
        a, b = coefficients(count)
        low = [(minima(np.frombuffer(h, np.uint64), a, b) & np.uint64(255)).astype(np.uint8).tobytes() for h in batch.column(1).to_pylist()]
        return {"rep": batch.column(0), "low": low}

    signed = map_batches(sets.join(ids, "rep", "left_semi").select("rep", "hashes"), sign, "rep long, low binary")
    dealt = rest.join(signed, "rep").withColumn("chunks", F.ceil(F.col("size") / block)).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "label", "n", "s", "low")
    schema = arrow_schema(spark, "a long, b long")

    def meet(table):
        rep, label, n, s, own = (table[c].to_numpy() for c in ("rep", "label", "n", "s", "own"))
        kinds, where, many = np.unique(label, return_inverse=True, return_counts=True)
        if len(kinds) == 1:
            return schema.empty_table()
        low = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(len(rep), count)
        apart = table["i"][0].as_py() != table["j"][0].as_py()
        lone = where != many.argmax()
        a, b = [], []
        for x in np.flatnonzero(lone):
            can = (label != label[x]) & (~lone | (rep > rep[x])) & (100 * np.minimum(n, n[x]) >= threshold * np.maximum(n, n[x]))
            can &= (100 + threshold) * np.minimum(s, s[x]) >= threshold * (n + n[x])
            if apart:
                can &= own != own[x]
            y = np.flatnonzero(can)
            if len(y):
                match = ((low[y] == low[x]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                y = y[match >= threshold / 100 - margin / 2]
                a += np.minimum(rep[y], rep[x]).tolist()
                b += np.maximum(rep[y], rep[x]).tolist()
        return pa.table({"a": a, "b": b}, schema=schema)

    return dealt.groupBy("cluster", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def _shingle_sets(wanted: DataFrame, source: DataFrame, shingle: int) -> DataFrame:
    """Sorted shingle hashes of classes (rep, doc_id of a row that has the set, digest of the set): (rep, hashes)."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"rep": [], "hashes": []}
        for rep, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = shingle_hashes(text, shingle).tobytes()
            if hashlib.blake2b(raw, digest_size=16).digest() == digest:  # another row of this doc_id may have another text
                out["rep"].append(rep), out["hashes"].append(raw)
        return out

    texts = source.where("doc_id is not null").join(wanted, "doc_id")
    return map_batches(texts.select("rep", "digest", "text"), run, "rep long, hashes binary").dropDuplicates(["rep"])


def _shared_sizes(sets: DataFrame) -> DataFrame:
    """Size n of every set, and how many s of its shingles any other set holds too: (rep, n, s)."""

    def spread(batch: pa.RecordBatch) -> dict:
        raw = batch.column(1).to_pylist()
        n = np.array([len(h) // 8 for h in raw], np.int64)
        return {"shingle": np.frombuffer(b"".join(raw), np.int64), "rep": np.repeat(batch.column(0).to_numpy(), n)}

    # a shingle comes once a set: those counted once are the ones that their set has alone
    alone = map_batches(sets, spread, "shingle long, rep long").groupBy("shingle").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).where("c = 1")
    alone = alone.groupBy("rep").agg(F.count("*").alias("alone"))
    sizes = sets.select("rep", (F.octet_length("hashes") / 8).cast("long").alias("n"))
    return sizes.join(alone, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s"))


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose full shingle sets have the similarity asked for."""
    both = pairs.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b").select("a", "b", "ha", "hb")

    def run(batch: pa.RecordBatch) -> dict:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= threshold * (len(x) + len(y) - common))
        keep = pa.array(keep, pa.bool_())
        return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    return map_batches(both, run, "a long, b long")


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of near duplicates, the one of smallest doc_id, in all its columns.

    Of rows equal in doc_id and text one stays; rows without a doc_id stay all. Options as in near_duplicates.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), **options).where("kept").select("doc_id").distinct()
    chosen = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return chosen.select(*docs.columns).unionByName(docs.where("doc_id is null"))
