"""Byte-level BPE over distinct words.

Documents are cut into pre-tokens, chunk by chunk: a chunk of bounded size numbers its distinct words and keeps every
document as the numbers of its words, in their positions. One shuffle brings the words of all chunks together by their
hash, where each distinct word is encoded once; a second one joins the ids back to the chunks and numbers they came from,
and the chunks' documents are put together again by position. Words travel a block at a time: those of one chunk and one
part of the hashes. The documents themselves lie in buckets by chunk, so that they are not shuffled. Decoding takes the bytes of every id from the token-byte table, which is as long as the vocabulary file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexframe.llm.common import arrow_schema, texts, work_path


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """One a worker process and vocabulary: the encoder of words, and the token-byte table."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = load_ranks(path)
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.shown = {i: str(i) for i in self.token_bytes}
        self.letter = "<u2" if max(self.token_bytes, default=0) < 1 << 16 else "<u4"

    def encode(self, word: str) -> list[int]:
        return self.bpe.encode_ordinary(word)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def to_planes(numbers: np.ndarray) -> bytes:
    """Numbers by byte planes, as many as the largest needs, the low bytes first: small ones take little room once compressed."""
    planes = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def of_planes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) - 1) // raw[0], np.int64)
    for k, plane in enumerate(np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)):
        out |= plane.astype(np.int64) << 8 * k
    return out


class Chunk:
    """Documents as numbers of their words; once it is closed, frequent words have small numbers."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.size = 0

    def add(self, doc: int | None, words: list[str]) -> None:
        number = self.numbers.setdefault
        self.docs.append((doc, np.fromiter((number(w, len(self.numbers)) for w in words), np.int64, len(words))))
        self.size += sum(map(len, words))

    def full(self, letters: int) -> bool:
        return self.size >= letters or len(self.numbers) >= 1 << 23

    def closed(self) -> tuple[list[str], list[tuple[int | None, bytes]]]:
        every = np.concatenate([p for _, p in self.docs]) if self.docs else np.zeros(0, np.int64)
        order = np.argsort(-np.bincount(every, minlength=len(self.numbers)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words = list(self.numbers)
        return [words[k] for k in order.tolist()], [(doc, to_planes(rank[p])) for doc, p in self.docs]


_CUT = "chunk long, doc_id long, places binary, part int, numbers binary, words array<string>"


def pre_tokens(docs: DataFrame, pattern: str, letters: int, parts: int) -> DataFrame:
    """Chunks of docs (doc_id, text as binary), stored in buckets by chunk.

    A row a document (chunk, doc_id, places), and a row for each part of a chunk's words (chunk, part, numbers, words).
    """
    spark = docs.sparkSession
    schema = arrow_schema(spark, _CUT)

    def run(batches):
        find, chunk, number = regex.compile(pattern).findall, Chunk(), TaskContext.get().partitionId() << 19

        def rows(n, **columns):
            return pa.RecordBatch.from_pydict({f.name: columns.get(f.name, [None] * n) for f in schema}, schema=schema)

        def out():
            words, held = chunk.closed()
            for at in range(0, len(held), 2000):
                some = held[at : at + 2000]
                yield rows(len(some), chunk=[number] * len(some), doc_id=[d for d, _ in some], places=[p for _, p in some])
            own = np.fromiter((zlib.crc32(w.encode()) % parts for w in words), np.int64, len(words))
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(parts + 1))
            full = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
            blocks = [order[cuts[k] : cuts[k + 1]] for k in full]
            yield rows(len(full), chunk=[number] * len(full), part=full, numbers=[to_planes(b) for b in blocks], words=[[words[k] for k in b.tolist()] for b in blocks])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                chunk.add(doc, find(text or ""))
                if chunk.full(letters):
                    yield from out()
                    chunk, number = Chunk(), number + 1
        if chunk.docs:
            yield from out()

    name = f"pre_tokens_{uuid.uuid4().hex}"
    docs.mapInArrow(run, _CUT).write.bucketBy(parts, "chunk").option("compression", "zstd").option("path", work_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def encoded(blocks: DataFrame, path: str, pattern: str, parts: int) -> DataFrame:
    """Blocks of words (chunk, part, numbers, words) with their ids: chunk, numbers, sizes (ids a word), ids, little-endian.

    All blocks of a part come one after another in one task, which encodes each distinct word of the part once.
    """
    schema = arrow_schema(blocks.sparkSession, "chunk long, numbers binary, sizes binary, ids binary")

    def run(batches):
        own, last, known = codec(path, pattern), None, {}
        for batch in batches:
            for chunk, part, numbers, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != last:
                    last, known = part, {}
                found = []
                for word in words:
                    if (ids := known.get(word)) is None:
                        ids = known[word] = own.encode(word)
                    found.append(ids)
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.fromiter((i for ids in found for i in ids), own.letter, int(sizes.sum()))
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "numbers": [numbers], "sizes": [to_planes(sizes)], "ids": [flat.tobytes()]}, schema=schema)

    dealt = blocks.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.select("chunk", "part", "numbers", "words").mapInArrow(run, "chunk long, numbers binary, sizes binary, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, letters: int = 32_000_000) -> DataFrame:
    """Encode and decode every document (doc_id, text).

    Returns a row per row: doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 (the decoded
    bytes); with_ids adds ids and decoded. A null text counts as empty: no tokens, digests of nothing. Repeated rows
    stay; a null doc_id stays null; other columns are ignored; an empty table gives no rows. Texts are never cut. Of a
    text that is not UTF-8, each wrong byte counts as U+FFFD and decodes to that. A chunk has about `letters` letters,
    or one longer document.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), source.rdd.getNumPartitions())
    cut = pre_tokens(source, pattern, letters, parts)
    ids = encoded(cut.where("words is not null").select("chunk", "part", "numbers", "words"), path, pattern, parts)
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    schema = arrow_schema(docs.sparkSession, ddl)

    def assemble(held, found):
        own = codec(path, pattern)
        blocks = [[of_planes(n), of_planes(z), np.frombuffer(i, own.letter)] for n, z, i in zip(*(found[c].to_pylist() for c in ("numbers", "sizes", "ids")), strict=True)]
        size = sum(len(n) for n, _, _ in blocks)
        shown, raw, counts = [""] * size, [b""] * size, np.zeros(size, np.int64)
        for numbers, sizes, flat in blocks:
            counts[numbers] = sizes
            tokens, at = flat.tolist(), 0
            for number, n in zip(numbers.tolist(), sizes.tolist(), strict=True):
                ids_of = tokens[at : at + n]
                shown[number], raw[number] = " ".join(map(own.shown.__getitem__, ids_of)), own.decode(ids_of)
                at += n
        out: dict[str, list] = {f.name: [] for f in schema}
        for doc, places in zip(held["doc_id"].to_pylist(), held["places"].to_pylist(), strict=True):
            numbers = of_planes(places)
            n, numbers = int(counts[numbers].sum()), numbers.tolist()
            joined, back = " ".join(map(shown.__getitem__, numbers)), b"".join(map(raw.__getitem__, numbers))
            row = [doc, n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back).hexdigest(), *(([int(x) for x in joined.split()], back) if with_ids else ())]
            for column, v in zip(out.values(), row, strict=True):
                column.append(v)
        return pa.table(out, schema=schema)

    held = cut.where("places is not null").select("chunk", "doc_id", "places")
    joined_back = ids.groupBy(F.col("chunk").alias("own"))
    return held.groupBy("chunk").cogroup(joined_back).applyInArrow(assemble, ddl)
