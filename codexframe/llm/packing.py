"""Best-fit packing of tokenised documents into sequences of fixed length.

Each task packs its own documents online: a bounded number of bins is open at a time, a bitset keyed by free
space finds the bin that fits a piece most tightly, and when one bin too many is open the fullest closes. What
is still open when the tasks end is merged in a second, equally bounded round over groups of tasks.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexframe.llm.common import arrow_schema, materialize, own_cache

#: A plain word in front of sentence marks; each part is then a token run of its own.
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([.,;:!?]+)")


#: Letters that a word without others keeps when it is normalised, but for their case: all versions of Unicode know them so.
_LATIN = "\u0250"
_LETTERS = r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _ends_in_letter(word: str) -> bool:
    """Whether a word of letters still ends in one when it is normalised; asked of Latin letters only, which all versions of Unicode know."""
    return word[-1] < _LATIN and word[-1].lower().isalpha()


def _byte_letters() -> dict[int, int]:
    """The printable characters that stand for bytes in byte-level vocabularies (fixed values): of code points below 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*plain}))}


def _of_letters(about: dict) -> bool:
    """Whether a word of lower-case Latin letters goes to the model of merges as it is, byte by byte."""
    cuts = (about.get("pre_tokenizer") or {}).get("pretokenizers", [])
    before = cuts[0]["pattern"]["Regex"].removesuffix(_LETTERS).split("|")
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    apart = len(cuts) == 2 and all(x.startswith("'") for x in before) and {k: v for k, v in cuts[1].items() if k != "trim_offsets"} == level
    return bool(apart and about["model"]["type"] == "BPE" and not about["model"].get("dropout") and not any(t["content"].isalpha() for t in about.get("added_tokens", [])))


def _by_words(about: dict) -> bool:
    """Whether the tokenizer lower-cases, and takes white space for nothing but an end of words."""
    steps = (about.get("normalizer") or {}).get("normalizers", [])
    cuts = (about.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    plain = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    kept = cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") and cuts[0].get("pattern", {}).get("Regex", "").endswith(_LETTERS)
    return bool(plain and kept and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in about.get("added_tokens", [])))


class WordIds(dict):
    """Token ids (little-endian unsigned 32-bit) of chunks between ASCII white space; of whole texts where the tokenizer is not one of words.

    At most twice `bound` are kept: when as many are new, they become the old ones, of which those used again stay.
    """

    def __init__(self, path: str, bound: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        self.tokenizer, self.bound, self.old, self.by_words = Tokenizer.from_file(path), bound, {}, _by_words(about)
        self.model, self.letters = self.tokenizer.model if self.by_words and _of_letters(about) else None, _byte_letters()

    def of_text(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split())) if self.by_words else self.encode(text.decode("utf-8", "replace"))

    def encode(self, text: str) -> bytes:
        own = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]  # without the places of tokens in the text
        return np.array(own.ids, dtype="<u4").tobytes()

    def of_letters(self, word: str) -> bytes:
        """A word of letters in lower case; one of Latin letters needs neither normalising nor cutting."""
        if self.model is None or max(word) >= _LATIN:
            return self.encode(word)
        own = self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(own)}I", *[t.id for t in own])

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        if (ids := self.old.get(chunk)) is not None:
            self[chunk] = ids
            return ids
        text = chunk.decode("utf-8", "replace")
        if text.isalpha():
            low = text.lower()
            if low != text:
                ids = self[low.encode()] if max(low) < _LATIN and low.isalpha() else self.encode(text)
            else:
                ids = self.of_letters(text)
        elif (found := _WORD_AND_MARKS.fullmatch(text)) and found[1].isalpha() and _ends_in_letter(found[1]):
            ids = self[found[1].encode()] + self[found[2].encode()]
        else:
            ids = self.encode(text)
        self[chunk] = ids
        return ids


def word_ids(path: str) -> WordIds:
    """One cache a worker process and tokenizer file."""
    return own_cache(("word ids", path), lambda: WordIds(path))


class BestFit:
    """Bounded-space online best-fit: at most `open_bins` bins, in a bitset keyed by their free space."""

    def __init__(self, capacity: int, open_bins: int, first_bin: int = 0):
        self.capacity, self.limit, self.next = capacity, open_bins, first_bin
        self.free, self.bins, self.open = 0, [[] for _ in range(capacity + 1)], 0

    def place(self, size: int) -> tuple[int, int]:
        """Bin and offset of a piece of that size."""
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            own = self.bins[space].pop()
            if not self.bins[space]:
                self.free ^= 1 << space
            self.open -= 1
        else:
            space, own = self.capacity, self.next
            self.next += 1
        left = space - size
        if left:
            self.bins[left].append(own)
            self.free |= 1 << left
            self.open += 1
            if self.open > self.limit:  # the fullest closes
                fullest = (self.free & -self.free).bit_length() - 1
                self.bins[fullest].pop()
                if not self.bins[fullest]:
                    self.free ^= 1 << fullest
                self.open -= 1
        return own, self.capacity - space

    def still_open(self) -> Iterator[tuple[int, int]]:
        """Bins not closed, with their fill."""
        for space, own in enumerate(self.bins):
            for b in own:
                yield b, self.capacity - space


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, ids binary"


def _documents(batch: pa.RecordBatch, at_once: int = 128) -> Iterator[tuple[int | None, bytes | None]]:
    """The rows of a batch; texts become objects for a few rows at once, not for the batch."""
    for start in range(0, batch.num_rows, at_once):
        part = batch.slice(start, at_once)
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def _pack_partition(path: str, capacity: int, end_id: int, open_bins: int, with_ids: bool):
    schema = arrow_schema_cached(_PIECES + ", fill long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = word_ids(path), np.uint32(end_id).tobytes()
        task = TaskContext.get().partitionId()
        fit = BestFit(capacity, open_bins, task << 32)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in _documents(batch):
                ids = cache.of_text(text or b"") + end
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    own, offset = fit.place(len(part) // 4)
                    rows.append((doc, piece, start, len(part) // 4, zlib.crc32(part), own, offset, part if with_ids else None, None))
            yield to_batch(rows, schema)
        yield to_batch([(None, None, None, None, None, own, None, None, fill) for own, fill in fit.still_open()], schema)

    return run


def arrow_schema_cached(ddl: str) -> pa.Schema:
    from pyspark.sql import SparkSession

    return arrow_schema(SparkSession.getActiveSession(), ddl)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, open_bins: int = 512, tasks_a_group: int = 64, with_ids: bool = False) -> DataFrame:
    """Place every document (doc_id, text), tokenised and followed by end_id, in sequences of `capacity` tokens.

    Documents longer than a sequence are cut into full pieces and a last, shorter one; other documents stay whole.
    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids with with_ids).
    Null and empty texts are one end token. Repeated rows are packed as often as they come; a null doc_id stays
    null. An empty table gives no rows. Other columns are ignored. At most `open_bins` bins a task are open; what they hold at
    the end of `tasks_a_group` tasks meets once more, at most open_bins * tasks_a_group bins in one task.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    made = materialize(source.mapInArrow(_pack_partition(tokenizer_path, capacity, end_id, open_bins, with_ids), _PIECES + ", fill long"), "pieces")
    pieces, open_at_end = made.where("fill is null").drop("fill"), made.where("fill is not null").select("bin", "fill")

    def merge(key, table):
        rows = table.sort_by([("fill", "descending"), ("bin", "ascending")])
        bins, fit, moves = rows["bin"].to_pylist(), BestFit(capacity, len(rows) + 1), []
        heads: dict[int, int] = {}
        for own, fill in zip(bins, rows["fill"].to_pylist(), strict=True):
            to, base = fit.place(fill)
            moves.append((own, heads.setdefault(to, own), base))
        return pa.table({"bin": [m[0] for m in moves], "to": [m[1] for m in moves], "base": [m[2] for m in moves]}, schema=pa.schema([("bin", pa.int64()), ("to", pa.int64()), ("base", pa.int64())]))

    group = F.expr(f"shiftright(bin, 32) div {tasks_a_group}")
    moves = open_at_end.groupBy(group.alias("g")).applyInArrow(merge, "bin long, to long, base long")
    out = pieces.join(moves, "bin", "left")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")]
    return out.select(*columns, *(["ids"] if with_ids else []))
