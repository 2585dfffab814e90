"""Exact repeated substrings by suffix arrays.

A string of `length` bytes is named by its piece of `piece` bytes of least hash (the first of equal ones), so equal
strings have equal names wherever they are. Neighbouring strings named by the same piece form a run, and only names
that several runs share can hold a repeat. Equal runs collapse to one class, and a class of several runs is a repeat as
a whole. The texts of the classes of a name meet in blocks of bounded size, where a suffix array puts equal strings
beside each other; a class none of whose cores (the bytes that neighbouring strings share around their piece) another
one of the block holds has no equal string there and stays out of the array. A name with very many classes is dealt
over several blocks. Across these, strings that start within one stretch of a few bytes, counted from their piece,
meet by the core that all of them share; only where another class holds that core are single strings compared by digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexframe.llm.common import anew, arrow_schema, map_batches, materialize, raw_texts
from codexframe.llm.minhash import mix
from codexframe.llm.suffix_array import suffix_array

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in stretches of so many strings.
_STRETCH = 1 << 19
#: The low bits of a hash that hold the place of its piece in the stretch, so that the first of equal ones is least.
_PLACE = np.uint64((1 << 20) - 1)


class Hashes:
    """Polynomial hashes (modulo 2^64) of substrings through prefix sums."""

    def __init__(self):
        self.byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


_hashes = Hashes()


def piece_hashes(part: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pieces of `piece` bytes, and the prefix sums they come from."""
    n = len(part)
    up, down = _hashes.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_hashes.byte[part] * up[:n], out=sums[1:])
    return mix((sums[piece:] - sums[: n - piece + 1]) * down[: n - piece + 1]), sums


def _ranked(pieces: np.ndarray) -> np.ndarray:
    """Hashes with the place in their low bits, so that the first of equal ones is least."""
    return pieces & ~_PLACE | np.arange(len(pieces), dtype=np.uint64)


def naming_place(raw: bytes, length: int, piece: int) -> int:
    """Where the piece that names the first string of raw starts."""
    return int(_ranked(piece_hashes(np.frombuffer(raw, np.uint8, length), piece)[0]).argmin())


#: Starts a stretch has; the strings that start in it share a core of the length less this plus one.
STRETCH_STARTS = 8


def stretches(raw: bytes, length: int, piece: int) -> list[tuple[int, int, int]]:
    """First start, last start and start of the core of every stretch of a class's text."""
    place, last = naming_place(raw, length, piece), len(raw) - length
    out, at = [], 0
    while at <= last:
        core = place - (place - at) // STRETCH_STARTS * STRETCH_STARTS
        out.append((at, min(core, last), core))
        at = core + 1
    return out


#: Neighbouring starts whose strings share a core, where classes of a block are told apart.
CORE_STARTS = 17


def with_common_cores(parts: list[bytes], length: int, piece: int) -> dict[int, int]:
    """The texts, all named by one piece, of which a core of `length` less CORE_STARTS bytes is in another one too.

    By their places, where the piece starts in them (-1: not at all). Two texts that share a string of `length` bytes
    share the core of its first start, counted from the piece.
    """
    place = naming_place(parts[0], length, piece)
    name = parts[0][place : place + piece]
    first: dict[tuple[int, bytes], int] = {}
    kept: dict[int, int] = {}
    places = []
    for k, part in enumerate(parts):
        at = part.find(name)
        places.append(at)
        if at < 0:  # another piece of the same hash
            kept[k] = at
            continue
        for back in range(0, length - piece, CORE_STARTS):
            end = at - back + length - CORE_STARTS
            if back <= at and end <= len(part):
                other = first.setdefault((back, part[at - back : max(end, at + piece)]), k)
                if other != k:
                    kept[k], kept[other] = at, places[other]
    return kept


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    full = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(x)] = x
    rows = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(raw: bytes, length: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last string start, name, and digest of the bytes covered, of every run."""
    out = []
    for base in range(0, max(0, len(raw) - length + 1), _STRETCH):
        part = np.frombuffer(raw, np.uint8, min(len(raw) - base, _STRETCH + length - 1), base)
        pieces, sums = piece_hashes(part, piece)
        _, down = _hashes.powers(len(part) + 1)
        least = sliding_min(_ranked(pieces), length - piece + 1)
        lo = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        hi = np.concatenate([lo[1:] - 1, [len(least) - 1]])
        name = pieces[(least[lo] & _PLACE).astype(np.int64)]
        end = hi + length
        digest = mix((sums[end] - sums[lo]) * down[lo] + (end - lo).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))
        out.append((lo + base, hi + base, name, digest))
    if not out:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def repeats_of_block(texts: list[bytes], length: int, pieces: list[tuple[int, int]] | None = None, piece: int = 0) -> list[np.ndarray]:
    """For every text, whether the string at each start occurs again in the block.

    pieces: for every text the number of the piece that names it and where it starts in it (-1: not at all). All of a
    text's strings hold that piece, so that it counts as one letter.
    """
    counts = [max(0, len(t) - length + 1) for t in texts]
    joined = b"\x00".join(texts)
    # a separator is 1, bytes count from 2, pieces follow; strings across separators are never valid starts
    codes, origin, at = [], [], 0
    for k, (t, n) in enumerate(zip(texts, counts, strict=True)):
        letters = np.frombuffer(t, np.uint8).astype(np.int64) + 2
        if pieces and pieces[k][1] >= 0:
            number, place = pieces[k]
            letters = np.concatenate([letters[:place], [258 + number], letters[place + piece :]])
        own = np.full(len(letters) + 1, -1, np.int64)
        own[:n] = np.arange(at, at + n)
        codes += [letters, [1]]
        origin.append(own)
        at += len(t) + 1
    found = np.zeros(at, bool)
    if texts:
        origin = np.concatenate(origin)
        order = origin[np.array(suffix_array(np.concatenate(codes)), np.int64)]
        last, last_text = -1, b""
        for s in order[order >= 0].tolist():
            own = joined[s : s + length]
            if own == last_text:
                found[s] = found[last] = True
            last, last_text = s, own
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return [found[s : s + n] for s, n in zip(starts.tolist(), counts, strict=False)]


def _bounds(flags: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Byte spans covered by marked string starts, merged."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + length
    lo, hi = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if hi and x <= hi[-1]:
            hi[-1] = y
        else:
            lo.append(x)
            hi.append(y)
    return lo, hi


def repeated_spans(docs: DataFrame, length: int = 200, piece: int = 64, block_bytes: int = 32_768, block_classes: int = 500) -> DataFrame:
    """Byte spans of docs (row keys doc, twin; text as binary) covered by strings that occur again: (doc, twin, lo, hi)."""
    spark = docs.sparkSession

    def name_runs(batch: pa.RecordBatch) -> dict:
        parts = [runs(t or b"", length, piece) for t in batch.column(2).to_pylist()]
        n = np.array([len(p[0]) for p in parts])
        join = lambda k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0)
        lo, hi = join(0), join(1)
        return {
            "doc": np.repeat(batch.column(0).to_numpy(), n), "twin": np.repeat(batch.column(1).to_numpy(), n), "lo": lo.astype(np.int64), "span": (hi - lo).astype(np.int32),
            "name": join(2).view(np.int64), "digest": join(3).view(np.int64),
        }

    every = materialize(map_batches(docs.select("doc", "twin", "text"), name_runs, "doc long, twin int, lo long, span int, name long, digest long"), "runs")
    # written first, so that the join has no aggregate of its key beside it and a very common name is split
    shared = every.groupBy("name").agg(F.count("*").alias("n"), (F.min("digest") == F.max("digest")).alias("same")).where("n > 1").select("name", "same")
    hits = materialize(every.join(materialize(shared, "shared-names"), "name"), "shared-runs")
    mixed = hits.where("not same")  # all runs of another name are copies of one
    # runs of a class are copies: any one of them stands for it, whole as first() takes all columns from one row
    one = [F.first(c).alias(c) for c in ("doc", "twin", "lo", "span")]
    classes = materialize(mixed.groupBy("name", "digest").agg(F.count("*").alias("n"), *one), "classes")
    # a class of several runs is a repeat as a whole; where all classes of a name are, nothing is left to compare
    sizes = classes.groupBy("name").agg(F.count("*").alias("c"), F.min("n").alias("fewest")).where("c > 1 and fewest = 1").select("name", "c")
    open_ = classes.withColumn("single", F.col("n") == 1).drop("n").join(materialize(sizes, "open-names"), "name")

    # the texts of these classes, from the documents that hold them
    wanted = open_.groupBy("doc", "twin").agg(F.collect_list(F.struct("name", "digest", "c", "lo", "span", "single")).alias("want"))
    with_text = wanted.join(anew(docs.select("doc", "twin", "text")), ["doc", "twin"]).select("doc", "twin", "want", "text")

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc", "twin", "base", "single", "name", "digest", "c", "part")}
        for doc, twin, want, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for w in want:
                row = (doc, twin, w["lo"], w["single"], w["name"], w["digest"], w["c"], text[w["lo"] : w["lo"] + w["span"] + length])
                for column, v in zip(out.values(), row, strict=True):
                    column.append(v)
        return out

    parts = map_batches(with_text, cut, "doc long, twin int, base long, single boolean, name long, digest long, c long, part binary")
    deal = F.pmod("digest", F.ceil(F.col("c") / block_classes))
    dealt = parts.withColumn("deal", deal).repartition("name", "deal").sortWithinPartitions("name", "deal", "digest")
    kind = "doc long, twin int, base long, single boolean, lo array<int>, hi array<int>, key binary, at int, part binary"
    schema = arrow_schema(spark, kind)
    name_of = lambda raw: hashlib.blake2b(raw, digest_size=16).digest()

    def sort_blocks(batches):
        rows: list[tuple] = []  # of all finished groups: the piece if it goes into the suffix array, and the row
        group: list[tuple] = []
        held, last = 0, None

        def close():
            """The group at hand joins the block; the bytes it brings."""
            firsts = {row[5]: row for row in group}  # a repeated document brings the same class again
            own = list(firsts.values())
            chosen = with_common_cores([row[7] for row in own], length, piece) if len(own) > 1 else {}
            number = len(rows)
            rows.extend(((number, chosen[k]) if k in chosen else None, row) for k, row in enumerate(own))
            group.clear()
            return sum(len(own[k][7]) for k in chosen)

        def flush():
            found = iter(repeats_of_block([row[7] for at, row in rows if at], length, [at for at, _ in rows if at], piece))
            out: dict[str, list] = {f.name: [] for f in schema}
            seen = set()
            for chosen, (doc, twin, base, single, _, _, c, part, _) in rows:
                m = next(found) if chosen else np.zeros(len(part) - length + 1, bool)
                cells = []
                if single and m.any():
                    cells.append((doc, twin, base, single, *_bounds(m, length), None, None, None))
                for first, last, core in stretches(part, length, piece) if c > block_classes else ():
                    keys = [name_of(part[at : at + length]) for at in range(first, last + 1)]
                    if not all(m[first + k] and key in seen for k, key in enumerate(keys)):
                        shared_by_all = part[core : core + length - STRETCH_STARTS + 1]
                        cells.append((doc, twin, base, single, None, None, name_of(shared_by_all), first, part[first : last + length]))
                    seen.update(keys)
                for cell in cells:
                    for column, v in zip(out.values(), cell, strict=True):
                        column.append(v)
            rows.clear()
            return pa.RecordBatch.from_pydict(out, schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and (row[4], row[8]) != last:
                    held += close()
                    if held >= block_bytes or len(rows) >= 4 * block_classes:
                        yield flush()
                        held = 0
                last = (row[4], row[8])
                group.append(row)
        if group:
            close()
            yield flush()

    settled = materialize(dealt.mapInArrow(sort_blocks, kind), "settled")
    within = settled.where("key is null").select("doc", "twin", "base", F.explode(F.arrays_zip("lo", "hi")).alias("s")).select("doc", "twin", (F.col("base") + F.col("s.lo")).alias("lo"), (F.col("base") + F.col("s.hi")).alias("hi"))

    def met(df):
        """Rows whose key comes more than once."""
        return df.join(df.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "key", "left_semi")

    def spell(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc", "twin", "base", "single", "at", "key")}
        for doc, twin, base, single, first, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for at in range(len(part) - length + 1):
                for column, v in zip(out.values(), (doc, twin, base, single, first + at, name_of(part[at : at + length])), strict=True):
                    column.append(v)
        return out

    cores = met(settled.where("key is not null")).select("doc", "twin", "base", "single", "at", "part")
    strings = materialize(map_batches(cores, spell, "doc long, twin int, base long, single boolean, at int, key binary"), "strings")
    # neighbouring strings of a class become one span
    own = Window.partitionBy("doc", "twin", "base").orderBy("at")
    across = met(strings).where("single").select("doc", "twin", "base", "at").withColumn("island", F.col("at") - F.dense_rank().over(own))
    across = across.groupBy("doc", "twin", "base", "island").agg((F.col("base") + F.min("at")).alias("lo"), (F.col("base") + F.max("at") + length).alias("hi"))
    # a run is its class alone, or a copy: told by its place in its document, so that the copies of a class needn't meet
    columns = ["doc", "twin", "lo", "span"]
    alone = classes.where("n = 1").select(*columns, "digest", F.lit(True).alias("alone"))
    copies = mixed.select(*columns, "digest", F.lit(False).alias("alone")).unionByName(alone).groupBy(*columns, "digest").agg(F.max("alone").alias("alone")).where("not alone")
    whole = hits.where("same").select(columns).unionByName(copies.select(columns))
    whole = whole.select("doc", "twin", "lo", (F.col("lo") + F.col("span") + length).alias("hi"))
    return whole.unionByName(within).unionByName(across.select("doc", "twin", "lo", "hi"))


def row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """doc (the id, or a hash of the text where it is null) and twin (a hash that tells rows of one id apart)."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text)).alias("doc"), F.hash(text, doc_id).alias("twin")


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or []):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for lo, hi in spans:
        parts.append(raw[at:lo])
        at = hi
    return b"".join([*parts, raw[at:]])


def _with_spans(docs: DataFrame, length: int, piece: int) -> DataFrame:
    """docs (any columns beside doc, twin, text) with a column spans; rows without repeats have null there."""
    spans = repeated_spans(docs, length, piece).groupBy("doc", "twin").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return anew(docs).join(spans, ["doc", "twin"], "left")


def remove_repeats(docs: DataFrame, length: int = 200, piece: int = 64) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that starts anywhere else as well (doc_id, text).

    Returns a row per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (the bytes that
    remain), kept (those bytes). Strings never cross documents and are judged on the input: all copies go. A null text
    counts as empty; texts shorter than `length` stay. Repeated rows repeat each other's text; a null doc_id stays
    null; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(F.col("doc_id"), text), text.alias("text"))
    joined = _with_spans(source, length, piece).select("doc_id", "text", "spans")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": batch.column(0), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            spans = _merged(spans)
            left = _kept(raw, spans)
            out["n_bytes"].append(len(raw)), out["n_removed"].append(len(raw) - len(left)), out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest()), out["kept"].append(left)
        return out

    return map_batches(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, length: int = 200, piece: int = 64) -> DataFrame:
    """docs with repeated strings cut out of column text, in all other columns as they are; null texts stay null.

    Parts of characters that a cut would leave go with it, and so do wrong bytes of a text that is cut and not UTF-8.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    keys = row_keys(F.col("doc_id"), text)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *keys, text.alias("text"))
    spans = repeated_spans(keyed.select("doc", "twin", "text"), length, piece).groupBy("doc", "twin").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    both = anew(keyed.select("row", "doc", "twin")).join(spans, ["doc", "twin"], "left").select("row.*", "spans")
    at, width, schema = docs.columns.index("text"), len(docs.columns), docs.schema

    def run(batches):
        for batch in batches:
            left = []
            for t, s in zip(raw_texts(batch.column(at)), batch.column(width).to_pylist(), strict=True):
                left.append(_kept(t, _merged(s)).decode("utf-8", "ignore").encode() if s and t is not None else t)
            columns = [pa.array(left, pa.large_binary()).cast(batch.schema.field(at).type, safe=False) if k == at else batch.column(k) for k in range(width)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(k) for k in range(width)]))

    return both.mapInArrow(run, schema)
