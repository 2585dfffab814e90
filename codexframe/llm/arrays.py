"""Sorted arrays in the shared folder: written by Spark tasks, memory-mapped by workers."""

from __future__ import annotations

import mmap
import os
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexframe.llm.common import arrow_schema, work_path



class Arrays:
    """Sorted keys with values beside them, in parts by key range under one folder; a part is mapped when first read.

    A part's file holds one column after another. `parts` has the first key, file and rows of each.
    """

    def __init__(self, folder: str, parts: list[tuple[int, str, int]], columns: list[tuple[str, str]]):
        self.folder, self.parts, self.columns = folder, sorted(parts), columns
        self.first = np.array([p[0] for p in self.parts], np.int64)
        self.before = np.concatenate([[0], np.cumsum([p[2] for p in self.parts])]).astype(np.int64)
        self._mapped: dict[int, dict] = {}

    def __getstate__(self):
        return {**self.__dict__, "_mapped": {}}

    def part(self, i: int) -> dict:
        if i not in self._mapped:
            _, file, n = self.parts[i]
            at, place, columns = f"{self.folder}/{file}", 0, {}
            if urlparse(at).scheme in ("", "file"):
                with open(urlparse(at).path, "rb") as f:
                    raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            else:  # a store without local paths: the part is read whole
                fs, path = pafs.FileSystem.from_uri(at)
                raw = fs.open_input_file(path).read()
            for name, kind in self.columns:
                columns[name] = np.frombuffer(raw, kind, n, place)
                place += n * np.dtype(kind).itemsize
            self._mapped[i] = columns
        return self._mapped[i]

    def _places(self, unique: np.ndarray):
        """Part, bounds of its keys among the unique keys, and their places in it."""
        own = np.searchsorted(self.first, unique, "right") - 1
        cuts = np.searchsorted(own, np.arange(len(self.parts) + 1))
        for i in range(len(self.parts)):
            a, b = cuts[i], cuts[i + 1]
            if a < b:
                part = self.part(i)
                yield i, part, a, b, np.minimum(np.searchsorted(part["key"], unique[a:b]), len(part["key"]) - 1)

    def look_up(self, keys: np.ndarray, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each key is there, and its values (0 where not)."""
        unique, back = np.unique(keys, return_inverse=True)
        there, out = np.zeros(len(unique), bool), [np.zeros(len(unique), dict(self.columns)[n]) for n in names]
        for _, part, a, b, place in self._places(unique):
            there[a:b] = part["key"][place] == unique[a:b]
            for o, n in zip(out, names, strict=True):
                o[a:b] = np.where(there[a:b], part[n][place], 0)
        return there[back], [o[back] for o in out]

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, all of which are there, among all keys."""
        unique, back = np.unique(keys, return_inverse=True)
        out = np.empty(len(unique), np.int64)
        for i, _, a, b, place in self._places(unique):
            out[a:b] = self.before[i] + place
        return out[back]


def _write(folder: str, pieces: list[bytes]) -> str:
    """A new file of the folder, there only when it is whole; its name."""
    file, at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arr", urlparse(folder)
    if at.scheme in ("", "file"):
        os.makedirs(at.path, exist_ok=True)
        with open(f"{at.path}/.{file}", "wb") as f:
            f.writelines(pieces)
        os.rename(f"{at.path}/.{file}", f"{at.path}/{file}")
    else:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path)
        with fs.open_output_stream(f"{path}/{file}") as f:
            for piece in pieces:
                f.write(piece)
    return file


def _planes(steps: np.ndarray) -> bytes:
    """Numbers by byte planes, so that planes of zeros take no room once compressed."""
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


GROUP_COLUMNS = [("key", "<i8"), ("total", "<i8"), ("once", "<i8"), ("twice", "<i8"), ("more", "<i8")]


def _add_up(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each was counted."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[first], np.diff(np.concatenate([first, [len(keys)]]))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)


def count_keys(df: DataFrame, keys_of, name: str, top: int, buckets: int, groups: bool = False, flush: int = 3_000_000):
    """Count keys over df and store them: (Arrays of key and c, Arrays of groups or None, totals).

    keys_of(batch) gives the keys of a batch (numbers from 0, evenly spread below `top`; any above go to the last
    bucket) and their counts or None. Each task adds up its keys and sends them to buckets of equal width as sorted
    steps in byte planes; a bucket becomes one part. groups: also store, for the upper half of the keys (key >> 32),
    the total and how many keys were counted once, twice, and oftener. totals: rows, their sum, and how many keys were
    counted 1, 2, 3 and 4 times. A task merges one bucket after another. What it tells of its parts is all that reaches the driver.
    """
    spark = df.sparkSession
    folder, group_folder = work_path(spark, name), work_path(spark, f"{name}-groups")
    width = min(-(-max(top, 1) // buckets), (1 << 63) - 1)
    if groups:  # no group may lie in two buckets
        width = -(-width >> 32) << 32
    sent = arrow_schema(spark, "bucket int, steps binary, counts binary")

    def send(batches):
        held, amount = [], 0

        def out():
            counted = None if held[0][1] is None else np.concatenate([c for _, c in held])
            keys, counts = _add_up(np.concatenate([k for k, _ in held]), counted)
            own = np.minimum(keys // width, buckets - 1)
            cuts = np.searchsorted(own, np.arange(buckets + 1))
            rows: dict[str, list] = {"bucket": [], "steps": [], "counts": []}
            for b in range(buckets):
                x, y = cuts[b], cuts[b + 1]
                if x < y:
                    rows["bucket"].append(b)
                    rows["steps"].append(_planes(np.diff(keys[x:y], prepend=0)))
                    rows["counts"].append(_planes(counts[x:y]))
            return pa.RecordBatch.from_pydict(rows, schema=sent)

        for batch in batches:
            keys, counts = keys_of(batch)
            if len(keys):
                held.append((keys, counts))
                amount += len(keys)
            if amount > flush:
                yield out()
                held, amount = [], 0
        if held:
            yield out()

    ddl = "first long, file string, rows long, total long, once long, twice long, thrice long, four long, group_first long, group_file string, group_rows long"
    told = arrow_schema(spark, ddl)

    def part_of(own: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        keys, c = _add_up(np.concatenate([np.cumsum(_unplanes(k)) for k, _ in own]), np.concatenate([_unplanes(n) for _, n in own]))
        row = {"first": int(keys[0]), "rows": len(keys), "total": int(c.sum()), **{n: int((c == k).sum()) for n, k in (("once", 1), ("twice", 2), ("thrice", 3), ("four", 4))}}
        row |= {"file": _write(folder, [keys.astype("<i8").tobytes(), c.astype("<i8").tobytes()])}
        if groups:
            up = keys >> 32
            at = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            columns = [up[at], np.add.reduceat(c, at), *(np.add.reduceat(x.astype(np.int64), at) for x in (c == 1, c == 2, c > 2))]
            row |= {"group_first": int(up[0]), "group_rows": len(at), "group_file": _write(group_folder, [x.astype(k).tobytes() for x, (_, k) in zip(columns, GROUP_COLUMNS, strict=True)])}
        return pa.RecordBatch.from_pylist([row], schema=told)

    def merge(batches):
        last, own = None, []
        for batch in batches:
            for b, steps, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and b != last:
                    yield part_of(own)
                    own = []
                last = b
                own.append((steps, counts))
        if own:
            yield part_of(own)

    dealt = df.mapInArrow(send, "bucket int, steps binary, counts binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    done = dealt.mapInArrow(merge, ddl).collect()
    totals = {k: sum(r[k] for r in done) for k in ("rows", "total", "once", "twice", "thrice", "four")}
    grouped = Arrays(group_folder, [(r.group_first, r.group_file, r.group_rows) for r in done], GROUP_COLUMNS) if groups else None
    return Arrays(folder, [(r.first, r.file, r.rows) for r in done], [("key", "<i8"), ("c", "<i8")]), grouped, totals
