"""Secret scans through layers of encoding.

The text is the first layer. A worklist unwraps percent escapes, Unicode escapes (both of the whole layer at once, since a
literal space can lie beside an escape), base64 and compressed payloads (gzip, zlib, deflate, bz2) of every layer into
further layers until nothing new appears; contents seen before are not entered again, so cycles end. Bytes that are no text part a run and don't hide the rest of it. Base64 is joined over line breaks and read at
all four alignments, and payloads of any size are inflated window by window. Every layer is scanned alike, and each character of a layer knows the span of the text it came from.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexframe.llm.common import map_batches, texts

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|%u([0-9A-Fa-f]{4})")
_GAP = re.compile(r"\s")
#: Base64 runs with line breaks and indentation inside; 20 characters without them, or more that a break joins.
_BREAK = r"(?:[\x20\t]*+(?:\r?\n|\\r\\n|\\n)[\x20\t]*+)"
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{20,}}+|[A-Za-z0-9+/_-]++(?={_BREAK}[A-Za-z0-9+/_-]))(?:{_BREAK}[A-Za-z0-9+/_-]++)*+={{0,2}}")
_BREAKS = re.compile(_BREAK)
#: Maximal parts of decoded text; shorter ones than 16 can hold neither a secret nor an encoded one.
_PART = re.compile("[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ud800-\udfff]{16,}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY")
#: Sixteen or more ASCII characters of two bytes each, the lower one first or last.
_WIDE = re.compile(rb"(?:[\x09\x0a\x0d\x20-\x7e]\x00){16,}+|(?:\x00[\x09\x0a\x0d\x20-\x7e]){16,}+")
#: Bytes of a compressed payload and of its content that are handled at once; a content's windows end between two
#: words, where no pattern and no encoded run can lie, and only beyond MOST anywhere, with an overlap.
FEED, CHUNK, WINDOW, MOST, OVERLAP = 1 << 16, 1 << 20, 4 << 20, 16 << 20, 1 << 20

_HEX_RUN = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))
_BASE64_RUN = bytes(1 if re.match(r"[A-Za-z0-9+/_-]", chr(c)) and c < 128 else 0 for c in range(256))
_STANDARD = str.maketrans("-_", "+/")
_IS_DIGIT = np.array([chr(c) in "0123456789abcdefABCDEF" for c in range(256)])
_DIGIT = np.array([int(chr(c), 16) if chr(c) in "0123456789abcdefABCDEF" else 0 for c in range(256)], np.uint8)
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) of one layer; raw, its bytes, only spares patterns that can't match."""
    found = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"\x01" * 16 in raw.translate(_HEX_RUN):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class Layer:
    """Text with the span of the first layer it stands for: one for each character, or one (box) for all of them."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None, box: tuple[int, int] | None = None):
        self.text, self.start, self.end, self.box = text, start, end, box

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.box:
            return self.box
        return (a, b) if self.start is None else (int(self.start[a:b].min()), int(self.end[a:b].max()))

    def within(self, text: str, a: np.ndarray, b: np.ndarray) -> Layer:
        """A further layer whose characters come from [a, b) of this one."""
        if self.box:
            return Layer(text, box=self.box)
        if self.start is None:
            return Layer(text, a, b)
        return Layer(text, self.start[a], self.end[b - 1])


def _bunzip(chunks: Iterable[bytes], used: list[int]) -> Iterator[bytes]:
    """Content of a bz2 stream as far as it is sound; used[0]: its bytes, once it ended."""
    fed, one = 0, bz2.BZ2Decompressor()
    for data in chunks:
        fed += len(data)
        while not one.eof and (data or not one.needs_input):
            try:
                out = one.decompress(data, CHUNK)
            except OSError:
                return
            data = b""
            if out:
                yield out
        if one.eof:
            used[0] = fed - len(one.unused_data)
            return


def _inflate(chunks: Iterable[bytes], used: list[int], form: int = 47) -> Iterator[bytes]:
    """Content of a compressed stream and of the members after it, as far as it is sound; used[0]: bytes of ended members.

    form: 47 for gzip and zlib by their heads, -15 for deflate without any.
    """
    fed, one = 0, zlib.decompressobj(form)
    for data in chunks:
        fed += len(data)
        more = True
        while more:
            before = one.copy()
            try:
                out = one.decompress(data, CHUNK)
            except zlib.error:
                sound = bytearray()
                try:
                    for k in range(len(data)):
                        sound += before.decompress(data[k : k + 1])
                except zlib.error:
                    pass
                if sound:
                    yield bytes(sound)
                return
            if out:
                yield out
            if one.eof:
                data, one = one.unused_data, zlib.decompressobj(31)
                used[0], more = fed - len(data), bool(data)
            else:
                data = one.unconsumed_tail
                more = bool(data) or len(out) == CHUNK


def _content(chunks: Iterable[bytes], used: list[int], above: frozenset[bytes]) -> Iterator[bytes]:
    """Content of a stream by how it begins; where that is itself a gzip stream not met above (a stream can hold itself), the content of it."""
    chunks = iter(chunks)
    head = next(chunks, b"")
    unpacked = _bunzip if head.startswith(b"BZh") else _inflate if _MAGIC.match(head) else lambda c, u: _inflate(c, u, -15)
    out = unpacked(chain([head], chunks), used)
    first = next(out, b"")
    key = hashlib.sha1(first[:FEED]).digest()
    if first.startswith(b"\x1f\x8b\x08") and key not in above:
        yield from _content(chain([first], out), [0], above | {key})
    else:
        yield from chain([first], out)


def _windows(chunks: Iterable[bytes]) -> Iterator[bytes]:
    held, looked, kept = bytearray(), 0, 0
    for chunk in chunks:
        held += chunk
        if len(held) < WINDOW:
            continue
        at = len(held) - 1
        while (at := held.rfind(b" ", max(looked, 1), at)) > 0 and not (held[at - 1 : at].isalnum() and held[at + 1 : at + 2].isalnum()):
            pass
        if at > kept:
            yield bytes(held[:at])
            del held[: at + 1]
            looked = kept = 0
        elif len(held) >= MOST:
            yield bytes(held)
            del held[:-OVERLAP]
            looked, kept = len(held) - 1, len(held) - 1
        else:
            looked = len(held) - 1
    if len(held) > kept:
        yield bytes(held)


def _is_deflate(raw: bytes) -> bool:
    """Whether bytes inflate as a stream without a head: 64 bytes of content, or all of a shorter one."""
    one = zlib.decompressobj(-15)
    try:
        return len(out := one.decompress(raw[:FEED], 64)) == 64 or (len(out) >= 16 and one.eof)
    except zlib.error:
        return False


def _from_bytes(layer: Layer, raw: bytes, spans: Callable[[], tuple[np.ndarray, np.ndarray]], end: Callable[[int], int], above: frozenset[bytes] = frozenset()) -> Iterator[Layer]:
    """Layers of all parts of decoded bytes that are text, in bytes or pairs of them, and of the payloads compressed in them.

    spans gives the source spans (starts, ends) of all bytes; end says where the span of a payload ends that begins at a place.
    """
    text = raw.decode("utf-8", "surrogateescape")
    parts = [m.span() for m in _PART.finditer(text)]
    if parts and layer.box:
        yield from (Layer(text[p:q], box=layer.box) for p, q in parts)
    elif parts:
        a, b = spans()
        if len(text) != len(raw):
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            width = np.where((points >= 0xDC80) & (points <= 0xDCFF), 1, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int64)
            last = np.cumsum(width)
            a, b = a[last - width], b[last - 1]
        for p, q in parts:
            yield layer.within(text[p:q], a[p:q], b[p:q])
    for m in _WIDE.finditer(raw) if b"\x00" in raw else ():
        wide, low = m[0].replace(b"\x00", b"").decode("ascii"), m.start()
        if layer.box:
            yield Layer(wide, box=layer.box)
        else:
            a, b = spans()
            yield layer.within(wide, a[low : m.end() : 2], b[low + 1 : m.end() : 2])
    at = 0
    places = [m.start() for m in _MAGIC.finditer(raw)]
    for first in places if places[:1] == [0] or not _is_deflate(raw) else [0, *places]:
        key = hashlib.sha1(raw[first : first + FEED]).digest()
        if first < at or key in above:
            continue
        used = [0]
        inner = None
        for window in _windows(_content((raw[k : k + FEED] for k in range(first, len(raw), FEED)), used, above | {key})):
            if inner is None:
                inner = Layer("", box=layer.box or layer.span(int(spans()[0][first]), end(int(spans()[0][first]))))
            yield from _from_bytes(inner, window, spans, end, above | {key})
        at = first + used[0]


def unwrap(layer: Layer, raw: bytes) -> Iterator[Layer]:
    """Layers one encoding below this one."""
    text = layer.text
    if b"%" in raw:
        codes = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        first = np.flatnonzero((codes[:-2] == ord("%")) & _IS_DIGIT[codes[1:-1]] & _IS_DIGIT[codes[2:]])
        if first.size:
            kept, decoded, after = np.ones(len(codes), bool), codes.copy(), np.ones(len(codes), np.int64)
            kept[first + 1] = kept[first + 2] = False
            decoded[first], after[first] = _DIGIT[codes[first + 1]] * 16 + _DIGIT[codes[first + 2]], 3

            def places() -> tuple[np.ndarray, np.ndarray]:
                own = (np.cumsum((codes & 0xC0) != 0x80) - 1)[kept]  # the character that a byte belongs to
                return own, own + after[kept]

            yield from _from_bytes(layer, decoded[kept].tobytes(), cache(places), lambda a: gap.start() if (gap := _GAP.search(text, a)) else len(text))
    if b"\\u" in raw or b"\\x" in raw or b"\\U" in raw or b"%u" in raw:
        escapes = [(m.start(), m.end(), int(next(filter(None, m.groups())), 16)) for m in _ONE_ESCAPE.finditer(text)]
        if escapes:
            kept, after = np.ones(len(text), bool), np.ones(len(text), np.int64)
            pieces, at = [], 0
            for a, b, code in escapes:
                kept[a + 1 : b], after[a] = False, b - a
                pieces += [text[at:a], chr(code) if code < 0x110000 else "\ufffd"]
                at = b
            joined_text = "".join([*pieces, text[at:]])
            starts = np.flatnonzero(kept)
            ends = starts + after[kept]
            for part in _PART.finditer(joined_text):
                yield layer.within(part[0], starts[part.start() : part.end()], ends[part.start() : part.end()])
    if b"\n" in raw or b"\\n" in raw or b"\x01" * 20 in raw.translate(_BASE64_RUN):
        for m in _BASE64.finditer(text):
            run = _BREAKS.sub("", m[0]).rstrip("=")
            if len(run) < 20:
                continue
            run = run.translate(_STANDARD)
            for skip in range(4):
                own = run[skip:]
                own = own[: len(own) - (len(own) % 4 == 1)]
                decoded = base64.b64decode(own + "=" * (-len(own) % 4))

                def spans(m=m, skip=skip, size=len(decoded), chars=len(own)) -> tuple[np.ndarray, np.ndarray]:
                    kept = np.ones(m.end() - m.start(), bool)
                    for one in _BREAKS.finditer(m[0]):
                        kept[one.start() : one.end()] = False
                    places, k = m.start() + np.flatnonzero(kept)[skip:], np.arange(size, dtype=np.int64)
                    return places[k * 8 // 6], places[np.minimum(-(-(k + 1) * 8 // 6), chars) - 1] + 1

                yield from _from_bytes(layer, decoded, cache(spans), lambda _, m=m: m.end())


def scan_text(text: str, raw: bytes | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans of the text, and all spans (those of decoded layers mapped to the text), as (start, kind, end)."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    base = base_spans(text, raw)
    found, seen, work = set(base), {hashlib.sha1(raw).digest()}, [unwrap(Layer(text), raw)]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        own = layer.text.encode("utf-8", "surrogatepass")
        key = hashlib.sha1(own + b"\x00" + repr(layer.span(0, len(layer.text))).encode()).digest()
        if key in seen:
            continue
        seen.add(key)
        for a, kind, b in base_spans(layer.text, own):
            start, end = layer.span(a, b)
            found.add((start, kind, end))
        work.append(unwrap(layer, own))
    return base, sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text of docs (doc_id, text).

    Returns a row per row: doc_id, n_assign, n_access, n_hex (base spans by kind), base_sha256 (of the joined base
    spans) and spans (all spans, joined). Offsets are code points, ends exclusive. A null or empty text has no spans;
    repeated rows and a null doc_id stay; other columns are ignored; an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"doc_id": batch.column(0), "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
        for raw in batch.column(1).to_pylist():
            raw = raw or b""
            base, spans = scan_text(raw.decode("utf-8", "replace"), raw)
            for kind, name in enumerate(KINDS):
                out[f"n_{name}"].append(sum(s[1] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_batches(source, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_text(text: str, mask: str = "[SECRET]") -> str:
    """The text with every found span, overlapping ones as one, replaced by the mask."""
    out, at = [], 0
    for start, _, end in scan_text(text)[1]:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with the secrets of column text masked; null texts stay null, all other columns as they are.

    A byte that is not UTF-8 becomes U+FFFD.
    """
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            masked = pa.array([None if t is None else redact_text(t) for t in texts(batch.column(at))], pa.string())
            yield batch.set_column(at, batch.schema.field(at), masked.cast(batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)
