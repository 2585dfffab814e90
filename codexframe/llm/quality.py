"""Quality classifier: an additive model of features with pairwise interactions.

Cyclic boosting fits one shallow tree of one feature at a time (and of one pair at a time, for the pairs whose
residual gain is highest); all trees of a feature add up to one lookup table over its bins. A score is the sum of the
bins' values through the logistic function, so scoring is binning and table lookups in vectors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexframe.llm.common import map_batches, raw_texts

FEATURES = (
    "log_chars", "log_words", "upper", "digit", "space", "symbol", "non_ascii", "newline", "bar", "mean_word", "long_word", "distinct_words", "top_word", "same_as_last",
    "distinct_lines", "mean_line", "sentence_ends", "capital_words", "symbol_words", "upper_words", "run_of_symbols", "compression",
)
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOL_RUN = re.compile(rb"[!#$%&*+=@^~|<>_-]{2,}")


def features(raw: bytes) -> list[float]:
    """Numbers that describe a whole text: shares of kinds of characters, words and lines, and repetition."""
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    w = max(1, len(words))
    lines = raw.split(b"\n")
    tally: dict[bytes, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    same = sum(map(bytes.__eq__, words[1:], words[:-1]))
    first = np.frombuffer(b"".join([x[:1] for x in words]) or b" ", np.uint8)
    last = np.frombuffer(b"".join([x[-1:] for x in words]) or b" ", np.uint8)
    is_symbol = _SYMBOL[last]
    symbol_runs = sum(len(m) for m in _SYMBOL_RUN.findall(raw))
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), counts[65:91].sum() / n, counts[48:58].sum() / n, counts[list(_SPACE)].sum() / n, counts[_SYMBOL].sum() / n,
        counts[128:].sum() / n, counts[10] / n * 100, counts[124] / n * 100, float(lengths.mean()), float((lengths > 14).mean()), len(tally) / w, max(tally.values(), default=0) / w,
        same / w, len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), counts[[46, 33, 63]].sum() / w, float(((first >= 65) & (first <= 90)).mean()), float(is_symbol.mean()),
        float(sum(map(bytes.isupper, words)) / w), symbol_runs / n, len(set(zip(words, words[1:], strict=False))) / w,
    ]


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"]] = True


@dataclass
class Additive:
    """Bin edges of every feature, a lookup table for each, and tables over the coarse bins of pairs."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        fine, rough = self.bins(x, self.edges), self.bins(x, self.coarse)
        out = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            out += t[fine[:, f]]
        for (f, g), t in self.pairs.items():
            out += t[rough[:, f], rough[:, g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """Values of a shallow tree over ordered bins: the best cut of the leaf that gains most, until `leaves` leaves."""
    cuts = [0, len(grad)]
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])

    def gain(a, b):
        k = np.arange(a + 1, b)
        if not len(k):
            return 0.0, a
        part = lambda p, q: (g[q] - g[p]) ** 2 / (h[q] - h[p] + smooth)
        each = part(a, k) + part(k, b) - part(a, b)
        return float(each.max()), int(k[each.argmax()])

    while len(cuts) <= leaves:
        best = max(gain(a, b) for a, b in zip(cuts, cuts[1:], strict=False))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(grad))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + smooth)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray, smooth: float) -> np.ndarray:
    """Values of the best tree that cuts both features once (four quadrants)."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    best, out = -1.0, np.zeros_like(grad)
    for i in range(len(grad) - 1):
        gs = np.stack([g[i, :-1], g[i, -1] - g[i, :-1], g[-1, :-1] - g[i, :-1], g[-1, -1] - g[i, -1] - g[-1, :-1] + g[i, :-1]])
        hs = np.stack([h[i, :-1], h[i, -1] - h[i, :-1], h[-1, :-1] - h[i, :-1], h[-1, -1] - h[i, -1] - h[-1, :-1] + h[i, :-1]])
        total = (gs**2 / (hs + smooth)).sum(0)
        j = int(total.argmax())
        if total[j] > best:
            best, v = total[j], gs[:, j] / (hs[:, j] + smooth)
            out = np.empty_like(grad)
            out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 120, pair_rounds: int = 40, pairs: int = 8, rate: float = 0.1, leaves: int = 3, smooth: float = 1.0) -> Additive:
    """Cyclic boosting of shallow trees on features x and labels y (0 or 1)."""
    cut = lambda f, n: np.unique(np.quantile(x[:, f], np.arange(1, n) / n)) if len(x) else np.zeros(0)
    model = Additive([cut(f, bins) for f in range(x.shape[1])], [cut(f, 12) for f in range(x.shape[1])])
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(share / (1 - share)))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(x) or y.min() == y.max():
        return model
    fine, rough, logit = model.bins(x, model.edges), model.bins(x, model.coarse), np.full(len(x), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(fine[:, f], g, len(table)), np.bincount(fine[:, f], h, len(table)), leaves, smooth)
            table += step
            logit += step[fine[:, f]]
    shape = lambda f, g: (len(model.coarse[f]) + 1, len(model.coarse[g]) + 1)

    def cells(f, g, weight):
        a, b = shape(f, g)
        return np.bincount(rough[:, f] * b + rough[:, g], weight, a * b).reshape(a, b)

    g, h = slopes()
    gains = {}
    for f in range(x.shape[1]):
        for k in range(f + 1, x.shape[1]):
            if min(shape(f, k)) > 1:
                gf, hf = cells(f, k, g), cells(f, k, h)
                gains[f, k] = float((_pair_tree(gf, hf, smooth) * gf).sum())
    for pair in sorted(gains, key=gains.get, reverse=True)[:pairs]:
        model.pairs[pair] = np.zeros(shape(*pair))
    for _ in range(pair_rounds):
        for (f, k), table in model.pairs.items():
            g, h = slopes()
            step = rate * _pair_tree(cells(f, k, g), cells(f, k, h), smooth)
            table += step
            logit += step[rough[:, f], rough[:, k]]
    return model


def is_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Additive:
    """A model from labelled rows that are not held out.

    docs (doc_id, text), labels (doc_id, quality). Of the labelled rows at most `sample_rows` are used, those of the
    smallest hashes of doc_id: this bound is a parameter, and only feature values of these rows reach the driver.
    """
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").where(~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # of a doc_id that several rows have, the least text counts, so that no more rows than known ones get here
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "quality": batch.column(1), "x": [[float(v) for v in features(t or b"")] for t in batch.column(2).to_pylist()]}

    got = map_batches(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text"), run, "doc_id long, quality int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    return fit(x, (got["quality"].to_numpy() > 0).astype(np.float64))


def score_documents(docs: DataFrame, model: Additive, threshold: float = 0.3) -> DataFrame:
    """Quality of every whole text (doc_id, text): doc_id, held_out, score (0 to 1, higher: better), predicted (0 or 1).

    Null and empty texts have all features zero and are scored so. Repeated rows stay; a null doc_id stays null, with
    held_out null; other columns are ignored; an empty table gives no rows. Without labels every score is 0.5.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        x = np.array([features(t or b"") for t in batch.column(2).to_pylist()], np.float64).reshape(batch.num_rows, len(FEATURES))
        score = model.score(x)
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    return map_batches(source, run, "doc_id long, held_out boolean, score double, predicted int")


def accepted_documents(docs: DataFrame, model: Additive, threshold: float = 0.3) -> DataFrame:
    """Rows of docs that the model accepts, in all their columns; null and empty texts are scored like others."""
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            x = np.array([features(t or b"") for t in raw_texts(batch.column(at))], np.float64).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, schema)
