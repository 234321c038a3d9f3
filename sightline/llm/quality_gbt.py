"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import Words, crc_mod, fields_of, labelled_sample, sliced, spare, utf8
from sightline.llm.quality_rules import SYMBOLS, duplicate_lines, repeated_words

#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 12_000
ACCEPT = 0.7
_CLASS = np.zeros((256, 8), bool)
for _i in range(256):
    _c = chr(_i) if _i < 128 else ""
    _CLASS[_i] = [_c.isupper(), _c.islower(), _c.isdigit(), bool(SYMBOLS[_i]), _c in "!?", _c in ".,;:", _i == 10, _i >= 128]
FEATURES = 22


def statistics(column: pa.Array) -> np.ndarray:
    """FEATURES statistics of each whole text; null texts are empty."""
    data, offsets = utf8(column)
    words = Words(data, offsets)
    size, n = np.diff(offsets).astype(float), np.diff(words.at).astype(float)
    out = np.zeros((len(size), FEATURES))
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(n)
    for j in range(8):
        out[:, 2 + j] = np.diff(np.concatenate([[0], np.cumsum(_CLASS[data, j])])[offsets]) / np.maximum(size, 1)
    length = (words.last - words.first).astype(float)
    per_word = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[words.at]) / np.maximum(n, 1)
    out[:, 10], out[:, 11], out[:, 12], out[:, 13] = per_word(length), per_word(length <= 2), per_word(length >= 10), per_word(length >= 20)
    odd = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    out[:, 14] = per_word(odd[words.last] > odd[words.first])
    low = np.concatenate([[0], np.cumsum(_CLASS[data, 1] | (data >= 128))])
    out[:, 15] = per_word(low[words.last] == low[words.first])
    texts = data.tobytes()
    for i, (a, b) in enumerate(zip(words.at[:-1], words.at[1:])):
        if a == b:
            continue
        own = words.hash[a:b]
        text = texts[offsets[i] : offsets[i + 1]]
        lines = text.count(b"\n") + 1
        kinds = len(np.unique(own))
        out[i, 16] = kinds / (b - a)
        out[i, 17] = kinds / np.sqrt(b - a)
        out[i, 18] = repeated_words(own) / (b - a)
        out[i, 19] = duplicate_lines(text) / lines
        out[i, 20] = (b - a) / lines
        out[i, 21] = (own[1:] == own[:-1]).mean() if b - a > 1 else 0
    return out


@dataclass
class Trees:
    """Complete binary trees in arrays: node i has children 2i + 1 (value at most the cut) and 2i + 2; leaves follow the inner nodes."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """All trees and rows step down a level at a time."""
        trees, at = np.arange(len(self.leaf)), np.zeros((len(x), len(self.leaf)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.cut[trees, at])
        total = self.base + self.leaf[trees, at - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 20, l2: float = 2.0) -> Trees:
    """Log loss by Newton steps; splits are searched in histograms of quantile bins."""
    inner, n = 2**depth - 1, len(x)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)
    rate_of = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate_of / (1 - rate_of)))
    feature, cut, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1))
    f = np.full(n, base)
    slots = binned + np.arange(x.shape[1]) * bins
    for t in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for i in range(inner):
            mine = np.flatnonzero(node == i)
            if len(mine) >= 2 * least:
                flat, width = slots[mine].ravel(), x.shape[1]
                sums = [np.bincount(flat, np.repeat(v, width), width * bins).reshape(width, bins).cumsum(axis=1) for v in (g[mine], h[mine], np.ones(len(mine)))]
                (lg, lh, ln), (tg, th, tn) = sums, [s[:, -1:] for s in sums]
                gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
                gain[(ln < least) | (tn - ln < least)] = -np.inf
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, i], cut[t, i] = j, cuts[j][b]
            node[mine] = 2 * i + 1 + (x[mine, feature[t, i]] > cut[t, i])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        f += leaf[t, at]
    return Trees(feature, cut, leaf, base, depth)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fold="true", sample: int = SAMPLE) -> Trees:
    """Fit on `sample` labelled documents at most, of the fold. Only their statistics reach the driver."""

    def measure(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "x": pa.array([r.tobytes() for r in statistics(batch.column("text"))], pa.binary())})

    rows = labelled_sample(docs, labels, label, fold, sample, label).select("text", "label").mapInArrow(measure, "label int, x binary").collect()
    rows.sort(key=lambda r: (r.label, r.x))
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(-1, FEATURES)
    return boost(x, np.array([r.label for r in rows], float))


def score(docs: DataFrame, model: Trees, out: str = "score") -> DataFrame:
    """Score every whole text: all columns, then `out`, the chance that the document is a good one.

    Null and empty texts are scored as texts without words. Repeated rows get equal scores. A column `out` is replaced.
    """
    keep = [c for c in docs.columns if c != out]
    chosen = docs.select(*keep)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in sliced(batches):
            s = held.value.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*keep, out])

    return chosen.mapInArrow(scored, f"{fields_of(chosen.schema)}, `{out}` double")


def classify_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on documents whose crc32(doc_id) mod 4 is not 2, and score all: doc_id, held_out, score, predicted (1 from ACCEPT on)."""
    held_out = crc_mod("doc_id", 4) == 2
    scored = score(docs.select("doc_id", "text"), train(docs, labels, fold=~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their own columns, whatever their names. Rows are judged by their texts alone."""
    model, out = train(docs, labels, fold=crc_mod("doc_id", 4) != 2), spare(docs.columns, "__quality")
    return score(docs, model, out).where(F.col(out) >= ACCEPT).drop(out)
