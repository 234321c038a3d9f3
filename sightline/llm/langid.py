"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import code_points, crc_mod, fields_of, gram_counts, sampled, sliced, tree_sum

ORDERS, BITS = (1, 2, 3), 15
#: Labelled documents that the weights are fitted on, at most; document frequencies come from all training documents.
SAMPLE = 2000


def _fold() -> np.ndarray:
    """For each code point, its lower case if it is a letter, else a blank."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            table[i] = ord(c.lower()[0])
    return table


_FOLD: list[np.ndarray] = []


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points with letters in lower case and runs of anything else as one blank each, and the offsets of the texts."""
    if not _FOLD:
        _FOLD.append(_fold())
    points, offsets = code_points(texts)
    x = _FOLD[0][np.minimum(points, 0x10FFFF)]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != 32) | (x[:-1] != 32)
    first[offsets[:-1][offsets[:-1] < len(x)]] = True
    kept = np.concatenate([[0], np.cumsum(first)])
    return x[first], kept[offsets]


def counts(batches):
    """(batch, row, counts by bucket, whether it has a letter) for each document."""
    for batch in sliced(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        points, offsets = folded(texts)
        yield batch, [points[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vector(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tf_idf(found, self.idf)

    def predict(self, points: np.ndarray) -> tuple[str, float]:
        """The language and its calibrated probability."""
        if not self.classes or not (points != 32).any():
            return "und", 0.0
        at, v = self.vector(gram_counts(points, ORDERS, BITS))
        p = softmax((v @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def tf_idf(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their sublinear TF-IDF weights, of unit length."""
    at = np.flatnonzero(found)
    v = np.log1p(found[at]) * idf[at]
    return at, v / (np.sqrt((v * v).sum()) or 1.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_leader(rows, labels: np.ndarray, k: int, width: int, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, by coordinate, with an elastic net: weights are 0 until their summed gradients exceed l1."""
    z, n = np.zeros((width + 1, k)), np.zeros((width + 1, k))

    def weights(at):
        leader, seen = z[at], n[at]
        return np.where(np.abs(leader) <= l1, 0.0, -(leader - np.sign(leader) * l1) / ((beta + np.sqrt(seen)) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, v = np.append(rows[i][0], width), np.append(rows[i][1], 1.0)
            w = weights(at)
            error = softmax(v @ w)
            error[labels[i]] -= 1
            g = v[:, None] * error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(width + 1))
    return w[:-1], w[-1]


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on held-back rows."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 121))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, key: str = "doc_id", label: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on documents with text and label. Document frequencies cover all of them; weights a sample of `sample` rows at most."""
    docs = docs.select(F.col(key).alias("key"), "text", F.col(label).alias("label")).where("text is not null and label is not null")

    def presence(batches):
        total = np.zeros((1 << BITS) + 1, np.int64)
        for _, rows in counts(batches):
            for points in rows:
                total[:-1] += gram_counts(points, ORDERS, BITS) > 0
                total[-1] += 1
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    def sparse(batches):
        for batch, rows in counts(batches):
            found = [gram_counts(points, ORDERS, BITS) for points in rows]
            at = [np.flatnonzero(c) for c in found]
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "at": pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), "n": pa.array([c[a].astype(np.uint32).tobytes() for c, a in zip(found, at)], pa.binary()), "back": batch.column("back")})

    df = tree_sum(docs.select("text").mapInArrow(presence, "v binary"))
    if not len(df) or not df[-1]:
        return Model([], np.zeros(1 << BITS), np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    idf = np.log((1 + df[-1]) / (1 + df[:-1]))
    chosen = sampled(docs, "key", sample, "langid").withColumn("back", F.pmod(F.xxhash64(F.lit("held back"), "key"), F.lit(5)) == 0)
    rows = chosen.select("text", "label", "back").mapInArrow(sparse, "label string, at binary, n binary, back boolean").collect()
    rows.sort(key=lambda r: (r.label, r.at, r.n))
    classes = sorted({r.label for r in rows})
    labels = np.array([classes.index(r.label) for r in rows], int)
    vectors = []
    for r in rows:
        at, c = np.frombuffer(r.at, np.uint16).astype(int), np.frombuffer(r.n, np.uint32)
        v = np.log1p(c) * idf[at]
        vectors.append((at, v / (np.sqrt((v * v).sum()) or 1.0)))
    back = np.array([r.back for r in rows], bool)
    if len(classes) < 2 or back.all():
        back[:] = False
    fit = np.flatnonzero(~back)
    w, b = follow_leader([vectors[i] for i in fit], labels[fit], len(classes), 1 << BITS)
    logits = np.array([vectors[i][1] @ w[vectors[i][0]] + b for i in np.flatnonzero(back)]).reshape(-1, len(classes))
    return Model(classes, idf, w, b, temperature_of(logits, labels[back]))


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Predict the language of each whole text: the columns of `keep`, lang_pred and score.

    Null texts and texts without a letter are `und` with score 0. Each row is predicted by its text alone, so repeated rows get equal results.
    Output columns replace input columns of the same name.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    chosen = docs.select(*keep, F.col("text").alias("text")) if "text" not in keep else docs.select(*keep)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch, rows in counts(batches):
            found = [held.value.predict(points) for points in rows]
            kept = batch.select(keep)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*keep, "lang_pred", "score"])

    return chosen.mapInArrow(predict, f"{fields_of(docs.select(*keep).schema)}, lang_pred string, score double")


def identify_documents(docs: DataFrame) -> DataFrame:
    """Train on documents whose crc32(doc_id) mod 4 is not 2, and predict all: doc_id, held_out, lang_pred, score."""
    held_out = crc_mod("doc_id", 4) == 2
    model = train(docs.where(~held_out))
    return identify(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
