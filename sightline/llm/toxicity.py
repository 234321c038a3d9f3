"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import Words, crc_mod, fields_of, labelled_sample, sliced, utf8

BITS, FACTORS = 18, 8
#: Labelled documents that the machine is fitted on, at most.
SAMPLE = 16_000
#: A term or a pair of terms can be one of the model's if this many sampled documents hold it and its shares among the two labels differ by so many
#: standard errors; a pair also by MORE of them than its terms do. Pairs are looked for among PAIRED terms.
LEAST, ERRORS, MORE, PAIRED = 5, 5.0, 3.0, 4096
#: Bytes of the beginnings of words that are terms, too: what many forms of a word share.
BEGINS = (4, 6)
_BEGUN = np.uint64(0x5BD1E9955BD1E995)
_GAPS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def terms(column: pa.Array) -> list[np.ndarray]:
    """The distinct hashed terms of each whole text: words, which are runs of ASCII letters, digits and other bytes from 128 on, in lower case, and the
    first bytes of those that are longer than BEGINS."""
    data, offsets = utf8(column)
    words = Words(data, offsets, lower=True, gaps=_GAPS)
    hashes, rows = [words.hash], [words.doc]
    for n in BEGINS:
        longer = np.flatnonzero(words.last - words.first > n)
        hashes.append(words.ranges(words.first[longer], words.first[longer] + n) ^ _BEGUN)
        rows.append(words.doc[longer])
    slot, row = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    at = np.searchsorted(row[order], np.arange(len(offsets)))
    return [np.unique(slot[order[a:b]]) for a, b in zip(at[:-1], at[1:])]


@dataclass
class Machine:
    """place: for each hashed term its row in the parameters, or -1. A feature's value is 1 where the text holds the term."""

    place: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, found: np.ndarray) -> float:
        at = self.place[found]
        at = at[at >= 0]
        v = self.factor[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.weight[at].sum()) + pairs, -30, 30))))


def errors(bad: np.ndarray, good: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """By how many standard errors the shares bad / n1 and good / n0 differ."""
    p = (bad + good) / (n1 + n0)
    return (bad / n1 - good / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))


def telling(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Hashed terms that tell the labels apart more than chance explains: alone, or in a pair that tells more than either of its terms does.

    Others only add noise to long texts. Pairs are looked for among the PAIRED terms that most sampled documents hold.
    """
    share = lambda some: np.bincount(np.concatenate([np.zeros(0, np.int64), *some]).astype(np.int64), minlength=1 << BITS)
    bad, good = share([r for r, t in zip(rows, y) if t]), share([r for r, t in zip(rows, y) if not t])
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    alone = np.abs(errors(bad, good, n1, n0))
    often = np.flatnonzero(bad + good >= LEAST)
    kept = often[alone[often] >= ERRORS]
    often = np.sort(often[np.argsort(-(bad + good)[often], kind="stable")[:PAIRED]])
    place = np.full(1 << BITS, -1, np.int32)
    place[often] = np.arange(len(often))
    both = np.zeros((2, len(often), len(often)), np.float32)
    for label in (0, 1):
        mine = [place[r] for r, t in zip(rows, y) if t == label]
        for i in range(0, len(mine), 1024):
            held = np.zeros((min(1024, len(mine) - i), len(often)), np.float32)
            for k, r in enumerate(mine[i : i + 1024]):
                held[k, r[r >= 0]] = 1
            both[label] += held.T @ held
    tell = []
    for i in range(0, len(often), 256):
        some = slice(i, i + 256)
        z = np.abs(errors(both[1, some], both[0, some], n1, n0))
        more = (both[:, some].sum(axis=0) >= LEAST) & (z >= np.maximum(ERRORS, np.maximum(alone[often[some]][:, None], alone[often][None, :]) + MORE))
        tell.append(often[some][more.any(axis=1)])
    return np.union1d(kept, np.concatenate([np.zeros(0, np.int64), *tell]))


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = 10, rate: float = 0.15, l2: float = 3e-5, batch: int = 64) -> Machine:
    """Adaptive gradient steps on the log loss of linear and pairwise terms. rows: distinct hashed terms of each document."""
    kept = telling(rows, y)
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    rng = np.random.default_rng(7)
    w, v = np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), FACTORS))
    share = (y.sum() + 1) / (len(y) + 2)
    b = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(len(w), 1e-6), np.full(v.shape, 1e-6), 1e-6
    docs = [p[p >= 0] for p in (place[r] for r in rows)]
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), batch):
            mine = order[i : i + batch]
            at, doc = np.concatenate([docs[j] for j in mine]), np.repeat(np.arange(len(mine)), [len(docs[j]) for j in mine])
            own = v[at]
            total = np.stack([np.bincount(doc, own[:, k], len(mine)) for k in range(FACTORS)], axis=1)
            square = np.bincount(doc, (own * own).sum(axis=1), len(mine))
            s = b + np.bincount(doc, w[at], len(mine)) + 0.5 * ((total**2).sum(axis=1) - square)
            error = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[mine]) / len(mine)
            used, inverse = np.unique(at, return_inverse=True)
            g = np.bincount(inverse, error[doc], len(used)) + l2 * w[used]
            pull = error[doc][:, None] * (total[doc] - own)
            h = np.stack([np.bincount(inverse, pull[:, k], len(used)) for k in range(FACTORS)], axis=1).reshape(len(used), FACTORS) + l2 * v[used]
            gw[used] += g * g
            gv[used] += h * h
            gb += error.sum() ** 2
            w[used] -= rate * g / np.sqrt(gw[used])
            v[used] -= rate * h / np.sqrt(gv[used])
            b -= rate * error.sum() / np.sqrt(gb)
    return Machine(place, float(b), w, v)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold="true", sample: int = SAMPLE) -> Machine:
    """Fit on `sample` labelled documents at most, of the fold. Only their hashed terms reach the driver."""

    def hashed(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "terms": pa.array([t.tobytes() for t in terms(batch.column("text"))], pa.binary())})

    rows = labelled_sample(docs, labels, label, fold, sample, label).select("text", "label").mapInArrow(hashed, "label int, terms binary").collect()
    rows.sort(key=lambda r: (r.label, r.terms))
    return fit([np.frombuffer(r.terms, np.int32) for r in rows], np.array([r.label for r in rows], float))


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id and score (the chance that the text is toxic) of every whole text.

    Null and empty texts have no terms: their score is the bias alone. Repeated rows get equal scores. Ids are of any type, null or not. Other
    columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array([held.value.score(t) for t in terms(batch.column("text"))], pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(scored, f"{fields_of(docs.select('doc_id').schema)}, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on documents whose crc32(doc_id) mod 5 is not 0, and score all: doc_id, held_out, score, predicted (1 from 0.5 on)."""
    held_out = crc_mod("doc_id", 5) == 0
    scored = score(docs, train(docs, labels, fold=~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
