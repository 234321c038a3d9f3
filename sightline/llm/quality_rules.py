"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import SPACE, Words, code_points, fields_of, gram_counts, ngram_hash, sliced, small, utf8

ORDERS, BITS = (3,), 15
#: Languages that have models of their own, those with the most trusted texts; all others are judged by the model of all languages together.
LANGUAGES = 128
#: How many n-grams of the language's raw model the trusted one starts with: what trusted texts have not shown yet is taken to be as in the corpus.
PRIOR = 10_000.0
#: A text is kept from this mean log-likelihood ratio on, in nats for each n-gram: unless trusted texts of its language make its n-grams rarer, by
#: the geometric mean, than the corpus does by more than a seventh.
THRESHOLD = -0.15
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def repeated_words(words: np.ndarray, width: int = 5) -> int:
    """Words in windows of `width` that occur twice or more in the text, by their hashes."""
    windows = ngram_hash(words, width)
    if len(windows) < 2:
        return 0
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    begin = np.flatnonzero(np.isin(windows, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b"\t\n\x0b\x0c\r ")]
    return len(lines) - len(set(lines))


def base_counts(column: pa.Array) -> dict[str, list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text (null: none)."""
    data, offsets = utf8(column)
    words = Words(data, offsets)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    texts = data.tobytes()
    return {
        "n_words": np.diff(words.at).tolist(),
        "word_chars": sums(((data & 0xC0) != 0x80) & ~SPACE[data]).tolist(),
        "n_symbols": sums(SYMBOLS[data]).tolist(),
        "n_dup_lines": [duplicate_lines(texts[a:b]) for a, b in zip(offsets[:-1], offsets[1:])],
        "n_repeat_words": [repeated_words(words.hash[a:b]) for a, b in zip(words.at[:-1], words.at[1:])],
    }


@dataclass(frozen=True)
class Ratio:
    """weights: for each model and bucket the log-likelihood ratio. Row 0 is of all languages together, row k + 1 of languages[k]."""

    languages: tuple[str, ...]
    weights: np.ndarray

    def row(self, docs: DataFrame):
        """The model that judges a document."""
        return _model(docs, self.languages)


def _lang(docs: DataFrame):
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def _model(docs: DataFrame, languages: tuple[str, ...]):
    if not languages:
        return F.lit(0)
    rows = F.create_map(*(F.lit(x) for k, name in enumerate(languages) for x in (name, k + 1)))
    return F.coalesce(F.try_element_at(rows, _lang(docs)), F.lit(0))


def ratio(docs: DataFrame, trusted: DataFrame, prior: float = PRIOR, languages: int = LANGUAGES) -> Ratio:
    """For each language and bucket, the log of its share among the n-grams of the trusted documents over its share in the whole corpus.

    docs: doc_id, text, and lang if there; trusted: doc_id. Every document counts; null texts hold nothing, a null language is one of its own. How
    common a language is among trusted documents is no merit of a text, so shares are within a language. A language without any trusted text, or
    beyond the `languages` with the most, is judged by the shares in all languages together: what trusted texts of other languages don't share counts
    against it. Without any trusted text at all there is nothing to compare with, and all ratios are 0. A table of languages x 2**BITS values.
    """
    ids = trusted.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct()
    known = docs.select(F.col("doc_id").alias("__d"), _lang(docs).alias("lang")).join(small(ids), F.col("__d") == F.col("__id"))
    named = tuple(r.lang for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect())
    chosen = docs.select("doc_id", "text", _model(docs, named).alias("stratum"))
    marked = chosen.join(small(ids), F.col("doc_id") == F.col("__id"), "left").select("text", "stratum", F.col("__id").isNotNull().alias("trusted"))

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for batch in sliced(batches):
            points, offsets = code_points([t or "" for t in batch.column("text").to_pylist()])
            for i, (k, good) in enumerate(zip(batch.column("stratum").to_pylist(), batch.column("trusted").to_pylist())):
                found = gram_counts(points[offsets[i] : offsets[i + 1]], ORDERS, BITS)
                own = total.setdefault(k, np.zeros((2, 1 << BITS), np.int64))
                own[0] += found
                own[1] += found if good else 0
        for k, (raw, good) in total.items():
            at = np.flatnonzero(raw)
            yield pa.RecordBatch.from_pydict({"stratum": pa.array(np.full(len(at), k, np.int32)), "bucket": pa.array(at.astype(np.int32)), "raw": pa.array(raw[at]), "good": pa.array(good[at])})

    counted = marked.mapInArrow(count, "stratum int, bucket int, raw bigint, good bigint")
    sums = counted.groupBy("stratum", "bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    table = np.zeros((2, len(named) + 1, 1 << BITS))
    for i, name in enumerate(("raw", "good")):
        table[i, sums.column("stratum").to_numpy(), sums.column("bucket").to_numpy()] = sums.column(name).to_numpy()
    table[:, 0] = table.sum(axis=1)
    raw, good = table
    share = (raw + 0.5) / (raw + 0.5).sum(axis=1, keepdims=True)
    found = np.log((good + prior * share) / (good.sum(axis=1, keepdims=True) + prior)) - np.log(share)
    return Ratio(named, np.where(good.sum(axis=1, keepdims=True) > 0, found, 0.0))


def judge(docs: DataFrame, model: Ratio, threshold: float = THRESHOLD) -> DataFrame:
    """Judge every whole text: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    llr is the mean of the weights of the text's language, or of all languages if it has no model (see ratio), over its n-grams (0 without any). kept: not base_failed, and llr is `threshold` at
    least. Null and empty texts have no words, so they fail. Repeated rows are judged alike. docs: doc_id (of any type), text, and lang if there;
    other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.weights)

    def judged(batches):
        for batch in sliced(batches):
            points, offsets = code_points([t or "" for t in batch.column("text").to_pylist()])
            llr = []
            for a, b, k in zip(offsets[:-1], offsets[1:], batch.column("stratum").to_pylist()):
                found = gram_counts(points[a:b], ORDERS, BITS)
                llr.append(float(found @ held.value[k]) / max(1, int(found.sum())))
            out = {"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.int64()) for k, v in base_counts(batch.column("text")).items()} | {"llr": pa.array(llr, pa.float64())}
            yield pa.RecordBatch.from_pydict(out)

    chosen = docs.select("doc_id", "text", model.row(docs).alias("stratum"))
    counted = chosen.mapInArrow(judged, f"{fields_of(docs.select('doc_id').schema)}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, llr double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr")


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Judge documents against those that `labels` marks with quality 1."""
    return judge(docs, ratio(docs, labels.where("quality = 1").select("doc_id")))
