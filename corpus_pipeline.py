"""Corpus preparation in stages over `documents`; each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import bpe, decontam, jaccard, quality_gbt, secret_scan
from sightline.llm.common import discard, materialize
from sightline.llm.queries import table, tokenizer_path

#: Near copies: five-word shingles, similarity from 0.8 on. Exact signatures would be nearly one for each shingle at 0.8; bands are 48 for a document.
NEAR = jaccard.Measure(width=5, num=8, den=10, bands=48)
#: Encoded pieces that a worker keeps: some 10 MB, as its memory holds what the stages before have left there, too.
CACHE = 50_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored by their counts of nothing; repeated rows and ties are judged alike;
    without labelled documents nothing is rejected. Columns of any name stay as they are."""
    return quality_gbt.good_documents(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id. Texts without words, and null ids, are near nothing and stay; rows
    of one id are one document, so all of them stay or go."""
    return jaccard.distinct_documents(docs, NEAR)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, all rows of them. Null and empty texts contain none, nor do null or empty items count."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, with null and empty texts as they are, and repeated rows masked alike."""
    return secret_scan.redact(docs, secret_scan.fit(docs))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens, ids (little-endian 32-bit integers) and decoded_sha256 (of the text that the ids decode to)."""
    return bpe.encode_documents(docs, tokenizer_path(), decode="decoded_sha256", cache=CACHE)


STAGES = [(f.__name__, f) for f in (quality_classifier, ngram_jaccard_join, benchmark_decontamination, secret_scans, bpe_encoding)]
#: Trained models, 64-bit hashes and merges are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
