"""The pipeline's stages against brute force on small tables."""

import hashlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from sightline.llm import bpe, queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_stages_keep_columns_and_do_their_work(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = queries.table(spark, str(DATA), "documents")
    columns, kept = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(DATA)))
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept[0] > kept[1] >= kept[2] >= kept[3] == kept[4] > 0
    labels = {r.doc_id: r.quality for r in queries.table(spark, str(DATA), "labels").collect()}
    left = {r.doc_id: r.text for r in docs.collect()}
    # Some sixty labels are enough to find most bad documents; test_quality_held_out measures accuracy.
    assert sum(labels.get(i) == 0 for i in left) <= 0.5 * sum(q == 0 for q in labels.values())
    assert sum(labels.get(i) == 1 for i in left) >= 0.8 * sum(q == 1 for q in labels.values())
    words = {i: "".join(c if c.isalnum() else " " for c in t.lower()).split() for i, t in left.items()}
    for item in queries.table(spark, str(DATA), "benchmark").collect():
        w = "".join(c if c.isalnum() else " " for c in item.text.lower()).split()
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        assert not any(len(own & {tuple(x[i : i + 5]) for i in range(len(x) - 4)}) >= 0.8 * len(own) for x in words.values())
    sets = {i: {tuple(x[k : k + 5]) for k in range(len(x) - 4)} for i, x in ((i, t.lower().split()) for i, t in left.items())}
    ids = sorted(i for i in sets if sets[i])
    assert not any(10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) for n, a in enumerate(ids) for b in ids[:n])
    theirs = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == theirs.encode(r.text, add_special_tokens=False).ids


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_last_stage_decodes_every_document(spark):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    docs = queries.table(spark, str(DATA), "documents")
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).collect()
    assert len(rows) == docs.count() and max(r.n_tokens for r in rows) > bpe.RUN
    for r in rows:
        text = theirs.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


ODD = [None, "", "  \n", "one", "the same seven words stand here twice over", "the same seven words stand here twice over", "x" * 4000, " ".join(f"w{i % 900}" for i in range(20_000)), "no id at all here"]


def odd_tables(spark, path, rows: bool):
    """A folder of odd documents (none at all if not rows) with columns named as stages name theirs, labels and benchmark items with nulls."""
    docs = [(i if i < 8 else None, t, None if i % 2 else "en", "s", len(t or "")) for i, t in enumerate([*ODD, ODD[-1]])]
    made = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    named = made.selectExpr("*", *[f"{i} as `{n}`" for i, n in enumerate(("__id", "__quality", "__d", "__t", "task", "grp", "label", "score", "h"))])
    (named if rows else named.where("false")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, None), (6, None, 1), (1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "the same seven words stand here twice over"), (None, None), (1, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return named.columns


@pytest.mark.parametrize("rows", [True, False])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    path = str(tmp_path / "odd")
    columns = odd_tables(spark, path, rows)
    for name, stage in corpus_pipeline.STAGES:
        docs = queries.table(spark, path, "documents")
        found = stage(spark, docs, path)
        assert found.columns == columns + (["n_tokens", "ids", "decoded_sha256"] if name == "bpe_encoding" else []), name
        kept = found.collect()
        assert len(kept) <= docs.count()
        if name in ("secret_scans", "bpe_encoding"):
            assert len(kept) == docs.count()
        if rows and name == "benchmark_decontamination":
            assert sorted(map(str, (r.doc_id for r in kept))) == ["0", "1", "2", "3", "6", "7", "None", "None"]
        if rows and name == "ngram_jaccard_join":
            assert sorted(map(str, (r.doc_id for r in kept))) == ["0", "1", "2", "3", "4", "6", "7", "None", "None"]
        if rows:
            assert all(r["__id"] == 0 and r["h"] == 8 for r in kept)
    assert corpus_pipeline.run(spark, path).count() <= (len(ODD) if rows else 0)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_run_is_the_stages_one_after_another(spark):
    docs = queries.table(spark, str(DATA), "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(DATA)))
    rows = lambda d: sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in d.collect())
    assert rows(corpus_pipeline.run(spark, str(DATA))) == rows(docs)
