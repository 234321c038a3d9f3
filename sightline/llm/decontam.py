"""Benchmark decontamination: which documents contain a test item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import materialize, small, spare

WIDTH, THRESHOLD = 5, 0.8
_SPREAD = 0x0101010101010101


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def once(column: Column) -> Column:
    """The column as the output of a generator: the optimiser can't copy its expression into filters or into lambdas, where it would be repeated."""
    return F.explode(F.array(column))


def shingles(words: Column, width: int, whole: bool, made) -> Column:
    """made(list of words) for each run of `width` words; with fewer words, for all of them if `whole`, else none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: made([F.get(words, i - 1 + j) for j in range(width)]))
    short = F.array(F.xxhash64(F.lit("short"), F.array_join(words, " ")) if made is hashed else F.array_join(words, " "))
    return F.when(F.size(words) >= width, F.array_distinct(runs)).when((F.size(words) > 0) & F.lit(whole), short)


def hashed(run: list[Column]) -> Column:
    return F.xxhash64(*run)


def spelled(run: list[Column]) -> Column:
    return F.concat_ws(" ", *run)


def row_key(id: str) -> Column:
    """64 bits that stand for an id, null or not, and a text: what tells rows apart."""
    return F.xxhash64(F.col(id).isNull(), F.col(id), F.coalesce("text", F.lit("")))


def size_class(n: Column, top: int | None = None) -> Column:
    """Classes of sizes that double: class k has sizes from 2**k on. With `top`, larger classes count as that one."""
    k = F.floor(F.log2(n.cast("double")) + 1e-9).cast("int")
    return k if top is None else F.least(k, F.lit(top))


def in_class(h: Column, k: Column) -> Column:
    """A hash as it is in class k: one number still, so that joins stay on one."""
    return h.bitwiseXOR(k.cast("bigint") * F.lit(_SPREAD))


def item_sketches(items: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Each item's shingles (item, item_id, n_item, need, shingle), and the bottom-k MinHash sketch of each (item, need, h).

    An item is a different (item_id, text). One of n shingles that a document contains to `threshold` lacks at most n - ceil(threshold * n) of
    them there. So of its k lowest hashes, k one more than that, the document has one at least: no such pair is missed.
    """
    tokens = items.select(row_key("item_id").alias("item"), "item_id", once(words(F.col("text"))).alias("w")).dropDuplicates(["item"])
    sizes = lambda n: (n.alias("n_item"), F.ceil(F.lit(threshold) * n - 1e-9).cast("int").alias("need"))
    spelt = tokens.select("item", "item_id", once(shingles(F.col("w"), width, True, spelled)).alias("s")).where("s is not null")
    every = materialize(spelt.select("item", "item_id", *sizes(F.size("s")), F.explode("s").alias("shingle")))
    hashes = tokens.select("item", once(F.array_sort(F.coalesce(shingles(F.col("w"), width, True, hashed), F.array().cast("array<bigint>")))).alias("h"))
    sketch = hashes.select("item", "h", *sizes(F.size("h"))).where("n_item > 0")
    return every, materialize(sketch.select("item", "need", F.explode(F.slice("h", F.lit(1), F.col("n_item") - F.col("need") + 1)).alias("h")))


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and a test item of which the document holds `threshold` of the distinct `width`-word shingles.

    docs: doc_id, text; items: item_id, text; other columns are not read. Words are runs of letters and digits in lower case; an item with fewer
    words than `width` is one shingle, found only in documents of just those words.
    Columns: doc_id, text_hash, item_id, item (stands for item_id and text), n_item (shingles of the item), n_shared, containment.
    Documents are told apart by doc_id and text, items by item_id and text: repeated rows are one, rows of one id with other texts are not, and
    a null is an id like others. Null and empty texts contain nothing and are in nothing; an empty table gives no rows.

    Search: containment, not resemblance, is wanted, so an item's sketch is looked up in each document's whole set instead of comparing sketches
    of both (which long documents would dilute). Both sides are partitioned by size: items have sketches that grow with their size, and are put
    into the partition of each size class of documents that can hold enough of them; a document's hashes meet only its own partition. All
    documents that can hold the largest item share one. Sketches are looked up where a document is read; only hits are shuffled.
    Survivors are verified on spelled-out shingles. DataFrame operations only.
    """
    every, sketch = item_sketches(items, width, threshold)
    top = sketch.agg(F.max(size_class(F.col("need")))).first()[0] or 0
    parts = materialize(sketch.select("item", "need", F.explode(F.sequence(size_class(F.col("need")), F.lit(top))).alias("k"), "h").select("item", "need", in_class(F.col("h"), F.col("k")).alias("h")))
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    tokens = docs.select("doc_id", text_hash.alias("text_hash"), once(words(F.col("text"))).alias("w"))
    hashes = tokens.select("doc_id", "text_hash", once(F.coalesce(shingles(F.col("w"), width, True, hashed), F.array().cast("array<bigint>"))).alias("h"))
    sized = hashes.select("doc_id", "text_hash", F.size("h").alias("n_doc"), size_class(F.greatest(F.size("h"), F.lit(1)), top).alias("k"), F.explode("h").alias("h"))
    hits = sized.select("doc_id", "text_hash", "n_doc", in_class(F.col("h"), F.col("k")).alias("h")).join(small(parts), "h").where("n_doc >= need")
    ids = materialize(hits.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).distinct())
    chosen = docs.select("doc_id", "text", text_hash.alias("text_hash")).join(small(ids), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__t")), "left_semi")
    spelt = chosen.select("doc_id", "text_hash", once(words(F.col("text"))).alias("w")).select("doc_id", "text_hash", F.explode(shingles(F.col("w"), width, True, spelled)).alias("shingle"))
    shared = spelt.join(small(every), "shingle").groupBy("doc_id", "text_hash", "item").agg(F.count_distinct("shingle").alias("n_shared"), F.first("item_id").alias("item_id"), F.first("n_item").alias("n_item"), F.first("need").alias("need"))
    sure = shared.where("n_shared >= need")
    return sure.select("doc_id", "text_hash", "item_id", "item", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns as they are, that contain no test item."""
    d, t = spare(docs.columns, "__d"), spare(docs.columns, "__t")
    leaks = materialize(contained_items(docs, items, width, threshold).select(F.col("doc_id").alias(d), F.col("text_hash").alias(t)).distinct())
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(t))
    return docs.join(small(leaks), same, "left_anti")
