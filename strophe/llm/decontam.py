"""Benchmark decontamination by n-gram windows, with DataFrame functions only.

Words are the runs ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Every
10 consecutive words of a benchmark item are a window; an item of fewer words is one
window. The windows' hashes are broadcast, after a check of their number, and every window
of a document is looked up as it is made; what the hash finds is verified word for word.
Beyond BROADCAST_WINDOWS the join runs by shuffle, with the same result: there a window's row
carries its own words only, and head rows are made without the join. A window's items are held together, so a passage that many documents share
costs each of them one lookup and no shuffle.

Defined results: null texts and texts without words have no words and no hits; an item
without words never occurs; items that repeat an item_id count once. Items with a null id hit
like others; together they count as one in n_items and aren't listed in item_ids. Documents are told
apart by row, so repeated rows each get their own result. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import free_name, written

N = 10
#: What lies between words.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More windows than this aren't broadcast; 500,000 windows of 10 words take about 100 MB.
BROADCAST_WINDOWS = 500_000
#: Stands for a document itself among its window hashes.
HEAD = 0x5EED0000


def words(text: Column) -> Column:
    """The words in order. What splitting leaves before the first and after the last is removed."""
    found = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP)
    return F.array_remove(found, "")


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """gram_hash, gram (the words), items: one row per distinct window of the benchmark.

    ``items`` ends with a null if the window is of an item with a null id.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    grams = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("gram"))
    nameless = F.when(F.bool_or(F.col("item_id").isNull()), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    grams = grams.groupBy("gram").agg(F.concat(F.collect_set(F.col("item_id").cast("string")), nameless).alias("items"))
    return grams.select(F.xxhash64("gram").alias("gram_hash"), "gram", "items")


def hits(docs: DataFrame, grams: DataFrame, n: int = N) -> DataFrame:
    """row_key, doc_id, n_words, start, length, items of every window of ``docs`` that occurs
    in the benchmark, and one head row for every document, with start -1 and no items.

    With a broadcast, head rows come from the same pass over the texts: HEAD stands before a
    document's window hashes, and among the benchmark's as a window of no words.
    """
    total, short = grams.count(), [r[0] for r in grams.where(F.size("gram") < n).select(F.size("gram")).distinct().collect()]
    split = docs.select("row_key", "doc_id", words(F.col("text")).alias("w"))
    if total > BROADCAST_WINDOWS:
        return _hits_by_shuffle(split, grams, [n, *sorted(short)])
    head = grams.sparkSession.range(1).select(F.lit(HEAD).alias("gram_hash"), F.array().cast("array<string>").alias("gram"), F.array().cast("array<string>").alias("items"))
    table = F.broadcast(grams.unionByName(head))
    found = None
    for length in [n, *sorted(short)]:
        places = F.when(F.size("w") >= length, F.sequence(F.lit(1), F.size("w") - length + 1)).otherwise(F.array().cast("array<int>"))
        hashes = F.transform(places, lambda i: F.xxhash64(F.slice("w", i, length)))  # noqa: B023
        before = F.array(F.lit(HEAD)) if found is None else F.array(F.lit(HEAD + 1))
        # hashes in a projection of their own: the generator then runs in generated code and
        # doesn't copy the words to every window's row
        each = split.select("row_key", "doc_id", "w", F.concat(before, hashes).alias("hashes")).select("row_key", "doc_id", "w", F.posexplode_outer("hashes").alias("place", "gram_hash"))
        is_head = F.col("place") == 0
        same = each.join(table, "gram_hash").where((is_head & (F.size("gram") == 0)) | (~is_head & (F.slice("w", F.greatest("place", F.lit(1)), length) == F.col("gram"))))
        part = same.select("row_key", "doc_id", F.size("w").cast("long").alias("n_words"), (F.col("place") - 1).alias("start"), F.lit(length).alias("length"), "items")
        found = part if found is None else found.unionByName(part)
    return found


def _hits_by_shuffle(split: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """``hits`` without a broadcast. A document's words stay in the task that splits them."""
    size = F.size("w")
    found = split.select("row_key", "doc_id", size.cast("long").alias("n_words"), F.lit(-1).alias("start"), F.lit(lengths[0]).alias("length"), F.array().cast("array<string>").alias("items"))
    for length in lengths:
        places = F.when(size >= length, F.sequence(F.lit(1), size - length + 1)).otherwise(F.array().cast("array<int>"))
        # windows in a projection of their own, so rows don't copy the words; outer, or a filter that
        # Spark infers from the generator would split the text again for every window
        own = F.transform(places, lambda i: F.slice("w", i, length))  # noqa: B023
        each = split.select("row_key", "doc_id", size.cast("long").alias("n_words"), own.alias("_grams")).select("row_key", "doc_id", "n_words", F.posexplode_outer("_grams").alias("start", "_gram"))
        each = each.withColumn("length", F.lit(length))
        each = each.withColumn("gram_hash", F.xxhash64("_gram"))
        same = each.join(grams.where(F.size("gram") == length), "gram_hash").where(F.col("_gram") == F.col("gram"))
        found = found.unionByName(same.select(*found.columns))
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids, contaminated, spans.

    ``spans`` lists the hit runs of words as (start, stop), stop excluded.
    """
    grams = written(item_windows(benchmark, n), "grams")
    found = written(hits(docs.select("doc_id", "text", row_key().alias("row_key")), grams, n), "hits")
    windows = found.where("start >= 0")
    order = Window.partitionBy("row_key").orderBy("start", "length")
    reach = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    spread = windows.select("row_key", "start", "length").distinct().withColumn("stop", F.col("start") + F.col("length")).withColumn("reach", F.coalesce(reach, F.lit(0)))
    spread = spread.withColumn("run", F.count_if(F.col("start") > F.col("reach")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spread.groupBy("row_key", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = runs.groupBy("row_key").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    items = windows.select("row_key", F.explode("items").alias("item_id")).distinct().groupBy("row_key").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    verdicts = written(spans.join(items, "row_key"), "verdicts")
    return found.where("start = -1").join(verdicts, "row_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), "spans",
    )


def row_key() -> Column:
    """Equal for rows with equal id and text, which have equal hits."""
    return F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))), 256)


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no benchmark window occurs."""
    grams, key = written(item_windows(benchmark, n), "grams"), free_name(docs, "row_key")
    found = hits(docs.select("doc_id", "text", row_key().alias("row_key")), grams, n).where("start >= 0")
    dirty = written(found.select(F.col("row_key").alias(key)).distinct(), "dirty")
    return docs.withColumn(key, row_key()).join(dirty, key, "left_anti").drop(key)
