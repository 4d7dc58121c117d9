"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / quality, u being a hash of its id, or of its text where
the id is null. Within a source,
documents in key order are a weighted random order without replacement; their sizes are
prefix-summed against the source's token budget. A budget of several source sizes takes
that many complete epochs first, and the rest by key order.

A source is ordered in cells of about CELL_ROWS rows. The key of quality q is exponential with
rate q, so the cell of a key is read off the source's mixture of exponentials, one for each of
LEVELS steps of quality: at most STEP times the mean falls into a cell, whatever the qualities.

Defined results: null and wordless texts have size 0 and are never taken. A null source is
a source of its own, ordered last. Equal rows get equal keys; which of them a budget ends
at makes no difference. An empty table gives an empty result.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import free_name, n_words, running_total, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Characters whose share lowers a document's quality.
SYMBOLS = "#*$%&|<>"
#: Rows of a source that one task orders, on average over its cells.
CELL_ROWS = 5_000
LEAST, STEP, LEVELS = 0.1, 1.25, 11
#: Passes of taking what still fits a budget; each leaves less than one document's size.
PASSES = 3


def quality(text: Column) -> Column:
    """From 1 (no symbols) down to LEAST (a tenth of all characters or more are symbols)."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(n > 0, F.greatest(F.lit(LEAST), 1.0 - 9.0 * symbols / n)).otherwise(F.lit(LEAST))


def level(q: Column) -> Column:
    """The step of quality that q lies in, the lowest being 0."""
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.floor(F.log(q / LEAST) / log(STEP) + 1e-9))).cast("int")


def cell(key: Column, shares: list[Column], cells: Column) -> Column:
    """The cell of a key, rising with it. ``shares`` are those of the levels among a source's rows;
    each level counts with its least rate, so that the rows of no level crowd into a cell."""
    before = sum((share * (1.0 - F.exp(-LEAST * STEP**k * key)) for k, share in enumerate(shares)), F.lit(0.0))
    return F.least(F.floor(before * cells), cells - 1).cast("long")


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) from a hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11) + 0.5) / float(2**53)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    Sources in code point order, null last, take the weights in turn. All sizes together
    are shared by weight; a target stops at ``max_epochs`` source sizes and what it leaves
    is shared again. With ratios r = limit / weight in rising order, a source is full as
    long as the level (budget - limits so far) / (weights from here on) is not below r.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("_n", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("_w", weight).withColumn("_limit", F.col("source_size") * float(max_epochs))
    rising = Window.orderBy(F.col("_limit") / F.col("_w"), "_n")
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", level).withColumn("_full", F.col("_level") * F.col("_w") >= F.col("_limit"))
    open_level = F.first(F.when(~F.col("_full"), F.col("_level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("_full"), F.col("_limit")).otherwise(F.least(F.col("_limit"), open_level * F.col("_w")))
    return rows.withColumn("target", F.round(target, 6)).drop("_n", "_w", "_limit", "_level", "_full")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, carry: tuple = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, and
    what columns ``carry`` names.

    ``copies`` says how often the mix repeats the whole document (0: left out) and
    ``taken`` is copies * size.
    """
    u = F.when(F.col("doc_id").isNull(), uniform(F.col("text"), F.lit(20240501))).otherwise(uniform(F.col("doc_id"), F.lit(20240501)))
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), u.alias("_u"), quality(F.col("text")).alias("_q"), F.crc32("text").alias("_tie"), *carry)
    rows = rows.withColumn("_key", -F.log("_u") / F.col("_q")).withColumn("_level", level(F.col("_q"))).drop("_u", "_q")
    rows = written(rows, "mix-rows")
    counts = [(F.count_if(F.col("_level") == k) / F.count("*")).alias(f"_share{k}") for k in range(LEVELS)]
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / CELL_ROWS).alias("_cells"), *counts), weights, max_epochs)
    sources = written(sources.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")), "mix-sources")
    named = sources.withColumnRenamed("source", "_source")
    rows = rows.join(named, rows["source"].eqNullSafe(named["_source"])).drop("_source").withColumn("_left", F.col("target") - F.col("_epochs") * F.col("source_size"))
    place = cell(F.col("_key"), [F.col(f"_share{k}") for k in range(LEVELS)], F.col("_cells"))
    rows = rows.select("*", place.alias("_bucket"), F.lit(False).alias("_extra")).drop("_level", "_cells", *[f"_share{k}" for k in range(LEVELS)])
    order = [F.col("_key"), F.col("doc_id"), F.col("_tie"), F.col("size")]
    for k in range(PASSES):
        rows = written(rows, f"mix-pass{k}")
        amount = F.when(~F.col("_extra") & (F.col("size") <= F.col("_left")), F.col("size")).otherwise(0)
        rows = running_total(rows, ["source"], "_bucket", order, amount, "_sum")
        fits = ~F.col("_extra") & (F.col("size") > 0) & (F.col("size") <= F.col("_left")) & (F.col("_sum") <= F.col("_left"))
        rows = rows.withColumn("_new", fits)
        if k < PASSES - 1:
            rows = written(rows, f"mix-new{k}")
            got = rows.where("_new").groupBy("source").agg(F.sum("size").alias("_got")).withColumnRenamed("source", "_source")
            rows = rows.join(got, rows["source"].eqNullSafe(got["_source"]), "left")
            rows = rows.withColumn("_left", F.col("_left") - F.coalesce(F.col("_got"), F.lit(0))).drop("_got", "_source")
        rows = rows.withColumn("_extra", F.col("_extra") | F.col("_new")).drop("_new", "_sum")
    copies = F.when(F.col("size") > 0, F.col("_epochs") + F.col("_extra").cast("long")).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("copies", copies)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: whole rows of ``docs``, each repeated ``copies`` times.

    Copies go by row: rows are numbered in a written table, so those with a null or a shared
    doc_id get their own copies like all others. ``docs`` may have any further columns.
    """
    row = free_name(docs, "_row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs", "zstd")
    plan = mix(numbered.select("doc_id", "source", "text", F.col(row).alias("_row")), weights, max_epochs, carry=("_row",)).where("copies > 0")
    plan = plan.select(F.col("_row").alias(row), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(row)
    return numbered.join(plan, row).select(*docs.columns)
