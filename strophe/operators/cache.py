"""Keys and bookkeeping of materialised results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.columns import clamp, similarity_threshold


def cache_keys(df: DataFrame, identity: list[str], analysis: list[str], branch: list[str], runtime: list[str]) -> DataFrame:
    """Adds analysis_key, branch_key and runtime_key, each the hash of the key above it and
    its own options; what changes an option changes its key and those below."""
    digest = lambda *c: F.sha2(F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in c]), 256)
    rows = df.withColumn("analysis_key", digest(*map(F.col, identity + analysis)))
    rows = rows.withColumn("branch_key", digest(F.col("analysis_key"), *map(F.col, branch)))
    return rows.withColumn("runtime_key", digest(F.col("branch_key"), *map(F.col, runtime)))


def change_impact(old: str, new: str, analysis: list[str], branch: list[str], runtime: list[str]) -> Column:
    """The highest level of which an option differs: Analysis, Branches, RuntimeOnly, None."""
    differs = lambda names: F.array_contains(F.array(*[~F.col(f"{old}.{x}").eqNullSafe(F.col(f"{new}.{x}")) for x in names]), True)
    return F.when(differs(analysis), "Analysis").when(differs(branch), "Branches").when(differs(runtime), "RuntimeOnly").otherwise("None")


def latest(df: DataFrame, key: Column, newest: list[Column], n: int | None = None, group: str | None = None) -> DataFrame:
    """The newest row of each key; with ``n``, the n newest keys (of each ``group``)."""
    kept = df.withColumn("_k", key)
    by = [*([group] if group else []), "_k"]
    kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*newest))).where("_r = 1")
    if n is not None and group:
        kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*newest))).where(F.col("_r") <= n)
    elif n is not None:
        kept = kept.orderBy(*newest).limit(n)
    return kept.drop("_k", "_r")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``changes`` and the rows of ``table`` whose key isn't among them."""
    return changes.unionByName(table.join(changes.select(key).distinct(), key, "left_anti"))


#: Bounds of the options of a runtime, and what an empty preset or quantum stands for.
BOUNDS = {"similarity": (0.65, 0.95), "look_ahead": (1, 5), "min_jump": (4, 64), "max_branches": (1, 12), "jump_probability": (0.0, 1.0), "jump_cooldown": (0, 64), "first_pass": (0.0, 1.0)}
DEFAULTS = {"preset": "Balanced", "quantum": "beats"}
EXACT, COMPATIBLE, MISS = "exact", "compatible", "miss"


def runtime_options(df: DataFrame) -> DataFrame:
    """The options of BOUNDS and DEFAULTS as a runtime takes them, and max_threshold from the similarity."""
    held = {x: clamp(F.col(x), low, high) for x, (low, high) in BOUNDS.items()}
    named = {x: F.when(F.trim(F.coalesce(F.col(x), F.lit(""))) == "", F.lit(default)).otherwise(F.col(x)) for x, default in DEFAULTS.items()}
    return df.withColumns({**held, **named, "max_threshold": similarity_threshold(held["similarity"])})


def lookup(inputs: DataFrame, index: DataFrame, key: str, identity: list[str], created: str) -> DataFrame:
    """``inputs`` with outcome and item: the cached item of ``index`` that an input may use.

    Both have branch_key, runtime_key and the columns ``identity`` of the file; ``index`` has item, ``created`` and
    available (whether its files are there). The newest item of the input's runtime key is exact if it is of the same
    file and available. Else the newest item of the same file and branch key with another runtime key is compatible, if
    available: its options have to be built anew (``runtime_options``). Else it is a miss. Keys match whatever
    their case. A runtime key hangs on its branch key, so one join by branch key finds both, and each input keeps
    the best of its items as they come, not a list of them. ``key`` names an input.
    """
    names = [*identity, "runtime_key", "item", "available"]
    items = index.select(F.lower("branch_key").alias("_branch"), F.struct(*names).alias("_item"), F.col(created).alias("_created"))
    rows = inputs.withColumn("_branch", F.lower("branch_key")).join(items, "_branch", "left")
    match = F.lower("_item.runtime_key") == F.lower("runtime_key")
    same = reduce(lambda a, b: a & b, (F.col(f"_item.{x}").eqNullSafe(F.col(x)) for x in identity))
    newest = lambda test: F.max_by(F.struct(F.col("_item.item").alias("item"), (F.col("_item.available") & same).alias("fine")), F.when(test, F.struct(F.col("_created"), F.col("_item.item"))))
    best = rows.groupBy(key).agg(newest(match).alias("_exact"), newest(~match & same).alias("_near"))
    exact, near = F.coalesce(F.col("_exact.fine"), F.lit(False)), F.coalesce(F.col("_near.fine"), F.lit(False))
    found = best.select(key, F.when(exact, EXACT).when(near, COMPATIBLE).otherwise(MISS).alias("outcome"), F.when(exact, F.col("_exact.item")).when(near, F.col("_near.item")).alias("item"))
    return inputs.join(found, key)
