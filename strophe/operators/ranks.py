"""Exact nearest-rank quantiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.plans.tables import settled


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_of_{k}"]) for k in keys])


def quantiles(df: DataFrame, keys: list[str], x: str, ps: dict[str, float]) -> DataFrame:
    """``keys`` and, for every name of ``ps``, the value of ``x`` at rank bround((n - 1) * p).

    Null values don't count; a group without any has no row. Equal values are counted before the
    shuffle; the counts are dealt to cells by ranges of (keys, x), the cells' sums prefixed, and
    only the cells that hold a wanted rank are ordered: no task gets a whole group.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    counts = settled(counts.repartitionByRange(*keys, x).withColumn("_cell", F.spark_partition_id()), "value-counts")
    up = Window.partitionBy(*keys).orderBy("_cell")
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_c"))
    cells = cells.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_cell").alias("_of__cell"), "_c", F.sum("_c").over(up).alias("_upto"), F.sum("_c").over(Window.partitionBy(*keys)).alias("_total"))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.bround((F.col("_total") - 1) * F.lit(p), 0).cast("long").alias("rank")) for name, p in ps.items()])
    wanted = cells.withColumn("_w", F.explode(ranks)).where("_w.rank < _upto and _w.rank >= _upto - _c")
    wanted = wanted.select(*[f"_of_{k}" for k in keys], "_of__cell", F.col("_w.name").alias("_name"), (F.col("_w.rank") - F.col("_upto") + F.col("_c")).alias("_rank"))
    rows = counts.join(wanted, _same(counts, wanted, [*keys, "_cell"])).select(*keys, x, "_n", "_name", "_rank")
    seen = F.sum("_n").over(Window.partitionBy(*keys, "_name").orderBy(x))
    found = rows.withColumn("_seen", seen).where("_rank < _seen and _rank >= _seen - _n")
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col(x))).alias(name) for name in ps])
