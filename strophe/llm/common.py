"""What several operators share: word patterns, written tables, running totals."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of anything but space, tab, line feed, VT, FF and CR.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, as in tests, may leave it unset; it gets a folder of its own.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, and a
    lost executor costs a reread. The files go when the cluster clears that folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def releasing_shuffles(spark: SparkSession):
    """Inside, the shuffle files of a finished write are deleted at once, not when the driver
    happens to collect garbage. A write that is still running keeps what it may need again."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and the fields of ``ddl`` after it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def spread_join(rows: DataFrame, table: DataFrame, key: str, size: str, share_rows: int = 50_000) -> DataFrame:
    """``rows`` joined with the one row that ``table`` has for their ``key``.

    Column ``size`` of ``table`` counts the rows of a key. Keys with more than ``share_rows`` are
    split into shares, so no task gets a whole hot key. The list of those keys is broadcast;
    it has at most len(rows) / share_rows rows, whatever the keys are.
    """
    shares = F.ceil(F.col(size) / share_rows).cast("int")
    hot = table.where(F.col(size) > share_rows).select(key, shares.alias("_shares"))
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("_share", F.when(F.col("_shares").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_shares"))).cast("int")).drop("_shares")
    spread = table.withColumn("_share", F.explode(F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1)))
    return marked.join(spread, [key, "_share"]).drop("_share")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[Column], amount: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows of ``group`` up to and with this one.

    ``bucket`` must rise with ``order``. Sums of the (group, bucket) cells are prefixed
    first and joined back, so one task orders one cell only, however large the group.
    Rows that tie in every ``order`` column get their totals in any order. ``df``
    should be a written table: it is read twice.
    """
    cells = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_cell"))
    before = F.sum("_cell").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)) if group else F.sum("_cell").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    keys = [*group, bucket]
    starts = cells.select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(before, F.lit(0)).alias("_before"))
    match = None
    for k in keys:
        same = df[k].eqNullSafe(starts[f"_{k}"])
        match = same if match is None else match & same
    inside = F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(starts, match).withColumn(out, F.col("_before") + inside).drop("_before", *[f"_{k}" for k in keys])
