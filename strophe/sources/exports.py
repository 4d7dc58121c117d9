"""JSON documents of analysed tracks, one line a track, written and read in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strophe.functions.columns import finite


def nested(track: str, levels: dict[str, DataFrame], fields: list[str]) -> DataFrame:
    """One row per track with an array of ``fields`` structs for each level, in order of start.

    A track's spans come together in its row, as the document demands.
    """
    out = None
    for name, rows in levels.items():
        level = rows.groupBy(track).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = level if out is None else out.join(level, track, "full")
    return out.select(track, *[F.coalesce(name, F.array()).alias(name) for name in levels])


def branches(edges: DataFrame, track: str, status: str) -> DataFrame:
    """track and an array of branch structs in order of from, to and distance.

    ``edges`` has track, src, dst, distance; distances that aren't finite become null.
    """
    jump = F.col("dst") - F.col("src")
    way = F.when(jump < 0, "backward").when(jump > 0, "forward").when(jump == 0, "self")
    branch = F.struct(F.col("src").alias("from_beat"), F.col("dst").alias("to_beat"), finite(F.col("distance")).alias("distance"), jump.alias("jump_beats"), way.alias("direction"), F.lit(status).alias("status"))
    return edges.groupBy(track).agg(F.array_sort(F.collect_list(branch)).alias("branches"))


def branch_documents(active: DataFrame, candidates: DataFrame, track: str) -> DataFrame:
    """track, active, candidates, n_active, n_candidates: one document of branches per track."""
    out = branches(active, track, "active").withColumnRenamed("branches", "active").join(branches(candidates, track, "candidate").withColumnRenamed("branches", "candidates"), track, "full")
    return out.withColumns({f"n_{x}": F.coalesce(F.size(x), F.lit(0)) for x in ("active", "candidates")})


def summary(levels: dict[str, DataFrame], track: str) -> DataFrame:
    """track and the number of rows of every level; 0 where a track has none of it."""
    out = None
    for name, rows in levels.items():
        level = rows.groupBy(track).agg(F.count("*").alias(f"n_{name}"))
        out = level if out is None else out.join(level, track, "full")
    return out.na.fill(0, [f"n_{name}" for name in levels])


def milliseconds(seconds: Column) -> Column:
    """Whole milliseconds, halves away from zero."""
    return F.round(seconds * 1000, 0).cast("long")


def write_documents(df: DataFrame, path: str, replace: bool = False) -> None:
    df.write.mode("overwrite" if replace else "errorifexists").json(path)


def read_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of ``schema`` with file and corrupt: the text of a line that isn't such a document, else null."""
    wanted = StructType([*schema.fields, StructField("corrupt", StringType())])
    rows = spark.read.schema(wanted).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))
