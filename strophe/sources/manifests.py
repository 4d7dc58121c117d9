"""Runtime packages as a table: one partition per runtime key, replaced as a whole.

A package is a row of runtime_key, quanta (array of which, start, duration) and edges (array of src, dst,
distance, deleted). Writing replaces the partitions of the keys that are written and no others. Spark
puts files in place when the whole write has finished, so a write that was killed leaves the old packages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.operators import graph

#: Fixed value: the version of a manifest that is read.
SCHEMA_VERSION = 1
SCHEMA = "quanta array<struct<which:long,start:double,duration:double>>, edges array<struct<src:long,dst:long,distance:double,deleted:boolean>>, schema_version int, runtime_key string"
WRONG_VERSION, NO_QUANTA = "unsupported-schema-version", "no-quanta"


def write_manifests(packages: DataFrame, path: str, version: int = SCHEMA_VERSION) -> None:
    """Replaces the packages of the keys of ``packages``; a key has one row."""
    rows = packages.select("quanta", "edges", F.lit(version).alias("schema_version"), "runtime_key")
    rows.repartition("runtime_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("runtime_key").parquet(path)


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Packages (runtime_key, quanta, edges, n_ignored) and errors (runtime_key, code, message).

    Another schema version, or a package without quanta, is an error row. Edges are checked anew: those whose ends
    aren't two quanta of the package, that have no finite distance or are deleted are left out and counted.
    """
    held = spark.read.schema(SCHEMA).parquet(path)
    code = F.when(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), WRONG_VERSION).when(F.coalesce(F.size("quanta"), F.lit(0)) < 1, NO_QUANTA)
    message = F.when(code == WRONG_VERSION, F.concat(F.lit("schema version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("null")))).otherwise("the package has no quanta")
    errors = held.where(code.isNotNull()).select("runtime_key", code.alias("code"), message.alias("message"))
    sound = held.where(code.isNull())
    edges = sound.select("runtime_key", F.inline("edges"))
    quanta = sound.select("runtime_key", F.inline("quanta")).select("runtime_key", "which").distinct()
    valid = graph.valid_edges(edges.withColumn("deleted", F.coalesce("deleted", F.lit(False))), quanta, "runtime_key")
    kept = valid.groupBy("runtime_key").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "distance", "deleted"))).alias("_kept"))
    none = F.array().cast("array<struct<src:bigint,dst:bigint,distance:double,deleted:boolean>>")
    rows = sound.join(kept, "runtime_key", "left").withColumn("_kept", F.coalesce("_kept", none))
    return rows.select("runtime_key", "quanta", F.col("_kept").alias("edges"), (F.coalesce(F.size("edges"), F.lit(0)) - F.size("_kept")).alias("n_ignored")), errors
