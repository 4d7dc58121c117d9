from pyspark.sql import functions as F

from strophe.operators import walk
from strophe.streaming import sessions

EVENT = "session string, track string, at long, steps int, seek int"


def played(spark, tmp_path, name, batches, quanta, edges):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/batch={k}")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*")
    run = sessions.play(stream, quanta, edges).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}-state").start()
    assert run.awaitTermination(120)
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_a_stream_plays_what_the_batch_walks(spark, tmp_path):
    quanta = spark.range(60).select(F.lit("a").alias("track"), F.col("id").alias("which"), F.lit(0.5).alias("duration"))
    edges = spark.createDataFrame([("a", k, (k * 7) % 40, 1.0 + k % 3) for k in range(4, 60, 3)], "track string, src int, dst int, distance double")
    want = sorted(tuple(r) for r in walk.simulate(quanta, edges, "track", 300).collect())
    batches = [[("a", "a", 2, 50, None), ("a", "a", 1, 100, None), ("x", "gone", 1, 5, None)], [("a", "a", 3, 150, None)]]
    assert played(spark, tmp_path, "whole", batches, quanta, edges) == want
    assert any(r[5] == "jump" or r[5] == "forced-in-end-zone" for r in want)


def test_a_seek_sets_the_beat(spark, tmp_path):
    quanta = spark.range(60).select(F.lit("a").alias("track"), F.col("id").alias("which"), F.lit(0.5).alias("duration"))
    edges = spark.createDataFrame([("a", 50, 2, 1.0)], "track string, src int, dst int, distance double")
    got = played(spark, tmp_path, "sought", [[("s", "a", 1, 3, None), ("s", "a", 2, 2, 30), ("s", "a", 3, None, 900), ("s", "a", 4, 1, None)]], quanta, edges)
    assert [(r[1], r[2], r[3]) for r in got] == [(0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 30, 31), (4, 31, 32), (5, 59, 0)]
