"""Whether a branch into a track's end zone can be left again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
ZONE, LEAST_BEATS, LOOK_AHEAD, DEPTH = 0.85, 16, 24, 3
OUTSIDE, ESCAPE, NO_ESCAPE, INVALID = "Destination outside end zone", "Destination has future escape", "Destination has no terminal escape", "Invalid branch"


def escape_guard(quanta: DataFrame, edges: DataFrame, track: str, zone: float = ZONE, least_beats: int = LEAST_BEATS, look_ahead: int = LOOK_AHEAD, depth: int = DEPTH) -> DataFrame:
    """Adds end_zone, escape, safe and reason to edges (track, src, dst and, if there, deleted).

    A quantum is in the end zone from ``zone`` of the track on or with ``least_beats`` or fewer left. From a
    destination in there, playing on for ``look_ahead`` quanta must meet a jump that ends outside, or one
    from whose destination that holds again, ``depth`` stretches in all. What can be left within a depth
    follows from the depth before by a window over the next quanta: no search, and no path is forgotten
    because another one came by. Deleted edges and such as end where they start or at no quantum are invalid.
    """
    order = Window.partitionBy(track).orderBy("which")
    n, place = F.count("*").over(Window.partitionBy(track)), F.row_number().over(order) - 1
    marked = quanta.select(track, "which", n.alias("_n"), place.alias("_place")).withColumn("_zone", (F.col("_place") >= F.floor(F.col("_n") * zone)) | (F.col("_n") - F.col("_place") <= least_beats)).select(track, "which", "_zone")
    alive = ~F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in edges.columns else F.lit(True)
    ends = marked.select(track, F.col("which").alias("dst"), "_zone")
    held = edges.drop("_zone").join(ends, [track, "dst"], "left").withColumn("_valid", alive & (F.col("src") != F.col("dst")) & F.col("_zone").isNotNull())
    jumps = held.where("_valid").select(track, "src", "dst", "_zone")
    ahead = order.rowsBetween(0, look_ahead - 1)
    left = None
    for _ in range(depth):
        rows = jumps.withColumn("_out", ~F.col("_zone"))
        if left is not None:
            rows = rows.join(left.select(track, F.col("which").alias("dst"), "_leaves"), [track, "dst"], "left").withColumn("_out", F.col("_out") | F.coalesce("_leaves", F.lit(False)))
        best = rows.groupBy(track, F.col("src").alias("which")).agg(F.bool_or("_out").alias("_out"))
        left = quanta.select(track, "which").join(best, [track, "which"], "left").select(track, "which", F.coalesce(F.max("_out").over(ahead), F.lit(False)).alias("_leaves"))
    held = held.join(left.select(track, F.col("which").alias("dst"), "_leaves"), [track, "dst"], "left")
    inside = F.col("_valid") & F.col("_zone")
    reason = F.when(~F.col("_valid"), INVALID).when(~F.col("_zone"), OUTSIDE).when(F.col("_leaves"), ESCAPE).otherwise(NO_ESCAPE)
    found = F.col("_valid") & (~F.col("_zone") | F.col("_leaves"))
    return held.withColumns({"end_zone": F.coalesce(inside, F.lit(False)), "escape": F.coalesce(found, F.lit(False)), "safe": F.coalesce(found, F.lit(False)), "reason": reason}).drop("_zone", "_valid", "_leaves")
