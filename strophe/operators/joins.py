"""Joins on order: containment, as-of, overlap and nearest.

Point-to-span and as-of joins are unions read by one window per track, linear in the rows;
only the overlap joins, whose result is pairs, join spans with spans, by equal stretches of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def containment(children: DataFrame, parents: DataFrame, track: str) -> DataFrame:
    """Adds parent and index_in_parent to ``children`` (track, start, which).

    ``parents`` (track, start, end, which) are disjoint and start-ordered; a child lies in a
    parent when start is in [start, end). Orphans have parent null and index -1.
    """
    up = parents.select(track, "start", F.lit(0).alias("_side"), F.struct("end", "which").alias("_parent"))
    kids = children.select("*", F.lit(1).alias("_side"))
    rows = kids.unionByName(up, allowMissingColumns=True)
    seen = F.last("_parent", ignorenulls=True).over(Window.partitionBy(track).orderBy("start", "_side").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_seen", seen).where("_side = 1")
    rows = rows.withColumn("parent", F.when(F.col("start") < F.col("_seen.end"), F.col("_seen.which"))).drop("_side", "_parent", "_seen")
    index = F.row_number().over(Window.partitionBy(track, "parent").orderBy("start", "which")) - 1
    return rows.withColumn("index_in_parent", F.when(F.col("parent").isNull(), F.lit(-1)).otherwise(index))


def asof_forward(left: DataFrame, right: DataFrame, track: str, payload: str, out: str) -> DataFrame:
    """Adds ``out``: ``payload`` of the first row of ``right`` (track, start, payload) that
    starts at or after the left row's start, null if there is none."""
    marks = right.select(track, "start", F.lit(1).alias("_side"), F.struct(F.col(payload).alias("v")).alias("_mark"))
    rows = left.select("*", F.lit(0).alias("_side")).unionByName(marks, allowMissingColumns=True)
    ahead = Window.partitionBy(track).orderBy("start", "_side", F.col("_mark.v")).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn(out, F.first("_mark", ignorenulls=True).over(ahead)["v"]).where("_side = 0").drop("_side", "_mark")


def overlapping(left: DataFrame, right: DataFrame, track: str) -> DataFrame:
    """Pairs that touch, of ``left`` (track, _ls, _le, ...) and ``right`` (track, _rs, _re, ...), ends not before starts.

    A track's time is cut into stretches as long as the longer of both sides' mean spans, so the
    spans' shares of stretches are at most twice the spans. A pair comes from the stretch of its later start.
    """
    mean = lambda df, a, b, out: df.groupBy(track).agg(F.avg(F.col(b) - F.col(a)).alias(out))
    width = mean(left, "_ls", "_le", "_wl").join(mean(right, "_rs", "_re", "_wr"), track).withColumn("_w", F.greatest("_wl", "_wr"))
    width = width.select(track, F.when(F.col("_w") > 0, F.col("_w")).otherwise(F.lit(1.0)).alias("_w"))

    def cut(df, a, b):
        first = F.floor(F.col(a) / F.col("_w"))
        return df.join(width, track).withColumn("_at", F.explode(F.sequence(first, F.greatest(first, F.floor(F.col(b) / F.col("_w"))))))

    pairs = cut(left, "_ls", "_le").join(cut(right, "_rs", "_re").drop("_w"), [track, "_at"])
    later = F.floor(F.greatest("_ls", "_rs") / F.col("_w")) == F.col("_at")
    return pairs.where((F.col("_re") >= F.col("_ls")) & (F.col("_rs") <= F.col("_le")) & later).drop("_at", "_w")


def cursor_overlap(quanta: DataFrame, segments: DataFrame, track: str) -> DataFrame:
    """Pairs of quanta and the segments they touch (both ends closed): track, quantum, segment.

    A segment before the last match of any earlier quantum is passed over, as a cursor that
    never moves back would do. Both sides have track, which, start, end.
    """
    q = quanta.select(track, F.col("which").alias("quantum"), F.col("start").alias("_ls"), F.col("end").alias("_le"))
    s = segments.select(track, F.col("which").alias("segment"), F.col("start").alias("_rs"), F.col("end").alias("_re"))
    pairs = overlapping(q, s, track)
    last = pairs.groupBy(track, "quantum").agg(F.max("segment").alias("_last"))
    before = F.max("_last").over(Window.partitionBy(track).orderBy("quantum").rowsBetween(Window.unboundedPreceding, -1))
    cursor = last.select(track, "quantum", F.coalesce(before, F.lit(0)).alias("_cursor"))
    return pairs.join(cursor, [track, "quantum"]).where(F.col("segment") >= F.col("_cursor")).select(track, "quantum", "segment")


def nearest_within(left: DataFrame, right: DataFrame, track: str, tolerance: float) -> DataFrame:
    """Adds nearest (which of the closest right row) and gap; null beyond ``tolerance``.

    Of two equally close the earlier wins. Only the rows just before and just after can be
    closest, so two windows find both.
    """
    marks = right.select(track, "start", F.lit(0).alias("_side"), F.struct("start", "which").alias("_mark"))
    rows = left.select("*", F.lit(1).alias("_side")).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(track)
    behind = F.last("_mark", ignorenulls=True).over(order.orderBy("start", "_side", F.col("_mark.which").desc()).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_mark", ignorenulls=True).over(order.orderBy("start", F.col("_side").desc(), "_mark.which").rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_b", behind).withColumn("_a", ahead).where("_side = 1")
    rows = rows.withColumn("_gb", F.abs(F.col("start") - F.col("_b.start"))).withColumn("_ga", F.abs(F.col("_a.start") - F.col("start")))
    pick = F.when(F.col("_ga").isNull() | (F.col("_gb") <= F.col("_ga")), F.struct(F.col("_gb").alias("g"), F.col("_b.which").alias("w"))).otherwise(F.struct(F.col("_ga").alias("g"), F.col("_a.which").alias("w")))
    rows = rows.withColumn("_pick", pick)
    near = F.col("_pick.g") <= tolerance
    return rows.withColumn("nearest", F.when(near, F.col("_pick.w"))).withColumn("gap", F.when(near, F.col("_pick.g"))).drop("_side", "_mark", "_b", "_a", "_gb", "_ga", "_pick")


def best_overlap(spans: DataFrame, windows: DataFrame, track: str) -> DataFrame:
    """track, span, window, overlap: the window that covers most of a span; the first wins ties."""
    s = spans.select(track, F.col("which").alias("span"), F.col("start").alias("_ls"), F.col("end").alias("_le"))
    w = windows.select(track, F.col("which").alias("window"), F.col("start").alias("_rs"), F.col("end").alias("_re"))
    pairs = overlapping(s, w, track).withColumn("overlap", F.least("_le", "_re") - F.greatest("_ls", "_rs")).where("overlap > 0")
    return pairs.groupBy(track, "span").agg(F.min_by(F.struct("window", "overlap"), F.struct(-F.col("overlap"), "window")).alias("_b")).select(track, "span", "_b.window", "_b.overlap")


def point_lookup(points: DataFrame, beats: DataFrame, track: str) -> DataFrame:
    """Adds beat: the beat whose [start, end) holds ``at``; the last beat behind the last start, else 0."""
    p = points.withColumn("start", F.col("at"))
    marks = beats.select(track, "start", F.lit(0).alias("_side"), F.struct("end", "which").alias("_mark"))
    rows = p.select("*", F.lit(1).alias("_side")).unionByName(marks, allowMissingColumns=True)
    seen = F.last("_mark", ignorenulls=True).over(Window.partitionBy(track).orderBy("start", "_side").rowsBetween(Window.unboundedPreceding, 0))
    top = F.max("_mark.which").over(Window.partitionBy(track))
    inside = (F.col("at") < F.col("_seen.end")) | (F.col("_seen.which") == F.col("_top"))
    rows = rows.withColumn("_seen", seen).withColumn("_top", top).where("_side = 1")
    return rows.withColumn("beat", F.coalesce(F.when(inside, F.col("_seen.which")), F.lit(0))).drop("_side", "_mark", "_seen", "_top", "start")
