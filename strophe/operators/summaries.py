"""Aggregations: medians, modes, quality of grids, guardrails."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.columns import finite
from strophe.operators.joins import nearest_within
from strophe.operators.ranks import quantiles
from strophe.operators.timeline import exploded


def vector_median(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, dim, median of every dimension over the rows of a key."""
    return exploded(df, [key], vector).groupBy(key, "dim").agg(F.median("x").alias("median"))


def mode(df: DataFrame, key: str, x: str) -> DataFrame:
    """key, mode, n: the most frequent value; the larger wins ties."""
    counts = df.groupBy(key, x).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max(F.struct("n", F.col(x).alias("x"))).alias("m")).select(key, F.col("m.x").alias("mode"), F.col("m.n").alias("n"))


def activation_summary(df: DataFrame, key: str, x: str, threshold: float) -> DataFrame:
    """Count, range, mean, nearest-rank percentiles and share of rows at the threshold;
    values that aren't finite count as 0."""
    v = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.col(x))
    rows = df.withColumn("_v", v)
    held = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.avg("_v").alias("mean"), F.count_if(F.col("_v") >= threshold).alias("n_above"))
    tops = quantiles(rows, [key], "_v", {f"p{p}": p / 100 for p in (50, 75, 90, 95, 99)})
    return held.join(tops.withColumnRenamed(key, "_k"), held[key].eqNullSafe(F.col("_k")), "left").drop("_k")


def grid_quality(beats: DataFrame, track: str) -> DataFrame:
    """Per track of (track, which, start): n, median_interval, bpm, std_ratio, cv, mad, n_gaps
    (over 1.65 medians) and n_duplicates (under 0.45)."""
    w = Window.partitionBy(track).orderBy("which")
    gaps = beats.withColumn("g", F.lead("start").over(w) - F.col("start"))
    base = gaps.groupBy(track).agg(F.count("*").alias("n"), F.median(F.when(F.col("g") > 0, F.col("g"))).alias("median_interval"), F.stddev_pop("g").alias("_s"), F.avg("g").alias("_m"))
    rows = gaps.join(base, track)
    more = rows.groupBy(track).agg(F.median(F.abs(F.col("g") - F.col("median_interval"))).alias("mad"), F.count_if(F.col("g") > 1.65 * F.col("median_interval")).alias("n_gaps"), F.count_if(F.col("g") < 0.45 * F.col("median_interval")).alias("n_duplicates"))
    return base.join(more, track).select(track, "n", "median_interval", (60.0 / F.col("median_interval")).alias("bpm"), (F.col("_s") / F.col("median_interval")).alias("std_ratio"), (F.col("_s") / F.col("_m")).alias("cv"), "mad", "n_gaps", "n_duplicates")


@dataclass(frozen=True)
class Limits:
    """What a usable grid keeps to (fixed values)."""

    least_beats: int = 2
    low_bpm: float = 40.0
    high_bpm: float = 220.0
    least_confidence: float = 0.01
    beats_per_second: float = 6.5
    interval_ratio: float = 0.65
    downbeat_distance: float = 0.03
    least_coverage: float = 0.80


def guardrails(beats: DataFrame, downbeats: DataFrame, tracks: DataFrame, track: str, limits: Limits = Limits()) -> DataFrame:
    """track, n, failure of every row of ``tracks`` (track, bpm, duration, coverage): the first broken rule, or null.

    ``beats`` has track, start and confidence, ``downbeats`` track and start. Coverage is null where no model
    took part; without a positive duration neither density nor coverage is judged.
    """
    none = F.lit(None).cast("double")
    step = lambda df: F.col("start") - F.lag("start").over(Window.partitionBy(track).orderBy("start"))
    unsound = F.count_if((F.col("_g") <= 0) | F.isnan("start") | (F.abs("start") == float("inf")))
    ratio = F.stddev_pop("_g") / F.avg("_g")
    grid = beats.withColumn("_g", step(beats)).groupBy(track).agg(
        F.count("*").alias("n"), F.count("confidence").alias("_told"), unsound.alias("_back"), F.count(finite(F.col("confidence"))).alias("_finite"),
        F.avg("confidence").alias("_mean"), F.when(F.count("*") >= 3, ratio).otherwise(none).alias("_ratio"),
    )
    marks = beats.select(track, "start", F.lit(0).alias("which"))
    near = nearest_within(downbeats.select(track, "start"), marks, track, limits.downbeat_distance).withColumn("_g", step(downbeats))
    bars = near.groupBy(track).agg(unsound.alias("_bars_back"), F.count_if(F.col("gap").isNull()).alias("_far"))
    rows = tracks.join(grid, track, "left").join(bars, track, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sized, bpm = F.col("duration") > 0, finite(F.col("bpm"))
    rules = [
        ("beat-count-too-low", F.col("n") < limits.least_beats),
        ("confidence-count-mismatch", F.col("_told") < F.col("n")),
        ("bpm-out-of-range", bpm.isNull() | (bpm < limits.low_bpm) | (bpm > limits.high_bpm)),
        ("beat-times-not-strictly-increasing", F.col("_back") > 0),
        ("confidences-not-finite", F.col("_finite") < F.col("n")),
        ("confidence-too-low", F.col("_mean") < limits.least_confidence),
        ("beat-density-too-high", sized & (F.col("n") / F.col("duration") > limits.beats_per_second)),
        ("beat-interval-stddev-too-high", F.col("_ratio") > limits.interval_ratio),
        ("downbeat-times-not-strictly-increasing", F.col("_bars_back") > 0),
        ("downbeat-not-aligned-to-beat", F.col("_far") > 0),
        ("ai-coverage-too-low", sized & (F.isnan("coverage") | (F.abs("coverage") == float("inf")) | (F.col("coverage") < limits.least_coverage))),
    ]
    return rows.select(track, "n", F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules]).alias("failure"))


def histogram_names(df: DataFrame, key: str, name: str, top: int) -> DataFrame:
    """key, names: the ``top`` most frequent names, count down and then name up."""
    counts = df.groupBy(key, name).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_n"), name))
    held = counts.withColumn("_r", rank).where(F.col("_r") <= top).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_r", F.col(name).alias("name")))).alias("_h"))
    return held.select(key, F.transform("_h", lambda x: x["name"]).alias("names"))


def beat_features(beats: DataFrame, frames: DataFrame, track: str, vector: str, rms: str, per_second: float) -> DataFrame:
    """track, which, vector (median in every dimension), loudness (first, maximum, mean) of the
    frames floor(start * fps) to ceil(end * fps) - 1 of a beat, held to the frames there are.

    ``frames`` has track, frame from 0 on, the vector and ``rms``. Each beat names its frames, so the
    join is by equal frame and grows with the frames that beats cover.
    """
    n = frames.groupBy(track).agg((F.max("frame") + 1).alias("_n"))
    first = F.floor(F.col("start") * per_second)
    last = F.greatest(first, F.ceil((F.col("start") + F.col("duration")) * per_second) - 1)
    held = lambda x: F.greatest(F.lit(0), F.least(x, F.col("_n") - 1))
    spans = beats.join(n, track).select(track, "which", F.explode(F.sequence(held(first), held(last))).alias("frame"))
    rows = spans.join(frames.select(track, "frame", vector, rms), [track, "frame"])
    loud = rows.groupBy(track, "which").agg(F.array(F.min_by(rms, "frame"), F.max(rms), F.avg(rms)).alias("loudness"))
    dims = rows.select(track, "which", F.posexplode(vector).alias("_d", "_x")).groupBy(track, "which", "_d").agg(F.median("_x").alias("_m"))
    vectors = dims.groupBy(track, "which").agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda x: x["_m"]).alias(vector))
    return vectors.join(loud, [track, "which"])
