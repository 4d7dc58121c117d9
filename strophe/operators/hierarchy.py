"""Bars, tatums and sections over a track's beats, and the phase at which bars begin."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.columns import clamp
from strophe.operators.joins import nearest_within


def bars(beats: DataFrame, track: str, per_bar: int = 4, phase: Column | None = None) -> DataFrame:
    """track, bar, start, duration, confidence (mean) of every ``per_bar`` beats from ``phase`` on.

    ``beats`` has track, which, start, duration, confidence; beats before the phase are in no bar.
    """
    at = F.col("which") - (F.lit(0) if phase is None else clamp(phase, 0, per_bar - 1))
    rows = beats.withColumn("bar", F.floor(at / per_bar)).where(at >= 0)
    end = F.max_by(F.col("start") + F.col("duration"), "which")
    out = rows.groupBy(track, "bar").agg(F.min_by("start", "which").alias("start"), end.alias("_end"), F.avg("confidence").alias("confidence"))
    return out.select(track, "bar", "start", F.greatest(F.lit(0.0), F.col("_end") - F.col("start")).alias("duration"), "confidence")


def bar_position(beats: DataFrame, per_bar: int = 4) -> DataFrame:
    """Adds bar_sin and bar_cos: the place of a beat in its bar on a circle."""
    angle = F.pmod(F.col("which"), F.lit(per_bar)) * (2 * math.pi / per_bar)
    return beats.withColumn("bar_sin", F.sin(angle)).withColumn("bar_cos", F.cos(angle))


def median_interval(beats: DataFrame, track: str) -> DataFrame:
    """track, interval: the median of the positive gaps between beats, else the first beat's
    duration, else half a second."""
    w = Window.partitionBy(track).orderBy("which")
    rows = beats.select(track, "which", "duration", (F.lead("start").over(w) - F.col("start")).alias("gap"))
    found = rows.groupBy(track).agg(F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("m"), F.min_by("duration", "which").alias("d"))
    return found.select(track, F.coalesce("m", F.when(F.col("d") > 0, F.col("d")), F.lit(0.5)).alias("interval"))


#: The least and greatest distance, in seconds, at which a downbeat belongs to a beat (fixed values).
NEAREST, FARTHEST, SNAP = 0.080, 0.180, 0.18


def matched_downbeats(beats: DataFrame, downbeats: DataFrame, track: str) -> DataFrame:
    """track, which: the beats that downbeats (track, start) fall on, each once.

    A downbeat inside the track takes its nearest beat, the earlier of two, if that is within
    0.3 of the median interval, held to 80 to 180 milliseconds.
    """
    last = beats.groupBy(track).agg(F.min("start").alias("_first"), F.max("start").alias("_last"), F.max_by("duration", "which").alias("_d"))
    bounds = last.join(median_interval(beats, track), track)
    limit = F.greatest(F.lit(NEAREST), F.least(F.lit(FARTHEST), 0.30 * F.col("interval")))
    bounds = bounds.select(track, "_first", (F.col("_last") + F.greatest("_d", "interval")).alias("_end"), limit.alias("_limit"))
    inside = downbeats.select(track, "start").join(bounds, track).where((F.col("start") >= F.col("_first")) & (F.col("start") <= F.col("_end")))
    return nearest_within(inside, beats.select(track, "start", "which"), track, F.col("_limit")).where("nearest is not null").select(track, F.col("nearest").alias("which")).distinct()


def bars_from_downbeats(beats: DataFrame, downbeats: DataFrame, track: str, per_bar: int = 4) -> DataFrame:
    """track, bar, start, duration, confidence: bars from one matched downbeat to the next, the
    last of ``per_bar`` beats. Tracks without a match have none."""
    w = Window.partitionBy(track).orderBy("which")
    n = F.count("*").over(Window.partitionBy(track))
    grid = beats.select(track, "which", "start", "duration", clamp(F.col("confidence"), 0.0, 1.0).alias("confidence"), n.alias("_n"))
    found = matched_downbeats(beats, downbeats, track)
    spans = found.join(grid.select(track, "which", "start", "duration", "_n"), [track, "which"])
    stop = F.coalesce(F.lead("which").over(w), F.least(F.col("_n"), F.col("which") + per_bar))
    spans = spans.select(track, "which", "start", F.col("duration").alias("_own"), "_n", stop.alias("stop"), (F.row_number().over(w) - 1).alias("bar"))
    until = F.when(F.col("stop") < F.col("_n"), F.col("stop")).otherwise(F.least(F.col("_n"), F.col("which") + per_bar) - 1)
    ends = grid.select(track, F.col("which").alias("_at"), F.col("start").alias("_s"), F.col("duration").alias("_d"))
    spans = spans.withColumn("_at", until).join(ends, [track, "_at"])
    length = F.when(F.col("stop") < F.col("_n"), F.col("_s") - F.col("start")).otherwise(F.col("_s") + F.col("_d") - F.col("start"))
    length = F.greatest(F.lit(1e-6), F.when((F.col("stop") < F.col("_n")) | (length > 0), length).otherwise(F.col("_own")))
    rows = spans.select(track, "bar", "start", length.alias("duration"), F.explode(F.sequence("which", F.greatest(F.col("stop") - 1, "which"))).alias("which"))
    rows = rows.join(grid.select(track, "which", "confidence"), [track, "which"])
    return rows.groupBy(track, "bar").agg(F.first("start").alias("start"), F.first("duration").alias("duration"), F.avg("confidence").alias("confidence"))


def snapped_downbeats(beats: DataFrame, downbeats: DataFrame, track: str, within: float = SNAP) -> DataFrame:
    """track, which, start: beats that are the nearest of a downbeat ``within`` seconds; each beat once."""
    grid = beats.select(track, "start", "which")
    found = nearest_within(downbeats.select(track, "start"), grid, track, within).where("nearest is not null").select(track, F.col("nearest").alias("which")).distinct()
    return found.join(grid, [track, "which"])


def meter(downbeats: DataFrame, track: str, default: int = 4, allowed: tuple = (3, 4, 6)) -> DataFrame:
    """track, meter: the commonest gap of two beats or more between downbeats (track, which) that is
    a meter, nearest to ``default`` on a tie, else the meter nearest to the upper median gap."""
    w = Window.partitionBy(track).orderBy("which")
    gaps = downbeats.select(track, (F.lead("which").over(w) - F.col("which")).alias("gap"))
    counts = gaps.groupBy(track, "gap").agg(F.count("*").alias("c"))
    big = F.when(F.col("gap") > 1, F.col("gap"))
    best = F.max_by(F.col("gap"), F.when(F.col("gap").isin(*allowed), F.struct("c", -F.abs(F.col("gap") - default), -F.col("gap"))))
    middle = Window.partitionBy(track).orderBy("gap")
    ranked = gaps.where("gap > 1").select(track, "gap", F.row_number().over(middle).alias("_r"), F.count("*").over(Window.partitionBy(track)).alias("_n"))
    median = ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(track, F.col("gap").alias("_m"))
    rows = counts.groupBy(track).agg(best.alias("best"), F.max(big).alias("any")).join(median, track, "left")
    near = F.array_min(F.array(*[F.struct(F.abs(F.col("_m") - x).alias("a"), F.lit(abs(x - default)).alias("b"), F.lit(x).cast("long").alias("x")) for x in sorted(allowed)]))["x"]
    return rows.select(track, F.coalesce(F.col("best").cast("long"), F.when(F.col("any").isNotNull(), near), F.lit(default).cast("long")).alias("meter"))


def sane_downbeats(beats: DataFrame, downbeats: DataFrame, track: str, within: float) -> DataFrame:
    """track, n, kept, max_distance, reason: a track's downbeats (track, place, start) stand or go
    together. ``place`` is their order. They go, for the first reason that holds, if one isn't
    finite, if they don't rise, without beats, or if one is further than ``within`` from its beat."""
    w = Window.partitionBy(track).orderBy("place")
    odd = F.isnan("start") | (F.abs("start") == float("inf")) | F.col("start").isNull()
    rows = downbeats.withColumn("_odd", odd).withColumn("_fall", F.col("start") <= F.lag("start").over(w))
    grid = beats.select(track, "start", "which")
    near = nearest_within(rows.where("not _odd"), grid, track, float("inf")).groupBy(track).agg(F.max("gap").alias("max_distance"))
    has = grid.select(track).distinct().withColumn("_has", F.lit(True))
    out = rows.groupBy(track).agg(F.count("*").alias("n"), F.max("_odd").alias("_odd"), F.max("_fall").alias("_fall")).join(has, track, "left").join(near, track, "left")
    reason = F.when(F.col("_odd"), "downbeats-not-finite").when(F.col("_fall"), "downbeats-not-strictly-increasing").when(F.col("_has").isNull(), "beats-missing").when(F.col("max_distance") > within, "downbeat-not-aligned-to-beat")
    out = out.withColumn("reason", reason)
    return out.select(track, "n", F.when(F.col("reason").isNull(), F.col("n")).otherwise(0).alias("kept"), "max_distance", "reason")


def tatums(beats: DataFrame, track: str) -> DataFrame:
    """track, which, start, duration, confidence: two halves of the way to the next beat."""
    w = Window.partitionBy(track).orderBy("which")
    gap = F.greatest(F.lit(0.0), F.coalesce(F.lead("start").over(w) - F.col("start"), F.col("duration")))
    rows = beats.withColumn("_half", F.greatest(F.lit(0.0), F.when(gap > 0, gap).otherwise(F.col("duration")) / 2))
    rows = rows.withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(track, (2 * F.col("which") + F.col("_k")).alias("which"), (F.col("start") + F.col("_k") * F.col("_half")).alias("start"), F.col("_half").alias("duration"), "confidence")


def bar_phase(beats: DataFrame, track: str, per_bar: int = 4, margin: float = 0.05) -> DataFrame:
    """track, phase, score, first_score: the beat of the bar on which downbeats fall best.

    ``beats`` has track, which, start, confidence, loudness, peak (boolean). A phase scores by
    its accent against other beats, even bars, change between phrases of four bars and nearness
    to peaks. It must beat phase 0 by ``margin``; under four bars of beats phase 0 stands.
    """
    w = Window.partitionBy(track).orderBy("which")
    accent = clamp(F.col("confidence") * 0.75 + F.greatest(F.lit(0.0), F.col("loudness")) * 0.25, 0.0, 1.0)
    gap = F.lead("start", per_bar).over(w) - F.col("start")
    rows = beats.select(
        track, accent.alias("accent"), (F.col("which") % per_bar).alias("phase"), F.floor(F.col("which") / (4 * per_bar)).alias("phrase"),
        F.when(gap > 0, gap).alias("gap"), F.max("peak").over(w.rowsBetween(-1, 1)).alias("near"), "peak",
    )
    own = rows.groupBy(track, "phase").agg(F.count("*").alias("n"), F.sum("accent").alias("s"), F.stddev_pop("gap").alias("sd"), F.avg("gap").alias("gap"), F.count_if("near").alias("hits"), F.max("peak").alias("peak"))
    phrases = rows.groupBy(track, "phase", "phrase").agg(F.count("*").alias("_n"), F.avg("accent").alias("a")).where("_n = 4")
    change = F.abs(F.col("a") - F.lag("a").over(Window.partitionBy(track, "phase").orderBy("phrase")))
    changes = phrases.withColumn("change", change).groupBy(track, "phase").agg(F.avg("change").alias("change"))
    whole = Window.partitionBy(track)
    rest = F.sum("n").over(whole) - F.col("n")
    others = F.when(rest > 0, (F.sum("s").over(whole) - F.col("s")) / rest).otherwise(0.0)
    scored = own.join(changes, [track, "phase"], "left")
    downbeat = clamp(0.5 + F.col("s") / F.col("n") - others, 0.0, 1.0)
    regular = F.when((F.col("n") < 3) | F.col("gap").isNull(), 0.0).otherwise(clamp(1 - F.col("sd") / F.greatest(F.lit(1e-6), F.col("gap")) / 0.08, 0.0, 1.0))
    steady = F.when((F.col("n") < 8) | F.col("change").isNull(), 0.5).otherwise(clamp(0.5 + F.col("change"), 0.0, 1.0))
    boundary = F.when(F.max("peak").over(whole), clamp(2 * F.col("hits") / F.col("n"), 0.0, 1.0)).otherwise(0.5)
    scored = scored.select(track, "phase", "n", (0.35 * downbeat + 0.20 * regular + 0.20 * steady + 0.25 * boundary).alias("score"))
    best = scored.groupBy(track).agg(F.sum("n").alias("_n"), F.max(F.struct("score", (-F.col("phase")).alias("p"))).alias("b"), F.max(F.when(F.col("phase") == 0, F.col("score"))).alias("first_score"))
    switch = (F.col("_n") >= 4 * per_bar) & (F.col("b.score") >= F.col("first_score") + margin)
    return best.select(track, F.when(switch, -F.col("b.p")).otherwise(F.lit(0)).alias("phase"), F.when(switch, F.col("b.score")).otherwise(F.col("first_score")).alias("score"), "first_score")


def sections(bars: DataFrame, durations: DataFrame, track: str, per_section: int = 8, long_per_section: int = 16, long_track: float = 240.0, least_track: float = 60.0, shortest: float = 8.0, most: int = 16) -> DataFrame:
    """track, which, start, duration: sections of a fixed number of bars, ``most`` at most.

    ``bars`` has track, bar, start; ``durations`` track, duration. A section under ``shortest``
    goes unless it is the last; the last one kept reaches to the track's end. Short tracks and
    tracks with fewer than two sections are one whole section.
    """
    sized = durations.where("duration > 0").join(bars.groupBy(track).agg(F.count("*").alias("_bars")), track, "left")
    step = F.when(F.col("duration") >= long_track, long_per_section).otherwise(per_section)
    cut = (F.col("duration") > least_track) & (F.col("_bars") >= 2 * per_section)
    sized = sized.select(track, F.col("duration").alias("_whole"), step.alias("_step"), F.coalesce(cut, F.lit(False)).alias("_cut"))
    w = Window.partitionBy(track).orderBy("bar")
    firsts = bars.join(sized.where("_cut"), track).where(F.col("bar") % F.col("_step") == 0).select(track, "bar", "start", "_whole", F.lead("start").over(w).alias("_next"))
    length = F.greatest(F.lit(0.0), F.coalesce("_next", "_whole") - F.col("start"))
    kept = firsts.withColumn("duration", length).where((F.col("duration") >= shortest) | F.col("_next").isNull())
    kept = kept.withColumn("which", F.row_number().over(w) - 1).where(F.col("which") < most).withColumn("_n", F.count("*").over(Window.partitionBy(track))).where("_n >= 2")
    reach = F.when((F.col("which") == F.col("_n") - 1) & (F.col("start") + F.col("duration") < F.col("_whole")), F.col("_whole") - F.col("start")).otherwise(F.col("duration"))
    kept = kept.select(track, "which", "start", reach.alias("duration"))
    single = sized.join(kept.select(track).distinct(), track, "left_anti").select(track, F.lit(0).alias("which"), F.lit(0.0).alias("start"), F.col("_whole").alias("duration"))
    return kept.unionByName(single)


def half_time(scores: DataFrame, track: str, rows_per_second: float, ratio: float = 0.60) -> DataFrame:
    """track, lag, bpm, halved: the lag of greatest score, or twice it where a tempo of 170 or
    more has a half in 75 to 135 bpm that scores near it. ``scores`` has track, lag, score."""
    best = scores.groupBy(track).agg(F.max(F.struct("score", (-F.col("lag")).alias("m"))).alias("b")).select(track, (-F.col("b.m")).alias("lag"), F.col("b.score").alias("score"))
    slower = scores.select(F.col(track).alias("_t"), F.col("lag").alias("_slow"), F.col("score").alias("_score"))
    rows = best.join(slower, (F.col(track) == F.col("_t")) & (F.col("_slow") == 2 * F.col("lag")), "left").drop("_t")
    bpm, slow = 60.0 * rows_per_second / F.col("lag"), 60.0 * rows_per_second / F.col("_slow")
    needed = F.when(slow.between(90.0, 120.0), min(0.45, ratio)).otherwise(ratio)
    halved = F.coalesce((bpm >= 170.0) & slow.between(75.0, 135.0) & (F.col("_score") >= F.col("score") * needed), F.lit(False))
    rows = rows.withColumn("halved", halved).withColumn("lag", F.when(F.col("halved"), F.col("_slow")).otherwise(F.col("lag")))
    return rows.select(track, "lag", (60.0 * rows_per_second / F.col("lag")).alias("bpm"), "halved")


#: Origin, role and ratio of the tempi made from a candidate, which keeps its own origin.
HARMONICS = [(None, "primary", 1.0), ("half-time", "half", 0.5), ("double-time", "double", 2.0), ("three-quarter", "three-quarter", 0.75), ("four-third", "four-third", 4.0 / 3.0)]


def harmonic_tempos(candidates: DataFrame, track: str, top: int, low: float = 60.0, high: float = 200.0) -> DataFrame:
    """track, rank, bpm, lag, score, origin, harmonic: candidates and their halves, doubles, 3/4 and 4/3.

    A harmonic in ``low`` to ``high`` scores 0.92 of its source; of equal tempos, to three
    places, the best stays; of equal scores the candidates come first, autocorrelations by lag before others, and
    what is made of them in that order. ``candidates`` has track, bpm, lag, score and, if not all are autocorrelation, origin.
    """
    made, given = [], F.col("origin") if "origin" in candidates.columns else F.lit("autocorrelation")
    source = [(given != "autocorrelation").alias("_late"), F.col("lag").alias("_from")]
    for k, (name, role, ratio) in enumerate(HARMONICS):
        bpm = F.col("bpm") * ratio
        lag = F.col("lag") if k == 0 else F.when(F.col("lag") > 0, F.greatest(F.lit(1), F.bround(F.col("lag") * F.col("bpm") / bpm))).otherwise(0)
        origin = F.lit(name) if name else given
        made.append(candidates.select(track, bpm.alias("bpm"), lag.cast("long").alias("lag"), (F.col("score") * (1.0 if k == 0 else 0.92)).alias("score"), origin.alias("origin"), F.lit(role).alias("harmonic"), F.lit(k).alias("_k"), *source).where((F.lit(k) == 0) | F.col("bpm").between(low, high)))
    rows = reduce(DataFrame.unionByName, made)
    order = [F.desc("score"), F.col("_k") > 0, F.col("_late"), F.col("_from"), F.col("_k")]
    same = Window.partitionBy(track, F.bround("bpm", 3)).orderBy(*order)
    rows = rows.withColumn("_same", F.row_number().over(same)).where("_same = 1")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(track).orderBy(*order))).where(F.col("rank") <= top).select(track, "rank", "bpm", "lag", "score", "origin", "harmonic")
