"""Window operators over ordered series: one row per (track, which)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.operators.ranks import quantiles


def navigation(df: DataFrame, track: str, order: list[str], start: str, fallback: float = 0.5) -> DataFrame:
    """Adds which, prev, next and duration: the gap to the next row, else from the one
    before, else ``fallback``; gaps that aren't positive don't count."""
    w = Window.partitionBy(track).orderBy(*order)
    gap = F.lead(start).over(w) - F.col(start)
    back = F.col(start) - F.lag(start).over(w)
    which = (F.row_number().over(w) - 1).cast("long")
    return df.select(
        "*", which.alias("which"), F.when(which > 0, which - 1).alias("prev"),
        F.when(F.lead(start).over(w).isNotNull(), which + 1).alias("next"),
        F.coalesce(F.when(gap > 0, gap), F.when(back > 0, back), F.lit(fallback)).alias("duration"),
    )


def around(track: str, order: str, r: int):
    return Window.partitionBy(track).orderBy(order).rowsBetween(-r, r)


def moving_average(df: DataFrame, track: str, order: str, x: str, r: int, out: str) -> DataFrame:
    """Mean over r rows to either side; the window shrinks at the ends."""
    return df.withColumn(out, F.avg(x).over(around(track, order, r)))


def onset_detection(df: DataFrame, track: str, order: str, x: str, width: int = 7, out: str = "odf") -> DataFrame:
    """Clamps at 0, takes a wide moving average (radius 2 * width) off, clamps, smooths
    (radius width // 2) and divides by the track's maximum."""
    rows = df.withColumn("_a", F.greatest(F.col(x), F.lit(0.0)))
    rows = rows.withColumn("_b", F.greatest(F.col("_a") - F.avg("_a").over(around(track, order, 2 * width)), F.lit(0.0)))
    rows = rows.withColumn("_c", F.avg("_b").over(around(track, order, width // 2)))
    top = F.max("_c").over(Window.partitionBy(track))
    return rows.withColumn(out, F.when(top > 0, F.col("_c") / top).otherwise(F.lit(0.0))).drop("_a", "_b", "_c")


def local_peaks(df: DataFrame, track: str, order: str, x: str, threshold: float = 0.0) -> DataFrame:
    """Inner rows with x >= the row before, x > the row after and x >= threshold."""
    w = Window.partitionBy(track).orderBy(order)
    rows = df.withColumn("_p", F.lag(x).over(w)).withColumn("_n", F.lead(x).over(w))
    return rows.where((F.col(x) >= F.col("_p")) & (F.col(x) > F.col("_n")) & (F.col(x) >= threshold)).drop("_p", "_n")


def candidate_peaks(df: DataFrame, track: str, order: str, x: str, share: float = 0.15, energy: float = 1e-9) -> DataFrame:
    """Local peaks that reach ``share`` of the track's maximum; the last row counts if it rises
    above the one before, a single row always. Tracks without ``energy`` have none."""
    w = Window.partitionBy(track).orderBy(order)
    top, n = F.max(x).over(Window.partitionBy(track)), F.count("*").over(Window.partitionBy(track))
    rows = df.withColumns({"_p": F.lag(x).over(w), "_n": F.lead(x).over(w), "_top": top, "_k": n})
    inner = (F.col(x) >= F.col("_p")) & (F.col(x) > F.col("_n"))
    last = F.col("_n").isNull() & (F.col(x) > F.col("_p"))
    held = (F.col("_top") > energy) & (F.col(x) >= share * F.col("_top")) & (inner | last | (F.col("_k") == 1))
    return rows.where(held).drop("_p", "_n", "_top", "_k")


def plateau_peaks(df: DataFrame, track: str, order: str, x: str, threshold: float | None = None) -> DataFrame:
    """Rows not below either neighbour, the ends having one neighbour, nor ``threshold``."""
    w = Window.partitionBy(track).orderBy(order)
    low = F.lit(float("-inf"))
    rows = df.withColumn("_m", F.greatest(F.coalesce(F.lag(x).over(w), low), F.coalesce(F.lead(x).over(w), low)))
    return rows.where((F.col(x) >= F.col("_m")) & (F.lit(True) if threshold is None else F.col(x) >= threshold)).drop("_m")


def refined_period(df: DataFrame, track: str, order: str, x: str, lag: float | str, energy: float = 1e-9) -> DataFrame:
    """track, period: the mean distance of peaks of half the maximum, of those within 0.75 to 1.5
    of ``lag``, a number or a column with the track's own; null with fewer than three peaks or none in range."""
    lag = F.col(lag) if isinstance(lag, str) else F.lit(lag)
    w = Window.partitionBy(track).orderBy(order)
    low = F.lit(float("-inf"))
    rows = df.withColumns({"_p": F.coalesce(F.lag(x).over(w), low), "_n": F.coalesce(F.lead(x).over(w), low), "_top": F.max(x).over(Window.partitionBy(track))})
    peak = (F.col("_top") > energy) & (F.col(x) >= 0.5 * F.col("_top")) & (F.col(x) >= F.col("_p")) & (F.col(x) > F.col("_n"))
    held = rows.where(peak).select(track, (F.col(order) - F.lag(order).over(w)).alias("_g"), lag.alias("_lag"))
    found = held.groupBy(track).agg(F.count("*").alias("_k"), F.avg(F.when(F.col("_g").between(0.75 * F.col("_lag"), 1.5 * F.col("_lag")), F.col("_g"))).alias("_m"))
    return df.select(track).distinct().join(found, track, "left").select(track, F.when(F.col("_k") >= 3, F.col("_m")).alias("period"))


def frame_times(beats: DataFrame, frames: DataFrame, durations: DataFrame, track: str, x: str, hop: float, energy: float = 1e-9) -> DataFrame:
    """track, frame, time, confidence of distinct beat frames (track, frame) inside the track: the
    maximum of ``x`` over two frames to either side, over the track's maximum."""
    local = F.max(x).over(Window.partitionBy(track).orderBy("frame").rangeBetween(-2, 2))
    top = F.greatest(F.lit(energy), F.max(x).over(Window.partitionBy(track)))
    strength = frames.select(track, "frame", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), local) / top)).alias("confidence"))
    rows = beats.select(track, "frame").distinct().withColumn("time", F.col("frame") * hop).join(durations.select(track, F.col("duration").alias("_d")), track)
    rows = rows.where((F.col("time") >= 0) & (F.col("time") <= F.col("_d"))).join(strength, [track, "frame"], "left")
    return rows.select(track, "frame", "time", F.coalesce("confidence", F.lit(FALLBACK_CONFIDENCE)).alias("confidence"))


#: Tempo and confidence of a grid without evidence (fixed values).
FALLBACK_BPM, FALLBACK_CONFIDENCE = 120.0, 0.35


def regular_grid(durations: DataFrame, track: str, bpm: float = FALLBACK_BPM) -> DataFrame:
    """track, which, start, confidence: beats at an even tempo from 0 to the track's duration."""
    step = 60.0 / bpm
    rows = durations.where("duration > 0").select(track, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("duration") / step))).alias("which"))
    return rows.select(track, "which", (F.col("which") * step).alias("start"), F.lit(FALLBACK_CONFIDENCE).alias("confidence"))


def window_peaks(df: DataFrame, track: str, order: str, x: str, r: int = 3, p: float = 0.75) -> DataFrame:
    """Rows that are the maximum of r rows to either side and reach the track's p-quantile."""
    limits = quantiles(df, [track], x, {"_limit": p})
    rows = df.withColumn("_m", F.max(x).over(around(track, order, r))).join(limits, track)
    return rows.where((F.col(x) == F.col("_m")) & (F.col(x) >= F.col("_limit"))).drop("_m", "_limit")


def windowed_median(df: DataFrame, track: str, order: str, x: str, r: int, out: str) -> DataFrame:
    """True median over r rows to either side."""
    held = F.sort_array(F.collect_list(x).over(around(track, order, r)))
    n = F.size(held)
    at = lambda k: F.element_at(held, k.cast("int"))
    return df.withColumn(out, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def exploded(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return df.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))


def zscore(df: DataFrame, group: list[str], x: str, floor: float = 1e-4) -> Column:
    """x less its group's mean over its population deviation, held to ``floor`` at least."""
    w = Window.partitionBy(*group)
    return (F.col(x) - F.avg(x).over(w)) / F.greatest(F.stddev_pop(x).over(w), F.lit(floor))


def min_max(track: str, x: str) -> Column:
    w = Window.partitionBy(track)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high > low, (F.col(x) - low) / (high - low)).otherwise(F.lit(0.0))


def frame_novelty(df: DataFrame, track: str, order: str, vector: str, extras: dict | None = None, r: int = 2) -> DataFrame:
    """RMS distance of each z-scored vector to the one before, plus weighted extra columns,
    smoothed over r rows to either side: columns track, order, novelty."""
    dims = exploded(df, [track, order], vector)
    dims = dims.withColumn("z", zscore(dims, [track, "dim"], "x"))
    w = Window.partitionBy(track, "dim").orderBy(order)
    step = F.pow(F.col("z") - F.lag("z").over(w), F.lit(2.0))
    raw = dims.withColumn("d", step).groupBy(track, order).agg(F.sqrt(F.coalesce(F.avg("d"), F.lit(0.0))).alias("raw"))
    if extras:
        raw = raw.join(df.select(track, order, *extras), [track, order])
        for name, weight in extras.items():
            raw = raw.withColumn("raw", F.col("raw") + weight * F.coalesce(F.col(name), F.lit(0.0)))
    return raw.select(track, order, F.avg("raw").over(around(track, order, r)).alias("novelty"))


def autocorrelation(df: DataFrame, track: str, order: str, x: str, low: int, high: int) -> DataFrame:
    """Mean product of a series with itself ``lag`` rows later, for each lag: track, lag, r, n.

    Rows lie at whole numbers of ``order``; a row's partner is at order + lag."""
    a = df.select(track, F.col(order).alias("_o"), F.col(x).alias("_x"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("lag"))
    b = df.select(F.col(track).alias("_t"), F.col(order).alias("_p"), F.col(x).alias("_y"))
    pairs = a.join(b, (F.col(track) == F.col("_t")) & (F.col("_o") + F.col("lag") == F.col("_p")))
    return pairs.groupBy(track, "lag").agg(F.avg(F.col("_x") * F.col("_y")).alias("r"), F.count("*").alias("n"))


def tempo_weight(lag: Column, rows_per_second: float, centre: float = 120.0, octaves: float = 1.0) -> Column:
    """Log-Gaussian prior of the tempo that a lag stands for."""
    bpm = 60.0 * rows_per_second / lag
    return F.exp(-0.5 * F.pow(F.log2(bpm / centre) / octaves, F.lit(2.0)))


def hopping_windows(df: DataFrame, track: str, which: str, size: int = 32, hop: int = 16, least: int = 12) -> DataFrame:
    """Each row once for every window of ``size`` rows that starts at a multiple of ``hop``
    and has ``least`` rows; adds window."""
    n = F.count("*").over(Window.partitionBy(track))
    first = F.greatest(F.lit(0), F.floor((F.col(which) - size) / hop) + 1)
    rows = df.withColumn("_n", n).withColumn("window", F.explode(F.sequence(first.cast("int"), F.floor(F.col(which) / hop).cast("int"))))
    return rows.where(F.col("window") * hop + least <= F.col("_n")).drop("_n")
