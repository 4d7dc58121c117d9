"""Acoustic segments: boundaries from a track's novelty, and the segments between them.

Boundaries depend on each other, so a track's novelty is folded in one task (minutes of audio,
some ten thousand numbers); segments are then aggregated from frames by Spark.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a segment and segments per second (fixed values).
TARGET, SHORTEST, LONGEST = 0.22, 0.09, 0.70
FEWEST, MOST, DENSEST = 3.0, 7.5, 8.0
#: Frames of an onset of this much count as active; novelty flatter than FLAT has no boundaries.
ACTIVE, FLAT = 0.25, 1e-8


def peaks(x: np.ndarray, least: float) -> np.ndarray:
    """Inner places not below ``least`` nor the one before, and above the one after."""
    return 1 + np.flatnonzero((x[1:-1] >= least) & (x[1:-1] >= x[:-2]) & (x[1:-1] > x[2:]))


def insert_apart(held: list[int], found: np.ndarray, gap: int, most: int | None = None) -> None:
    """Puts each place, in the order given, into the sorted ``held`` if both neighbours are
    ``gap`` away, until it has ``most``."""
    for place in found.tolist():
        if most is not None and len(held) >= most:
            return
        at = bisect_left(held, place)
        if place - held[at - 1] >= gap and held[at] - place >= gap:
            held.insert(at, place)


def split_long(held: list[int], x: np.ndarray, least: float, longest: int, gap: int) -> None:
    """Cuts stretches over ``longest`` at their greatest value, ``gap`` off the ends, as long as that
    is ``least`` or more. A cut concerns its own stretch only, so stretches are done one by one."""
    todo = list(zip(held[:-1], held[1:], strict=True))
    while todo:
        start, stop = todo.pop()
        low, high = start + gap, min(stop - gap, len(x) - 1)
        if stop - start > longest and high > low:
            best = low + int(x[low : high + 1].argmax())
            if x[best] >= least:
                insort(held, best)
                todo += [(start, best), (best, stop)]


def target_density(x: np.ndarray, onset: np.ndarray) -> float:
    """Segments per second to aim at: more with active frames and with varied novelty."""
    active = float((onset >= ACTIVE).mean()) if len(onset) else 0.0
    return float(np.clip(4.0 + 2.2 * active + 0.35 * np.clip(x.std(), 0.0, 2.0), FEWEST, MOST))


def sweep(x: np.ndarray, onset: np.ndarray, hop: float) -> tuple[list[int], float, int]:
    """The boundaries of a novelty curve, the density aimed at and the candidates found.

    Thresholds fall from mean + 1.4 deviations to mean + 0.2; the first whose boundaries have
    about the density is taken, else the one nearest in number, filled up to it by novelty.
    (Thinning out boundaries that are too dense changes nothing: any that could go is kept apart.)
    """
    n, aim = len(x), target_density(x, onset)
    long = n * hop
    fewest = int(np.ceil(long * max(FEWEST, aim - 1.2)))
    most = max(fewest, int(np.floor(long * min(MOST, aim + 1.2))))
    target = int(np.clip(np.rint(long * aim), fewest, most))
    gap = max(1, int(np.rint(SHORTEST / hop)))
    longest = max(gap + 1, int(np.rint(LONGEST / hop)))
    mean, deviation, best, multiplier = x.mean(), np.sqrt(((x - x.mean()) ** 2).mean()), None, 1.4
    while multiplier >= 0.2:
        least = mean + multiplier * deviation
        found = peaks(x, least)
        held = [0, n]
        insert_apart(held, found[np.argsort(-x[found], kind="stable")], gap)
        split_long(held, x, least, longest, gap)
        density = (len(held) - 1) / max(hop, long)
        if max(FEWEST, aim - 0.35) <= density <= min(MOST, aim + 0.75):
            return held, aim, len(found)
        if best is None or abs(len(held) - 1 - target) < abs(len(best) - 1 - target):
            best = held
        multiplier -= 0.1
    inner = np.setdiff1d(np.arange(1, n - 1), best)
    wanted = max(int(np.ceil(long * max(FEWEST, aim - 0.35))) + 1, min(most + 1, target + 1))
    insert_apart(best, inner[np.argsort(-x[inner], kind="stable")], gap, wanted + 1)
    return best, aim, len(peaks(x, mean))


def snapped(x: np.ndarray, hop: float) -> list[int]:
    """Even boundaries, each moved to the greatest value near it, between its neighbours."""
    step = max(1, int(np.rint(TARGET / hop)))
    held = list(range(0, len(x), step))
    held += [len(x)] if held[-1] != len(x) else []
    near = max(1, int(np.rint(TARGET / hop * 0.35)))
    for k in range(1, len(held) - 1):
        low, high = max(held[k - 1] + 1, held[k] - near), min(held[k + 1] - 1, held[k] + near)
        if high > low:
            held[k] = low + int(x[low : high + 1].argmax())
    return sorted(set(held))


def novelty_boundaries(frames: DataFrame, track: str, hop: float) -> DataFrame:
    """track, mode, density, candidates, boundaries of frames (track, frame, novelty, onset).

    Boundaries begin with 0 and end with the number of frames; a track of under three frames or
    with flat novelty has none, and mode 'temporal-fallback'.
    """

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        x, onset = pdf["novelty"].to_numpy(float), pdf["onset"].to_numpy(float)
        if len(x) < 3 or ((x - x.mean()) ** 2).mean() < FLAT:
            row = (key[0], "temporal-fallback", None, 0, [])
        else:
            held, aim, found = sweep(x, onset, hop)
            row = (key[0], "novelty", aim, found, held)
        return pd.DataFrame([row], columns=["k", "mode", "density", "candidates", "boundaries"])

    kind = frames.schema[track].dataType.simpleString()
    out = frames.select(track, "frame", "novelty", "onset").groupBy(track).applyInPandas(fold, f"k {kind}, mode string, density double, candidates long, boundaries array<long>")
    return out.withColumnRenamed("k", track)


def temporal_boundaries(frames: DataFrame, track: str, hop: float, frame_seconds: float) -> DataFrame:
    """track, boundaries at even steps: every frame while frames are few, else TARGET seconds."""
    n = frames.groupBy(track).agg(F.count("*").alias("n"))
    covered = F.greatest(F.lit(frame_seconds), (F.col("n") - 1) * hop + frame_seconds)
    step = F.when(F.col("n") / covered <= DENSEST, 1).otherwise(max(1, int(np.rint(TARGET / hop))))
    return n.select(track, F.concat(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step.cast("long")), F.array("n")).alias("boundaries"))


def segments(frames: DataFrame, boundaries: DataFrame, track: str, hop: float, frame_seconds: float) -> DataFrame:
    """The segments between ``boundaries`` (track, boundaries) of frames (track, frame, rms, timbre,
    pitches, novelty): track, segment, first, stop, start, duration, confidence, loudness_start,
    loudness_max, loudness_max_time, timbre, pitches.

    Vectors are means in which values that aren't finite count as 0; pitches are divided by
    their maximum. The confidence is the boundary's novelty between the track's least and
    greatest, 0.5 for the first segment.
    """
    spans = boundaries.select(track, F.posexplode(F.slice("boundaries", 1, F.greatest(F.size("boundaries") - 1, F.lit(0)))).alias("segment", "first"))
    own = Window.partitionBy(track).orderBy("frame")
    rows = frames.join(spans.withColumnRenamed("first", "frame"), [track, "frame"], "left")
    rows = rows.withColumn("segment", F.last("segment", ignorenulls=True).over(own)).where("segment is not null")
    low, high = (f("novelty").over(Window.partitionBy(track)) for f in (F.min, F.max))
    rows = rows.withColumn("_c", F.when(high > low, (F.col("novelty") - low) / (high - low)).otherwise(0.0))
    whole = rows.groupBy(track, "segment").agg(
        F.min("frame").alias("first"), (F.max("frame") + 1).alias("stop"), F.min_by("_c", "frame").alias("_c"), F.min_by("rms", "frame").alias("loudness_start"),
        F.max("rms").alias("loudness_max"), F.max(F.struct("rms", (-F.col("frame")).alias("f"))).alias("_top"),
    )
    start = F.col("first") * hop
    whole = whole.select(
        track, "segment", "first", "stop", start.alias("start"), F.greatest(F.lit(0.0), (F.col("stop") - 1) * hop + frame_seconds - start).alias("duration"),
        F.when(F.col("segment") == 0, 0.5).otherwise(F.col("_c")).alias("confidence"), "loudness_start", "loudness_max", F.greatest(F.lit(0.0), -F.col("_top.f") * hop - start).alias("loudness_max_time"),
    )
    for name in ("timbre", "pitches"):
        whole = whole.join(vector_means(rows, [track, "segment"], name), [track, "segment"], "left")
    top = F.array_max("pitches")
    return whole.withColumn("pitches", F.when(top > 0, F.transform("pitches", lambda x: x / top)).otherwise(F.col("pitches")))


def vector_means(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys and the mean of ``vector`` over their rows; what isn't finite counts as 0."""
    dims = rows.select(*keys, F.posexplode(vector).alias("_d", "_x"))
    finite = F.when(F.isnan("_x") | (F.abs("_x") == float("inf")), 0.0).otherwise(F.coalesce("_x", F.lit(0.0)))
    means = dims.groupBy(*keys, "_d").agg(F.avg(finite).alias("_m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_m"))), lambda x: x["_m"]).alias(vector))


def boundary_ratio(frames: DataFrame, boundaries: DataFrame, track: str) -> DataFrame:
    """track, ratio: the mean novelty of inner boundaries over that of the other inner frames;
    0 where there are none or no novelty outside."""
    marks = boundaries.select(track, F.explode("boundaries").alias("frame"), F.lit(True).alias("_b"))
    rows = frames.join(marks, [track, "frame"], "left").withColumn("_n", F.count("*").over(Window.partitionBy(track)))
    inner = (F.col("frame") > 0) & (F.col("frame") < F.col("_n") - 1)
    means = rows.groupBy(track).agg(F.avg(F.when(F.col("_b") & (F.col("frame") > 0), F.col("novelty"))).alias("_in"), F.avg(F.when(inner & F.col("_b").isNull(), F.col("novelty"))).alias("_out"))
    return means.select(track, F.when((F.col("_out") > 0) & F.col("_in").isNotNull(), F.col("_in") / F.col("_out")).otherwise(0.0).alias("ratio"))


def bar_vectors(beats: DataFrame, track: str, vector: str, per_bar: int = 4) -> DataFrame:
    """track, bar, vector: the mean of every ``per_bar`` beats' vectors."""
    return vector_means(beats.withColumn("bar", F.floor(F.col("which") / per_bar)), [track, "bar"], vector)


#: Scales in bars, the threshold in deviations, and the bonuses of bars on a phrase (fixed values).
SCALES, OVER, BONUS = (3, 5, 8), 0.12, (0.10, 0.05)


def smoothed(x: np.ndarray, width: int) -> np.ndarray:
    """The mean over ``width`` places, of those that exist."""
    if width < 2 or not len(x):
        return x
    ones = np.ones(2 * (width // 2) + 1)
    return np.convolve(x, ones)[width // 2 :][: len(x)] / np.convolve(np.ones(len(x)), ones)[width // 2 :][: len(x)]


def bar_novelty(vectors: np.ndarray) -> np.ndarray:
    """A checkerboard with a Gaussian taper along the diagonal of the bars' cosine similarities."""
    z = (vectors - vectors.mean(axis=0)) / np.maximum(1e-4, vectors.std(axis=0))
    norm = np.linalg.norm(z, axis=1)
    unit = z / np.where(norm > 0, norm, 1.0)[:, None]
    n, r = len(z), int(np.clip(len(z) // 12, 2, 4))
    at = np.arange(-r, r + 1)
    side = np.where(at > 0, 1.0, -1.0)
    sigma = max(1.0, r / 2.0)
    kernel = np.outer(side, side) * np.exp(-(at[:, None] ** 2 + at**2) / (2.0 * sigma * sigma))
    out = np.zeros(n)
    for k in range(r, n - r):
        near = unit[k - r : k + r + 1]
        out[k] = max(0.0, float((kernel * (near @ near.T)).sum()))
    return smoothed(out, 3)


def section_boundaries(novelty: np.ndarray, starts: np.ndarray, duration: float) -> tuple[list[int], int]:
    """The bars at which sections begin, with 0 and the number of bars, and how many candidates
    there were: peaks at any of SCALES, the best first, apart by about a 36th of the track."""
    n, score = len(starts), {}
    low = min(8.0, duration * 0.08)
    high, least = max(low, duration - 4.0), novelty.mean() + OVER * novelty.std()
    for scale in SCALES:
        x = smoothed(novelty, max(3, scale | 1))
        for bar in peaks(x, least).tolist():
            if bar < n - 1 and low <= starts[bar] <= high:
                bonus = BONUS[0] if bar % 4 == 0 else BONUS[1] if bar % 2 == 0 else 0.0
                score[bar] = max(score.get(bar, -1.0), x[bar] + bonus)
    held, gap = [0, n], float(np.clip(duration / 36.0, 6.0, 11.0))
    most = int(np.clip(np.rint(duration / 28.0) + 2, 4, 10))
    time = lambda bar: starts[bar] if bar < n else duration
    for bar in sorted(score, key=lambda b: -score[b]):
        if len(held) - 1 >= most:
            break
        k, now = bisect_left(held, bar), starts[bar]
        edge = now <= 12.0 or duration - now <= 12.0
        if held[k] != bar and (edge or (now - time(held[k - 1]) >= gap and time(held[k]) - now >= gap)):
            held.insert(k, bar)
    return held, len(score)


def structural_sections(bars: DataFrame, durations: DataFrame, track: str, least_bars: int = 16, least_seconds: float = 60.0) -> DataFrame:
    """track, which, bar, start, duration, confidence, candidates: sections that begin where bars
    change. ``bars`` has track, bar, start, vector; ``durations`` track, duration.

    Tracks that are too short, flat or give fewer than a section in 45 seconds (three at least)
    have no rows: their sections are the fixed ones.
    """

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rows, long = pdf.sort_values("bar"), [], float(pdf["_whole"].iloc[0])
        if long > least_seconds and len(pdf) >= least_bars:
            novelty, starts = bar_novelty(np.stack(pdf["vector"])), pdf["start"].to_numpy(float)
            if ((novelty - novelty.mean()) ** 2).mean() >= FLAT:
                held, found = section_boundaries(novelty, starts, long)
                low, high = novelty.min(), novelty.max()
                if len(held) - 1 >= max(3, int(np.ceil(long / 45.0))):
                    for k, (a, b) in enumerate(zip(held[:-1], held[1:], strict=True)):
                        end = starts[b] if b < len(starts) else long
                        rows.append((key[0], k, a, starts[a], max(1e-6, end - starts[a]), 1.0 if k == 0 else float(np.clip((novelty[a] - low) / (high - low), 0, 1)), found))
        return pd.DataFrame(rows, columns=["k", "which", "bar", "start", "duration", "confidence", "candidates"])

    kind = bars.schema[track].dataType.simpleString()
    own = bars.select(track, "bar", "start", "vector").join(durations.select(track, F.col("duration").alias("_whole")), track)
    return own.groupBy(track).applyInPandas(fold, f"k {kind}, which long, bar long, start double, duration double, confidence double, candidates long").withColumnRenamed("k", track)


def section_novelty(bars: DataFrame, durations: DataFrame, track: str) -> DataFrame:
    """track, candidates, selected, mean, max: what a track's bar novelty offers for sections."""

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar")
        x = bar_novelty(np.stack(pdf["vector"]))
        held, found = section_boundaries(x, pdf["start"].to_numpy(float), float(pdf["_whole"].iloc[0])) if len(pdf) >= 3 else ([], 0)
        return pd.DataFrame([(key[0], found, max(0, len(held) - 2), float(x.mean()), float(x.max()))], columns=["k", "candidates", "selected", "mean", "max"])

    kind = bars.schema[track].dataType.simpleString()
    own = bars.select(track, "bar", "start", "vector").join(durations.select(track, F.col("duration").alias("_whole")), track)
    return own.groupBy(track).applyInPandas(fold, f"k {kind}, candidates long, selected long, mean double, max double").withColumnRenamed("k", track)


def enriched_sections(sections: DataFrame, beats: DataFrame, track: str) -> DataFrame:
    """``sections`` (track, which, start, duration) with confidence and loudness of the beats that
    start inside: the mean confidence between the track's least and greatest, the mean loudness.

    Beats come to their section by one window over both, sections being in order and disjoint.
    """
    from strophe.operators.joins import containment

    spans = sections.select(track, "start", (F.col("start") + F.col("duration")).alias("end"), "which")
    inside = containment(beats.select(track, "start", "which", "confidence", "loudness"), spans, track).where("parent is not null")
    means = inside.groupBy(track, F.col("parent").alias("which")).agg(F.avg("confidence").alias("_s"), F.avg("loudness").alias("loudness"))
    rows = sections.drop("confidence", "loudness").join(means, [track, "which"], "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    low, high = (f("_s").over(Window.partitionBy(track)) for f in (F.min, F.max))
    share: Column = F.when(high > low, (F.col("_s") - low) / (high - low)).otherwise(0.0)
    return rows.withColumn("confidence", share).withColumn("loudness", F.coalesce("loudness", F.lit(0.0))).drop("_s")
