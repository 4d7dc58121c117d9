"""Two beat grids of a track compared: offsets between them, their trust, windows to correct.

Grids are rows of track and start, in seconds. A grid's starts come together in one row per
window or track, which a track's length bounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strophe.functions.columns import clamp
from strophe.operators import corrections
from strophe.operators.folds import claim
from strophe.operators.timeline import hopping_windows

OFFSETS = [float(x) for x in range(-250, 251, 5)]
TOLERANCE_MS = 70.0
FOUND = ["zero_f1", "offset_ms", "best_f1"]

#: What a weak window's reason, readiness, strength and risk, and the levels of trust are called.
REASONS = ["LegacyTempoInstability", "LegacySparseOrDenseBeats", "AdvisorMoreStableIntervals", "AdvisorStrongerLocalAgreement", "CandidateDisagreement", "InsufficientEvidence", "PhaseAlignmentUnstable"]
READINESS = ["Blocked", "CandidateForExperimentalCorrection", "CandidateForReview", "DiagnosticOnly", "None"]
STRENGTHS = {"VeryStrong": 0.90, "Strong": 0.75, "Moderate": 0.50, "Weak": 0.0}
RISKS = ["Low", "Medium", "High", "Blocked"]
LEVELS = ["None", "Low", "Medium", "High", "VeryHigh"]
#: F1 and score that a level of agreement takes.
LEAST_F1 = {"VeryHigh": 0.93, "High": 0.85, "Medium": 0.65, "Low": 0.40}
LEAST_SCORE = {"VeryHigh": 0.90, "High": 0.80, "Medium": 0.60, "Low": 0.35}
#: A weak window's limits by profile: least weakness, strength and readiness, F1 of an agreement, greatest change of count.
WINDOW_PROFILES = {
    "strict-production": {"weakness": 0.55, "strength": 0.60, "readiness": 0.72, "f1": 0.70, "count": 0.35},
    "balanced-probe": {"weakness": 0.45, "strength": 0.50, "readiness": 0.60, "f1": 0.55, "count": 0.45},
    "exploratory-probe": {"weakness": 0.35, "strength": 0.40, "readiness": 0.48, "f1": 0.45, "count": 0.60},
}


def agreement(reference: np.ndarray, candidate: np.ndarray, offset: float, tolerance: float = TOLERANCE_MS) -> tuple[float, float]:
    """F1 and mean error of the candidate shifted by ``offset``; all in milliseconds.

    Where no two candidates are nearest to the same reference, claiming in turn gives each its
    nearest, so the loop is left out.
    """
    shifted = candidate + offset
    after = np.searchsorted(reference, shifted)
    low, high = np.maximum(after - 1, 0), np.minimum(after, len(reference) - 1)
    nearest = np.where(np.abs(reference[low] - shifted) <= np.abs(reference[high] - shifted), low, high)
    errors = np.abs(reference[nearest] - shifted)
    held = errors <= tolerance
    errors = errors[held].tolist() if len(np.unique(nearest[held])) == held.sum() else claim(reference, shifted, tolerance)
    n = len(errors)
    return (2 * n / (len(reference) + len(candidate)) if n else 0.0), (sum(errors) / n if n else float("inf"))


def search_offset(reference: np.ndarray, candidate: np.ndarray) -> tuple[float, float, float]:
    """F1 unshifted, the best offset of OFFSETS (greatest F1, least error, nearest to 0), its F1.

    An offset whose candidates near any reference are too few for the unshifted F1 is left out.
    """
    if not len(reference) or not len(candidate):
        return 0.0, 0.0, 0.0
    zero_f1 = agreement(reference, candidate, 0.0)[0]
    shifted = candidate + np.array(OFFSETS)[:, None]
    after = np.searchsorted(reference, shifted)
    gaps = np.minimum(np.abs(reference[np.maximum(after - 1, 0)] - shifted), np.abs(reference[np.minimum(after, len(reference) - 1)] - shifted))
    most = 2 * (gaps <= TOLERANCE_MS).sum(axis=1) / (len(reference) + len(candidate))
    best, best_f1, best_error = 0.0, -1.0, float("inf")
    for offset in np.array(OFFSETS)[most >= zero_f1 - 1e-6]:
        f1, error = agreement(reference, candidate, offset)
        level = abs(f1 - best_f1) < 1e-7
        if f1 > best_f1 or (level and error < best_error) or (level and abs(error - best_error) < 1e-7 and abs(offset) < abs(best)):
            best, best_f1, best_error = float(offset), f1, error
    return zero_f1, best, best_f1


@F.pandas_udf(StructType([StructField(x, DoubleType()) for x in FOUND]))
def offsets(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    found = [search_offset(np.asarray(a, float) * 1000, np.asarray(b, float) * 1000) for a, b in zip(reference, candidate, strict=True)]
    return pd.DataFrame(found, columns=FOUND)


#: Offsets and tolerances of a comparison by the side, in milliseconds.
SHADOW_OFFSETS, SHADOW_TOLERANCES = [float(x) for x in range(-120, 121, 10)], (50, 70, 100)
SHADOW = [f"f1_{t}" for t in SHADOW_TOLERANCES] + ["best_offset_ms", "best_offset_f1"]


def shadow_search(reference: np.ndarray, candidate: np.ndarray) -> list[float]:
    """F1 at each tolerance unshifted, then the best of SHADOW_OFFSETS (greatest F1, then least error) and its F1."""
    if not len(reference) or not len(candidate):
        return [float(len(reference) == len(candidate))] * len(SHADOW_TOLERANCES) + [0.0, 0.0]
    best, best_f1, best_error = 0.0, -1.0, float("inf")
    for offset in SHADOW_OFFSETS:
        f1, error = agreement(reference, candidate, offset)
        if f1 > best_f1 or (abs(f1 - best_f1) < 1e-7 and error < best_error):
            best, best_f1, best_error = offset, f1, error
    return [agreement(reference, candidate, 0.0, float(t))[0] for t in SHADOW_TOLERANCES] + [best, best_f1]


@F.pandas_udf(StructType([StructField(x, DoubleType()) for x in SHADOW]))
def shadows(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    found = [shadow_search(np.asarray(a, float) * 1000, np.asarray(b, float) * 1000) for a, b in zip(reference, candidate, strict=True)]
    return pd.DataFrame(found, columns=SHADOW)


def over_partitions(rows: DataFrame, track: str) -> DataFrame:
    """Rows by track over all shuffle partitions: few bytes, but a long search for each."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), track)


def starts() -> Column:
    return F.array_sort(F.collect_list("start"))


def intervals(grid: Column) -> Column:
    """The positive gaps of an ordered array."""
    gaps = F.zip_with(F.slice(grid, 2, F.greatest(F.lit(0), F.size(grid) - 1)), F.slice(grid, 1, F.greatest(F.lit(0), F.size(grid) - 1)), lambda b, a: b - a)
    return F.filter(gaps, lambda x: x > 0)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def variation(gaps: Column) -> Column:
    """Deviation over mean of an array; null under two values."""
    mean = mean_of(gaps)
    return F.when(F.size(gaps) >= 2, F.sqrt(mean_of(F.transform(gaps, lambda x: (x - mean) * (x - mean)))) / mean)


def median_of(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, (F.floor(n / 2) + 1).cast("int"))) / 2)


def compared_windows(reference: DataFrame, candidate: DataFrame, track: str, size: int = 32, hop: int = 16, least: int = 12, slack: float = 0.5) -> DataFrame:
    """track, window, start, end, reference, candidate (arrays), zero_f1, offset_ms, best_f1,
    reliable: hopping windows of the reference with the candidate's beats within ``slack``."""
    which = F.row_number().over(Window.partitionBy(track).orderBy("start")) - 1
    rows = hopping_windows(over_partitions(reference.select(track, "start"), track).withColumn("which", which), track, "which", size, hop, least)
    cut = rows.groupBy(track, "window").agg(starts().alias("reference")).withColumns({"start": F.element_at("reference", 1), "end": F.element_at("reference", -1)})
    beats = candidate.select(F.col(track).alias("_t"), F.col("start").alias("_s"))
    inside = F.col("_s").between(F.col("start") - slack, F.col("end") + slack)
    held = cut.join(beats, (F.col(track) == F.col("_t")) & inside, "left").groupBy(track, "window").agg(F.first("reference").alias("reference"), F.first("start").alias("start"), F.first("end").alias("end"), F.array_sort(F.collect_list("_s")).alias("candidate"))
    found = held.withColumn("_o", offsets("reference", "candidate"))
    return found.select(track, "window", "start", "end", "reference", "candidate", "_o.*", (F.col("_o.best_f1") >= 0.40).alias("reliable"))


def alignment(reference: DataFrame, candidate: DataFrame, windows: DataFrame, track: str) -> DataFrame:
    """track, count_ratio, zero_f1, offset_ms, best_f1, n_windows, offset_mad, confidence, reason,
    status of two whole grids; ``windows`` is what ``compared_windows`` gives for them.

    A track that one grid lacks has the status not-available. Nothing is corrected.
    """
    left, right = (over_partitions(x.select(track, "start"), track).groupBy(track).agg(starts().alias(name)) for x, name in ((reference, "reference"), (candidate, "candidate")))
    whole = left.join(right, track, "full").withColumns({x: F.coalesce(x, F.array().cast("array<double>")) for x in ("reference", "candidate")})
    whole = whole.withColumn("_o", offsets("reference", "candidate"))
    good = windows.where("reliable").select(track, "offset_ms")
    middle = good.groupBy(track).agg(F.median("offset_ms").alias("_m"))
    spread = good.join(middle, track).groupBy(track).agg(F.count("*").alias("_n"), F.median(F.abs(F.col("offset_ms") - F.col("_m"))).alias("_mad"))
    spread = spread.select(track, F.when(F.col("_n") > 1, F.col("_mad")).alias("offset_mad"))
    counts = windows.groupBy(track).agg(F.count("*").alias("n_windows"))
    rows = whole.select(track, F.when(F.size("reference") > 0, F.size("candidate") / F.size("reference")).alias("count_ratio"), ((F.size("reference") == 0) | (F.size("candidate") == 0)).alias("_lacks"), "_o.*")
    rows = rows.join(counts, track, "left").join(spread, track, "left").withColumn("n_windows", F.coalesce("n_windows", F.lit(0)))
    ratio, best, offset = F.col("count_ratio"), F.col("best_f1"), F.abs("offset_ms")
    stable = F.coalesce(F.col("offset_mad") <= 20.0, F.lit(False)) | (F.col("n_windows") < 2)
    confidence = F.when((best < 0.40) | (ratio < 0.65) | (ratio > 1.35) | (offset > 180.0), "None").when((best >= 0.85) & ratio.between(0.80, 1.20) & stable, "High").when(best >= 0.65, "Medium").otherwise("Low")
    rows = rows.withColumn("confidence", F.when(F.col("_lacks"), "None").otherwise(confidence))
    none = F.col("confidence") == "None"
    reason = F.when(F.col("_lacks"), "missing-beats").when((ratio < 0.65) | (ratio > 1.35), "count-ratio-out-of-range").when(offset > 180.0, "offset-out-of-range").when(none, "agreement-too-low").when(F.col("n_windows") == 0, "insufficient-local-windows")
    status = F.when(F.col("_lacks"), "not-available").when(none, "unreliable").when((offset <= 10.0) & (F.col("zero_f1") >= 0.85), "aligned").when((offset > 10.0) | (best - F.col("zero_f1") > 1e-6), "offset-detected").otherwise("aligned")
    return rows.withColumns({"reason": reason, "status": status}).drop("_lacks")


def shadow_comparison(reference: DataFrame, candidate: DataFrame, track: str) -> DataFrame:
    """track, count_ratio, precision, recall and F1 within 50, 70 and 100 ms, best_offset_ms and its F1.

    A track that one grid lacks has no matches; without a reference count_ratio is null.
    """
    left, right = (over_partitions(x.select(track, "start"), track).groupBy(track).agg(starts().alias(name)) for x, name in ((reference, "reference"), (candidate, "candidate")))
    whole = left.join(right, track, "full").withColumns({x: F.coalesce(x, F.array().cast("array<double>")) for x in ("reference", "candidate")})
    rows = whole.withColumn("_o", shadows("reference", "candidate")).select(track, F.size("reference").alias("_r"), F.size("candidate").alias("_c"), "_o.*")
    matched = {t: F.col(f"f1_{t}") * (F.col("_r") + F.col("_c")) / 2 for t in SHADOW_TOLERANCES}
    over = {f"{name}_{t}": F.when(F.col(n) > 0, m / F.col(n)).otherwise(0.0) for t, m in matched.items() for name, n in (("precision", "_c"), ("recall", "_r"))}
    return rows.withColumns({"count_ratio": F.when(F.col("_r") > 0, F.col("_c") / F.col("_r")), **over}).drop("_r", "_c")


def weak_windows(windows: DataFrame, profile: str = "strict-production") -> DataFrame:
    """Adds n_reference, n_candidate, weakness, strength, readiness, risk, weak, promising,
    correctable, strength_class, verdict and reasons to the rows of ``compared_windows``, by the limits of a profile."""
    limit = WINDOW_PROFILES[profile]
    gaps = windows.withColumns({"_r": intervals(F.col("reference")), "_c": intervals(F.col("candidate")), "n_reference": F.size("reference"), "n_candidate": F.size("candidate")})
    rows = gaps.withColumns({"_rcv": variation(F.col("_r")), "_ccv": variation(F.col("_c")), "_median": median_of(F.col("_r")), "_ratio": F.abs(F.col("n_candidate") / F.col("n_reference") - 1)})
    best, offset, ratio = F.col("best_f1"), F.abs("offset_ms"), F.col("_ratio")
    dense = F.col("n_reference") / F.greatest(F.lit(0.001), F.col("end") - F.col("start"))
    uneven = F.coalesce(clamp((F.col("_rcv") - 0.10) / 0.15, 0.0, 1.0), F.lit(0.0))
    crowded = F.when((dense > 4.0) | (F.col("_median") < 0.25), 1.0).otherwise(0.0)
    apart = 0.7 * F.when(best < 0.40, 1.0).when(best < 0.65, 0.6).otherwise(0.0)
    even = F.when(F.col("_ccv") <= 0.10, 1.0).when(F.col("_ccv") <= 0.18, 0.7).when(F.col("_ccv") > 0.30, 0.0).otherwise(0.4)
    agreed = F.when(best >= 0.85, 1.0).when(best >= 0.70, 0.75).when(best >= 0.50, 0.4).otherwise(0.0)
    near = F.when(offset <= 60.0, 1.0).when(offset <= 120.0, 0.7).otherwise(0.2)
    counted = F.when(ratio <= 0.15, 1.0).when(ratio <= limit["count"], 0.7).otherwise(0.0)
    risk = F.when(ratio > 0.50, "Blocked").when((offset > 180.0) | (best < 0.40) | (ratio > limit["count"]), "High").when((offset > 120.0) | (best < 0.65), "Medium").otherwise("Low")
    rows = rows.withColumns({"weakness": F.greatest(uneven, crowded, apart), "strength": 0.25 * even + 0.35 * agreed + 0.15 * near + 0.25 * counted, "risk": risk})
    rows = rows.withColumns({"readiness": 0.5 * F.col("weakness") + 0.5 * F.col("strength"), "weak": F.col("weakness") >= limit["weakness"], "promising": (F.col("strength") >= limit["strength"]) & (F.col("risk") != "Blocked")})
    rows = rows.withColumn("correctable", F.col("weak") & F.col("promising") & (F.col("readiness") >= limit["readiness"]) & F.col("risk").isin("Low", "Medium"))
    states = [F.col("risk") == "Blocked", F.col("correctable"), F.col("weak") & F.col("promising"), F.col("weak") | F.col("promising"), F.lit(True)]
    verdict = F.coalesce(*[F.when(test, F.lit(name)) for test, name in zip(states, READINESS, strict=True)])
    strength_class = F.coalesce(*[F.when(F.col("strength") >= least, F.lit(name)) for name, least in STRENGTHS.items()])
    told = zip([F.col("_rcv") > 0.18, F.col("_median") < 0.25, F.col("_ccv") < F.col("_rcv"), best >= limit["f1"], best < 0.65, ratio > limit["count"], ~F.col("reliable")], REASONS, strict=True)
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in told]))
    return rows.withColumns({"strength_class": strength_class, "verdict": verdict, "reasons": reasons}).drop("_r", "_c", "_rcv", "_ccv", "_median", "_ratio")


def _near(offset: Column) -> Column:
    """Share of an offset's size in an agreement's score."""
    return F.when(offset <= 60.0, 1.0).when(offset <= 120.0, 0.75).when(offset <= 180.0, 0.40).otherwise(0.0)


def _first_level(tests: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in tests.items()], F.lit("None"))


def _reason(level: Column, f1: Column, counted: Column, near: Column) -> Column:
    return F.when((level == "None") & (f1 < 0.40), "agreement-f1-too-low").when(counted <= 0, "count-ratio-out-of-range").when(near <= 0, "offset-too-large").otherwise(F.lower(level))


def window_confidence(windows: DataFrame) -> DataFrame:
    """Adds score, level, level_reason and fusable to the rows of ``compared_windows``: 0.75 of F1,
    0.15 of the offset's size, 0.10 of being reliable."""
    f1, offset = clamp(F.col("best_f1"), 0.0, 1.0), F.abs("offset_ms")
    score = clamp(0.75 * f1 + 0.15 * _near(offset) + 0.10 * F.col("reliable").cast("double"), 0.0, 1.0)
    extra = {"VeryHigh": F.col("reliable") & (offset <= 60.0), "High": F.col("reliable") & (offset <= 90.0), "Medium": F.col("reliable"), "Low": F.lit(True)}
    rows = windows.withColumns({"score": score, "level": _first_level({x: (f1 >= least) & extra[x] for x, least in LEAST_F1.items()})})
    level = F.col("level")
    return rows.withColumns({"level_reason": _reason(level, f1, F.lit(1.0), _near(offset)), "fusable": F.col("reliable") & level.isin("High", "VeryHigh")})


def agreement_confidence(aligned: DataFrame, windows: DataFrame, track: str) -> DataFrame:
    """track, score, level, reliable, level_reason, n_high, n_medium, n_windows, high_ratio, readiness.

    ``aligned`` is what ``alignment`` gives, ``windows`` what ``window_confidence`` gives. The score is
    0.55 of F1, 0.20 of the count ratio, 0.15 of the offset's size, 0.10 of its stability over windows.
    Tracks whose status is not-available have level None, score and readiness null.
    """
    f1, offset, apart = clamp(F.col("best_f1"), 0.0, 1.0), F.abs("offset_ms"), F.abs(F.col("count_ratio") - 1)
    counted = F.coalesce(F.when(apart <= 0.15, 1.0).when(apart <= 0.30, 0.75).when(apart <= 0.50, 0.40), F.lit(0.0))
    stable = F.coalesce(F.col("offset_mad") <= 20.0, F.lit(False)) | (F.col("n_windows") < 2)
    steady = F.when(stable, 1.0).when(F.col("offset_mad") <= 50.0, 0.75).otherwise(0.45)
    counts = windows.groupBy(track).agg(F.count_if(F.col("level").isin("High", "VeryHigh")).alias("n_high"), F.count_if(F.col("level").isin("Medium", "High", "VeryHigh")).alias("n_medium"))
    rows = aligned.join(counts, track, "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("n_high", "n_medium")})
    known = F.col("status") != "not-available"
    rows = rows.withColumns({"_f1": f1, "_counted": counted, "_near": _near(offset), "score": F.when(known, clamp(0.55 * f1 + 0.20 * counted + 0.15 * _near(offset) + 0.10 * steady, 0.0, 1.0)), "high_ratio": F.when(F.col("n_windows") > 0, F.col("n_high") / F.col("n_windows")).otherwise(0.0)})
    usable = known & (F.col("_counted") > 0) & (F.col("_near") > 0)
    rows = rows.withColumn("level", _first_level({x: usable & (F.col("score") >= LEAST_SCORE[x]) & (F.col("_f1") >= least) for x, least in LEAST_F1.items()}))
    rows = rows.withColumn("level_reason", F.when(known, _reason(F.col("level"), F.col("_f1"), F.col("_counted"), F.col("_near"))).otherwise(F.coalesce("reason", "status")))
    level, high = F.col("level"), F.col("high_ratio")
    unready = F.col("level_reason").isin("count-ratio-out-of-range", "offset-too-large") | (level.isin("None", "Low") & (high < 0.25))
    ready = level.isin("High", "VeryHigh") & (high >= 0.55) & (F.col("_f1") >= 0.80)
    readiness = F.when(unready, "not-ready").when(ready, "candidate-ready").otherwise("diagnostic-ready")
    rows = rows.withColumns({"reliable": (level != "None") & (F.col("confidence") != "None"), "readiness": F.when(known, readiness)})
    return rows.select(track, "score", "level", "reliable", "level_reason", "n_high", "n_medium", "n_windows", "high_ratio", "readiness")


def corrected(reference: DataFrame, candidate: DataFrame, windows: DataFrame, track: str, profile: str = "strict-production", most: int = corrections.MOST_WINDOWS) -> DataFrame:
    """track, n_reference, n_windows, corrected (array), reason: the reference with the beats of
    its correctable windows replaced by the candidate's, shifted by the window's offset.

    ``windows`` comes from ``weak_windows``. The ``most`` readiest of a track are tried in turn, by the limits of a
    profile (``corrections.decisions``); a later one replaces what an earlier one put into its span. Beats
    nearer than ``corrections.SPACING`` to the last one kept go. Without an accepted window, or where the result breaks a guardrail,
    corrected is null and reason names why.
    """
    limit = corrections.PROFILES[profile]
    told = {"weak": F.col("correctable"), "promising": F.col("correctable"), "verdict": F.when(F.col("correctable"), READINESS[1])}
    windows = windows.withColumns({x: c for x, c in told.items() if x not in windows.columns})
    taken = corrections.decisions(windows, track, profile, most).where(F.col("decision") == corrections.CREATED)
    spans = taken.select(F.col(track).alias("_t"), F.col("start").alias("_a"), F.col("end").alias("_b"), "turn", "offset_ms")
    later = spans.select("_t", "_a", "_b", F.col("turn").alias("_later"))
    own = reference.select(track, "start", F.lit(0).alias("turn"))
    shifted = F.col("start") + F.col("offset_ms") / 1000
    put = candidate.select(track, "start").join(spans, (F.col(track) == F.col("_t")) & shifted.between(F.col("_a"), F.col("_b"))).select(track, shifted.alias("start"), "turn")
    over = (F.col(track) == F.col("_t")) & (F.col("_later") > F.col("turn")) & F.col("start").between(F.col("_a"), F.col("_b"))
    beats = own.unionByName(put).join(later, over, "left_anti").groupBy(track).agg(starts().alias("_all"))
    counts = reference.groupBy(track).agg(F.count("*").alias("n_reference"))
    rows = counts.join(taken.groupBy(track).agg(F.count("*").alias("n_windows")), track, "left").join(beats.select(track, corrections.spaced("_all").alias("corrected")), track, "left")
    rows = rows.withColumn("n_windows", F.coalesce("n_windows", F.lit(0))).withColumn("_gaps", intervals(F.col("corrected")))
    rows = rows.withColumns({"_n": F.coalesce(F.size("corrected"), F.lit(0)), "_median": median_of(F.col("_gaps")), "_cv": variation(F.col("_gaps"))})
    length = F.element_at("corrected", -1) - F.element_at("corrected", 1)
    dense = F.when(F.col("_n") > 0, F.when(length > 0, F.col("_n") / length).otherwise(float("inf")))
    reason = (
        F.when(F.col("n_windows") == 0, "no-correction-windows-accepted").when(F.col("_n") < 1, "corrected-beat-count-zero").when(dense > 4.0, "corrected-density-too-high")
        .when(F.col("_median") < 0.25, "corrected-median-interval-too-low").when(60 / F.col("_median") > 200.0, "corrected-bpm-too-high")
        .when(F.abs(F.col("_n") / F.col("n_reference") - 1) > limit["count"], "corrected-count-ratio-out-of-range").when(F.col("_cv") > 0.25, "corrected-interval-cv-too-high")
    )
    rows = rows.withColumn("reason", reason)
    return rows.select(track, "n_reference", "n_windows", F.when(F.col("reason").isNull(), F.col("corrected")).alias("corrected"), "reason")
