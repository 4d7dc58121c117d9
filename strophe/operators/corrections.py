"""Which weak windows of a track are corrected, and what keeps the others from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: The limits of a correction by profile: least strength and readiness, greatest offset, change of
#: count and of tempo, and whether a window must be a candidate for correction already.
PROFILES = {
    "strict-production": {"strength": 0.70, "readiness": 0.72, "offset": 120.0, "count": 0.25, "bpm": 20.0, "require": True},
    "balanced-probe": {"strength": 0.50, "readiness": 0.60, "offset": 160.0, "count": 0.45, "bpm": 28.0, "require": True},
    "exploratory-probe": {"strength": 0.40, "readiness": 0.48, "offset": 220.0, "count": 0.60, "bpm": 40.0, "require": False},
}
#: Windows tried and shown, their greatest length, the least gap of corrected beats.
MOST_WINDOWS, MOST_SHOWN, MOST_SECONDS, SPACING = 8, 12, 20.0, 0.25
#: Decisions, and rejections in the order in which they are met.
CREATED, REJECTED = "CandidateCreated", "Rejected"
REJECTIONS = ["high-risk-window", "window-duration-too-long", "offset-too-large", "advisor-strength-too-low", "correction-readiness-too-low", "bad-count-ratio"]
#: What a window that none of these keeps from correction is counted under, and the blockers before a rejection.
OPEN = "candidate-window"
BLOCKERS = ["not-weak-window", "advisor-not-promising", "risk-blocked", "risk-high", "future-correction-candidate-false"]


def _tests(limit: dict) -> dict[str, Column]:
    """The condition of each rejection; a window without an offset or a count ratio is out of range."""
    ratio = F.coalesce(F.abs(F.col("n_candidate") / F.when(F.col("n_reference") > 0, F.col("n_reference")) - 1), F.lit(998.0))
    tests = [
        F.col("risk").isin("High", "Blocked"), F.col("end") - F.col("start") > MOST_SECONDS, F.coalesce(F.abs("offset_ms"), F.lit(999.0)) > limit["offset"],
        F.col("strength") < limit["strength"], F.col("readiness") < limit["readiness"], ratio > limit["count"],
    ]
    return dict(zip(REJECTIONS, tests, strict=True))


def _first(tests: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in tests], F.lit(None).cast("string"))


def decisions(windows: DataFrame, track: str, profile: str = "strict-production", most: int = MOST_WINDOWS) -> DataFrame:
    """Adds turn, decision, rejection and blocker to the rows of ``grids.weak_windows``.

    The ``most`` readiest candidates of a track are tried, by readiness, less risk and start, and have a
    turn from 1 on and a decision; a rejected one names its first rejection. ``blocker`` tells for every
    window what keeps it from correction.
    """
    limit = PROFILES[profile]
    wanted = F.col("correctable") if limit["require"] else F.lit(True)
    asked = wanted & (F.col("verdict") == "CandidateForExperimentalCorrection") & F.col("risk").isin("Low", "Medium") & F.col("promising")
    asked = F.coalesce(asked, F.lit(False))
    order = Window.partitionBy(track, asked).orderBy(F.desc("readiness"), F.when(F.col("risk") == "Low", 0).otherwise(1), "start")
    turn = F.when(asked & (F.row_number().over(order) <= most), F.row_number().over(order))
    tests = _tests(limit)
    rejection = _first(list(tests.items()))
    early = [(BLOCKERS[0], ~F.col("weak")), (BLOCKERS[1], ~F.col("promising"))]
    unripe = _first([(BLOCKERS[2], F.col("risk") == "Blocked"), (BLOCKERS[3], F.col("risk") == "High"), *[(x, tests[x]) for x in (REJECTIONS[4], REJECTIONS[3], REJECTIONS[5], REJECTIONS[2])], (BLOCKERS[4], F.lit(True))])
    blocker = F.coalesce(_first(early), F.when(~F.col("correctable"), unripe), rejection, F.lit(OPEN))
    rows = windows.withColumns({"turn": turn, "_rejection": rejection, "blocker": blocker})
    tried = F.col("turn").isNotNull()
    decision = F.when(tried, F.when(F.col("_rejection").isNull(), CREATED).otherwise(REJECTED))
    return rows.withColumns({"decision": decision, "rejection": F.when(tried, F.col("_rejection"))}).drop("_rejection")


def correction_summary(decided: DataFrame, track: str, shown: int = MOST_SHOWN) -> DataFrame:
    """track, n_windows, n_weak, n_candidates, n_accepted, n_rejected, n_shown, blockers, top_blockers of ``decisions``.

    ``blockers`` maps each blocker to its windows, ``top_blockers`` lists the ``shown`` most frequent ones, count
    down and then name up.
    """
    count = lambda test: F.count_if(test)
    whole = decided.groupBy(track).agg(
        F.count("*").alias("n_windows"), count(F.col("weak")).alias("n_weak"), count(F.col("turn").isNotNull()).alias("n_candidates"), count(F.col("decision") == CREATED).alias("n_accepted"),
        count(F.col("decision") == REJECTED).alias("n_rejected"), F.least(F.lit(shown), count(F.col("weak") | F.col("promising") | (F.col("readiness") > 0))).alias("n_shown"),
    )
    counts = decided.groupBy(track, "blocker").agg(F.count("*").alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "blocker")))
    held = counts.groupBy(track).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("blocker", "n")))).alias("blockers"), F.slice(F.transform(ranked, lambda x: x["blocker"]), 1, shown).alias("top_blockers") if shown else F.array().cast("array<string>").alias("top_blockers"))
    return whole.join(held, track)


@F.pandas_udf(ArrayType(DoubleType()))
def spaced(beats: pd.Series) -> pd.Series:
    """Of ascending times those at least SPACING after the last one kept, in one pass."""

    def kept(times) -> list[float] | None:
        if times is None:
            return None
        times = np.asarray(times, float)
        if not len(times) or (np.diff(times) >= SPACING).all():
            return times.tolist()
        out = [times[0]]
        for t in times[1:].tolist():
            if t - out[-1] >= SPACING:
                out.append(t)
        return out

    return beats.map(kept)
