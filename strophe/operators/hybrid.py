"""Which grid of a track becomes the final one: its own, or the corrected one where that is safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a profile allows the corrected grid: change of count, tempo, beats a second, and its least middle gap.
PROFILES = {
    "strict-production": {"count": 0.25, "bpm": 200.0, "density": 4.0, "gap": 0.25},
    "balanced-probe": {"count": 0.35, "bpm": 210.0, "density": 4.5, "gap": 0.22},
    "exploratory-probe": {"count": 0.50, "bpm": 230.0, "density": 5.0, "gap": 0.18},
}
DISABLED, MISSING, NONE_ACCEPTED, CLAIM = "corrected-experimental-final-disabled", "corrected-experimental-candidate-missing", "no-correction-windows-accepted", "not-evaluated"
#: Parts of a reason that tell the kind of fallback, first match.
KINDS = {
    "CorrectedCandidateDense": ["dense"],
    "CorrectedCandidateCountRatioOutOfRange": ["count-ratio"],
    "CorrectedCandidateImplausible": ["implausible", "beat-count-zero", "bpm", "median-interval", "density"],
    "CorrectedCandidateUnsafe": ["unsafe", "accepted-correction-window-count-too-low"],
}
#: Fallbacks that leave everything as it was, and those that mean a failure.
NOOP = ["CorrectedCandidateMissing", "CorrectedCandidateNotCreated", "NoCorrectionWindowsAccepted", "WeakWindowsNotReady", *(f"CorrectedCandidate{x}" for x in ("Unsafe", "Dense", "Implausible", "CountRatioOutOfRange"))]
FAILURE = ["RuntimeFailure", "AdvisorUnavailable", "AdvisorRejected", "CorrectionDiagnosticsMissing"]


def first_of(rules: list[tuple[str | Column, Column]]) -> Column:
    """The name of the first rule whose condition holds; null for none. A condition without a value doesn't hold."""
    return F.coalesce(*[F.when(holds, F.lit(name) if isinstance(name, str) else name) for name, holds in rules])


def unsafe(profile: str, least_accepted: int) -> Column:
    """Why the corrected grid may not be the final one; null where it may."""
    limit = PROFILES[profile]
    changed = F.abs(F.col("corrected_count") / F.col("legacy_count") - 1)
    return first_of([
        ("legacy-candidate-missing", F.col("legacy_count").isNull()),
        (MISSING, F.col("corrected_count").isNull()),
        ("weak-window-corrections-missing", F.col("created").isNull()),
        ("weak-window-correction-plan-missing", F.col("planned").isNull()),
        ("corrected-candidate-not-created", ~F.col("created")),
        ("accepted-correction-window-count-too-low", F.col("accepted") < least_accepted),
        ("hbg07-should-modify-final-grid-unsafe", F.col("modifies")),
        ("hbg07-should-apply-correction-unsafe", F.col("applies")),
        ("external-benchmark-claim-status-not-evaluated", ~F.lower("claim").eqNullSafe(CLAIM)),
        ("plan-accepted-correction-window-count-too-low", F.col("planned") < least_accepted),
        ("corrected-candidate-dense-grid", F.col("dense")),
        (F.coalesce("rejection", F.lit("corrected-candidate-implausible")), ~F.col("plausible")),
        ("corrected-bpm-too-high", F.col("bpm") > limit["bpm"]),
        ("corrected-median-interval-too-low", F.col("median_gap") < limit["gap"]),
        ("corrected-beat-density-too-high", F.col("density") > limit["density"]),
        ("legacy-beat-count-zero", F.col("legacy_count") == 0),
        ("corrected-vs-legacy-count-ratio-out-of-range", changed > limit["count"]),
    ])


def fallback() -> Column:
    """The kind of fallback that ``reason`` and the candidates tell."""
    reason, told, lacks = F.lower("reason"), F.lower("correction_reason"), F.col("corrected_count").isNull()
    missing = [
        ("CorrectionDiagnosticsMissing", F.col("created").isNull()),
        ("NoCorrectionWindowsAccepted", told == NONE_ACCEPTED),
        ("CorrectedCandidateMissing", (told == MISSING) | (reason == MISSING)),
        ("CorrectionDiagnosticsMissing", (F.lower("correction_status") == "not-available") & told.isNull()),
        ("WeakWindowsNotReady", F.lower("correction_status") == "not-available"),
        ("CorrectedCandidateNotCreated", ~F.col("created")),
        ("CorrectedCandidateMissing", F.lit(True)),
    ]
    held = [(kind, reduce(lambda a, b: a | b, [reason.contains(x) for x in parts])) for kind, parts in KINDS.items()]
    return first_of([
        ("AdvisorUnavailable", F.col("advisor_plausible").isNull()),
        ("AdvisorRejected", F.col("advisor_rejection").isNotNull() | F.col("advisor_dense") | ~F.col("advisor_plausible")),
        *[(name, lacks & holds) for name, holds in missing], *held, ("Unknown", F.lit(True)),
    ])


def hybrid_choice(sets: DataFrame, track: str, profile: str = "strict-production", least_accepted: int = 1, allowed: bool = True) -> DataFrame:
    """track, status, decision, source, reason, category, safe_noop, failure: the final grid of a track.

    ``sets`` has a row per track: legacy_count (beats of its own grid; null: there is none, and
    source is null), advisor_plausible (null: no advisor), advisor_rejection, advisor_dense,
    corrected_count (null: no corrected grid), dense, plausible, rejection, bpm, median_gap and
    density of the corrected grid, created (null: nothing known of the correction), accepted,
    modifies, applies, claim, correction_reason, correction_status, and planned (windows of the
    plan, null: no plan). A limit whose value is null isn't broken.
    """
    rows = sets.withColumn("reason", unsafe(profile, least_accepted) if allowed else F.lit(DISABLED))
    safe, own = F.col("reason").isNull(), F.when(F.col("legacy_count").isNotNull(), "legacy")
    kind = F.when(safe, "None").otherwise(fallback())
    lost = "SelectedLegacy" if not allowed else F.when(F.col("corrected_count").isNull(), "NotAvailable").otherwise("FallbackToLegacy")
    return rows.select(
        track, F.when(safe, "selected-corrected-experimental").otherwise("fallback-to-legacy" if allowed else "disabled").alias("status"),
        F.when(safe, "SelectedCorrectedExperimental").otherwise(lost).alias("decision"), F.when(safe, "corrected-experimental").otherwise(own).alias("source"),
        "reason", kind.alias("category"), kind.isin(NOOP).alias("safe_noop"), kind.isin(FAILURE).alias("failure"),
    )
