import pytest

from strophe.operators import hybrid

COLUMNS = "t int, legacy_count int, advisor_plausible boolean, advisor_rejection string, advisor_dense boolean, corrected_count int, dense boolean, plausible boolean, rejection string, bpm double, median_gap double, density double, created boolean, accepted int, modifies boolean, applies boolean, claim string, correction_reason string, correction_status string, planned int"
SAFE = {"t": 1, "legacy_count": 100, "advisor_plausible": True, "advisor_rejection": None, "advisor_dense": False, "corrected_count": 110, "dense": False, "plausible": True, "rejection": None, "bpm": 120.0, "median_gap": 0.5, "density": 2.0, "created": True, "accepted": 2, "modifies": False, "applies": False, "claim": "Not-Evaluated", "correction_reason": None, "correction_status": "built", "planned": 2}
LOST = {"corrected_count": None}
CASES = [
    ({}, None, "None"),
    ({"legacy_count": None}, "legacy-candidate-missing", "Unknown"),
    (LOST, "corrected-experimental-candidate-missing", "CorrectedCandidateMissing"),
    (LOST | {"created": None}, "corrected-experimental-candidate-missing", "CorrectionDiagnosticsMissing"),
    (LOST | {"correction_reason": "No-Correction-Windows-Accepted"}, "corrected-experimental-candidate-missing", "NoCorrectionWindowsAccepted"),
    ({"created": None}, "weak-window-corrections-missing", "Unknown"),
    ({"planned": None}, "weak-window-correction-plan-missing", "Unknown"),
    ({"planned": 0}, "plan-accepted-correction-window-count-too-low", "CorrectedCandidateUnsafe"),
    ({"accepted": 0, "modifies": True}, "accepted-correction-window-count-too-low", "CorrectedCandidateUnsafe"),
    ({"modifies": True}, "hbg07-should-modify-final-grid-unsafe", "CorrectedCandidateUnsafe"),
    ({"claim": None}, "external-benchmark-claim-status-not-evaluated", "Unknown"),
    ({"dense": True, "plausible": False}, "corrected-candidate-dense-grid", "CorrectedCandidateDense"),
    ({"plausible": False}, "corrected-candidate-implausible", "CorrectedCandidateImplausible"),
    ({"plausible": False, "rejection": "beat-density-too-high"}, "beat-density-too-high", "CorrectedCandidateImplausible"),
    ({"bpm": 201.0}, "corrected-bpm-too-high", "CorrectedCandidateImplausible"),
    ({"legacy_count": 0}, "legacy-beat-count-zero", "CorrectedCandidateImplausible"),
    ({"corrected_count": 126}, "corrected-vs-legacy-count-ratio-out-of-range", "CorrectedCandidateCountRatioOutOfRange"),
    ({"bpm": 201.0, "advisor_plausible": None}, "corrected-bpm-too-high", "AdvisorUnavailable"),
    ({"bpm": 201.0, "advisor_rejection": "odd"}, "corrected-bpm-too-high", "AdvisorRejected"),
    ({"advisor_rejection": "odd"}, None, "None"),
]


def rows(spark, changes):
    return spark.createDataFrame([tuple((SAFE | change | {"t": k}).values()) for k, change in enumerate(changes)], COLUMNS)


def test_reasons_and_kinds(spark):
    found = {r.t: r for r in hybrid.hybrid_choice(rows(spark, [c for c, _, _ in CASES]), "t").collect()}
    assert [(found[k].reason, found[k].category) for k in range(len(CASES))] == [(reason, kind) for _, reason, kind in CASES]
    assert (found[0].status, found[0].decision, found[0].source) == ("selected-corrected-experimental", "SelectedCorrectedExperimental", "corrected-experimental")
    assert (found[1].decision, found[1].source, found[2].decision, found[2].source) == ("FallbackToLegacy", None, "NotAvailable", "legacy")
    assert [(found[k].safe_noop, found[k].failure) for k in (0, 2, 3, 5, 17)] == [(False, False), (True, False), (False, True), (False, False), (False, True)]


@pytest.mark.parametrize("profile, taken", [("strict-production", [0]), ("balanced-probe", [0, 1]), ("exploratory-probe", [0, 1, 2])])
def test_profiles(spark, profile, taken):
    sets = rows(spark, [{}, {"bpm": 205.0, "median_gap": 0.23, "density": 4.2, "corrected_count": 130}, {"bpm": 225.0, "median_gap": 0.19, "density": 4.8, "corrected_count": 145}, {"bpm": 231.0}])
    assert sorted(r.t for r in hybrid.hybrid_choice(sets, "t", profile).where("reason is null").collect()) == taken


def test_without_leave_the_own_grid_stays(spark):
    changes = [{}, LOST, LOST | {"correction_status": "Not-Available"}, LOST | {"correction_status": "not-available", "correction_reason": "late"}, LOST | {"created": False}]
    found = {r.t: (r.status, r.decision, r.source, r.reason, r.category) for r in hybrid.hybrid_choice(rows(spark, changes), "t", allowed=False).collect()}
    kinds = ["Unknown", "CorrectedCandidateMissing", "CorrectionDiagnosticsMissing", "WeakWindowsNotReady", "CorrectedCandidateNotCreated"]
    assert found == {k: ("disabled", "SelectedLegacy", "legacy", "corrected-experimental-final-disabled", kind) for k, kind in enumerate(kinds)}
