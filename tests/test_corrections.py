"""Each decision and blocker of a weak window, and beats kept apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.operators import corrections

FINE = {"t": 1, "window": 0, "start": 0.0, "end": 16.0, "offset_ms": 20.0, "strength": 0.9, "readiness": 0.9, "risk": "Low", "weak": True, "promising": True, "correctable": True, "verdict": "CandidateForExperimentalCorrection", "n_reference": 20, "n_candidate": 21}
SCHEMA = "t int, window int, start double, end double, offset_ms double, strength double, readiness double, risk string, weak boolean, promising boolean, correctable boolean, verdict string, n_reference int, n_candidate int"
CASES = [
    ({}, "CandidateCreated", None, "candidate-window"),
    ({"end": 20.5}, "Rejected", "window-duration-too-long", "window-duration-too-long"),
    ({"offset_ms": -121.0}, "Rejected", "offset-too-large", "offset-too-large"),
    ({"offset_ms": None}, "Rejected", "offset-too-large", "offset-too-large"),
    ({"strength": 0.69}, "Rejected", "advisor-strength-too-low", "advisor-strength-too-low"),
    ({"readiness": 0.71}, "Rejected", "correction-readiness-too-low", "correction-readiness-too-low"),
    ({"n_candidate": 26}, "Rejected", "bad-count-ratio", "bad-count-ratio"),
    ({"n_reference": 0}, "Rejected", "bad-count-ratio", "bad-count-ratio"),
    ({"risk": "High"}, None, None, "high-risk-window"),
    ({"verdict": "Blocked"}, None, None, "candidate-window"),
    ({"weak": False}, "CandidateCreated", None, "not-weak-window"),
    ({"promising": False}, None, None, "advisor-not-promising"),
    ({"correctable": False, "risk": "Blocked"}, None, None, "risk-blocked"),
    ({"correctable": False, "risk": "High"}, None, None, "risk-high"),
    ({"correctable": False, "readiness": 0.5, "strength": 0.1}, None, None, "correction-readiness-too-low"),
    ({"correctable": False, "strength": 0.1, "n_candidate": 60}, None, None, "advisor-strength-too-low"),
    ({"correctable": False, "n_candidate": 60, "offset_ms": 999.0}, None, None, "bad-count-ratio"),
    ({"correctable": False, "offset_ms": 999.0}, None, None, "offset-too-large"),
    ({"correctable": False}, None, None, "future-correction-candidate-false"),
]


def frame(spark, changes):
    return spark.createDataFrame([tuple((FINE | {"t": k, "window": k} | c).values()) for k, c in enumerate(changes)], SCHEMA)


def test_every_decision_and_blocker(spark):
    got = corrections.decisions(frame(spark, [c[0] for c in CASES]), "t").orderBy("t").collect()
    assert [(r.decision, r.rejection, r.blocker) for r in got] == [c[1:] for c in CASES]
    assert {r.rejection for r in got} - {None} == set(corrections.REJECTIONS) - {"high-risk-window"}
    assert {r.blocker for r in got} == {*corrections.REJECTIONS, *corrections.BLOCKERS, corrections.OPEN}


def test_profiles_and_turns(spark):
    windows = frame(spark, [{"readiness": 0.6 + k / 100, "strength": 0.55, "offset_ms": 150.0, "n_candidate": 28, "correctable": k % 2 == 0} for k in range(24)]).withColumn("t", F.lit(1))
    found = {p: corrections.decisions(windows, "t", p).where("turn IS NOT NULL").orderBy("turn").collect() for p in corrections.PROFILES}
    assert [r.window for r in found["balanced-probe"]] == list(range(22, 6, -2)) and {r.decision for r in found["balanced-probe"]} == {"CandidateCreated"}
    assert {r.rejection for r in found["strict-production"]} == {"offset-too-large"}
    assert [r.window for r in found["exploratory-probe"]] == list(range(23, 15, -1))


def test_summary(spark):
    decided = corrections.decisions(frame(spark, [c[0] for c in CASES]), "t").withColumn("t", F.lit(7))
    row = corrections.correction_summary(decided, "t", 3).first()
    assert (row.n_windows, row.n_accepted, row.n_rejected, row.n_shown) == (len(CASES), 2, 7, 3)
    assert sum(row.blockers.values()) == len(CASES) and row.blockers["offset-too-large"] == 3
    assert row.top_blockers == sorted(row.blockers, key=lambda x: (-row.blockers[x], x))[:3]


@pytest.mark.parametrize("times", [None, [], [1.0], [0.0, 0.1, 0.2, 0.3, 0.4, 0.5], np.cumsum(np.random.default_rng(1).random(4_000) * 0.3).tolist()])
def test_spaced_beats(spark, times):
    kept = []
    for t in times or []:
        if not kept or t - kept[-1] >= corrections.SPACING:
            kept.append(t)
    got = spark.createDataFrame([(times,)], "b array<double>").select(corrections.spaced("b")).first()[0]
    assert got == (None if times is None else kept)
