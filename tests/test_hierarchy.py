import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.operators import checks, grids, hierarchy, summaries
from strophe.operators.folds import claim
from strophe.sources import exports

BEATS = "t int, start double"


def grid(spark, track, count, gap=0.5, shift=0.0):
    return spark.createDataFrame([(track, k * gap + shift) for k in range(count)], BEATS)


def test_a_shifted_grid_is_found(spark):
    reference, candidate = grid(spark, 1, 48), grid(spark, 1, 48, shift=0.1)
    windows = grids.compared_windows(reference, candidate, "t").persist()
    assert sorted((r.window, len(r.reference), r.offset_ms, r.best_f1, r.zero_f1, r.reliable) for r in windows.collect()) == [(0, 32, -100.0, 1.0, 0.0, True), (1, 32, -100.0, pytest.approx(64 / 65), 0.0, True), (2, 16, -100.0, pytest.approx(32 / 33), 0.0, True)]
    row = grids.alignment(reference, candidate, windows, "t").first()
    assert (row.status, row.confidence, row.offset_ms, row.best_f1, row.offset_mad, row.reason) == ("offset-detected", "High", -100.0, 1.0, 0.0, None)


def test_equal_missing_and_sparse_grids(spark):
    reference = grid(spark, 1, 20).union(grid(spark, 2, 20)).union(grid(spark, 3, 20))
    candidate = grid(spark, 1, 20).union(grid(spark, 3, 10, gap=1.0)).union(grid(spark, 4, 3))
    windows = grids.compared_windows(reference, candidate, "t")
    rows = {r.t: r for r in grids.alignment(reference, candidate, windows, "t").collect()}
    assert {k: (r.status, r.reason) for k, r in rows.items()} == {1: ("aligned", None), 2: ("not-available", "missing-beats"), 3: ("unreliable", "count-ratio-out-of-range"), 4: ("not-available", "missing-beats")}
    none = {r.t: (len(r.candidate), r.best_f1, r.offset_ms) for r in windows.where("t = 2").collect()}
    assert none == {2: (0, 0.0, 0.0)}


def test_weak_window_of_an_uneven_reference(spark):
    uneven = spark.createDataFrame([(1, k * 0.5 + (0.2 if k % 2 else 0.0)) for k in range(16)], BEATS)
    row = grids.weak_windows(grids.compared_windows(uneven, grid(spark, 1, 16, shift=0.1), "t")).where("window = 0").first()
    assert (row.weakness, row.risk, row.n_candidate, row.promising) == (1.0, "Medium" if row.best_f1 < 0.65 else "Low", 16, True)
    assert "LegacyTempoInstability" in row.reasons and "AdvisorMoreStableIntervals" in row.reasons
    even = grids.weak_windows(grids.compared_windows(grid(spark, 1, 16), grid(spark, 1, 16), "t")).where("window = 0").first()
    assert (even.weakness, even.strength, even.verdict, even.reasons) == (0.0, 1.0, "DiagnosticOnly", ["AdvisorStrongerLocalAgreement"])


def test_weak_windows_by_profile(spark):
    # 16 beats against 22: the counts differ by 0.375, over the strict limit and under the others
    held = [k * 0.5 for k in range(16)]
    windows = spark.createDataFrame([(1, 0, 0.0, 7.5, held, [k * 7.5 / 21 for k in range(22)], 0.6, 0.0, 0.6, True)], "t int, window int, start double, end double, reference array<double>, candidate array<double>, zero_f1 double, offset_ms double, best_f1 double, reliable boolean")
    found = {p: grids.weak_windows(windows, p).first() for p in grids.WINDOW_PROFILES}
    assert [r.risk for r in found.values()] == ["High", "Medium", "Medium"]
    assert [r.strength for r in found.values()] == [pytest.approx(0.25 + 0.35 * 0.4 + 0.15), pytest.approx(0.25 + 0.35 * 0.4 + 0.15 + 0.25 * 0.7), pytest.approx(0.25 + 0.35 * 0.4 + 0.15 + 0.25 * 0.7)]
    # weakness 0.7 * 0.6 = 0.42, readiness (0.42 + 0.715) / 2 = 0.5675
    assert [(r.weak, r.promising, r.correctable) for r in found.values()] == [(False, False, False), (False, True, False), (True, True, True)]
    assert ["AdvisorStrongerLocalAgreement" in r.reasons for r in found.values()] == [False, True, True]
    assert ["InsufficientEvidence" in r.reasons for r in found.values()] == [True, False, False]


def test_agreement_confidence_levels(spark):
    reference = grid(spark, 1, 48).union(grid(spark, 2, 48)).union(grid(spark, 3, 20)).union(grid(spark, 4, 48))
    candidate = grid(spark, 1, 48).union(grid(spark, 2, 48, shift=0.1)).union(grid(spark, 3, 5, gap=1.0))
    windows = grids.compared_windows(reference, candidate, "t")
    aligned = grids.alignment(reference, candidate, windows, "t")
    got = {r.t: r for r in grids.agreement_confidence(aligned, grids.window_confidence(windows), "t").collect()}
    assert {t: (r.level, r.reliable, r.level_reason, r.readiness) for t, r in got.items()} == {
        1: ("VeryHigh", True, "veryhigh", "candidate-ready"), 2: ("VeryHigh", True, "veryhigh", "diagnostic-ready"),
        3: ("None", False, "count-ratio-out-of-range", "not-ready"), 4: ("None", False, "missing-beats", None),
    }
    assert (got[1].score, got[1].n_high, got[1].n_windows, got[2].n_high, got[2].n_medium) == (1.0, 3, 3, 0, 3)
    assert got[2].score == pytest.approx(0.55 + 0.20 + 0.15 * 0.75 + 0.10) and got[4].score is None


def test_shadow_comparison_of_shifted_and_missing_grids(spark):
    reference = grid(spark, 1, 48).union(grid(spark, 2, 48)).union(grid(spark, 3, 4))
    candidate = grid(spark, 1, 48, shift=0.06).union(grid(spark, 2, 24, gap=1.0)).union(grid(spark, 4, 4))
    got = {r.t: r for r in grids.shadow_comparison(reference, candidate, "t").collect()}
    assert (got[1].f1_50, got[1].f1_70, got[1].precision_70, got[1].recall_100, got[1].best_offset_ms, got[1].best_offset_f1) == (0.0, 1.0, 1.0, 1.0, -60.0, 1.0)
    assert (got[2].count_ratio, got[2].precision_50, got[2].recall_50, got[2].best_offset_ms) == (0.5, pytest.approx(1.0), pytest.approx(0.5), 0.0)
    assert (got[3].f1_70, got[3].precision_70, got[3].count_ratio) == (0.0, 0.0, 0.0) and (got[4].count_ratio, got[4].best_offset_f1) == (None, 0.0)


def test_sanity_errors_of_vectors_and_missing_levels(spark):
    tracks = spark.createDataFrame([(1, 2.0, " "), (2, 0.0, "h")], "t int, duration double, file_hash string")
    beats = spark.createDataFrame([(1, 0.0, 0.5, [], [1.0]), (1, -1.0, 0.5, None, [float("nan")]), (1, 0.5, 0.5, [float("inf")], [float("inf")])], "t int, start double, duration double, timbre array<double>, pitches array<double>")
    got = {(r.t, r.error): r.n for r in checks.sanity_errors(tracks, {"beat": beats}, "t").collect()}
    assert got == {
        (1, "Metadata file hash is required."): 1, (2, "Metadata duration must be greater than zero."): 1, (1, "Beat start cannot be negative."): 1,
        (1, "Beat timbre cannot be empty."): 2, (1, "Beat feature values must be finite."): 2, (2, "Analysis must contain at least one beat."): 1,
    }


def test_guardrails_name_the_first_broken_rule(spark):
    even = [k * 0.5 for k in range(16)]
    cases = {
        1: (even, [0.0, 2.0], 0.9, 120.0, 8.0, None, None), 2: ([0.0], [], 0.9, 120.0, 8.0, None, "beat-count-too-low"), 3: (even, [], None, 120.0, 8.0, None, "confidence-count-mismatch"),
        4: (even, [], 0.9, 230.0, 8.0, None, "bpm-out-of-range"), 5: ([*even, 0.5], [], 0.9, 120.0, 8.0, None, "beat-times-not-strictly-increasing"), 6: (even, [], float("nan"), 120.0, 8.0, None, "confidences-not-finite"),
        7: (even, [], 0.001, 120.0, 8.0, None, "confidence-too-low"), 8: (even, [], 0.9, 120.0, 2.0, None, "beat-density-too-high"), 9: ([0.0, 0.1, 0.2, 5.0], [], 0.9, 120.0, 8.0, None, "beat-interval-stddev-too-high"),
        10: (even, [1.0, 1.0], 0.9, 120.0, 8.0, None, "downbeat-times-not-strictly-increasing"), 11: (even, [1.2], 0.9, 120.0, 8.0, None, "downbeat-not-aligned-to-beat"), 12: (even, [], 0.9, 120.0, 8.0, 0.5, "ai-coverage-too-low"),
        13: (even, [1.02], 0.9, 120.0, 0.0, 0.5, None), 14: ([], [], 0.9, None, 8.0, None, "beat-count-too-low"),
    }
    beats = spark.createDataFrame([(t, x, c[2]) for t, c in cases.items() for x in c[0]], "t int, start double, confidence double")
    down = spark.createDataFrame([(t, x) for t, c in cases.items() for x in c[1]], BEATS)
    tracks = spark.createDataFrame([(t, c[3], c[4], c[5]) for t, c in cases.items()], "t int, bpm double, duration double, coverage double")
    assert {r.t: r.failure for r in summaries.guardrails(beats, down, tracks, "t").collect()} == {t: c[6] for t, c in cases.items()}


def test_bar_phase_follows_the_accents(spark):
    rows = [(1, k, k * 0.5, 1.0 if k % 4 == 2 else 0.1, 0.0, k % 4 == 2) for k in range(40)] + [(2, k, k * 0.5, 1.0 if k % 4 == 2 else 0.1, 0.0, False) for k in range(12)]
    beats = spark.createDataFrame(rows, "t int, which int, start double, confidence double, loudness double, peak boolean")
    assert {r.t: r.phase for r in hierarchy.bar_phase(beats, "t").collect()} == {1: 2, 2: 0}


def test_sections_of_short_and_long_tracks(spark):
    bars = spark.createDataFrame([(1, k, 2.0 * k) for k in range(40)] + [(2, k, 2.0 * k) for k in range(4)], "t int, bar int, start double")
    ends = spark.createDataFrame([(1, 80.0), (2, 8.0), (3, 0.0)], "t int, duration double")
    got = sorted((r.t, r.which, r.start, r.duration) for r in hierarchy.sections(bars, ends, "t").collect())
    assert got == [*[(1, k, 16.0 * k, 16.0) for k in range(5)], (2, 0, 0.0, 8.0)]
    few = sorted((r.which, r.start, r.duration) for r in hierarchy.sections(bars, ends, "t", most=3).where("t = 1").collect())
    assert few == [(0, 0.0, 16.0), (1, 16.0, 16.0), (2, 32.0, 48.0)]


def test_half_time_needs_a_near_score(spark):
    scores = spark.createDataFrame([("a", 4, 1.0), ("a", 8, 0.5), ("b", 4, 1.0), ("b", 8, 0.4), ("c", 8, 1.0), ("c", 16, 1.0)], "t string, lag int, score double")
    assert {r.t: (r.lag, r.halved) for r in hierarchy.half_time(scores, "t", 12.0).collect()} == {"a": (8, True), "b": (4, False), "c": (8, False)}


def test_branch_documents_null_what_json_lacks(spark):
    edges = spark.createDataFrame([(1, 5, 2, float("nan")), (1, 2, 5, 1.5)], "t int, src int, dst int, distance double")
    row = exports.branch_documents(edges, edges.where("src > 9"), "t").select("*", F.to_json("active").alias("j")).first()
    assert [(b.from_beat, b.direction, b.distance) for b in row.active] == [(2, "forward", 1.5), (5, "backward", None)]
    assert (row.n_active, row.n_candidates) == (2, 0) and "NaN" not in row.j


def test_agreement_equals_claims_in_turn():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (np.sort(rng.integers(0, 3_000, rng.integers(1, 30)).astype(float)) for _ in range(2))
        errors = claim(a, b + 15.0, 70.0)
        assert grids.agreement(a, b, 15.0) == (2 * len(errors) / (len(a) + len(b)), pytest.approx(sum(errors) / len(errors)) if errors else float("inf"))


def test_corrected_takes_the_steadier_beats(spark):
    uneven = [k * 0.5 + (0.2 if k % 2 and k >= 20 else 0.0) for k in range(36)]
    reference, candidate = spark.createDataFrame([(1, x) for x in uneven], BEATS), grid(spark, 1, 36)
    wanted = [(1, 0, 10.0, 17.7, "Low", 0.9, 0.9, True, 16, 16, 0.0), (1, 1, 14.0, 17.7, "Low", 0.8, 0.9, True, 8, 8, 40.0), (1, 2, 0.0, 9.5, "High", 0.9, 0.9, False, 16, 16, 0.0)]
    windows = spark.createDataFrame(wanted, "t int, window int, start double, end double, risk string, readiness double, strength double, correctable boolean, n_reference int, n_candidate int, offset_ms double")
    row = grids.corrected(reference, candidate, windows, "t").first()
    want = [x for x in uneven if not 10.0 <= x <= 17.7] + [k * 0.5 for k in range(36) if 10.0 <= k * 0.5 < 14.0] + [k * 0.5 + 0.04 for k in range(36) if 14.0 <= k * 0.5 + 0.04 <= 17.7]
    assert row.reason is None and row.n_windows == 2 and row.corrected == pytest.approx(sorted(want))
    none = grids.corrected(reference, candidate, windows.where("window = 2"), "t").first()
    assert (none.corrected, none.reason) == (None, "no-correction-windows-accepted")


def test_offset_search_equals_all_offsets_tried():
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = (np.sort(rng.integers(0, 4_000, rng.integers(1, 25)).astype(float)) for _ in range(2))
        best = (0.0, -1.0, float("inf"))
        for offset in grids.OFFSETS:
            errors = claim(a, b + offset, 70.0)
            f1, error = 2 * len(errors) / (len(a) + len(b)), sum(errors) / len(errors) if errors else float("inf")
            level = abs(f1 - best[1]) < 1e-7
            if f1 > best[1] or level and (error < best[2] or abs(error - best[2]) < 1e-7 and abs(offset) < abs(best[0])):
                best = (offset, f1, error)
        assert grids.search_offset(a, b)[1:] == (best[0], pytest.approx(best[1]))
