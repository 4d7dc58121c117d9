"""The chained tracker: tempo candidates by a plain loop, whole tracks, broken tracks, providers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.operators import beatgrids, timeline, tracker
from strophe.plans import registry

FPS = 50.0


def plain_candidates(x, low=60.0, high=200.0):
    first, last = int(FPS * 60 / high), int(np.ceil(FPS * 60 / low))
    weigh = lambda bpm: np.exp(-0.5 * (np.log2(bpm / 120) / 1.4) ** 2) * (1.0 if 85 <= bpm <= 150 else 0.85 if bpm < 70 or bpm > 190 else 0.95)
    own = {lag: sum(x[i] * x[i + lag] for i in range(len(x) - lag)) / (len(x) - lag) * weigh(60 * FPS / lag) for lag in range(first, min(last, len(x) - 1) + 1)}
    best = max(own, key=lambda k: (own[k], -k))
    slow = 60 * FPS / (2 * best)
    if 60 * FPS / best >= 170 and 2 * best in own and 75 <= slow <= 135 and own[2 * best] >= own[best] * (0.45 if 90 <= slow <= 120 else 0.6):
        best *= 2
    at = [k for k in range(len(x)) if x[k] >= max(x) / 2 and (k == 0 or x[k] >= x[k - 1]) and (k == len(x) - 1 or x[k] > x[k + 1])]
    gaps = [b - a for a, b in zip(at, at[1:], strict=False) if 0.75 * best <= b - a <= 1.5 * best]
    chosen = min(max(60 * FPS / (np.mean(gaps) if len(at) >= 3 and gaps else best), low), high)
    rows = [(60 * FPS / k, k, s, "autocorrelation", "primary") for k, s in own.items()]
    if min(abs(r[0] - chosen) for r in rows) > 0.001:
        rows.append((chosen, best, own[best], "refined-peak", "primary"))
    for bpm, lag, s, _, _ in list(rows):
        for ratio, origin, role in ((0.5, "half-time", "half"), (2.0, "double-time", "double"), (0.75, "three-quarter", "three-quarter"), (4 / 3, "four-third", "four-third")):
            if low <= bpm * ratio <= high:
                rows.append((bpm * ratio, max(1, round(lag / ratio)), s * 0.92, origin, role))
    top = {}
    for r in sorted(rows, key=lambda r: -r[2]):
        top.setdefault(round(r[0], 3), r)
    return chosen, sorted(top.values(), key=lambda r: -r[2])[:30]


@pytest.mark.parametrize("gap", [17, 25, 33.4, 41])
def test_candidates_match_a_plain_loop(spark, gap):
    rnd = np.random.default_rng(int(gap))
    x = rnd.random(700) * 0.2
    x[np.rint(np.arange(5, 690, gap)).astype(int)] = 1.0
    odf = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)] + [("silent", k, 0.0) for k in range(50)] + [("short", 0, 1.0)], "t string, frame long, x double")
    got = tracker.tempo_candidates(odf, "t", "x", FPS).orderBy("t", "place").collect()
    chosen, want = plain_candidates(x)
    own = [r for r in got if r.t == "a"]
    assert np.allclose([(r.bpm, r.score) for r in own], [w[:1] + w[2:3] for w in want])
    assert {(round(r.bpm, 3), r.origin, r.harmonic) for r in own} == {(round(w[0], 3), w[3], w[4]) for w in want}
    assert [r.bpm for r in own if r.selected] == [pytest.approx(chosen)] or all(abs(w[0] - chosen) > 0.001 for w in want)
    assert {(r.t, r.bpm, r.origin, r.harmonic) for r in got if r.t != "a"} == {(t, 120.0, "fallback", "unknown") for t in ("silent", "short")}


def frames(tracks):
    return [(t, k, float(v), float(v), float(v)) for t, x in tracks.items() for k, v in enumerate(x)]


FRAME = "t string, frame long, flux double, onset double, evidence double"


def test_tracks_end_each_in_its_own_way(spark):
    """A pulse, a silent track, and broken ones that become rows while the others finish."""
    pulse = np.zeros(2000)
    pulse[np.arange(10, 2000, 25)] = 1.0
    broken = pulse.copy()
    broken[7] = np.nan
    rows = spark.createDataFrame(frames({"pulse": pulse, "silent": np.zeros(500), "nan": broken, "long": pulse}), FRAME)
    lengths = {"pulse": 40.0, "silent": 10.0, "nan": 40.0, "long": float("inf"), "empty": 5.0, "null": None}
    tracks = spark.createDataFrame(list(lengths.items()), "t string, duration double")
    beats, summary = tracker.track_beats(rows, tracks, "t", FPS, evidence="evidence")
    told = {r.t: r for r in summary.collect()}
    assert {t: r.code for t, r in told.items()} == {"pulse": None, "silent": None, "nan": tracker.NOT_FINITE, "long": tracker.NO_DURATION, "empty": tracker.NO_FRAMES, "null": tracker.NO_DURATION}
    assert told["pulse"].bpm == pytest.approx(120.0) and told["pulse"].mode.split("+")[0] in ("audio-refined", "snapped-regular", "regular")
    assert (told["silent"].bpm, told["silent"].mode, told["silent"].n_beats) == (120.0, "regular", 21)
    assert all(told[t].n_beats == 0 and told[t].message for t in ("nan", "long", "empty", "null"))
    got = [r.start for r in beats.where("t = 'pulse'").orderBy("which").collect()]
    assert len(got) == told["pulse"].n_beats >= 70 and np.allclose(np.diff(got), 0.5)
    assert {round(s * FPS) % 25 for s in got} == {10}
    assert not tracker.track_beats(rows.limit(0), tracks.limit(0), "t", FPS)[1].collect()


def test_harmonics_reach_the_choice_of_a_tempo(spark):
    """Chained, the tempo with the best score among plain autocorrelations is known as such."""
    x = np.zeros(1500)
    x[np.arange(3, 1500, 20)] = 1.0
    rows = spark.createDataFrame(frames({"a": x}), FRAME)
    tracks = spark.createDataFrame([("a", 30.0)], "t string, duration double")
    found = {g: tracker.track_beats(rows, tracks, "t", FPS, grid_tempo=g, elastic=False, piecewise=False)[1].first() for g in (True, False)}
    assert found[True].bpm == pytest.approx(150.0) and found[False].bpm == pytest.approx(150.0)


def test_providers(spark):
    grid = lambda source, *tracks: spark.createDataFrame([(t, float(k), source) for t in tracks for k in range(2)], "t int, start double, confidence double")
    cases = [(1, "BuiltIn", True), (2, "BeatThis", True), (3, "BeatThis", True), (4, "BeatThis", False), (5, "BeatThis", None), (6, "Hybrid", True), (7, "Hybrid", True), (8, None, True), (9, "Shadow", False)]
    tracks = spark.createDataFrame(cases, "t int, provider string, fallback boolean")
    failures = spark.createDataFrame([(2, None), (3, "bpm-out-of-range"), (4, "bpm-out-of-range")], "t int, failure string")
    beats, told = tracker.provided(tracks, grid(0.1, *range(1, 10)), grid(0.2, 2, 3, 4, 9), failures, grid(0.3, 6), "t")
    assert {r.t: (r.source, r.reason, r.code) for r in told.collect()} == {
        1: ("built-in", None, None), 2: ("advisor", None, None), 3: ("built-in", "beat-this-guardrail-rejected:bpm-out-of-range", None), 4: (None, "beat-this-guardrail-rejected:bpm-out-of-range", "provider-rejected"),
        5: ("built-in", "beat-this-provider-not-configured", None), 6: ("corrected", None, None), 7: ("built-in", None, None), 8: (None, None, "unsupported-provider"), 9: ("built-in", None, None),
    }
    assert {r.t: (r.n, r.c) for r in beats.groupBy("t").agg(F.count("*").alias("n"), F.max("confidence").alias("c")).collect()} == {1: (2, 0.1), 2: (2, 0.2), 3: (2, 0.1), 5: (2, 0.1), 6: (2, 0.3), 7: (2, 0.1), 9: (2, 0.1)}


def strengths(rnd, length):
    x = rnd.random(length) * rnd.choice([0.0, 0.3, 1.0])
    if rnd.random() < 0.6:
        x[:: int(rnd.integers(2, 30))] = 1.0
    return np.round(x, 1) if rnd.random() < 0.3 else x


@pytest.mark.parametrize(("per_second", "tightness", "count", "low", "high"), [(8.0, 1.0, 80, 1, 110), (50.0, 100.0, 6, 200, 900)])
def test_chains_and_scores_together_are_those_one_by_one(monkeypatch, per_second, tightness, count, low, high):
    rnd = np.random.default_rng(count)
    own = [strengths(rnd, int(rnd.integers(low, high))) for _ in range(count)]
    which, bpm = np.repeat(np.arange(count), 6), np.tile([85.0, 96.0, 120.0, 133.3, 180.0, 240.0], count)
    share, refined = rnd.random(len(which)), rnd.random(len(which)) < 0.2
    want = [beatgrids.dense_chain(own[k], per_second * 60 / b, tightness) for k, b in zip(which, bpm, strict=True)]
    scores = [beatgrids.tempo_score(own[k], b, s, bool(r), per_second, tightness) for k, b, s, r in zip(which, bpm, share, refined, strict=True)]
    for cells in (1, 3000, 1_000_000):
        monkeypatch.setattr(beatgrids, "CELLS", cells)
        got, chains = beatgrids.tempo_scores_of(own, which, bpm, share, refined, per_second, tightness)
        assert all(np.array_equal(a, b) for a, b in zip(chains, want, strict=True)) and np.allclose(got, scores, rtol=0, atol=1e-12)


def step_by_step(rows, tracks, per_second, tightness):
    """The chain by its operators, a table each."""
    odf = timeline.onset_detection(timeline.onset_detection(rows, "t", "frame", "flux", tracker.WIDTH, "_tempo"), "t", "frame", "onset", tracker.WIDTH, "_odf").cache()
    candidates = tracker.tempo_candidates(odf, "t", "_tempo", per_second).cache()
    chosen = beatgrids.selected_tempo(beatgrids.tempo_scores(odf, candidates, "t", "_odf", per_second, tightness), "t")
    periods = chosen.select("t", "bpm", (60.0 * per_second / F.col("bpm")).alias("period")).join(tracks, "t").cache()
    grid = beatgrids.usable_grid(odf, beatgrids.dense_beats(odf, periods, "t", "_odf", tightness), periods, "t", "_odf", per_second, beatgrids.MICRO_SNAP)
    grid = beatgrids.composite_beats(rows, grid.select("t", "frame"), periods, "t", "evidence", tightness)
    grid = beatgrids.elastic_beats(odf, grid.select("t", "frame"), periods, "t", "_odf", per_second)
    grid = beatgrids.piecewise_beats(odf, grid.select("t", "frame"), periods, "t", "_odf", per_second)
    return periods, timeline.frame_times(grid, odf.select("t", "frame", "_odf"), tracks, "t", "_odf", 1.0 / per_second)


def test_tracks_together_are_the_chain_step_by_step(spark, monkeypatch):
    """Many tracks in one pass, taken up a few at a time, have the tempi and beats of the operators one after another."""
    rnd = np.random.default_rng(4)
    held = {f"t{k}": x for k in range(40) if (x := strengths(rnd, int(rnd.integers(3, 420)))).max() > 0}
    rows = spark.createDataFrame([(t, k, float(v), float(v) ** 2, float(u)) for t, x in held.items() for k, (v, u) in enumerate(zip(x, rnd.random(len(x)), strict=True))], FRAME)
    tracks = spark.createDataFrame([(t, len(x) / 9.0) for t, x in held.items()], "t string, duration double")
    monkeypatch.setattr(tracker, "FRAMES", 500)
    beats, summary = tracker.track_beats(rows, tracks, "t", 8.0, evidence="evidence", tightness=1.0)
    periods, timed = step_by_step(rows, tracks, 8.0, 1.0)
    assert {r.t: r.bpm for r in summary.collect()} == {r.t: r.bpm for r in periods.collect()}
    assert sorted((r.t, r.start, r.confidence) for r in beats.collect()) == sorted((r.t, r.time, r.confidence) for r in timed.collect())
    assert {r.t: r.n_beats for r in summary.collect()} == {r.t: r.c for r in timed.groupBy("t").agg(F.count("*").alias("c")).collect()}


def test_the_chain_writes_one_table_and_keeps_its_plan_small(spark, monkeypatch):
    """A table a step, and tables joined with each other, were what filled the driver."""
    written = []
    monkeypatch.setattr(tracker, "settled", lambda df, name: written.append(df) or df)
    rows = spark.createDataFrame(frames({"a": np.ones(30)}), FRAME)
    beats, summary = tracker.track_beats(rows, spark.createDataFrame([("a", 3.0)], "t string, duration double"), "t", FPS)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (beats, summary)]
    assert len(written) == 1 and all(plan.count("Join") == 1 and plan.count("InPandas") == 0 and plan.count("MapInArrow") == 1 for plan in plans)


def test_the_summary_reads_a_written_table_only(spark):
    """Nothing is joined, shuffled or sent to the driver for it, however many tracks there are; it tells of the beats there are."""
    sf = "/root/testdata/sf0.001"
    found = registry.tracked_summary(spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Join", "Exchange", "Aggregate", "InPandas") if x in plan]
    told, beats = found.collect(), registry.tracked_beats(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.max("which").alias("last")).collect()
    assert {r.user_id: r.n_beats for r in told if r.n_beats} == {r.user_id: r.n for r in beats} and all(r.last == r.n - 1 for r in beats)
    assert {r.user_id for r in told} == {r.user_id for r in registry.beats(spark, sf).select("user_id").distinct().collect()}
