import itertools
import math

import numpy as np
import pytest

from strophe.operators import beatgrids, graph


def strengths(spark, tracks):
    return spark.createDataFrame([(t, k, float(v)) for t, x in tracks.items() for k, v in enumerate(x)], "t int, frame long, x double")


def grid(spark, tracks):
    return spark.createDataFrame([(t, int(k)) for t, frames in tracks.items() for k in frames], "t int, frame long")


def periods(spark, tracks):
    return spark.createDataFrame([(t, float(p), float(d)) for t, (p, d) in tracks.items()], "t int, period double, duration double")


def chosen(df):
    out = {}
    for row in sorted(df.collect()):
        out.setdefault(row.t, []).append(row.frame)
    return out


def plain_chain(x, period, tightness):
    n, mean = len(x), sum(x) / len(x)
    deviation = max(1e-9, math.sqrt(sum((v - mean) ** 2 for v in x) / n))
    reach = max(1, round(period))
    local = []
    for k in range(n):
        near = [(x[j] / deviation, math.exp(-0.5 * ((j - k) * 32 / period) ** 2)) for j in range(max(0, k - reach), min(n, k + reach + 1))]
        local.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    if max(local) <= 1e-9:
        return list(range(0, n, reach))
    low = max(1, round(period / 2))
    high = max(low + 1, round(period * 2))
    total, back = [], []
    for k in range(n):
        ways = [(total[k - g] - tightness * math.log(g / period) ** 2, -g) for g in range(low, high + 1) if k - g >= 0]
        best = max(ways) if ways else (0.0, 1)
        total.append(local[k] + max(0.0, best[0]))
        back.append(k + best[1] if ways else -1)
    tops = [k for k in range(1, n - 1) if total[k] >= total[k - 1] and total[k] > total[k + 1]]
    if not tops:
        return list(range(0, n, reach))
    middle = sorted(total[k] for k in tops)
    middle = (middle[(len(tops) - 1) // 2] + middle[len(tops) // 2]) / 2
    at = max([k for k in tops if total[k] >= middle / 2], default=tops[-1])
    chain = []
    while at >= 0:
        chain.insert(0, at)
        at = back[at]
    if len(chain) > 2:
        weak = math.sqrt(sum(local[k] ** 2 for k in chain) / len(chain)) / 2
        while chain and local[chain[0]] <= weak:
            chain.pop(0)
        while len(chain) > 1 and local[chain[-1]] <= weak:
            chain.pop()
    return chain


def test_dense_beats_are_the_plain_chain(spark):
    rng = np.random.default_rng(4)
    tracks = {t: rng.random(n) ** 3 for t, n in enumerate((1, 2, 3, 7, 40, 150, 300))} | {7: np.zeros(20), 8: np.ones(20)}
    spans = {t: (2.5 + t, 1.0) for t in tracks}
    found = chosen(beatgrids.dense_beats(strengths(spark, tracks), periods(spark, spans), "t", "x", 3.0))
    assert found == {t: plain for t, x in tracks.items() if (plain := plain_chain(x.tolist(), spans[t][0], 3.0))}


def test_dense_beats_follow_a_pulse_and_need_a_period(spark):
    pulse = [1.0 if k % 8 == 3 else 0.0 for k in range(160)]
    spans = periods(spark, {1: (8, 3.2), 2: (0, 3.2), 3: (math.inf, 3.2)})
    found = chosen(beatgrids.dense_beats(strengths(spark, {1: pulse, 2: pulse, 3: pulse, 4: pulse}), spans, "t", "x"))
    assert found == {1: list(range(3, 160, 8))}


def test_usable_grid_takes_the_first_that_is_even(spark):
    pulse = [1.0 if k % 10 == 4 else 0.1 for k in range(200)]
    uneven = [1.0 if k % 20 in (9, 11) else 0.1 for k in range(200)]
    tracks = {1: pulse, 2: pulse, 3: uneven, 4: pulse, 5: pulse[:30]}
    own = grid(spark, {1: range(4, 200, 10), 2: [4, 5, 60], 3: [9], 9: [1]})
    spans = periods(spark, {t: (10, len(x) / 50) for t, x in tracks.items()})
    out = beatgrids.usable_grid(strengths(spark, tracks), own, spans, "t", "x", 50.0).collect()
    assert {(r.t, r.mode) for r in out} == {(1, "aligned"), (2, "snapped-regular"), (3, "regular"), (4, "snapped-regular"), (5, "regular")}
    frames = {t: sorted(r.frame for r in out if r.t == t) for t in tracks}
    assert frames[1] == frames[2] == frames[4] == list(range(4, 200, 10))
    # snapped, track 3 would alternate between gaps of 8 and 12: a deviation of 2 over a median of 8
    assert frames[3] == list(range(0, 200, 10))
    assert frames[5] == [0, 10, 20]


def test_micro_snap_keeps_order_and_period():
    x = np.full(60, 0.1)
    x[[11, 19, 24, 31, 41, 50]] = 1.0
    assert beatgrids.micro_snapped(x, np.arange(0, 60, 10), 10.0, 0.10).tolist() == [0, 11, 20, 31, 41, 50]
    assert beatgrids.micro_snapped(np.zeros(30), np.arange(0, 30, 10), 10.0, 0.10).tolist() == [0, 10, 20]


def test_composite_beats_pass_a_gate(spark):
    pulse = [1.0 if k % 10 == 4 else 0.1 for k in range(400)]
    beside, right = range(6, 400, 10), range(4, 400, 10)
    own = grid(spark, {1: beside, 2: right, 3: [4, 14]})
    spans = periods(spark, {t: (10, 8.0) for t in (1, 2, 3, 4)})
    out = beatgrids.composite_beats(strengths(spark, {1: pulse, 2: pulse, 3: pulse, 4: pulse}), own, spans, "t", "x").collect()
    assert {(r.t, r.mode) for r in out} == {(1, "composite-dp"), (2, "rejected"), (3, "not-enough-data")}
    assert {t: sorted(r.frame for r in out if r.t == t) for t in (1, 2, 3)} == {1: list(right), 2: list(right), 3: [4, 14]}


def plain_elastic(x, grid, period, reach):
    """Every choice of places in turn, without numpy."""
    states = {}
    for k, frame in enumerate(grid):
        span = range(max(0, frame - reach), min(len(x), frame + reach + 1))
        own = {frame} | {j for j in span if span[0] < j < span[-1] and x[j] >= x[j - 1] and x[j] > x[j + 1]}
        top = max(span, key=lambda j: (x[j], -j))
        own |= {top} if x[top] > x[frame] else set()
        own |= {round(sum(j * x[j] for j in span) / sum(x[j] for j in span))}
        after = {}
        for j in sorted(own):
            worth = x[j] - abs(j - frame) / period * 0.2
            ways = [(total - 2 * ((j - i - period) / period) ** 2, -i) for i, (total, _) in states.items() if 0.7 * period < j - i < 1.3 * period]
            if k == 0:
                after[j] = (worth, [j])
            elif ways:
                best = max(ways)
                after[j] = (worth + best[0], [*states[-best[1]][1], j])
            else:
                after[j] = (worth - 5.0, [*states[min(states)][1], j])
        states = after
    return max(states.items(), key=lambda s: (s[1][0], -s[0]))[1][1]


def test_elastic_beats_are_the_plain_best_path(spark):
    rng = np.random.default_rng(9)
    tracks = {t: np.where(rng.random(120) < 0.25, 1.0, 0.1) * (0.5 + rng.random(120)) for t in range(8)}
    given = {t: [5 + 10 * k + int(j) for k, j in enumerate(rng.integers(-1, 2, 12))] if t % 4 else list(range(5, 120, 10)) for t in tracks}
    out = beatgrids.elastic_beats(strengths(spark, tracks), grid(spark, given), periods(spark, dict.fromkeys(tracks, (10, 2.4))), "t", "x", 50.0).collect()
    modes = {r.t: r.mode for r in out}
    assert set(modes.values()) == {"elastic-local-onset", "rejected"}
    for t, x in tracks.items():
        nominal = given[t]
        path = plain_elastic(x.tolist(), nominal, 10.0, 2)
        frames = sorted(r.frame for r in out if r.t == t)
        assert frames == (path if modes[t] == "elastic-local-onset" else nominal)
        before, after = (float(np.mean([x[k] for k in g])) for g in (nominal, path))
        spread = [np.std(np.diff(g)) / np.median(np.diff(g)) for g in (nominal, path)]
        assert (modes[t] == "elastic-local-onset") == (after > before * 1.01 and spread[1] <= max(spread[0] * 1.8, spread[0] + 0.04))


def test_elastic_beats_need_eight(spark):
    x = np.ones(60)
    out = beatgrids.elastic_beats(strengths(spark, {1: x}), grid(spark, {1: [5, 15, 25]}), periods(spark, {1: (10, 1.2)}), "t", "x", 50.0).collect()
    assert [(r.frame, r.mode) for r in sorted(out)] == [(5, "not-enough-data"), (15, "not-enough-data"), (25, "not-enough-data")]


def plain_window_score(x, beats, offset, period, reach):
    hits = strength = near = 0.0
    frames = [min(max(round(b + offset * period), 0), len(x) - 1) for b in beats]
    for frame in frames:
        span = range(max(0, frame - reach), min(len(x), frame + reach + 1))
        top = max(span, key=lambda j: (x[j], -j))
        gap = abs(top - frame) if x[top] > x[frame] else reach + 1
        hits, strength, near = hits + (gap <= reach), strength + x[top] / max(x), near + 1 - gap / (reach + 1)
    bar = [np.mean([x[f] / max(x) for k, f in enumerate(frames) if (k % 4 == 0) == first]) for first in (True, False)]
    n = len(beats)
    return 0.45 * hits / n + 0.25 * strength / n + 0.15 * near / n + 0.10 * min(1, max(0, 0.5 + bar[0] - bar[1])) + 0.05 * min(1, n / 32) - 0.20 * abs(offset)


def test_window_offsets_are_the_best_of_all():
    rng = np.random.default_rng(3)
    x = rng.random(640) ** 4
    beats = 4 + 10 * np.arange(60)
    scores = beatgrids.window_scores(x, beats, 10.0)
    assert beatgrids.spans(60) == [(0, 32), (16, 48), (32, 60)] and beatgrids.spans(32) == [(0, 32)] and beatgrids.spans(33) == [(0, 32), (16, 33)]
    plain = [[plain_window_score(x.tolist(), beats[a:b].tolist(), o, 10.0, 1) for o in beatgrids.OFFSETS] for a, b in beatgrids.spans(60)]
    assert scores == pytest.approx(np.array(plain))
    picks = itertools.product(range(len(beatgrids.OFFSETS)), repeat=3)
    value = lambda p: sum(scores[i][k] for i, k in enumerate(p)) - 0.35 * sum((beatgrids.OFFSETS[a] - beatgrids.OFFSETS[b]) ** 2 for a, b in itertools.pairwise(p))
    assert beatgrids.smooth_offsets(scores).tolist() == [beatgrids.OFFSETS[k] for k in max(picks, key=value)]


def test_piecewise_beats(spark):
    x = [{8: 0.3, 9: 0.6, 10: 1.0, 11: 0.6, 12: 0.3}.get(k % 20, 0.0) for k in range(1300)]
    early, right = [10 + 20 * k - 4 for k in range(64)], [10 + 20 * k for k in range(64)]
    spans = periods(spark, dict.fromkeys((1, 2, 3, 4), (20, 26)))
    out = beatgrids.piecewise_beats(strengths(spark, dict.fromkeys((1, 2, 3, 4), x)), grid(spark, {1: early, 2: right, 3: early[:31], 5: early}), spans, "t", "x", 50.0).collect()
    assert {(r.t, r.mode) for r in out} == {(1, "piecewise-window-offset"), (2, "rejected"), (3, "not-enough-data")}
    moved, kept = (sorted(r.frame for r in out if r.t == t) for t in (1, 2))
    assert kept == right
    # a beat hits a greater frame beside it, not its own: of the steps of a frame, three come nearest
    assert moved == [k + 3 for k in early]


def test_the_tempo_of_a_pulse_scores_best(spark):
    x = [1.0 if k % 25 == 5 else 0.0 for k in range(1000)]
    tempos = [(1, 0, 95.0, 1.0, "autocorrelation"), (1, 1, 120.0, 0.9, "peak"), (1, 2, 150.0, 1.0, "peak"), (1, 3, 60.0, 1.0, "half"), (1, 4, 120.0, 0.9, "refined-peak"), (2, 0, 120.0, 1.0, "peak")]
    candidates = spark.createDataFrame(tempos, "t int, place long, bpm double, score double, origin string")
    found = {(r.t, r.place): r.grid_score for r in beatgrids.tempo_scores(strengths(spark, {1: x}), candidates, "t", "x", 50.0).collect()}
    # every beat on a peak at full strength: 39 gaps of 25 frames, evenly, bar phase without preference
    right = 0.30 * 0.9 + 0.25 + 0.15 + 0.12 * 39 * 25 / 1000 + 0.10 + 0.08 * 0.5
    assert found[1, 1] == pytest.approx(right) and found[1, 4] == pytest.approx(right - 0.04)
    assert found[1, 3] is None and found[2, 0] is None and max(found[1, 0], found[1, 2]) < right


def test_what_goes_before_the_best_tempo(spark):
    rows = [
        (1, 0, 120.0, 0.5, "peak", 0.7), (1, 1, 100.0, 0.9, "peak", 0.6),
        (2, 0, 90.0, 0.9, "peak", 0.8), (2, 1, 178.0, 0.2, "double", 0.1), (2, 2, 182.0, 0.3, "double", 0.1), (2, 3, 200.0, 0.9, "double", 0.2),
        (3, 0, 120.0, 0.5, "peak", 0.7), (3, 1, 110.0, 0.49, "autocorrelation", 0.1), (3, 2, 84.0, 0.9, "autocorrelation", None),
        (4, 0, 120.0, 0.5, "peak", 0.7), (4, 1, 110.0, 0.48, "autocorrelation", 0.1),
        (5, 0, 70.0, 0.1, "peak", None), (5, 1, 60.0, 0.5, "peak", None),
        (6, 0, 120.0, 0.5, "peak", 0.7), (6, 1, 130.0, 0.5, "peak", 0.7),
    ]
    scored = spark.createDataFrame(rows, "t int, place long, bpm double, score double, origin string, grid_score double")
    assert {r.t: r.bpm for r in beatgrids.selected_tempo(scored, "t").collect()} == {1: 120.0, 2: 182.0, 3: 110.0, 4: 120.0, 5: 70.0, 6: 120.0}


def test_every_way_of_routing(spark):
    edge = "t int, src long, dst long, distance double, score double"
    edges = spark.createDataFrame([(1, 9, 0, 10.0, 10.0), (3, 7, 0, 10.0, 10.0)], edge)
    more = [(2, 9, 1, 40.0, 40.0), (2, 8, 1, 45.0, 45.0), (2, 9, 0, 65.0, 65.0), (3, 9, 1, 60.0, 60.0), (4, 7, 1, 40.0, 40.0), (5, 4, 1, 40.0, 40.0), (5, 3, 1, 35.0, 35.0), (7, 4, 1, 20.0, 20.0)]
    candidates = edges.union(spark.createDataFrame(more, edge))
    quanta = spark.createDataFrame([(t, k) for t in range(1, 8) for k in range(10)], "t int, which long")
    sizes = spark.createDataFrame([(t, 10) for t in range(1, 8)], "t int, n long")
    thresholds = spark.createDataFrame([(t, 30.0) for t in range(1, 8)], "t int, applied double")
    targets = graph.early_target(edges, sizes, "t")
    costs, reach = graph.hop_cost(quanta, edges, targets, "t"), graph.reachability(quanta, edges, "t")
    limits = graph.anchor_limits(edges, sizes, thresholds, "t")
    assert {r.t: r.limit for r in limits.collect()} == {1: 55.0, 3: 55.0} | dict.fromkeys((2, 4, 5, 6, 7), 65.0)
    found = {r.t: (r.decision, r.src, r.dst, r.hops, r.inserted) for r in graph.anchor_routing(candidates, edges, reach, costs, targets, limits, "t").collect()}
    assert found == {
        1: ("existing-preferred-anchor", 9, 0, 0, False),
        2: ("inserted-preferred-anchor", 9, 1, 0, True),
        3: ("existing-fallback-anchor", 7, 0, 0, False),
        4: ("inserted-fallback-anchor", 7, 1, 0, True),
        5: ("legacy-fallback", 4, 1, None, True),
        6: ("legacy-fallback", None, None, None, False),
        7: ("legacy-fallback", 4, 1, None, False),
    }


@pytest.mark.parametrize("gaps, expected", [([], (0.0, 0, 0)), ([10, 10, 10], (0.0, 0, 0)), ([10, 17, 4], (pytest.approx(np.std([10, 17, 4]) / 10), 1, 1))])
def test_regularity(gaps, expected):
    assert beatgrids.regularity(np.cumsum([0, *gaps]), 10.0) == expected
