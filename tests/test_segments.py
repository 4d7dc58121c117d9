import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strophe.operators import folds, graph, hierarchy, segments, timeline


def slow_sweep(x, onset, hop):
    """The boundaries by plain sets and repeated scans."""
    n, long = len(x), len(x) * hop
    aim = min(7.5, max(3.0, 4 + 2.2 * sum(o >= 0.25 for o in onset) / len(onset) + 0.35 * min(2, max(0, np.std(x)))))
    fewest = int(np.ceil(long * max(3.0, aim - 1.2)))
    most = max(fewest, int(np.floor(long * min(7.5, aim + 1.2))))
    target = min(max(round(long * aim), fewest), most)
    gap, longest = max(1, round(0.09 / hop)), max(max(1, round(0.09 / hop)) + 1, round(0.70 / hop))

    def fits(held, k):
        return k - max(h for h in held if h <= k) >= gap and min(h for h in held if h >= k) - k >= gap

    best, m = None, 1.4
    while m >= 0.2:
        least, held = np.mean(x) + m * np.std(x), {0, n}
        for k in sorted((k for k in range(1, n - 1) if x[k] >= least and x[k] >= x[k - 1] and x[k] > x[k + 1]), key=lambda k: -x[k]):
            if fits(held, k):
                held.add(k)
        changed = True
        while changed:
            changed, order = False, sorted(held)
            for a, b in zip(order, order[1:]):
                low, high = a + gap, min(b - gap, n - 1)
                if b - a > longest and high > low:
                    k = max(range(low, high + 1), key=lambda k: (x[k], -k))
                    if x[k] >= least:
                        held.add(k)
                        changed = True
                        break
        density = (len(held) - 1) / max(hop, long)
        if max(3.0, aim - 0.35) <= density <= min(7.5, aim + 0.75):
            return sorted(held)
        if best is None or abs(len(held) - 1 - target) < abs(len(best) - 1 - target):
            best = held
        m -= 0.1
    wanted = max(int(np.ceil(long * max(3.0, aim - 0.35))) + 1, min(most + 1, target + 1))
    for k in sorted((k for k in range(1, n - 1) if k not in best), key=lambda k: -x[k]):
        if len(best) - 1 >= wanted:
            break
        if fits(best, k):
            best.add(k)
    return sorted(best)


def test_boundary_sweep_against_plain_sets():
    rng = np.random.default_rng(2)
    for n in (5, 30, 200, 400):
        for hop in (0.0232, 0.01, 0.1):
            x = rng.random(n) ** rng.choice([1, 6]) * rng.choice([0.1, 1, 30])
            onset = rng.random(n) * rng.choice([0.2, 1])
            assert segments.sweep(x, onset, hop)[0] == slow_sweep(x.tolist(), onset.tolist(), hop)


def test_snapped_boundaries_stay_between_their_neighbours():
    x = np.random.default_rng(3).random(97)
    held = segments.snapped(x, 0.0232)
    assert held[0] == 0 and held[-1] == 97 and held == sorted(set(held))
    assert segments.snapped(np.ones(1), 0.0232) == [0, 1]
    for k, place in list(enumerate(held))[1:-1]:
        low, high = max(held[k - 1] + 1, 9 * k - 3), min(9 * (k + 1) - 1 if 9 * (k + 1) < 97 else 96, 9 * k + 3)
        assert place == low + int(x[low : high + 1].argmax())


def test_novelty_segments_are_aggregates_of_their_frames(spark):
    rng = np.random.default_rng(5)
    rows = [(t, k, float(rng.random()), [float(rng.random()), float("nan") if k % 5 == 0 else 1.0], [1.0, 4.0], float(rng.random() ** 3), float(rng.random())) for t in (1, 2) for k in range(120)]
    rows += [(3, 0, 1.0, [1.0, 1.0], [0.0, 0.0], 1.0, 1.0), (4, 0, 1.0, [1.0, 1.0], [0.0, 0.0], 1.0, 1.0), (4, 1, 1.0, [1.0, 1.0], [0.0, 0.0], 1.0, 1.0), (4, 2, 1.0, [1.0, 1.0], [0.0, 0.0], 1.0, 1.0)]
    frames = spark.createDataFrame(rows, "t int, frame long, rms double, timbre array<double>, pitches array<double>, novelty double, onset double")
    found = segments.novelty_boundaries(frames, "t", 0.02)
    held = {r.t: r for r in found.collect()}
    assert held[3].mode == held[4].mode == "temporal-fallback" and held[1].mode == "novelty"
    data = pd.DataFrame(rows, columns=frames.columns)
    ratio = {r.t: r.ratio for r in segments.boundary_ratio(frames, found, "t").collect()}
    got = segments.segments(frames, found, "t", 0.02, 0.04).collect()
    for t in (1, 2):
        own, b = data[data.t == t].sort_values("frame"), held[t].boundaries
        x = own.novelty.to_numpy()
        inner = [k for k in b if 0 < k < 120]
        assert ratio[t] == pytest.approx(x[inner].mean() / np.delete(x[1:-1], [k - 1 for k in inner if k < 119]).mean())
        mine = sorted((r for r in got if r.t == t), key=lambda r: r.segment)
        assert [r.first for r in mine] + [mine[-1].stop] == b
        for r in mine:
            part = own[(own.frame >= r.first) & (own.frame < r.stop)]
            assert r.timbre[1] == pytest.approx(np.nan_to_num([v[1] for v in part.timbre]).mean()) and r.pitches == [0.25, 1.0]
            assert r.loudness_max == part.rms.max() and r.loudness_max_time == pytest.approx((part.frame.to_numpy()[part.rms.argmax()] - r.first) * 0.02)
            assert r.confidence == pytest.approx(0.5 if r.segment == 0 else (x[r.first] - x.min()) / (x.max() - x.min()))


def test_positional_distance_is_driven_by_the_source(spark):
    body = "struct<timbre:array<double>,pitches:array<double>,loudness_start:double,loudness_max:double,duration:double,confidence:double>"
    one = lambda x: ([x, 0.0], [0.0, x], 0.0, 0.0, 0.0, 0.0)
    held = spark.createDataFrame([(1, 0, 0, 10, one(0.0)), (1, 1, 0, 11, one(1.0)), (1, 1, 1, 12, one(5.0)), (1, 2, 0, 10, one(0.0))], f"t int, quantum int, place int, segment int, s {body}")
    pairs = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 0, 2), (1, 9, 0)], "t int, src int, dst int")
    got = {(r.src, r.dst): r.distance for r in graph.positional_distance(pairs, held, "t").collect()}
    assert got == {(0, 1): 11.0, (1, 0): (11.0 + 100.0) / 2, (0, 2): 100.0, (9, 0): float("inf")}


def test_bar_novelty_and_sections_against_loops(spark):
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.normal(3 * np.eye(4)[c], 0.2, (9, 4)) for c in range(4)])
    z = (vectors - vectors.mean(0)) / np.maximum(1e-4, vectors.std(0))
    n, r = 36, 3
    want = np.zeros(n)
    for c in range(r, n - r):
        for i in range(-r, r + 1):
            for j in range(-r, r + 1):
                sign = 1 if (i > 0) == (j > 0) else -1
                cos = z[c + i] @ z[c + j] / np.linalg.norm(z[c + i]) / np.linalg.norm(z[c + j])
                want[c] += sign * np.exp(-(i * i + j * j) / (2 * 1.5 * 1.5)) * cos
    want = np.maximum(0, want)
    want = [want[max(0, k - 1) : k + 2].mean() for k in range(n)]
    assert np.allclose(segments.bar_novelty(vectors), want)
    starts = np.arange(n) * 4.0
    bars = spark.createDataFrame([(1, k, float(starts[k]), vectors[k].tolist()) for k in range(n)] + [(2, k, 4.0 * k, [1.0]) for k in range(20)], "t int, bar long, start double, vector array<double>")
    lengths = spark.createDataFrame([(1, 144.0), (2, 80.0)], "t int, duration double")
    rows = sorted(segments.structural_sections(bars, lengths, "t").collect(), key=lambda r: r.which)
    assert {r.t for r in rows} == {1} and all(min(abs(r.bar - b) for r in rows) <= 1 for b in (0, 9, 18, 27)) and len(rows) >= 4
    assert sum(r.duration for r in rows) == pytest.approx(144.0)
    summary = {r.t: r for r in segments.section_novelty(bars, lengths, "t").collect()}
    assert summary[1].selected == len(rows) - 1 and summary[1].candidates >= summary[1].selected and summary[2].max == 0


def test_adaptive_tatums_begin_at_the_peaks(spark):
    beats = spark.createDataFrame([(1, k, float(k), 1.0) for k in range(10)] + [(2, 0, 0.0, 1.0)], "t int, which int, start double, duration double")
    onset = [0.0] * 100
    for frame in (3, 6, 14, 33):  # two peaks in beat 0, one in beats 1 and 3
        onset[frame] = 1.0
    onset[50] = 0.2  # under the threshold
    marks = spark.createDataFrame([(1, k, x) for k, x in enumerate(onset)], "t int, frame int, onset double")
    rows = sorted(folds.adaptive_tatums(beats, marks, "t", 10.0).collect(), key=lambda r: (r.t, r.which))
    starts = [round(r.start, 6) for r in rows if r.t == 1]
    assert starts[:7] == [0.0, 0.3, 0.6, 1.0, 1.4, 2.0, 2.5] and 3.3 in starts and 5.5 in starts and len(starts) == 21
    assert rows[1].confidence == 1.0 and [r.start for r in rows if r.t == 2] == [0.0, 0.5]
    busy = spark.createDataFrame([(1, k, float(k % 3 == 1)) for k in range(100)], "t int, frame int, onset double")
    assert folds.adaptive_tatums(beats.where("t = 1"), busy, "t", 10.0).count() <= 26


def test_greedy_suppression_and_beat_path_against_loops(spark):
    rng = random.Random(6)
    rows = [(t, rng.random() * 20, rng.random()) for t in range(3) for _ in range(60)]
    df = spark.createDataFrame(rows, "t int, x double, s double")
    got = {(r.t, r.x) for r in folds.greedy_suppression(df, "t", "x", "s", 0.7).collect()}
    want = set()
    for t in range(3):
        held = []
        for _, x, _ in sorted((r for r in rows if r[0] == t), key=lambda r: -r[2]):
            if all(abs(x - h) >= 0.7 for h in held):
                held.append(x)
        want |= {(t, x) for x in held}
    assert got == want
    for t in range(3):
        own = sorted((x, s) for k, x, s in rows if k == t)
        best = []
        for i, (x, s) in enumerate(own):
            steps = [best[j] - 100 * np.log((x - own[j][0]) / 1.5) ** 2 for j in range(i) if 0.75 <= x - own[j][0] <= 3.0]
            best.append(s + max([0, *steps]))
        chain = [r for r in folds.beat_path(df, "t", "x", "s", 1.5).collect() if r.t == t]
        assert max(r.total for r in chain) == pytest.approx(max(best))


def test_hop_cost_has_no_limit_and_late_anchor_takes_the_latest(spark):
    quanta = spark.range(101).select(F.lit(1).alias("t"), F.col("id").alias("which"))
    steps = spark.createDataFrame([(1, 10 * k, 10 * k - 11 if k > 1 else 0, 1.0) for k in range(1, 11)], "t int, src long, dst long, distance double")
    targets = spark.createDataFrame([(1, 0)], "t int, target long")
    hops = {r.which: r.hops for r in graph.hop_cost(quanta, steps, targets, "t").collect()}
    assert hops[0] == 0 and hops[100] == 10 and hops[91] == 10 and hops[5] == 1
    edges = spark.createDataFrame([(1, 70, 2, 3.0), (1, 95, 6, 9.0), (1, 90, 60, 1.0), (1, 99, 80, 1.0)], "t int, src long, dst long, distance double")
    reach = graph.reachability(quanta, edges, "t")
    target = graph.early_target(edges, reach.select("t", "n").distinct(), "t")
    assert target.first().target == 25
    costs = graph.hop_cost(quanta, edges, target, "t")
    best = graph.late_anchor(edges, reach, costs, target, "t").first()
    assert (best.src, best.dst, best.hops, best.tier) == (95, 6, 0, 1)


def test_clusters_and_order_follow_the_policy(spark):
    quanta = spark.createDataFrame([(1, 100)], "t int, n long")
    pairs = spark.createDataFrame([(1, 40, 60, 5.0), (1, 40, 20, 5.0), (1, 40, 90, 5.0), (1, 40, 41, 1.0)], "t int, src long, dst long, distance double")
    best = graph.top_neighbours(graph.structural_score(pairs, quanta, "t"), "t", 3).orderBy("rank").collect()
    assert [r.dst for r in best][0] in (20, 90) and 41 not in [r.dst for r in best]
    edges = spark.createDataFrame([(1, 2, 10, 5.0, 30.0, False, True, False, True), (1, 3, 11, 4.0, 20.0, False, True, False, False), (1, 2, 90, 1.0, 1.0, True, False, False, False)], "t int, src long, dst long, distance double, score double, section_change boolean, short_local boolean, local_loop boolean, boundary boolean")
    gone = {(r.src, r.dst): r.deleted for r in graph.prune_clusters(edges, "t").collect()}
    assert gone == {(2, 10): True, (3, 11): False, (2, 90): False}
    assert graph.prune_clusters(edges.withColumn("boundary", F.lit(False)), "t").where("deleted").count() == 2


def test_downbeats_that_do_not_rise_go_together(spark):
    beats = spark.createDataFrame([(t, k, 0.5 * k, 0.5, 0.8) for t in (1, 2, 3) for k in range(8)], "t int, which long, start double, duration double, confidence double")
    down = spark.createDataFrame([(1, 0, 0.02), (1, 1, 2.03), (2, 0, 2.0), (2, 1, 1.0), (3, 0, 0.26), (4, 0, 1.0), (5, 0, float("nan"))], "t int, place int, start double")
    got = {r.t: (r.kept, r.reason) for r in hierarchy.sane_downbeats(beats, down, "t", 0.1).collect()}
    assert got == {1: (2, None), 2: (0, "downbeats-not-strictly-increasing"), 3: (0, "downbeat-not-aligned-to-beat"), 4: (0, "beats-missing"), 5: (0, "downbeats-not-finite")}
    bars = [(r.bar, r.start, r.duration) for r in hierarchy.bars_from_downbeats(beats.where("t = 1"), down, "t").orderBy("bar").collect()]
    assert bars == [(0, 0.0, 2.0), (1, 2.0, 2.0)]
    assert timeline.refined_period(beats.withColumn("x", F.lit(1.0)), "t", "which", "x", 4.0).first().period is None
