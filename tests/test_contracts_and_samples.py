"""Contracts, the escape guard and resampling against plain forms of the same."""

import random

import numpy as np
import pytest

from strophe.operators import contracts, escape, resample

FULL = '{"info": {}, "audio_summary": {"duration": 1}, "analysis": {"sections": [], "bars": [], "beats": [%s], "tatums": [], "segments": []}}'


def test_contract_cases(spark):
    quantum = '{"start": 0, "duration": 1e3, "confidence": 0.5, "more": "free"}'
    rows = [
        ("fine", FULL % quantum), ("null", None), ("bad", "{"), ("list", "[]"), ("scalar", "3"), ("empty", "{}"),
        ("element", FULL % f"{quantum}, null, [], {quantum}"), ("kinds", FULL % '{"start": "0", "duration": true, "confidence": -1e999}'),
    ]
    found = {}
    for r in contracts.violation_rows(spark.createDataFrame(rows, "key string, document string"), "key", "document").collect():
        found.setdefault(r["key"], set()).add((r.path, r.place, r.message))
    root = {("Analysis root", None, "Analysis root must be an object.")}
    assert "fine" not in found and found["null"] == found["bad"] == found["list"] == found["scalar"] == root
    assert {x[0] for x in found["empty"]} == {"info", "audio_summary", "analysis"}
    assert found["element"] == {(f"analysis.beats[{k}]", k, f"analysis.beats[{k}] must be an object.") for k in (1, 2)}
    assert {x[0] for x in found["kinds"]} == {f"analysis.beats[0].{x}" for x in ("start", "duration", "confidence")}
    assert not contracts.violation_rows(spark.createDataFrame([], "key string, document string"), "key", "document").collect()


def test_contracts_nest(spark):
    spec = {"a": [[contracts.NUMBER]], "b": {"c": {"d": [{"e": contracts.NUMBER}]}}}
    text = '{"a": [[1], [2, "x"], 3], "b": {"c": {"d": [{"e": 1}, {}]}}}'
    got = contracts.violation_rows(spark.createDataFrame([(1, text)], "key int, document string"), "key", "document", spec).collect()
    assert {(r.path, r.place) for r in got} == {("a[1][1]", 1), ("a[2]", 2), ("b.c.d[1].e", 1)}


def can_leave(at, edges, zone, n, ahead, depth):
    if depth == 0:
        return False
    jumps = [(s, d) for s, d in edges if at <= s < at + ahead and s != d and 0 <= d < n]
    return any(not zone[d] or can_leave(d, edges, zone, n, ahead, depth - 1) for s, d in jumps)


def test_escape_guard_matches_a_search(spark):
    rnd, quanta, edges, want = random.Random(6), [], [], {}
    for track in range(12):
        n = rnd.randrange(1, 60)
        quanta += [(track, i) for i in range(n)]
        zone = [i >= int(n * 0.7) or n - i <= 5 for i in range(n)]
        own = {(rnd.randrange(n), rnd.choice([rnd.randrange(n), min(n - 1, int(n * 0.7) + rnd.randrange(n)), n + 3])) for _ in range(rnd.randrange(14))}
        gone = {e for e in own if rnd.random() < 0.2}
        edges += [(track, s, d, True if (s, d) in gone else rnd.choice([False, None])) for s, d in own]
        for s, d in own:
            valid = (s, d) not in gone and s != d and d < n
            free = valid and not zone[d]
            left = valid and zone[d] and can_leave(d, own - gone, zone, n, 6, 3)
            want[track, s, d] = (valid and zone[d], free or left, escape.INVALID if not valid else escape.OUTSIDE if free else escape.ESCAPE if left else escape.NO_ESCAPE)
    got = escape.escape_guard(spark.createDataFrame(quanta, "t int, which int"), spark.createDataFrame(edges, "t int, src int, dst int, deleted boolean"), "t", 0.7, 5, 6, 3)
    assert {(r.t, r.src, r.dst): (r.end_zone, r.safe, r.reason) for r in got.collect()} == want
    assert len({x[2] for x in want.values()}) == 4


@pytest.mark.parametrize(("rate", "target"), [(3, 2), (48, 22), (2, 3), (5, 5), (44_100, 22_050)])
def test_resampling_is_a_convolution_over_block_borders(spark, monkeypatch, rate, target):
    monkeypatch.setattr(resample, "BLOCK", 37)
    rnd = np.random.default_rng(4)
    signals = {"a": rnd.normal(size=300), "b": rnd.normal(size=1), None: rnd.normal(size=37)}
    rows = [(k, i, float(x), rate) for k, v in signals.items() for i, x in enumerate(v)] + [("nulls", 0, None, rate)]
    got = {}
    for r in resample.resampled(spark.createDataFrame(rows, "t string, i long, x double, rate int"), "t", "i", "x", "rate", target, 4).orderBy("i").collect():
        got.setdefault(r.t, []).append((r.i, r.x))
    half, cut = resample.reach(rate, target, 4), min(1, target / rate)
    for k, v in signals.items():
        m = -(-len(v) * target // rate)
        assert [i for i, _ in got[k]] == list(range(m))
        for i, x in got[k]:
            place = i * rate // target
            near = np.arange(place - half + 1, place + half + 1)
            t = i * rate / target - near
            w = np.sinc(cut * t) * np.cos(np.pi * t / (2 * half)) ** 2
            want = sum(w[j] * v[q] for j, q in enumerate(near) if 0 <= q < len(v)) / w.sum()
            assert x == pytest.approx(v[i] if rate == target else want, abs=1e-9)
    assert all(x == 0 for _, x in got["nulls"])


def test_tones_keep_their_shape(spark):
    """The stated error bound, for tones up to 1 - 1/16 of the lower rate's half."""
    rate, target, n = 48_000, 22_050, 6_000
    for share in (0.01, 0.4, 0.9):
        hz = share * target / 2
        rows = [(1, i, float(np.sin(2 * np.pi * hz * i / rate)), rate) for i in range(n)]
        out = resample.resampled(spark.createDataFrame(rows, "t int, i long, x double, rate int"), "t", "i", "x", "rate", target).orderBy("i").toPandas()
        want = np.sin(2 * np.pi * hz * out["i"] / target)
        assert abs(out["x"] - want)[100:-100].max() < 0.01
