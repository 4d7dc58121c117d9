"""Blocked neighbours against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strophe.operators import graph, neighbours
from strophe.plans import registry

SCHEMA = "label int, which long, index_in_parent int, v array<double>, extra string"


def quanta(spark, vectors, index=lambda i: i % 4, label=1):
    return spark.createDataFrame([(label, i, index(i), [float(x) for x in v], None) for i, v in enumerate(vectors)], SCHEMA)


def kept(found, sizes, k):
    best = graph.top_neighbours(graph.structural_score(found, sizes, "label"), "label", k)
    return sorted((r.label, r.src, r.dst, round(r.distance, 9), r["rank"]) for r in best.select("label", "src", "dst", "distance", "rank").collect())


@pytest.mark.parametrize("kind", ["ties", "odd bars", "norms"])
def test_blocks_give_the_rows_of_all_pairs(spark, monkeypatch, kind):
    rnd = np.random.default_rng(7)
    vectors = {"ties": rnd.integers(0, 2, (160, 3)), "odd bars": rnd.normal(size=(150, 4)), "norms": rnd.normal(size=(150, 4)) * rnd.choice([0.1, 1, 9], (150, 1))}[kind]
    rows = quanta(spark, vectors, (lambda i: i * 7 % 5) if kind == "odd bars" else (lambda i: i % 4)).unionByName(quanta(spark, vectors[:3], label=2))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    pairs = graph.candidate_pairs(rows, "label", "v", 20.0, 60.0)
    near = graph.look_ahead(pairs, sizes.select("label", F.lit(80.0).alias("applied")), "label", 2)
    want = kept(near, sizes, 4)
    assert want
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    assert kept(neighbours.nearest(rows, sizes, "label", "v", 20.0, 60.0, 4), sizes, 4) == want


def test_no_quanta_no_neighbours(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert not neighbours.nearest(rows, rows.groupBy("label").agg(F.count("*").alias("n")), "label", "v", 1.0, 80.0, 4).collect()
    with pytest.raises(ValueError, match="penalty"):
        neighbours.nearest(rows, rows, "label", "v", 1.0, 101.0, 4)


def test_a_track_of_twenty_thousand_quanta(spark):
    """The k best of sampled sources by brute force; no pair list of the track is made."""
    rnd, n = np.random.default_rng(3), 20_000
    vectors = rnd.normal(size=(n, 8))
    frame = pd.DataFrame({"label": 1, "which": np.arange(n), "index_in_parent": np.arange(n) % 4, "v": vectors.tolist(), "extra": ""})
    rows = spark.createDataFrame(frame, SCHEMA)
    sizes = spark.createDataFrame([(1, n)], "label int, n long")
    found = neighbours.nearest(rows, sizes, "label", "v", 10.0, 60.0, 4, ahead=False).toPandas()
    assert (found.groupby("src").size() <= 4 * 2 + 6).all()
    far = found[(found["src"] - found["dst"]).abs() >= 16].groupby("src")
    for src in rnd.integers(0, n, 40):
        other = np.arange(n)
        other = other[(other % 4 == src % 4) & (abs(other - src) >= 16)]
        distance = 10.0 * np.sqrt(((vectors[other] - vectors[src]) ** 2).sum(axis=1))
        want = sorted(distance[distance < 60])[:4]
        got = sorted(far.get_group(src)["distance"])[:4] if src in far.groups else []
        assert np.allclose(got, want)


def test_look_ahead_by_window(spark):
    pairs = spark.createDataFrame([("t", 0, 5, 1.0), ("t", 1, 6, 2.0), ("t", 2, 7, 9.0), ("t", 4, 9, 1.0), ("u", 1, 6, 1.0), ("t", 1, 7, 1.0)], "track string, src long, dst long, distance double")
    limit = spark.createDataFrame([("t", 9.0), ("u", 9.0)], "track string, applied double")
    found = {d: {(r.track, r.src, r.dst) for r in graph.look_ahead(pairs, limit, "track", d).collect()} for d in (1, 2, 3)}
    assert found[1] == {(r.track, r.src, r.dst) for r in pairs.collect()}
    assert found[2] == {("t", 0, 5), ("t", 1, 6)} and found[3] == {("t", 0, 5)}


def rows_of(df):
    return sorted(tuple(r) for r in df.select("label", "src", "dst", "distance").collect())


@pytest.mark.parametrize("kind", ["ties", "odd bars", "holes"])
def test_stretches_give_all_pairs(spark, monkeypatch, kind):
    """Pairs of stretches of 16 and 4,096 places are those of the join, to the last bit; so are those whose next are near."""
    rnd = np.random.default_rng(11)
    vectors = (rnd.integers(0, 2, (90, 3)) if kind == "ties" else rnd.normal(size=(90, 4))).astype(float).tolist()
    if kind == "holes":  # null vectors and elements, other lengths, NaN, infinite and huge values, a place left out
        vectors[3], vectors[20], vectors[40], vectors[41], vectors[50], vectors[51], vectors[52] = None, vectors[20][:2], [], [float("nan")] * 4, [float("inf"), 1.0, 1.0, 1.0], [1e200, 0.0, 0.0, 0.0], [1e200, 0.0, 0.5, 0.0]
        vectors[8][1] = vectors[9][0] = None
    index = (lambda i: i * 7 % 5) if kind == "odd bars" else (lambda i: i % 4)
    rows = spark.createDataFrame([(t, i, index(i), v, None) for t, n in ((1, 90), (2, 5), (None, 9)) for i, v in enumerate(vectors[:n]) if (kind, i) != ("holes", 60)], SCHEMA)
    pairs = graph.candidate_pairs(rows, "label", "v", 20.0, 60.0)
    limits = spark.createDataFrame([(1, 55.0), (2, 40.0)], "label int, applied double")
    for size in (16, 4096):
        monkeypatch.setattr(neighbours, "STRETCH", size)
        assert rows_of(neighbours.all_pairs(rows, "label", "v", 20.0, 60.0)) == rows_of(pairs) != []
        for depth in (1, 3):
            got = neighbours.all_pairs(rows.join(limits, "label"), "label", "v", 20.0, 60.0, depth, F.col("applied"), ("extra",))
            assert got.columns == ["label", "src", "dst", "distance", "extra"] and rows_of(got) == rows_of(graph.look_ahead(pairs, limits, "label", depth)) != []
    with pytest.raises(ValueError, match="penalty"):
        neighbours.all_pairs(rows, "label", "v", 1.0, 101.0)


def wide_exchanges(df):
    """Joins of a plan whose sides are shuffled or sorted: those of all pairs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]


def test_scores_of_all_pairs_join_no_track_with_itself(spark):
    found = registry.structural_score(spark, "/root/testdata/sf0.001")
    assert not wide_exchanges(found) and "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_look_ahead_over_all_pairs_makes_no_pair_list(spark):
    """Pairs aren't joined, shuffled or sorted to look ahead; the rows are those of the window over all pairs."""
    found, q = registry.look_ahead_gate(spark, "/root/testdata/sf0.001"), registry.quanta(spark, "/root/testdata/sf0.001")
    assert not wide_exchanges(found) and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    limits = q.select("label").distinct().withColumn("applied", F.lit(70))
    want = graph.look_ahead(graph.candidate_pairs(q, "label", "v", 50.0, 80.0), limits, "label")
    assert rows_of(found) == rows_of(registry.rounded(want, "distance")) != []


def test_marks_are_the_rules_of_an_edge(spark):
    """Scores of edges at random by the rules, spelt out; a null distance is no exceptional match."""
    rnd = np.random.default_rng(5)
    edges = [(1, int(a), int(b), None if k % 9 == 0 else float(rnd.choice([3.0, 8.0, 20.0]))) for k, (a, b) in enumerate(zip(rnd.integers(0, 90, 400), rnd.integers(0, 90, 400), strict=True)) if a != b]
    rows = spark.createDataFrame(edges, "label int, src long, dst long, distance double")
    sizes = spark.createDataFrame([(1, 90)], "label int, n long")
    scored = graph.structural_score(rows, sizes, "label")
    assert scored.columns == ["label", "src", "dst", "distance", "short_local", "local_loop", "section_change", "boundary", "bonus", "reasons", "decision", "penalty", "score"]
    told = graph.structural_score(rows.withColumn("n", F.lit(90).cast("long")), None, "label", separator=",")
    assert sorted((r.src, r.dst, ",".join(r.reasons)) for r in scored.collect()) == sorted((r.src, r.dst, r.reasons) for r in told.collect())
    for r in scored.collect():
        j, a, b = abs(r.dst - r.src), r.src // 4, r.dst // 4
        same, change, edge, gain, close = r.src % 4 == r.dst % 4, a // 8 != b // 8, {a % 8, b % 8} & {0, 7} != set(), j >= 45, (r.distance if r.distance is not None else 99.0) <= 8
        local = j < 16 and not (change or edge or gain)
        loop = local and (a // 4 == b // 4 or a // 8 == b // 8)
        minus = (35 if j < 4 else 18 if j < 16 else 0) + (0 if same else 18 if j < 16 else 8) + 8 * (a % 4 != b % 4 and j < 16) + 28 * local + 18 * loop
        plus = 12 * (j >= 32) + (0 if not same else 4 if j < 16 else 8) + 3 * (a % 4 == b % 4) + 3 * (a % 8 == b % 8) + 3 * (a % 16 == b % 16 and j >= 32) + 12 * change + 8 * edge + 8 * gain + 4 * close
        evidence = (change or edge or gain) and same and not loop
        unsure = j < 4 and evidence and r.distance is None
        rejected = (j < 4 and not (evidence and close) and not unsure) or (4 <= j < 16 and local and not evidence)
        penalty = max(0, minus - min(minus, plus))
        assert (r.bonus, r.penalty, r.decision, r.short_local, r.local_loop) == (plus, penalty, "rejected" if rejected else "accepted", local, loop)
        assert r.score == (None if r.distance is None else r.distance + penalty)
