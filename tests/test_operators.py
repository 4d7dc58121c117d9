import random

from pyspark.sql import functions as F

from strophe.functions import columns as C
from strophe.operators import folds, graph
from strophe.operators.walk import Walk, WalkOptions


def test_similarity_threshold_knots(spark):
    rows = spark.createDataFrame([(0.78, 95.0), (0.86, 80.0), (0.92, 70.0), (0.1, 100.0), (2.0, 65.0)], "s double, t double")
    assert rows.where(C.similarity_threshold(F.col("s")) != F.col("t")).count() == 0


def test_slug(spark):
    rows = spark.createDataFrame([("Été - à_la.Plage!", "ete-a-la-plage"), ("???", "local-audio"), (None, "local-audio")], "x string, want string")
    assert rows.where(C.slug(F.col("x")) != F.col("want")).count() == 0


def test_segment_filter_adds_durations(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, 0.9, [0.0, 0.0, 0.0]), (1, 1, 2.0, 0.1, [0.1, 0.0, 0.0]), (1, 2, 4.0, 0.1, [5.0, 0.0, 0.0]), (1, 3, 8.0, 0.9, [5.0, 0.0, 0.0])], "t int, which int, duration double, confidence double, timbre array<double>")
    assert [(r.which, r.duration) for r in folds.segment_filter(rows, "t").orderBy("which").collect()] == [(0, 3.0), (2, 4.0), (3, 8.0)]


def test_greedy_match_claims_each_reference_once(spark):
    ref = spark.createDataFrame([(1, 0.0), (1, 1.0)], "t int, start double")
    cand = spark.createDataFrame([(1, 0.1), (1, 0.2), (1, 1.05), (2, 1.0)], "t int, start double")
    rows = {r.t: r for r in folds.greedy_match(ref, cand, "t", 0.3).collect()}
    assert (rows[1].matched, rows[1].n_cand, rows[2].n_ref, rows[2].matched) == (2, 3, 0, 0)
    same = folds.greedy_match(ref.where("start >= 0"), ref.where("start < 2"), "t", 0.1).first()
    assert (same.matched, same.f1) == (2, 1.0)


def test_reachability_against_search(spark):
    rng, rows = random.Random(3), []
    n, tracks = 20, 12
    for t in range(tracks):
        rows += [(t, rng.randrange(n), rng.randrange(n), 1.0) for _ in range(rng.randrange(12))]
    quanta = spark.range(tracks).select(F.col("id").cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("which"))
    edges = spark.createDataFrame(rows, "t int, src int, dst int, distance double")
    for r in graph.reachability(quanta, edges, "t").collect():
        seen, queue = set(), [r.which]
        while queue:
            at = queue.pop()
            if at < n and at not in seen:
                seen.add(at)
                queue += [at + 1, *(d for t, s, d, _ in rows if t == r.t and s == at)]
        assert r.earliest == min(seen)


def test_walk_never_jumps_before_the_first_pass():
    walk, beat = Walk([0.5] * 100, {k: [(1.0, 0)] for k in range(100)}, 1, WalkOptions()), 0
    reasons = []
    for _ in range(70):
        beat, _, reason = walk.decide(beat)
        reasons.append(reason)
    assert set(reasons) == {"first-pass"}


def test_slug_of_every_letter(spark):
    """Against the canonical decomposition of each letter up to U+FFFF, alone and between others."""
    import unicodedata

    def plain(text):
        out, pending = "", False
        for c in unicodedata.normalize("NFD", text):
            kind = unicodedata.category(c)
            if kind == "Mn":
                continue
            if kind[0] == "L" or kind == "Nd":
                out, pending = out + ("-" if pending and out else "") + c.lower(), False
            elif c in "-_." or c.isspace():
                pending = bool(out)
        return out or "local-audio"

    # letters that an older Unicode knows too: the JVM may be behind Python
    known = unicodedata.ucd_3_2_0.category
    letters = [chr(k) for k in range(0x20, 0x2000) if known(chr(k)) == unicodedata.category(chr(k)) and known(chr(k))[0] in "LNZPS" and len(chr(k).lower()) == 1]
    texts = [f"{c} x{c}_y" for c in letters] + ["Žižek – ő ș ŵ", "A!b", "  .-_ ", "日本 語", "a b", "😀 z", "été", "-a--b-"]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", C.slug(F.col("x")).alias("s")).collect()
    # a capital sigma at the end of a word has another small letter in Java
    assert [(r.x, r.s) for r in got if r.s != plain(r.x) and "Σ" not in r.x] == []
