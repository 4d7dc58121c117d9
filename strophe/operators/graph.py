"""The similarity graph of a track's quanta: candidates, thresholds, scores, reachability.

A track is small (minutes of audio, some thousand quanta); tracks are many. Everything is
keyed by track, so work spreads by track and no join leaves it.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.columns import l2

MISSING_PENALTY = 100.0
#: Structural scores (fixed values).
PENALTY = {"very-short-jump": 35, "short-jump": 18, "short-phase": 18, "phase": 8, "phrase4-phase": 8, "short-local-risk": 28, "local-loop-risk": 18}
BONUS = {"long-jump": 12, "same-phase-short": 4, "same-phase": 8, "phrase": 3, "section-change": 12, "boundary": 8, "reach-gain": 8, "exceptional": 4}
EXCEPTIONAL = 8.0


def segment_distance(a: str, b: str) -> Column:
    """Weighted distance of two segment structs: timbre 1, pitches 10, loudness start and
    maximum 1 each, duration 100, confidence 1."""
    gap = lambda name, weight: weight * F.abs(F.col(f"{a}.{name}") - F.col(f"{b}.{name}"))
    vectors = l2(F.col(f"{a}.timbre"), F.col(f"{b}.timbre")) + 10.0 * l2(F.col(f"{a}.pitches"), F.col(f"{b}.pitches"))
    return vectors + gap("loudness_start", 1.0) + gap("loudness_max", 1.0) + gap("duration", 100.0) + gap("confidence", 1.0)


def positional_distance(pairs: DataFrame, segments: DataFrame, track: str) -> DataFrame:
    """track, src, dst, distance: the mean over the source's segments of the distance to the
    destination's segment at the same place; a missing or the very same segment counts 100. A
    source without segments is infinitely far from everything.

    ``segments`` has track, quantum, place, segment (an id) and the struct ``s``. The distance
    is driven by the source, so it isn't symmetric.
    """
    a = segments.select(track, F.col("quantum").alias("src"), "place", F.col("segment").alias("_ia"), F.col("s").alias("a"))
    b = segments.select(track, F.col("quantum").alias("dst"), "place", F.col("segment").alias("_ib"), F.col("s").alias("b"))
    rows = pairs.join(a, [track, "src"], "left").join(b, [track, "dst", "place"], "left")
    d = F.when(F.col("_ib").isNull() | (F.col("_ia") == F.col("_ib")), F.lit(MISSING_PENALTY)).otherwise(segment_distance("a", "b"))
    d = F.when(F.col("_ia").isNull(), float("inf")).otherwise(d)
    return rows.withColumn("d", d).groupBy(track, "src", "dst").agg(F.avg("d").alias("distance"))


def candidate_pairs(quanta: DataFrame, track: str, vector: str, scale: float, max_distance: float, min_jump: int = 0) -> DataFrame:
    """track, src, dst, distance under ``max_distance`` between quanta (track, which,
    index_in_parent, vector).

    A different index in the parent adds 100 to a distance, so up to a limit of 100 only
    equal indexes can pass: the penalty becomes a join key.
    """
    a = quanta.select(track, F.col("which").alias("src"), F.col("index_in_parent").alias("_i"), F.col(vector).alias("_a"))
    b = quanta.select(track, F.col("which").alias("dst"), F.col("index_in_parent").alias("_j"), F.col(vector).alias("_b"))
    rows = a.join(b.withColumn("_i", F.col("_j")), [track, "_i"]) if max_distance <= MISSING_PENALTY else a.join(b, track)
    jump = F.abs(F.col("dst") - F.col("src"))
    rows = rows.where((F.col("src") != F.col("dst")) & ((jump >= min_jump) if min_jump > 4 else F.lit(True)))
    penalty = F.when(F.col("_i") == F.col("_j"), 0.0).otherwise(MISSING_PENALTY)
    return rows.select(track, "src", "dst", (scale * l2(F.col("_a"), F.col("_b")) + penalty).alias("distance")).where(F.col("distance") < max_distance)


def top_neighbours(scored: DataFrame, track: str, k: int) -> DataFrame:
    """The k best accepted destinations of a source: distance, penalty, no local loop, no short
    local jump, the longer jump, dst. ``scored`` is what ``structural_score`` gives."""
    jump = F.abs(F.col("dst") - F.col("src"))
    order = Window.partitionBy(track, "src").orderBy("distance", "penalty", "local_loop", "short_local", jump.desc(), "dst")
    return scored.where("decision = 'accepted'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def by_score(edges: DataFrame, track: str) -> DataFrame:
    """Adds score_rank: the place among a source's edges by score, distance, longer jump, dst."""
    order = Window.partitionBy(track, "src").orderBy("score", "distance", F.abs(F.col("dst") - F.col("src")).desc(), "dst")
    return edges.withColumn("score_rank", F.row_number().over(order))


def best_backward(edges: DataFrame, sizes: DataFrame, track: str, max_distance: float | Column) -> DataFrame:
    """The edge of a track that leads back furthest: track, src, dst, distance, percent.

    Ties go by distance, score, dst and src.
    """
    back = edges.where((F.col("dst") < F.col("src")) & (F.col("distance") < max_distance)).join(sizes, track)
    rows = back.withColumn("percent", (F.col("src") - F.col("dst")) * 100.0 / F.col("n"))
    order = Window.partitionBy(track).orderBy(F.desc("percent"), "distance", "score", "dst", "src")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(track, "src", "dst", "distance", "percent")


def delete_edges(edges: DataFrame, listed: DataFrame, track: str) -> DataFrame:
    """Adds deleted: whether an edge (track, src, dst) is in ``listed``."""
    gone = listed.select(track, "src", "dst").distinct().withColumn("_gone", F.lit(True))
    return edges.join(gone, [track, "src", "dst"], "left").withColumn("deleted", F.coalesce("_gone", F.lit(False))).drop("_gone")


def threshold_sweep(pairs: DataFrame, sizes: DataFrame, track: str, first: int = 10, step: int = 5, limit: int = 80) -> DataFrame:
    """track, reported, applied: the first of 10, 15, ... below ``limit`` at which a sixth of
    the track's ``n`` quanta have a neighbour. One pass instead of a loop: a source counts
    from its least distance on. If none does, ``limit`` is reported and the last tried applied.
    """
    last = first + (limit - 1 - first) // step * step
    least = pairs.groupBy(track, "src").agg(F.min("distance").alias("d"))
    tries = least.select(track, F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))).alias("t"), "d").where("d <= t")
    counts = tries.groupBy(track, "t").agg(F.count("*").alias("sources"))
    enough = sizes.join(counts, track, "left").groupBy(track).agg(F.min(F.when(F.col("sources") >= F.col("n") / 6, F.col("t"))).alias("t"))
    return enough.select(track, F.coalesce("t", F.lit(limit)).alias("reported"), F.coalesce("t", F.lit(last)).alias("applied"))


def edges_at_threshold(pairs: DataFrame, thresholds: DataFrame, track: str) -> DataFrame:
    """The pairs, with all their columns, within their track's threshold."""
    return pairs.join(thresholds, track).where(F.col("distance") <= F.col("applied")).select(*pairs.columns)


def look_ahead(pairs: DataFrame, thresholds: DataFrame, track: str, depth: int = 3) -> DataFrame:
    """Pairs of which every (src + o, dst + o), o below ``depth``, is within the threshold too.

    Pairs of one jump stand in a row by src, so one window looks ahead; (src, dst) is unique."""
    near = pairs.join(thresholds, track).where(F.col("distance") <= F.col("applied")).select(track, "src", "dst", "distance")
    along = Window.partitionBy(track, F.col("dst") - F.col("src")).orderBy("src")
    follow = reduce(lambda a, b: a & b, (F.lead("src", o).over(along) == F.col("src") + o for o in range(1, depth)), F.lit(True))
    return near.withColumn("_follow", follow).where("_follow").drop("_follow")


#: What the structural score of a jump hangs on, true or false, and whether its distance is exceptional (1), not (0) or null (2).
MARKS = ("very", "short", "far", "same", "phase4", "phase8", "phase16", "change", "boundary", "gain", "together")


def structural_marks(spark, separator: str | None = None) -> DataFrame:
    """A row for each way in which a jump can be marked: _code, penalty, bonus, reasons, decision and the flags."""
    codes = spark.range(0, 3 << len(MARKS), 1, 1)
    mark = {name: F.getbit("id", F.lit(k)) == 1 for k, name in enumerate(MARKS)}
    state = F.shiftright("id", len(MARKS))
    very, is_short, far, same, change, boundary, gain = (mark[x] for x in ("very", "short", "far", "same", "change", "boundary", "gain"))
    phase, close = {n: mark[f"phase{n}"] for n in (4, 8, 16)}, F.when(state < 2, state == 1)
    local = is_short & ~change & ~boundary & ~gain
    loop = local & mark["together"]
    # condition, reason, penalty, bonus - in the order in which reasons are listed
    rules = [
        (very, "very-short-jump", PENALTY["very-short-jump"], 0),
        (~very & is_short, "short-jump", PENALTY["short-jump"], 0),
        (~is_short & far, "long-jump", 0, BONUS["long-jump"]),
        (~is_short & ~far, "medium-jump", 0, 0),
        (same & is_short, "same-bar-phase", 0, BONUS["same-phase-short"]),
        (same & ~is_short, "same-bar-phase", 0, BONUS["same-phase"]),
        (~same & is_short, "bar-phase-mismatch", PENALTY["short-phase"], 0),
        (~same & ~is_short, "bar-phase-mismatch", PENALTY["phase"], 0),
        (phase[4], "same-phrase4-phase", 0, BONUS["phrase"]),
        (~phase[4] & is_short, "phrase4-phase-mismatch", PENALTY["phrase4-phase"], 0),
        (phase[8], "same-phrase8-phase", 0, BONUS["phrase"]),
        (phase[16] & far, "same-phrase16-phase", 0, BONUS["phrase"]),
        (change, "section-change", 0, BONUS["section-change"]),
        (boundary, "structural-boundary", 0, BONUS["boundary"]),
        (gain, "reach-gain", 0, BONUS["reach-gain"]),
        (local, "short-local-risk", PENALTY["short-local-risk"], 0),
        (loop, "local-loop-risk", PENALTY["local-loop-risk"], 0),
        (close, "exceptional-acoustic-match", 0, BONUS["exceptional"]),
    ]
    evidence = (change | boundary | gain) & same & ~loop
    bad_very = very & ~(evidence & close)
    bad_short = ~bad_very & is_short & local & ~evidence
    names = [F.when(c, F.lit(name)) for c, name, _, _ in rules] + [F.when(bad_very, F.lit("rejected-very-short-local")), F.when(bad_short, F.lit("rejected-short-local"))]
    total = lambda k: sum((F.when(r[0], float(r[k])).otherwise(0.0) for r in rules if r[k]), F.lit(0.0))
    reasons = F.array_compact(F.array(*names)) if separator is None else F.concat_ws(separator, *names)
    rows = codes.select(F.col("id").alias("_code"), local.alias("short_local"), loop.alias("local_loop"), change.alias("section_change"), boundary.alias("boundary"), total(2).alias("_p"), total(3).alias("bonus"), reasons.alias("reasons"), F.when(bad_very | bad_short, "rejected").otherwise("accepted").alias("decision"))
    return rows.withColumn("penalty", F.greatest(F.lit(0.0), F.col("_p") - F.least("_p", "bonus"))).drop("_p")


def structural_score(edges: DataFrame, sizes: DataFrame | None, track: str, beats_per_bar: int = 4, section_bars: int = 8, very_short_bars: int = 1, short_bars: int = 4, phrase_bars: int = 8, boundary_bars: int = 1, separator: str | None = None) -> DataFrame:
    """Adds penalty, bonus, score, reasons, decision and the flags short_local, local_loop,
    section_change and boundary to edges (track, src, dst, distance).

    Bars, phrases and sections follow from the beat's number. The bonus pays off the penalty
    and no more; short jumps without structural evidence are rejected. Without ``sizes`` the edges have
    their track's n. With a ``separator`` reasons are one text.

    An edge is marked by a number, and what that stands for is looked up in a small table: rules and texts are
    worked out once for each way to be marked, not for each edge.
    """
    rows = edges if sizes is None else edges.join(sizes, track)
    bar = {x: F.floor(F.col(x) / beats_per_bar) for x in ("src", "dst")}
    section = {x: F.floor(bar[x] / section_bars) for x in bar}
    in_section = {x: F.pmod(bar[x], F.lit(section_bars)) for x in bar}
    jump = F.abs(F.col("dst") - F.col("src"))
    very, short, phrase = (beats_per_bar * x for x in (very_short_bars, short_bars, phrase_bars))
    edge_of = lambda x: (in_section[x] < boundary_bars) | (in_section[x] >= section_bars - boundary_bars)
    found = {
        "very": jump < very, "short": jump < short, "far": jump >= phrase, "same": F.pmod(F.col("src"), F.lit(beats_per_bar)) == F.pmod(F.col("dst"), F.lit(beats_per_bar)),
        **{f"phase{n}": F.pmod(bar["src"], F.lit(n)) == F.pmod(bar["dst"], F.lit(n)) for n in (4, 8, 16)}, "change": section["src"] != section["dst"], "boundary": edge_of("src") | edge_of("dst"),
        "gain": jump >= F.greatest(F.lit(short), F.floor(F.col("n") / 2)), "together": (F.floor(bar["src"] / 4) == F.floor(bar["dst"] / 4)) | (F.floor(bar["src"] / 8) == F.floor(bar["dst"] / 8)),
    }
    state = F.when(F.col("distance") <= EXCEPTIONAL, 1).when(F.col("distance").isNull(), 2).otherwise(0)
    code = sum((F.when(found[name], 1 << k).otherwise(0) for k, name in enumerate(MARKS)), state * (1 << len(MARKS)))
    marks = F.broadcast(structural_marks(edges.sparkSession, separator))
    rows = rows.withColumn("_code", code.cast("long")).join(marks, "_code").drop("_code", "n")
    return rows.select("*", (F.col("distance") + F.col("penalty")).alias("score")).select(*[x for x in rows.columns if x not in ("penalty", "score")], "penalty", "score")


def reachability(quanta: DataFrame, edges: DataFrame, track: str) -> DataFrame:
    """track, which, n, earliest, reach: the earliest quantum that playing on and jumping can
    come to, and reach = n - earliest.

    From i, playing on meets every source from i on, so one step leads to m(i), the least of
    i and of the destinations of sources not before i. m never falls as i rises and m(i) <= i,
    so repeating it from i ends at the last fixed point up to i: two windows, no loop.
    """
    best = edges.groupBy(track, F.col("src").alias("which")).agg(F.min("dst").alias("_d"))
    order = Window.partitionBy(track).orderBy("which")
    later = order.rowsBetween(0, Window.unboundedFollowing)
    n = F.count("*").over(Window.partitionBy(track))
    step = quanta.select(track, "which").join(best, [track, "which"], "left").select(track, "which", n.alias("n"), F.least("which", F.min("_d").over(later)).alias("_m"))
    fixed = F.max(F.when(F.col("_m") == F.col("which"), F.col("which"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return step.select(track, "which", "n", fixed.alias("earliest")).withColumn("reach", F.col("n") - F.col("earliest"))


def hop_cost(quanta: DataFrame, edges: DataFrame, targets: DataFrame, track: str) -> DataFrame:
    """track, which, hops: jumps needed to come to or before ``target`` (one per track).

    Playing on is free, so k jumps serve every quantum up to P(k): P(0) is the target and
    P(k+1) the larger of P(k) and the last source with a destination up to P(k). The layers of
    a track are followed until they stop growing; what none of them serves has null.
    """

    def layers(key, pdf: pd.DataFrame, target: pd.DataFrame) -> pd.DataFrame:
        if target.empty:
            return pd.DataFrame([], columns=["k", "p"])
        pdf = pdf.sort_values("dst") if len(pdf) else pd.DataFrame({"src": [], "dst": []})
        ends, reach = pdf["dst"].to_numpy(), np.maximum.accumulate(pdf["src"].to_numpy())
        found = [int(target["target"].iloc[0])]
        while (at := np.searchsorted(ends, found[-1], "right")) and reach[at - 1] > found[-1]:
            found.append(int(reach[at - 1]))
        return pd.DataFrame([(key[0], found)], columns=["k", "p"])

    kind = targets.schema[track].dataType.simpleString()
    own = edges.select(track, "src", "dst").groupBy(track).cogroup(targets.select(F.col(track).alias(track), "target").groupBy(track))
    found = own.applyInPandas(layers, f"k {kind}, p array<long>").withColumnRenamed("k", track)
    rows = quanta.select(track, "which").join(found, track, "left")
    first = F.array_position(F.transform("p", lambda x: x >= F.col("which")), True)
    return rows.select(track, "which", F.when(first > 0, first - 1).alias("hops"))


def percent_index(n: Column, percent: int) -> Column:
    """The quantum at a percentage of a track's n."""
    return F.greatest(F.lit(0), F.least(F.floor(n * (percent / 100.0)), n - 1))


def early_target(edges: DataFrame, sizes: DataFrame, track: str, percent: int = 25) -> DataFrame:
    """track, target: the quantum that counts as early enough to come back to.

    The mark at ``percent``, or the first destination of a way back if that is later, or the
    first one from the last third, which counts up to the mark at 55 percent.
    """
    rows = sizes.join(edges.where("dst < src").select(track, "src", "dst"), track, "left").groupBy(track, "n")
    late = F.min(F.when(F.col("src") >= percent_index(F.col("n"), 66), F.col("dst")))
    rows = rows.agg(F.min("dst").alias("first"), late.alias("late"))
    hint = F.when(F.col("late").isNull(), F.col("first")).otherwise(F.least("late", percent_index(F.col("n"), 55)))
    mark = percent_index(F.col("n"), percent)
    return rows.select(track, F.when(F.col("first").isNull(), mark).otherwise(F.least(F.greatest(mark, F.col("first"), hint), F.col("n") - 1)).cast("long").alias("target"))


def last_branch_point(reach: DataFrame, edges: DataFrame, track: str) -> DataFrame:
    """track, last: of quanta with edges, the latest that reaches half the track, else the one
    that reaches most (the later wins ties), else 0."""
    sources = edges.select(track, F.col("src").alias("which")).distinct()
    share = (F.col("reach") - (F.col("n") - F.col("which"))) * 100.0 / F.col("n")
    rows = reach.withColumn("share", share).join(sources.withColumn("_e", F.lit(True)), [track, "which"], "left")
    usable = F.col("_e") & (F.col("share") > 0)
    pick = rows.groupBy(track).agg(F.max(F.when(usable & (F.col("share") >= 50), F.col("which"))).alias("a"), F.max_by("which", F.when(usable, F.struct("share", "which"))).alias("b"))
    return pick.select(track, F.coalesce("a", "b", F.lit(0)).alias("last"))


def sequential_filter(edges: DataFrame, last: DataFrame, track: str) -> DataFrame:
    """Drops edges whose source's predecessor has an edge of the same jump; not from quantum 0
    nor from the last branch point."""
    rows = edges.join(last, track).withColumn("_j", F.col("dst") - F.col("src"))
    before = rows.select(track, (F.col("src") + 1).alias("src"), "_j")
    free = (F.col("src") == 0) | (F.col("src") == F.col("last"))
    return rows.where(free).unionByName(rows.where(~free).join(before, [track, "src", "_j"], "left_anti").select(rows.columns)).drop("_j", "last")


def bad_branch_filter(edges: DataFrame, last: DataFrame, track: str) -> DataFrame:
    """Sources before the last branch point must have destinations before it."""
    return edges.join(last, track).where((F.col("src") >= F.col("last")) | (F.col("dst") < F.col("last"))).drop("last")


def prune_clusters(edges: DataFrame, track: str, window: int = 32, short: int = 16, keep: int = 1) -> DataFrame:
    """Adds deleted: in clusters of two and more short local edges between the same two phrases of
    ``window`` beats, all go if none is at a structural boundary, else all but the best ``keep``
    (score, longer jump, dst, src).

    Short local are edges under ``short`` beats inside a section that are a local risk or stay in a
    phrase. ``edges`` has what ``structural_score`` gives; other edges are never deleted.
    """
    at = {x: F.floor(F.col(x) / window) for x in ("src", "dst")}
    jump = F.abs(F.col("dst") - F.col("src"))
    local = (jump < short) & ~F.col("section_change") & (F.col("short_local") | F.col("local_loop") | (at["src"] == at["dst"]))
    rows = edges.withColumn("_sw", at["src"]).withColumn("_dw", at["dst"]).withColumn("_local", local)
    whole = Window.partitionBy(track, "_sw", "_dw", "_local")
    rank = F.row_number().over(whole.orderBy("score", jump.desc(), "dst", "src"))
    gone = F.col("_local") & (F.count("*").over(whole) >= 2) & (~F.max("boundary").over(whole) | (rank > keep))
    return rows.withColumn("deleted", gone).drop("_sw", "_dw", "_local")


#: Least ways back of the tiers as shares of a long branch, and what the late choice may give
#: up against the best one (fixed values).
TIERS = (1.0, 0.5, 0.25)
LATE = {"hops": 1, "back": 0.60, "slack": 0.02, "least_slack": 4, "landing": 0.50, "near": 4, "near_back": 0.80}


def late_anchor(edges: DataFrame, reach: DataFrame, costs: DataFrame, targets: DataFrame, track: str, min_long: Column | None = None, first_percent: int = 66, late_percent: int = 80) -> DataFrame:
    """The late edge back to a track's early part: track, src, dst, distance, hops, tier.

    A source stands with its best way back (fewest jumps from there to the target, earliest
    reach, distance, longest way). Tier k allows k jumps and asks for a way back of ``min_long``
    (a fifth of the track), a half and a quarter of it; in each, sources from ``late_percent`` on
    come before those from ``first_percent`` on. In the first tier with any, the latest
    source is taken that gives up no more than LATE against the best. Where no tier has any,
    tier 4 is the best edge that needs no further jump.
    """
    cost = ["hops", "earliest", "distance", F.desc("back"), F.desc("src")]
    long = F.greatest(F.lit(1), F.floor(F.col("n") / 5 if min_long is None else min_long))
    ends = reach.select(track, F.col("which").alias("dst"), "n", "earliest").join(costs.select(track, F.col("which").alias("dst"), "hops"), [track, "dst"])
    rows = edges.where("dst < src").select(track, "src", "dst", "distance").join(ends, [track, "dst"]).where("hops is not null").withColumn("back", F.col("src") - F.col("dst"))
    own = Window.partitionBy(track, "src").orderBy("hops", "earliest", "distance", F.desc("back"))
    rows = rows.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r").join(targets, track)
    needs = F.array(*[F.greatest(F.lit(x), F.floor(long * share)).cast("long") for x, share in zip((1, 2, 1), TIERS, strict=True)])
    rows = rows.withColumn("_late", F.col("src") >= F.greatest(percent_index(F.col("n"), first_percent), percent_index(F.col("n"), late_percent)))
    rows = rows.where(F.col("src") >= percent_index(F.col("n"), first_percent)).select("*", F.posexplode(needs).alias("_t", "need"))
    tiered = rows.where((F.col("hops") <= F.col("_t") + 1) & (F.col("earliest") <= F.col("target")) & (F.col("back") >= F.col("need"))).withColumn("_g", 2 * F.col("_t") + F.when(F.col("_late"), 0).otherwise(1))
    direct = rows.where("_t = 0 and hops = 0").withColumn("_g", F.lit(6))
    picked = tiered.unionByName(direct).withColumn("_first", F.min("_g").over(Window.partitionBy(track))).where("_g = _first")
    best = F.first(F.struct("hops", "earliest", "back", "src")).over(Window.partitionBy(track).orderBy(*cost))
    picked = picked.withColumn("b", best)
    slack = F.greatest(F.lit(LATE["least_slack"]), F.floor(F.col("n") * LATE["slack"]))
    fine = (F.col("hops") <= F.col("b.hops") + LATE["hops"]) & (F.col("earliest") <= F.col("b.earliest") + slack) & (F.col("back") >= F.greatest("need", F.floor(F.col("b.back") * LATE["back"])))
    fine = fine & ((F.col("hops") <= F.col("b.hops")) | (F.col("dst") <= F.floor(F.col("n") * LATE["landing"])))
    is_best = F.col("src") == F.col("b.src")
    latest = Window.partitionBy(track).orderBy(F.desc("_fine"), F.desc("src"))
    picked = picked.withColumn("_fine", F.when(F.col("_g") < 6, fine | is_best).otherwise(is_best)).withColumn("_r", F.row_number().over(latest))
    near = (F.abs(F.col("src") - F.col("b.src")) <= LATE["near"]) & (F.col("hops") > F.col("b.hops")) & (F.col("back") < F.col("b.back") * LATE["near_back"])
    picked = picked.withColumn("_back", F.max((F.col("_r") == 1) & near).over(Window.partitionBy(track)))
    chosen = picked.where((F.col("_back") & is_best) | (~F.col("_back") & (F.col("_r") == 1)))
    return chosen.select(track, "src", "dst", "distance", "hops", (F.floor(F.col("_g") / 2) + 1).alias("tier"))


#: The way back, in percent, from which an anchor must be near, and how near with and without it.
LONG_BACK, STRICT, RELAXED = 50.0, 55.0, 65.0
#: What a routing decision is called, in the order in which they are tried.
ROUTES = ["existing-preferred-anchor", "inserted-preferred-anchor", "existing-fallback-anchor", "inserted-fallback-anchor", "legacy-fallback"]


def anchor_limits(edges: DataFrame, sizes: DataFrame, thresholds: DataFrame, track: str) -> DataFrame:
    """track, n, applied, limit: the distance under which an edge may become an anchor."""
    longest = edges.where("dst < src").groupBy(track).agg(F.max(F.col("src") - F.col("dst")).alias("_l"))
    far = F.coalesce("_l", F.lit(0)) * 100.0 / F.col("n") >= LONG_BACK
    rows = sizes.join(thresholds.select(track, "applied"), track).join(longest, track, "left")
    return rows.select(track, "n", "applied", F.when(far, STRICT).otherwise(RELAXED).alias("limit"))


def anchor_routing(candidates: DataFrame, edges: DataFrame, reach: DataFrame, costs: DataFrame, targets: DataFrame, limits: DataFrame, track: str, preferred_percent: int = 80, fallback_percent: int = 66, min_long: Column | None = None) -> DataFrame:
    """track, decision, src, dst, distance, hops, earliest, inserted: how a track comes back from its end.

    In this order: the late anchor among ``edges`` from ``preferred_percent`` on, the best one of
    ``candidates`` to insert there, then the same two from ``fallback_percent`` on. To insert are
    candidates that lead back, aren't edges, and lie over the applied threshold and under the limit
    (fewest jumps to the target, earliest reach, distance, longest way, latest source). A track
    without any has the candidate that leads back furthest, inserted if it is over the threshold,
    or nulls. Every track of ``limits`` has one row.
    """
    ends = reach.select(track, F.col("which").alias("dst"), "earliest")
    preferred = F.col("src") >= percent_index(F.col("n"), preferred_percent)
    held = late_anchor(edges, reach, costs, targets, track, min_long, fallback_percent).join(ends, [track, "dst"]).join(limits, track)
    held = held.withColumn("stage", F.when(preferred, 0).otherwise(2))
    free = candidates.where("dst < src").select(track, "src", "dst", "distance").join(edges.select(track, "src", "dst"), [track, "src", "dst"], "left_anti").join(limits, track)
    free = free.where((F.col("src") >= percent_index(F.col("n"), fallback_percent)) & (F.col("distance") < F.col("limit")) & (F.col("distance") > F.col("applied")))
    free = free.join(ends, [track, "dst"]).join(costs.select(track, F.col("which").alias("dst"), "hops").where("hops is not null"), [track, "dst"])
    order = Window.partitionBy(track).orderBy("stage", "hops", "earliest", "distance", F.desc(F.col("src") - F.col("dst")), F.desc("src"))
    free = free.withColumn("stage", F.when(preferred, 1).otherwise(3)).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    names = [track, "stage", "src", "dst", "distance", "hops", "earliest"]
    routed = held.select(names).unionByName(free.select(names)).withColumn("_r", F.row_number().over(Window.partitionBy(track).orderBy("stage"))).where("_r = 1").drop("_r")
    far = best_backward(candidates.join(limits.select(track, "limit"), track), limits.select(track, "n"), track, F.col("limit"))
    rows = limits.select(track, "applied").join(routed, track, "left").join(far.select(track, F.struct("src", "dst", "distance").alias("_far")), track, "left")
    chosen = {x: F.when(F.col("stage").isNotNull(), F.col(x)).otherwise(F.col("_far")[x]) for x in ("src", "dst", "distance")}
    rows = rows.withColumns(chosen).withColumn("inserted", F.when(F.col("stage").isNull(), F.coalesce(F.col("distance") > F.col("applied"), F.lit(False))).otherwise(F.col("stage").isin(1, 3)))
    decision = F.element_at(F.array(*[F.lit(x) for x in ROUTES]), (F.coalesce("stage", F.lit(4)) + 1).cast("int"))
    return rows.select(track, decision.alias("decision"), "src", "dst", "distance", "hops", "earliest", "inserted")


def valid_edges(edges: DataFrame, quanta: DataFrame, track: str) -> DataFrame:
    """Edges between two different quanta that both exist, with a finite distance, not deleted."""
    ends = quanta.select(track, "which")
    good = edges.where((F.col("src") != F.col("dst")) & ~F.isnan("distance") & (F.abs("distance") != float("inf")) & ~F.col("deleted"))
    for end in ("src", "dst"):
        good = good.join(ends.withColumnRenamed("which", end), [track, end], "left_semi")
    return good


def adjacency(edges: DataFrame, track: str) -> DataFrame:
    """track, src, out: destinations in the order distance, dst."""
    return edges.groupBy(track, "src").agg(F.array_sort(F.collect_list(F.struct("distance", "dst"))).alias("out"))


def choice_cdf(edges: DataFrame, track: str) -> DataFrame:
    """Adds weight = 1 / (1 + distance) and cdf, its running share within a source."""
    w = Window.partitionBy(track, "src")
    weight = 1.0 / (1.0 + F.greatest("distance", F.lit(0.0)))
    rows = edges.withColumn("weight", weight)
    return rows.withColumn("cdf", F.sum("weight").over(w.orderBy("distance", "dst")) / F.sum("weight").over(w))


def branch_counts(edges: DataFrame, track: str, short: int = 16, very_short: int = 4) -> DataFrame:
    """Per track: active, deleted, short, very short edges and the longest way back in percent."""
    jump = F.abs(F.col("dst") - F.col("src"))
    live = ~F.col("deleted")
    return edges.groupBy(track).agg(
        F.count_if(live).alias("active"), F.count_if("deleted").alias("deleted"), F.count_if(live & (jump < short)).alias("short"), F.count_if(live & (jump < very_short)).alias("very_short"),
        F.coalesce(F.max(F.when(live, (F.col("src") - F.col("dst")) * 100.0 / F.col("n"))), F.lit(0.0)).alias("longest_back"),
    )


def short_pairs(quanta: DataFrame, track: str, vector: str, scale: float, short: int = 16) -> DataFrame:
    """track, src, dst, distance of all pairs that jump less than ``short``, whatever their distance.

    Joined by track and place, so the work is linear in a track's quanta and no task holds a track.
    """
    steps = F.array(*[F.lit(k) for k in range(1 - short, short) if k])
    left = quanta.select(track, F.col("which").alias("src"), F.col("index_in_parent").alias("_i"), F.col(vector).alias("_a"), F.explode(steps).alias("_step")).withColumn("dst", F.col("src") + F.col("_step"))
    right = quanta.select(track, F.col("which").alias("dst"), F.col("index_in_parent").alias("_j"), F.col(vector).alias("_b"))
    penalty = F.when(F.col("_i") == F.col("_j"), 0.0).otherwise(MISSING_PENALTY)
    return left.join(right, [track, "dst"]).select(track, "src", "dst", (scale * l2(F.col("_a"), F.col("_b")) + penalty).alias("distance"))


def branch_diagnostics(short: DataFrame, candidates: DataFrame, pruned: DataFrame, sizes: DataFrame, track: str) -> DataFrame:
    """Per track of ``sizes``: n_candidates, n_active, n_removed, n_risk and n_rejected, 0 where it has none.

    ``short`` is ``short_pairs`` with the scores of ``structural_score``: only short jumps are ever rejected,
    and they are counted before the look at their distance. ``candidates`` are a source's neighbours, ``pruned``
    the edges with the mark of ``prune_clusters``; risk counts the active ones that may loop in place.
    """
    live = ~F.col("deleted")
    found = [
        candidates.groupBy(track).agg(F.count("*").alias("n_candidates")), short.where("decision = 'rejected'").groupBy(track).agg(F.count("*").alias("n_rejected")),
        pruned.groupBy(track).agg(F.count_if(live).alias("n_active"), F.count_if("deleted").alias("n_removed"), F.count_if(live & F.col("local_loop")).alias("n_risk")),
    ]
    rows = sizes.select(track)
    for counts in found:
        rows = rows.join(counts, track, "left")
    return rows.na.fill(0, ["n_candidates", "n_active", "n_removed", "n_risk", "n_rejected"])


def self_similarity_novelty(quanta: DataFrame, track: str, vector: str, r: int = 4) -> DataFrame:
    """track, which, novelty: a checkerboard with Gaussian taper run down the diagonal of the
    track's cosine self-similarity. Only pairs inside the kernel are made."""
    from strophe.functions.columns import cosine

    a = quanta.select(track, F.col("which").alias("_i"), F.col(vector).alias("_a"))
    near = a.select(track, "_i", "_a", F.explode(F.sequence(F.lit(1 - 2 * r), F.lit(2 * r - 1))).alias("_o")).withColumn("_j", F.col("_i") + F.col("_o"))
    pairs = near.join(quanta.select(track, F.col("which").alias("_j"), F.col(vector).alias("_b")), [track, "_j"]).select(track, "_i", "_j", cosine(F.col("_a"), F.col("_b")).alias("s"))
    low, high = F.greatest("_i", "_j") - r, F.least("_i", "_j") + r - 1
    spread = pairs.where(low <= high).select(track, "_i", "_j", "s", F.explode(F.sequence(low + 1, high + 1)).alias("which"))
    x, y = F.col("_i") - F.col("which"), F.col("_j") - F.col("which")
    spread = spread.where((x >= -r) & (x < r) & (y >= -r) & (y < r))
    x, y = x + 0.5, y + 0.5
    kernel = F.signum(x * y) * F.exp(-(x * x + y * y) / (2.0 * (r / 2.0) ** 2))
    spread = spread.join(quanta.select(track, "which"), [track, "which"], "left_semi")
    return spread.groupBy(track, "which").agg(F.greatest(F.lit(0.0), F.sum(F.col("s") * kernel)).alias("novelty"))


def layout(edges: DataFrame, sizes: DataFrame, track: str, most: int = 650, per_beat: int = 12) -> DataFrame:
    """The edges to draw on a circle: the ``most`` best of a track by quality and id, with
    src_angle, dst_angle, quality and highlighted (among ``per_beat`` best of their beat).

    ``edges`` has track, id, src, dst, distance; ``sizes`` track, n.
    """
    quality = F.when(F.col("distance").isNull() | F.isnan("distance") | (F.abs("distance") == float("inf")), 0.35).when(F.col("distance") <= 0, 1.0).otherwise(1 / (1 + F.col("distance")))
    rows = edges.where("src <> dst").withColumn("quality", F.greatest(F.lit(0.15), F.least(F.lit(1.0), quality)))
    own = Window.partitionBy(track, "src").orderBy(F.desc("quality"), "dst", "id")
    rows = rows.withColumn("highlighted", F.row_number().over(own) <= per_beat)
    best = Window.partitionBy(track).orderBy(F.desc("quality"), "id")
    rows = rows.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most).join(sizes, track)
    angle = {f"{x}_angle": F.col(x) / F.col("n") * (2 * math.pi) - math.pi / 2 for x in ("src", "dst")}
    return rows.withColumns(angle).drop("_r", "n")
