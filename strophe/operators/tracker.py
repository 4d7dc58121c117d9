"""From onset strengths to beats in one plan over all tracks: tempo candidates, the tempo, the grid
and its refinements, the grid that a provider's rules choose, and a row for each track that can't be
tracked.

A track's strengths are packed into a row, and a task goes through a batch of tracks at once; a track that ends
early (no energy, a broken input, a rejected grid) gets its row while the others go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal
from functools import lru_cache
from itertools import groupby, pairwise
from math import ceil, exp, floor, inf, log, nan

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.operators import beatgrids, hierarchy, timeline
from strophe.plans.tables import settled

#: Tempo bounds, centre and spread of the prior, candidates kept, width of the smoothing, how near tempi count as one.
LOW_BPM, HIGH_BPM, CENTRE, OCTAVES, MOST, WIDTH, SAME = 60.0, 200.0, 120.0, 1.4, 30, 7, 0.001
ENERGY = 1e-9
#: Frames of the tracks that a task takes up at once.
FRAMES = 100_000
#: What the steps of a grid are called.
REFINED, REGULAR = "audio-refined", "regular"
STEPS = {"composite-dp": "composite-dp", "elastic-local-onset": "elastic", "piecewise-window-offset": "piecewise"}
#: Providers, and why an advisor's grid isn't taken.
BUILT_IN, AUTO, ADVISOR, SHADOW, HYBRID = "BuiltIn", "Auto", "BeatThis", "Shadow", "Hybrid"
NOT_CONFIGURED, REJECTED = "beat-this-provider-not-configured", "beat-this-guardrail-rejected:"
#: Codes of error rows.
NO_DURATION, NO_FRAMES, NOT_FINITE, UNKNOWN_PROVIDER, NO_GRID = "invalid-duration", "no-frames", "strength-not-finite", "unsupported-provider", "provider-rejected"


def tempo_score(lag: int, per_second: float) -> float:
    """The prior of a lag's tempo and its penalty, the prior as ``timeline.tempo_weight`` has it."""
    bpm = 60.0 * per_second / lag
    return exp(-0.5 * ((log(bpm / CENTRE) / log(2.0)) / OCTAVES) ** 2.0) * (1.0 if 85.0 <= bpm <= 150.0 else 0.85 if bpm < 70.0 or bpm > 190.0 else 0.95)


@lru_cache(10_000)
def thousandths(bpm: float) -> int:
    """A tempo to three places as it is written, halves to even."""
    return int(Decimal(repr(bpm)).scaleb(3).to_integral_value(ROUND_HALF_EVEN))


def refined_period(frames: np.ndarray, x: np.ndarray, lag: int) -> float | None:
    """``timeline.refined_period`` of one track."""
    top = x.max()
    padded = np.concatenate([[-np.inf], x, [-np.inf]])
    peaks = frames[(top > ENERGY) & (x >= 0.5 * top) & (x >= padded[:-2]) & (x > padded[2:])]
    gaps = np.diff(peaks)
    gaps = gaps[(gaps >= 0.75 * lag) & (gaps <= 1.5 * lag)]
    return float(gaps.sum()) / len(gaps) if len(peaks) >= 3 and len(gaps) else None


def tempi(frames: np.ndarray, x: np.ndarray, per_second: float, low: float, high: float, most: int) -> list[tuple]:
    """The candidates of one track, as ``tempo_candidates`` describes them: bpm, lag, score, origin, harmonic, selected."""
    first = max(1, floor(per_second * 60.0 / high))
    last = max(first + 1, ceil(per_second * 60.0 / low))
    if not len(x) > first or not x.max() > ENERGY:
        return [(min(max(timeline.FALLBACK_BPM, low), high), 0, 0.0, "fallback", "unknown", True)]
    scores = {lag: float(x[:-lag] @ x[lag:]) / (len(x) - lag) * tempo_score(lag, per_second) for lag in range(first, min(last, len(x) - 1) + 1)}
    best = max(scores, key=lambda lag: (scores[lag], -lag))
    slow = 60.0 * per_second / (2 * best)
    if 60.0 * per_second / best >= 170.0 and 75.0 <= slow <= 135.0 and scores.get(2 * best, -1.0) >= scores[best] * (0.45 if 90.0 <= slow <= 120.0 else 0.60):
        best *= 2
    period = refined_period(frames, x, best)
    chosen = min(max(60.0 * per_second / (best if period is None else period), low), high)
    own = [(60.0 * per_second / lag, lag, score, "autocorrelation", False) for lag, score in scores.items()]
    if min(abs(r[0] - chosen) for r in own) > SAME:
        own.append((chosen, best, scores[best], "refined-peak", True))
    rows = []
    for k, (name, role, ratio) in enumerate(hierarchy.HARMONICS):
        for bpm, lag, score, origin, late in own:
            other = bpm * ratio
            if k == 0 or low <= other <= high:
                rows.append((-score if k == 0 else -(score * 0.92), k > 0, late, lag, k, other, lag if k == 0 else max(1, round(lag * bpm / other)), name or origin, role))
    rows.sort()
    seen, kept = set(), []
    for r in rows:
        if (same := thousandths(r[5])) not in seen:
            seen.add(same)
            kept.append(r)
    kept = kept[:most]
    gap, nearest = min((abs(r[5] - chosen), k) for k, r in enumerate(kept))
    return [(r[5], r[6], -r[0], r[7], r[8], k == nearest and gap <= SAME) for k, r in enumerate(kept)]


def packed(df: DataFrame, track: str, *names: str) -> DataFrame:
    """track, _s: the rows of a track as one array of structs of ``names``."""
    return df.groupBy(track).agg(F.collect_list(F.struct(*names)).alias("_s"))


def unpacked(column: pa.Array) -> list[dict[str, np.ndarray]]:
    """The arrays of structs of ``packed``, a dictionary of arrays each, in the order of their first name; empty ones for null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy()
    rows, ends = column.flatten(), np.append(0, lengths.cumsum())
    names = [field.name for field in rows.type]
    fields = [x.to_numpy(zero_copy_only=False) for x in rows.flatten()]
    out = []
    for low, high in pairwise(ends.tolist()):
        own = [x[low:high] for x in fields]
        if (np.diff(own[0]) < 0).any():
            order = np.argsort(own[0], kind="stable")
            own = [x[order] for x in own]
        out.append(dict(zip(names, own, strict=True)))
    return out


def shares(tracks: list[int], sizes: list[int]) -> list[list[int]]:
    """Tracks in turn, as many together as have FRAMES frames, one at least."""
    ends = np.cumsum(sizes) // FRAMES if sizes else []
    return [[k for k, _ in own] for _, own in groupby(zip(tracks, ends, strict=True), key=lambda x: x[1])]


def tempo_candidates(odf: DataFrame, track: str, x: str, per_second: float, low: float = LOW_BPM, high: float = HIGH_BPM, most: int = MOST) -> DataFrame:
    """track, place, bpm, lag, score, origin, harmonic, selected: the tempi that strengths (track, frame, x) suggest.

    A lag's score is its mean product under the prior and the penalty of extreme tempi. The best lag, or
    twice it (``hierarchy.half_time``), refined by the distances of the track's own peaks, is selected; where no
    candidate has its tempo it becomes one (refined-peak). Then come halves, doubles, 3/4 and 4/3
    (``hierarchy.harmonic_tempos``). A series without energy or too short for any lag has one candidate, the fallback.
    A track's series is a row, and a task goes through many.
    """
    kind = odf.schema[track].dataType.simpleString()
    schema = f"`{track}` {kind}, place long, bpm double, lag long, score double, origin string, harmonic string, selected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(k, *t) for k, t in enumerate(tempi(own["frame"], own["x"].astype(float), per_second, low, high, most))] for own in unpacked(batch.column(1))]
            tracks = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
            columns = list(zip(*(t for f in found for t in f), strict=True)) or [[]] * 7
            yield pa.record_batch([tracks, *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.string(), pa.string(), pa.bool_()), strict=True))], names=[track, "place", "bpm", "lag", "score", "origin", "harmonic", "selected"])

    return packed(odf.select(track, "frame", F.col(x).cast("double").alias("x")), track, "frame", "x").mapInArrow(run, schema)


def chosen_tempo(candidates: list[tuple], fits: list[float]) -> float:
    """``beatgrids.selected_tempo`` of one track; NaN in ``fits`` where a candidate has no score."""
    score = lambda k: (-candidates[k][2], k)
    best = min(range(len(candidates)), key=lambda k: (inf if fits[k] != fits[k] else -fits[k], k))
    bpm = candidates[best][0]
    double = [k for k, c in enumerate(candidates) if bpm < beatgrids.SLOW and c[0] >= beatgrids.FAST and abs(c[0] - 2 * bpm) / max(1.0, 2 * bpm) <= beatgrids.NEAR_DOUBLE]
    primary = [k for k, c in enumerate(candidates) if c[0] >= beatgrids.SLOWEST and c[3] == "autocorrelation"]
    if double:
        return candidates[min(double, key=score)][0]
    if primary and candidates[k := min(primary, key=score)][2] >= candidates[best][2] * beatgrids.NEAR_BEST:
        return candidates[k][0]
    return bpm


def chosen_tempi(tracks: list[dict], candidates: list[list[tuple]], per_second: float, tightness: float) -> list[tuple[float, np.ndarray | None]]:
    """A track's tempo whose own beats fit best, and the beats of its chain (None if that tempo wasn't tried)."""
    jobs, tops = [], []
    for t, own in enumerate(candidates):
        tops.append(max(beatgrids.ENERGY, *(c[2] for c in own)))
        jobs += [(t, k) for k in [k for k, c in enumerate(own) if c[0] >= beatgrids.SLOWEST][: beatgrids.MOST] if own[k][0] < inf]
    tried = [candidates[t][k] for t, k in jobs]
    which = np.array([t for t, _ in jobs], int)
    fits, chains = beatgrids.tempo_scores_of(
        [own["_odf"] for own in tracks], which, np.array([c[0] for c in tried], float), np.array([c[2] / tops[t] for c, t in zip(tried, which, strict=True)], float), np.array([c[3] == "refined-peak" for c in tried], bool), per_second, tightness
    )
    found = [[nan] * len(own) for own in candidates]
    chain_of = {}
    for (t, k), fit, chain in zip(jobs, fits.tolist(), chains, strict=True):
        found[t][k] = fit
        chain_of.setdefault((t, candidates[t][k][0]), chain)
    chosen = [chosen_tempo(own, fit) for own, fit in zip(candidates, found, strict=True)]
    return [(bpm, chain_of.get((t, bpm))) for t, bpm in enumerate(chosen)]


def strength_at(frames: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The confidence of ``timeline.frame_times`` at the frames ``at``."""
    low, high, place = np.searchsorted(frames, at - 2), np.searchsorted(frames, at + 2, "right"), np.searchsorted(frames, at)
    there = (place < len(frames)) & (frames[np.minimum(place, len(frames) - 1)] == at)
    local = np.array([x[a:b].max() if b > a else 0.0 for a, b in zip(low.tolist(), high.tolist(), strict=True)])
    return np.where(there, np.clip(np.maximum(0.0, local) / max(ENERGY, x.max()), 0.0, 1.0), timeline.FALLBACK_CONFIDENCE)


def errors_of(broken: Column) -> tuple[Column, Column]:
    """code and message of a track (duration, _n frames) that can't be tracked, null for one that can."""
    sound = F.coalesce((F.col("duration") > 0) & ~F.isnan("duration") & (F.col("duration") < float("inf")), F.lit(False))
    code = F.when(~sound, NO_DURATION).when(F.col("_n").isNull(), NO_FRAMES).when(broken > 0, NOT_FINITE)
    message = F.when(code == NO_DURATION, F.concat(F.lit("duration is "), F.coalesce(F.col("duration").cast("string"), F.lit("null")))).when(code == NO_FRAMES, "the track has no frames")
    return code, message.when(code == NOT_FINITE, F.concat(broken.cast("string"), F.lit(" strengths are null or not finite")))


def track_beats(frames: DataFrame, tracks: DataFrame, track: str, per_second: float, evidence: str | None = None, grid_tempo: bool = True, elastic: bool = True, piecewise: bool = True, tightness: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """Beats (track, which, start, confidence) and a summary (track, code, message, bpm, mode, n_beats) of every row of ``tracks``.

    ``frames`` has track, frame, flux and onset and, if named, ``evidence``; ``tracks`` track and duration in seconds.
    With ``grid_tempo`` the tempo is the one whose own beats fit best, else the selected candidate. The mode names the
    first usable grid and each refinement that was taken. Tracks with a broken input have a code and no beats: no positive
    duration, no frames, or a strength that is null or not finite. Those without energy, or whose beats all lie outside, have
    an even grid.

    A track's strengths become one row; a task goes through the whole chain with many of them, tempos tried
    together, and only the finished grids are written.
    """
    strengths = ["flux", "onset", *([evidence] if evidence else [])]
    broken = sum((F.count_if(F.col(x).isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) for x in strengths), F.lit(0))
    odf = timeline.onset_detection(frames, track, "frame", "flux", WIDTH, "_tempo")
    odf = timeline.onset_detection(odf, track, "frame", "onset", WIDTH, "_odf")
    names = ["frame", "_tempo", "_odf", *([F.col(evidence).cast("double").alias("_evidence")] if evidence else [])]
    held = odf.groupBy(track).agg(F.count("*").alias("_n"), broken.alias("_broken"), F.max("flux").alias("_top"), F.collect_list(F.struct(*names)).alias("_s"))
    code, message = errors_of(F.col("_broken"))
    rows = tracks.select(track, "duration").join(held, track, "left").select(track, "duration", code.alias("code"), message.alias("message"), "_top", "_s")
    rows = rows.withColumn("_s", F.when(F.col("code").isNull() & (F.col("_top") > ENERGY), F.col("_s"))).drop("_top")

    def grids(own: list[dict], durations: list[float]) -> list[tuple[float, str, np.ndarray, np.ndarray]]:
        candidates = [tempi(x["frame"], x["_tempo"], per_second, LOW_BPM, HIGH_BPM, MOST) for x in own]
        if grid_tempo:
            chosen = chosen_tempi(own, candidates, per_second, tightness)
        else:
            chosen = [(next((c[0] for c in x if c[5]), None), None) for x in candidates]
        out = []
        for x, (bpm, chain), duration in zip(own, chosen, durations, strict=True):
            if bpm is None:
                out.append(even(None, duration))
                continue
            period, odf = 60.0 * per_second / bpm, x["_odf"]
            chain = beatgrids.dense_chain(odf, period, tightness) if chain is None else chain
            grid, mode = beatgrids.usable(odf, np.unique(chain), period, duration * per_second, beatgrids.MICRO_SNAP)
            mode = REFINED if mode == "aligned" else mode
            steps = [lambda at, x=x, p=period: beatgrids.gated(x["_evidence"], at, p, tightness)] if evidence else []
            steps += [lambda at, x=odf, p=period: beatgrids.elastic(x, at, p, per_second)] * elastic + [lambda at, x=odf, p=period: beatgrids.piecewise(x, at, p, per_second)] * piecewise
            for step in steps:
                grid, name = step(np.unique(grid))
                mode = "+".join([mode, *([STEPS[name]] if name in STEPS else [])])
            grid = np.unique(grid)
            start = grid * (1.0 / per_second)
            inside = (start >= 0) & (start <= duration)
            out.append((bpm, mode, start[inside], strength_at(x["frame"], odf, grid[inside])) if inside.any() else even(bpm, duration))
        return out

    def even(bpm: float | None, duration: float) -> tuple[float, str, np.ndarray, np.ndarray]:
        bpm = timeline.FALLBACK_BPM if bpm is None else bpm
        start = np.arange(floor(duration / (60.0 / bpm)) + 1) * (60.0 / bpm)
        return bpm, REGULAR, start, np.full(len(start), timeline.FALLBACK_CONFIDENCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, durations = unpacked(batch.column(4)), batch.column(1).to_pylist()
            sound = [k for k, x in enumerate(batch.column(2).to_pylist()) if x is None]
            live = [k for k in sound if len(own[k]["frame"])]
            found = {k: even(None, durations[k]) for k in sound}
            for part in shares(live, [len(own[k]["frame"]) for k in live]):
                found |= dict(zip(part, grids([own[k] for k in part], [durations[k] for k in part]), strict=True))
            none = (None, None, np.empty(0), np.empty(0))
            bpm, mode, start, confidence = zip(*(found.get(k, none) for k in range(len(own))), strict=True) if len(own) else ((),) * 4
            ends = pa.array(np.append(0, np.cumsum([len(x) for x in start])), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.empty(0))) for x in (start, confidence)]
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(bpm, pa.float64()), pa.array(mode, pa.string()), *lists], names=[track, "code", "message", "bpm", "mode", "start", "confidence"])

    kind = tracks.schema[track].dataType.simpleString()
    told = settled(rows.mapInArrow(run, f"`{track}` {kind}, code string, message string, bpm double, mode string, start array<double>, confidence array<double>"), "tracked")
    beats = told.select(track, F.posexplode(F.arrays_zip("start", "confidence")).alias("which", "_b")).select(track, F.col("which").cast("long").alias("which"), "_b.start", "_b.confidence")
    return beats, told.select(track, "code", "message", "bpm", "mode", F.size("start").cast("long").alias("n_beats"))


def provided(tracks: DataFrame, built_in: DataFrame, advisor: DataFrame, failures: DataFrame, corrected: DataFrame, track: str) -> tuple[DataFrame, DataFrame]:
    """The final beats (track, start, confidence, source) and a row per track: track, source, reason, code.

    ``tracks`` has track, provider and fallback (whether a rejected advisor gives way to the built-in grid). Grids
    have track, start, confidence; ``failures`` (track, failure) tells the guardrail that an advisor's grid breaks, null
    for none; ``corrected`` holds the grids that the hybrid choice took. BeatThis takes the advisor's grid where it is
    sound, Hybrid the corrected one where there is one, the others the built-in one. A track whose provider isn't known, or
    whose advisor is rejected without a fallback, gets a code and no beats; the others go on.
    """
    known = lambda df, name: df.select(track).distinct().withColumn(name, F.lit(True))
    rows = tracks.select(track, "provider", F.coalesce("fallback", F.lit(True)).alias("fallback")).join(known(advisor, "_advised"), track, "left").join(known(corrected, "_corrected"), track, "left").join(failures.select(track, "failure"), track, "left")
    asked = F.col("provider") == ADVISOR
    reason = F.when(asked & F.col("_advised").isNull(), NOT_CONFIGURED).when(asked & F.col("failure").isNotNull(), F.concat(F.lit(REJECTED), F.col("failure")))
    strange = F.coalesce(~F.col("provider").isin(BUILT_IN, AUTO, ADVISOR, SHADOW, HYBRID), F.lit(True))
    code = F.when(strange, UNKNOWN_PROVIDER).when(F.col("reason").isNotNull() & ~F.col("fallback"), NO_GRID)
    source = F.when(F.col("code").isNotNull(), F.lit(None)).when(asked & F.col("reason").isNull(), "advisor").when((F.col("provider") == HYBRID) & F.col("_corrected"), "corrected").otherwise("built-in")
    told = settled(rows.withColumn("reason", reason).withColumn("code", code).select(track, source.alias("source"), "reason", "code"), "providers")
    grids = [df.select(track, "start", "confidence", F.lit(name).alias("source")) for df, name in ((built_in, "built-in"), (advisor, "advisor"), (corrected, "corrected"))]
    beats = grids[0].unionByName(grids[1]).unionByName(grids[2]).join(told.where("source IS NOT NULL").select(track, "source"), [track, "source"], "left_semi")
    return beats, told
