"""Beats of a track from its onset strengths: the dense chain, its gate, usable, elastic and
piecewise grids, the tempo that fits.

Frames are rows of track, frame (from 0 on, without holes) and a strength; a track has one period,
in frames. What depends on the beat before is a fold over one track in pandas, which a track's
length bounds. Tracks without frames or without a period give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.operators.folds import renewed

#: Least energy; a step's least and greatest share of the period; width of the
#: smoothing in parts of a period; share under which ends are weak.
ENERGY, SHORTEST, LONGEST, SMOOTHING, WEAK = 1e-9, 0.5, 2.0, 32.0, 0.5
#: Least beats of a usable grid and their share of the expected ones; deviation of its
#: gaps over their median, and what a grid may add to that; shares of the period that make a gap missing or doubled.
LEAST, LEAST_SHARE, DEVIATION, MORE_DEVIATION, MISSING, DOUBLED = 8, 0.65, 0.22, 0.02, 1.65, 0.45
#: Reach of a snap and of a beat's own snap in periods, the period's bounds after it, and how far a peak stands out.
SNAP, MICRO_SNAP, KEEPS, STANDS_OUT = 0.15, 0.10, (0.85, 1.15), 1.05
#: Fixed values of the gate: share of the tightness, gain of evidence, change of count, and growth of the deviation.
LOOSER, GAIN, COUNT_CHANGE, GROWTH, SLACK = 0.65, 1.03, 0.02, 1.35, 0.025

#: Fixed values of the elastic grid: reach in periods and in milliseconds; bounds of a step in periods and its weight; what a
#: shift by a period and a step out of bounds cost; gain of evidence; growth of the deviation.
REACH, REACH_MS, STEP, STEP_COST, SHIFT_COST, BREAK_COST, ELASTIC_GAIN, ELASTIC_GROWTH, ELASTIC_SLACK = 0.18, 130.0, (0.70, 1.30), 2.0, 0.20, 5.0, 1.01, 1.8, 0.04
#: Fixed values of a tempo's score: weights of the candidate's own score, beats at peaks, strength, coverage, evenness and bar phase.
WEIGHTS = (0.30, 0.25, 0.15, 0.12, 0.10, 0.08)
#: Least tempo and most candidates scored; a peak's share of the top and reach in periods; deviation without
#: evenness; what a refined period loses; tempo under which the double counts, from which one does and how near; share of the
#: best that the first autocorrelation needs.
SLOWEST, MOST, PEAK, PEAK_REACH, UNEVEN, REFINED_LOSS, SLOW, FAST, NEAR_DOUBLE, NEAR_BEST = 85.0, 30, 0.20, 0.12, 0.25, 0.04, 100.0, 150.0, 0.03, 0.98

#: Fixed values of the piecewise grid: beats of a window, hop and least beats; offsets in beats; reach of a hit in periods; weights
#: of hits, strength, nearness, bar phase and coverage; what a beat of offset and its change cost; gain; greatest middle and single shift
#: in milliseconds; growth of the deviation.
WINDOW, HOP, LEAST_WINDOW, OFFSETS, HIT_REACH = 32, 16, 8, [round(0.05 * k, 4) for k in range(-9, 10)], 0.12
WINDOW_WEIGHTS, OFFSET_COST, CHANGE_COST = (0.45, 0.25, 0.15, 0.10, 0.05), 0.20, 0.35
PIECE_GAIN, MIDDLE_SHIFT_MS, SINGLE_SHIFT_MS, PIECE_GROWTH, PIECE_SLACK = 0.015, 180.0, 260.0, 1.6, 0.035


def steps(length: int, period: float, first: int = 0) -> np.ndarray:
    return np.arange(first, length, max(1, int(np.rint(period))))


def smoothed(x: np.ndarray, period: float) -> np.ndarray:
    """Strengths over their deviation, averaged with a bell of one period to both sides."""
    reach = max(1, int(np.rint(period)))
    bell = np.exp(-0.5 * (np.arange(-reach, reach + 1) * SMOOTHING / period) ** 2)
    inside = slice(reach, reach + len(x))
    return np.convolve(x / max(1e-9, x.std()), bell)[inside] / np.convolve(np.ones(len(x)), bell)[inside]


def dense_chain(x: np.ndarray, period: float, tightness: float) -> np.ndarray:
    """Frames of the best chain over all frames, without its weak ends; steps of the period where
    there is nothing to follow."""
    local = smoothed(x, period)
    if local.max() <= ENERGY:
        return steps(len(x), period)
    near = max(1, int(np.rint(period * SHORTEST)))
    far = max(near + 1, int(np.rint(period * LONGEST)))
    cost = tightness * np.log(np.arange(near, far + 1) / period) ** 2
    total, back = local.copy(), np.full(len(x), -1)
    for k in range(near, len(x)):
        before = total[max(0, k - far) : k - near + 1][::-1] - cost[: min(far, k) - near + 1]
        j = int(before.argmax())
        total[k] += max(0.0, before[j])
        back[k] = k - near - j
    tops = np.flatnonzero((total[1:-1] >= total[:-2]) & (total[1:-1] > total[2:])) + 1
    if not len(tops):
        return steps(len(x), period)
    high = tops[total[tops] >= 0.5 * np.median(total[tops])]
    chain = [int(high[-1] if len(high) else tops[-1])]
    while back[chain[-1]] >= 0:
        chain.append(int(back[chain[-1]]))
    chain = np.array(chain[::-1])
    if len(chain) > 2:
        strong = np.flatnonzero(local[chain] > WEAK * np.sqrt((local[chain] ** 2).mean()))
        chain = chain[strong[0] : strong[-1] + 1] if len(strong) else chain[:0]
    return chain


#: Most strengths that chains are sought over at once.
CELLS = 1_000_000


def _smoothed_like(scaled: np.ndarray, period: float, held: dict) -> np.ndarray:
    """``smoothed`` of strengths that are over their deviation already; ``held`` keeps what hangs on length and period."""
    if (len(scaled), period) not in held:
        reach = max(1, int(np.rint(period)))
        bell = np.exp(-0.5 * (np.arange(-reach, reach + 1) * SMOOTHING / period) ** 2)
        inside = slice(reach, reach + len(scaled))
        held[len(scaled), period] = bell, inside, np.convolve(np.ones(len(scaled)), bell)[inside]
    bell, inside, weight = held[len(scaled), period]
    return np.convolve(scaled, bell)[inside] / weight


def dense_chains(own: list[np.ndarray], which: np.ndarray, periods: np.ndarray, tightness: float) -> list[np.ndarray]:
    """``dense_chain`` of many pairs of strengths (``own[k]`` for k in ``which``) and periods together, a frame of all at a time."""
    size = np.array([len(own[k]) for k in which], int)
    scaled = [x / max(1e-9, x.std()) for x in own]
    found: list[np.ndarray] = [np.empty(0, int)] * len(which)
    order, low = np.argsort(size, kind="stable"), 0
    while low < len(order):
        ends = size[order[low:]] * np.arange(1, len(order) - low + 1)
        high = low + max(1, int(np.searchsorted(ends, CELLS, "right")))
        part, held = order[low:high], {}
        local = np.zeros((len(part), int(size[part[-1]])))
        for row, k in enumerate(part.tolist()):
            local[row, : size[k]] = _smoothed_like(scaled[which[k]], float(periods[k]), held)
        for k, chain in zip(part.tolist(), _chains(np.ascontiguousarray(local.T), size[part], periods[part], tightness), strict=True):
            found[k] = steps(int(size[k]), float(periods[k])) if chain is None else chain
        low = high
    return found


def _chains(local: np.ndarray, size: np.ndarray, periods: np.ndarray, tightness: float) -> list[np.ndarray | None]:
    """The chains over columns of smoothed strengths, as long as ``size`` says; None where there is nothing to follow."""
    near = np.maximum(1, np.rint(periods * SHORTEST).astype(int))
    far = np.maximum(near + 1, np.rint(periods * LONGEST).astype(int))
    least, most, (length, count) = int(near.min()), int(far.max()), local.shape
    gaps = np.arange(least, most + 1)[:, None]
    cost = tightness * np.log(gaps / periods) ** 2
    cost[(gaps < near) | (gaps > far)] = np.inf
    padded = np.full((most + length, count), -np.inf)
    padded[most:] = local
    backward = np.ascontiguousarray(cost[::-1])
    for k in range(least, length):
        padded[most + k] += np.maximum(0.0, (padded[k : k + len(gaps)] - backward).max(axis=0))
    total, tops = padded[most:], np.zeros(local.shape, bool)
    tops[1:-1] = (total[1:-1] >= total[:-2]) & (total[1:-1] > total[2:]) & (np.arange(1, length - 1)[:, None] < size - 1)
    number, sorted_tops = tops.sum(axis=0), np.sort(np.where(tops, total, np.inf), axis=0)
    at = lambda k: np.take_along_axis(sorted_tops, np.minimum(np.maximum(k, 0), length - 1)[None], axis=0)[0]
    middle = (at((number - 1) // 2) + at(number // 2)) / 2
    high = tops & (total >= 0.5 * middle)
    last = lambda mask: length - 1 - mask[::-1].argmax(axis=0)
    place = np.where(high.any(axis=0), last(high), last(tops))
    live = np.flatnonzero((number > 0) & (local.max(axis=0) > ENERGY))
    path, columns, place = [], live, place[live]
    while len(columns):
        path.append((columns, place))
        going = place >= near[columns]
        columns, place = columns[going], place[going]
        if len(columns):
            place = place - least - (padded[most + place - gaps, columns] - cost[:, columns]).argmax(axis=0)
    chains: list[np.ndarray | None] = [None] * count
    if not path:
        return chains
    owner, frame = (np.concatenate(x)[::-1] for x in zip(*path, strict=True))
    order = np.argsort(owner, kind="stable")
    owner, frame = owner[order], frame[order]
    ends = np.searchsorted(owner, np.append(live, count))
    strength = local[frame, owner]
    for k, a, b in zip(live.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a > 2:
            own = strength[a:b]
            strong = np.flatnonzero(own > WEAK * np.sqrt((own**2).mean()))
            a, b = (a + int(strong[0]), a + int(strong[-1]) + 1) if len(strong) else (a, a)
        chains[k] = frame[a:b]
    return chains


def regularity(grid: np.ndarray, period: float) -> tuple[float, int, int]:
    """Deviation of the gaps over their median, and how many gaps are missing a beat or doubled."""
    gaps = np.diff(grid)
    if not len(gaps):
        return 0.0, 0, 0
    return float(gaps.std() / max(1.0, np.median(gaps))), int((gaps > period * MISSING).sum()), int((gaps < period * DOUBLED).sum())


def no_worse(grid: np.ndarray, other: np.ndarray, period: float) -> bool:
    (spread, missing, doubled), (spread0, missing0, doubled0) = regularity(grid, period), regularity(other, period)
    return doubled <= doubled0 and missing <= missing0 and spread <= max(DEVIATION, spread0 + MORE_DEVIATION)


def around(x: np.ndarray, frame: int, reach: int) -> tuple[int, int, int]:
    """The span around a frame and its first greatest frame."""
    low, high = max(0, frame - reach), min(len(x), frame + reach + 1)
    return low, high, low + int(x[low:high].argmax())


def snapped(x: np.ndarray, grid: np.ndarray, period: float) -> np.ndarray:
    """Steps from the grid's first beat (the greatest of two periods, without one), each to the peak nearby."""
    step = max(1, int(np.rint(period)))
    first = int(grid[0]) if len(grid) else int(x[: max(1, 2 * step) + 1].argmax())
    return np.unique([around(x, int(k), max(2, int(np.rint(step * SNAP))))[2] for k in steps(len(x), period, first)])


def micro_snapped(x: np.ndarray, grid: np.ndarray, period: float, share: float) -> np.ndarray:
    """Each beat to the peak nearby where that stands out and keeps order and period."""
    out: list[int] = []
    for k, frame in enumerate(grid.tolist()):
        low, high, top = around(x, frame, max(1, int(np.rint(period * share))))
        top = top if x[top] > x[frame] else frame
        gaps = ([top - out[-1]] if out else []) + ([int(grid[k + 1]) - top] if k + 1 < len(grid) else [])
        fits = all(g > 0 and KEEPS[0] * period <= g <= KEEPS[1] * period for g in gaps) and (bool(out) or top > 0)
        stands = x[top] > STANDS_OUT * x[low:high].mean() or x[top] > x[frame]
        out.append(top if stands and fits else frame)
    return np.unique(out)


def usable(x: np.ndarray, grid: np.ndarray, period: float, expected: float, micro: float | None) -> tuple[np.ndarray, str]:
    grid = np.unique(grid[(grid >= 0) & (grid < len(x))]).astype(int)
    counts = [max(1, int(np.rint(n / period))) for n in (len(x), expected)]
    least = max(LEAST, int(max(counts) * LEAST_SHARE))
    even, (spread, missing, doubled) = steps(len(x), period), regularity(grid, period)
    if len(grid) >= least and not missing and not doubled and spread <= DEVIATION:
        return grid, "aligned"
    moved = snapped(x, grid, period)
    if len(moved) >= least and no_worse(moved, even, period):
        return moved, "snapped-regular"
    if micro is not None and no_worse(near := micro_snapped(x, even, period, micro), even, period):
        return near, "regular+micro-snap"
    return even, "regular"


def gated(x: np.ndarray, grid: np.ndarray, period: float, tightness: float) -> tuple[np.ndarray, str]:
    if len(grid) < LEAST:
        return grid, "not-enough-data"
    found = dense_chain(x, period, tightness * LOOSER)
    if not len(found):
        return grid, "no-candidate"
    before, after = (x[np.clip(g, 0, len(x) - 1)].mean() for g in (grid, found))
    (spread, missing, _), (spread1, missing1, doubled1) = regularity(grid, period), regularity(found, period)
    even = not doubled1 and missing1 <= missing and spread1 <= max(spread * GROWTH, spread + SLACK)
    good = after >= before * GAIN and abs(len(found) - len(grid)) / len(grid) <= COUNT_CHANGE and even
    return (found, "composite-dp") if good else (grid, "rejected")


def places(x: np.ndarray, frame: int, reach: int) -> np.ndarray:
    """Where a beat may go: itself, the peaks and the top around it, and the middle of their strength."""
    frame = min(max(frame, 0), len(x) - 1)
    low, high, top = around(x, frame, reach)
    near, up = x[low:high], np.maximum(0.0, x[low:high])
    peaks = low + 1 + np.flatnonzero((near[1:-1] >= near[:-2]) & (near[1:-1] > near[2:]))
    middle = [int(np.rint((np.arange(low, high) * up).sum() / up.sum()))] if up.sum() > 0 else []
    return np.unique([frame, *([top] if x[top] > x[frame] else []), *peaks.tolist(), *middle])


def elastic(x: np.ndarray, grid: np.ndarray, period: float, per_second: float) -> tuple[np.ndarray, str]:
    if len(grid) < LEAST:
        return grid, "not-enough-data"
    reach = max(1, int(np.rint(min(period * REACH, per_second * REACH_MS / 1000))))
    options = [places(x, frame, reach) for frame in grid.tolist()]
    total, back = [], []
    for frame, own in zip(grid.tolist(), options, strict=True):
        worth = x[own] - np.abs(own - frame) / max(1.0, period) * SHIFT_COST
        if total:
            step = own[:, None] - options[len(total) - 1][None, :]
            ways = total[-1] - STEP_COST * ((step - period) / period) ** 2
            ways[(step <= period * STEP[0]) | (step >= period * STEP[1])] = -np.inf
            best = ways.argmax(axis=1)
            reached = np.isfinite(ways.max(axis=1))
            back.append(np.where(reached, best, 0))
            worth = worth + np.where(reached, ways.max(axis=1), -BREAK_COST)
        total.append(worth)
    at, path = int(total[-1].argmax()), []
    for k in range(len(options) - 1, -1, -1):
        path.append(options[k][at])
        at = int(back[k - 1][at]) if k else 0
    found = np.unique(path)
    (spread, missing, _), (spread1, missing1, doubled1) = regularity(grid, period), regularity(found, period)
    even = not doubled1 and missing1 <= missing and spread1 <= max(spread * ELASTIC_GROWTH, spread + ELASTIC_SLACK)
    gains = x[found].mean() > x[np.clip(grid, 0, len(x) - 1)].mean() * ELASTIC_GAIN
    return (found, "elastic-local-onset") if len(found) == len(grid) and even and gains else (grid, "rejected")


def tempo_score(x: np.ndarray, bpm: float, share: float, refined: bool, per_second: float, tightness: float) -> float:
    """How well the beats that a tempo gives fit the strengths; ``share`` is its own score over the best one's."""
    period, top = per_second * 60.0 / bpm, max(ENERGY, x.max())
    found = dense_chain(x, period, tightness)
    found = found if len(found) >= 4 else steps(len(x), period)
    peaks = np.flatnonzero((x[1:-1] >= PEAK * top) & (x[1:-1] >= x[:-2]) & (x[1:-1] > x[2:])) + 1
    strength = x[found] / top
    hits = (np.abs(found[:, None] - _nearest(peaks, found)).min(axis=1) <= max(1, int(np.rint(period * PEAK_REACH)))).mean() if len(peaks) else 0.0
    cover = min(1.0, (found[-1] - found[0]) / len(x)) if len(found) > 1 else 0.0
    evenness = min(1.0, max(0.0, 1.0 - regularity(found, period)[0] / UNEVEN))
    first = np.arange(len(found)) % 4 == 0
    phase = min(1.0, max(0.0, 0.5 + strength[first].mean() - strength[~first].mean())) if len(found) >= 8 else 0.0
    terms = (share, hits, strength.mean(), cover, evenness, phase)
    return float(sum(w * t for w, t in zip(WEIGHTS, terms, strict=True)) - (REFINED_LOSS if refined else 0.0))


def tempo_scores_of(own: list[np.ndarray], which: np.ndarray, bpm: np.ndarray, share: np.ndarray, refined: np.ndarray, per_second: float, tightness: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """``tempo_score`` of many tempos together, and the beats that they give; ``which`` tells whose strengths a tempo is for."""
    if not len(which):
        return np.empty(0), []
    periods = per_second * 60.0 / bpm
    chains = dense_chains(own, which, periods, tightness)
    length = np.array([len(x) for x in own])
    beats = [x if len(x) >= 4 else steps(int(length[k]), float(p)) for x, k, p in zip(chains, which, periods, strict=True)]
    size, flat = np.array([len(x) for x in beats]), np.concatenate(beats)
    first = np.append(0, size.cumsum()[:-1])
    job = np.repeat(np.arange(len(size)), size)
    turn = np.arange(len(flat)) - first[job]
    mean = lambda x, keep=None: np.add.reduceat(x if keep is None else np.where(keep, x, 0.0), first) / np.maximum(1, size if keep is None else np.add.reduceat(keep.astype(int), first))
    tops = np.array([max(ENERGY, x.max()) for x in own])
    reach = np.maximum(1, np.rint(periods * PEAK_REACH).astype(int))
    start = np.append(0, (length + int(reach.max()) + 2).cumsum()[:-1])  # further apart than a hit may be
    peaks = np.concatenate([a + 1 + np.flatnonzero((x[1:-1] >= PEAK * top) & (x[1:-1] >= x[:-2]) & (x[1:-1] > x[2:])) for a, x, top in zip(start, own, tops, strict=True)])
    strength = np.concatenate(own)[np.append(0, length.cumsum()[:-1])[which][job] + flat] / tops[which][job]
    there = start[which][job] + flat
    hits = mean((np.abs(there[:, None] - _nearest(peaks, there)).min(axis=1) <= reach[job]).astype(float)) if len(peaks) else np.zeros(len(size))
    end = flat[first + size - 1]
    cover = np.where(size > 1, np.minimum(1.0, (end - flat[first]) / length[which]), 0.0)
    spread = np.zeros(len(size))
    if (inner := turn > 0).any():
        gaps, gap_of, many = np.diff(flat, prepend=0)[inner], job[inner], np.maximum(size - 1, 1)
        middle = (end - flat[first]) / many
        spread = np.sqrt(np.bincount(gap_of, (gaps - middle[gap_of]) ** 2, len(size)) / many)
        gaps = gaps[np.lexsort((gaps, gap_of))]
        at = np.append(0, (size - 1).cumsum()[:-1])
        median = (gaps[np.minimum(at + (many - 1) // 2, len(gaps) - 1)] + gaps[np.minimum(at + many // 2, len(gaps) - 1)]) / 2
        spread = np.where(size > 1, spread / np.maximum(1.0, median), 0.0)
    evenness = np.clip(1.0 - spread / UNEVEN, 0.0, 1.0)
    phase = np.where(size >= 8, np.clip(0.5 + mean(strength, turn % 4 == 0) - mean(strength, turn % 4 != 0), 0.0, 1.0), 0.0)
    terms = (share, hits, mean(strength), cover, evenness, phase)
    return sum(w * t for w, t in zip(WEIGHTS, terms, strict=True)) - np.where(refined, REFINED_LOSS, 0.0), chains


def _nearest(peaks: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """The peaks before and after each frame."""
    after = np.searchsorted(peaks, frames)
    return np.stack([peaks[np.maximum(after - 1, 0)], peaks[np.minimum(after, len(peaks) - 1)]], axis=1)


def spans(count: int) -> list[tuple[int, int]]:
    """First and past-the-last beats of hopping windows, up to the one that holds the last beat."""
    firsts = range(0, max(1, count - WINDOW + HOP), HOP)
    return [(a, min(count, a + WINDOW)) for a in firsts if min(count, a + WINDOW) - a >= LEAST_WINDOW]


def window_scores(x: np.ndarray, grid: np.ndarray, period: float) -> np.ndarray:
    """A row per window, a column per offset: how well its beats, moved by the offset, meet the peaks."""
    reach, top = max(1, int(np.rint(period * HIT_REACH))), max(ENERGY, x.max())
    best, gap = x.copy(), np.full(len(x), reach + 1)
    padded = np.pad(x, reach, constant_values=-np.inf)
    for d in range(-reach, reach + 1):
        there = padded[reach + d : reach + d + len(x)]
        better = there > best
        best, gap = np.where(better, there, best), np.where(better, abs(d), gap)
    at = np.clip(np.rint(grid[None, :] + np.array(OFFSETS)[:, None] * period).astype(int), 0, len(x) - 1)
    rows = []
    for a, b in spans(len(grid)):
        own = at[:, a:b]
        first = np.arange(b - a) % 4 == 0
        phase = np.clip(0.5 + x[own[:, first]].mean(axis=1) / top - x[own[:, ~first]].mean(axis=1) / top, 0, 1)
        cover = np.full(len(OFFSETS), min(1.0, (b - a) / 32))
        terms = ((gap[own] <= reach).mean(axis=1), best[own].mean(axis=1) / top, (1 - gap[own] / (reach + 1)).mean(axis=1), phase, cover)
        rows.append(sum(w * t for w, t in zip(WINDOW_WEIGHTS, terms, strict=True)) - OFFSET_COST * np.abs(OFFSETS))
    return np.array(rows)


def smooth_offsets(scores: np.ndarray) -> np.ndarray:
    """The offsets, one a window, of greatest score less the cost of their changes."""
    values = np.array(OFFSETS)
    change = CHANGE_COST * (values[:, None] - values[None, :]) ** 2
    total, back = scores[0], []
    for own in scores[1:]:
        ways = total[None, :] + own[:, None] - change
        back.append(ways.argmax(axis=1))
        total = ways.max(axis=1)
    path = [int(total.argmax())]
    for row in reversed(back):
        path.append(int(row[path[-1]]))
    return values[path[::-1]]


def piecewise(x: np.ndarray, grid: np.ndarray, period: float, per_second: float) -> tuple[np.ndarray, str]:
    if len(grid) < WINDOW:
        return grid, "not-enough-data"
    moved, weight = np.zeros(len(grid)), np.zeros(len(grid))
    for (a, b), offset in zip(spans(len(grid)), smooth_offsets(window_scores(x, grid, period)), strict=True):
        near = np.maximum(0.05, 1 - np.abs(np.arange(a, b) - (a + b - 1) / 2) / max(1.0, (b - a) / 2))
        moved[a:b] += offset * period * near
        weight[a:b] += near
    order = np.arange(len(grid))
    found = np.maximum.accumulate(np.rint(grid + np.where(weight > 0, moved / np.where(weight > 0, weight, 1), 0)).astype(int) - order) + order
    shifts = np.sort(np.abs(found - grid)) / per_second * 1000
    before, after = (x[np.clip(g, 0, len(x) - 1)].mean() / max(ENERGY, x.max()) for g in (grid, found))
    (spread, missing, _), (spread1, missing1, doubled1) = regularity(grid, period), regularity(found, period)
    even = not doubled1 and missing1 <= missing + 1 and spread1 <= max(spread * PIECE_GROWTH, spread + PIECE_SLACK)
    small = shifts[int(np.rint((len(shifts) - 1) * 0.5))] <= MIDDLE_SHIFT_MS and shifts[-1] <= SINGLE_SHIFT_MS
    return (found, "piecewise-window-offset") if after >= before + PIECE_GAIN and even and small else (grid, "rejected")


def _strengths(frames: DataFrame, periods: DataFrame, track: str, x: str, *more: str) -> DataFrame:
    return frames.select(track, "frame", x).join(periods.select(track, "period", *more).where("period > 0 and period < double('inf')"), track)


def _by_track(rows: DataFrame, beats: DataFrame, track: str, x: str, choose: Callable) -> DataFrame:
    """track, frame, mode: what ``choose`` makes of a track's strengths, beats and first row."""

    def fold(key: tuple, own: pd.DataFrame, grid: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame([], columns=["k", "frame", "mode"])
        own = own.sort_values("frame")
        at = np.unique(grid["frame"].to_numpy(int)) if "frame" in grid.columns else np.empty(0, int)
        found, mode = choose(own[x].to_numpy(float), at, own.iloc[0])
        return pd.DataFrame({"k": [key[0]] * len(found), "frame": found, "mode": mode})

    kind = rows.schema[track].dataType.simpleString()
    both = rows.groupBy(track).cogroup(renewed(beats.select(track, "frame")).groupBy(track))
    return both.applyInPandas(fold, f"k {kind}, frame long, mode string").withColumnRenamed("k", track)


def dense_beats(frames: DataFrame, periods: DataFrame, track: str, x: str, tightness: float = 100.0) -> DataFrame:
    """track, frame: beats of the best chain over all frames of a track.

    A frame's worth is its smoothed strength; a step of g frames costs tightness * log(g / period)^2.
    The chain ends at the last local top of at least half the middle one, and loses weak ends.
    """

    def fold(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        found = dense_chain(own.sort_values("frame")[x].to_numpy(float), float(own["period"].iloc[0]), tightness)
        return pd.DataFrame({"k": [key[0]] * len(found), "frame": found})

    rows = _strengths(frames, periods, track, x)
    kind = rows.schema[track].dataType.simpleString()
    return rows.groupBy(track).applyInPandas(fold, f"k {kind}, frame long").withColumnRenamed("k", track)


def usable_grid(frames: DataFrame, beats: DataFrame, periods: DataFrame, track: str, x: str, per_second: float, micro: float | None = None) -> DataFrame:
    """track, frame, mode: the first usable of a track's own beats, even steps snapped to peaks, even
    steps snapped by the beat (with ``micro``, a share of the period such as MICRO_SNAP), even steps.

    ``beats`` has track, frame; ``periods`` track, period, duration in seconds.
    """
    rows = _strengths(frames, periods, track, x, "duration")
    return _by_track(rows, beats, track, x, lambda own, at, first: usable(own, at, float(first["period"]), float(first["duration"]) * per_second, micro))


def composite_beats(frames: DataFrame, beats: DataFrame, periods: DataFrame, track: str, x: str, tightness: float = 100.0) -> DataFrame:
    """track, frame, mode: the dense chain over the evidence ``x`` where it gains by it and is as
    even as the given beats (mode composite-dp), else these, with the reason as mode."""
    return _by_track(_strengths(frames, periods, track, x), beats, track, x, lambda own, at, first: gated(own, at, float(first["period"]), tightness))


def elastic_beats(frames: DataFrame, beats: DataFrame, periods: DataFrame, track: str, x: str, per_second: float) -> DataFrame:
    """track, frame, mode: beats moved together to peaks nearby, in order and near the period (mode
    elastic-local-onset), where the strengths gain by it and the grid stays even; else the given beats."""
    return _by_track(_strengths(frames, periods, track, x), beats, track, x, lambda own, at, first: elastic(own, at, float(first["period"]), per_second))


def piecewise_beats(frames: DataFrame, beats: DataFrame, periods: DataFrame, track: str, x: str, per_second: float) -> DataFrame:
    """track, frame, mode: beats moved by offsets that change smoothly from window to window (mode
    piecewise-window-offset), where the strengths gain by it, shifts are small and the grid stays
    even; else the given beats."""
    return _by_track(_strengths(frames, periods, track, x), beats, track, x, lambda own, at, first: piecewise(own, at, float(first["period"]), per_second))


def tempo_scores(frames: DataFrame, candidates: DataFrame, track: str, x: str, per_second: float, tightness: float = 100.0) -> DataFrame:
    """candidates (track, place, bpm, score, origin) with grid_score: how well a tempo's own beats fit
    the strengths. Only the first MOST of a track from SLOWEST on have one."""
    whole = Window.partitionBy(track)
    fast = F.col("bpm") >= SLOWEST
    rows = candidates.withColumns({"_top": F.greatest(F.lit(ENERGY), F.max("score").over(whole)), "_turn": F.sum(fast.cast("int")).over(whole.orderBy("place"))})
    scored = rows.where(fast & (F.col("_turn") <= MOST) & (F.col("bpm") < float("inf"))).select(track, "place", "bpm", (F.col("score") / F.col("_top")).alias("share"), (F.col("origin") == "refined-peak").alias("refined"))

    def fold(key: tuple, own: pd.DataFrame, tempos: pd.DataFrame) -> pd.DataFrame:
        if own.empty or tempos.empty:
            return pd.DataFrame([], columns=["k", "place", "grid_score"])
        values = own.sort_values("frame")[x].to_numpy(float)
        found = [tempo_score(values, t.bpm, t.share, bool(t.refined), per_second, tightness) for t in tempos.itertuples()]
        return pd.DataFrame({"k": [key[0]] * len(found), "place": tempos["place"], "grid_score": found})

    kind = frames.schema[track].dataType.simpleString()
    both = frames.select(track, "frame", x).groupBy(track).cogroup(renewed(scored).groupBy(track))
    found = both.applyInPandas(fold, f"k {kind}, place long, grid_score double").withColumnRenamed("k", track)
    return candidates.join(found, [track, "place"], "left")


def selected_tempo(scored: DataFrame, track: str) -> DataFrame:
    """track, bpm, score, origin: the candidate of greatest grid_score (the first one, where none has any).

    Under SLOW, a candidate from FAST on that is about its double goes before it; so does the best
    autocorrelation whose own score comes near its own.
    """
    what = F.struct("bpm", "score", "origin")
    first = lambda order: F.min_by(what, F.struct(*order))
    best = scored.groupBy(track).agg(first([F.when(F.col("grid_score").isNull(), float("inf")).otherwise(-F.col("grid_score")), F.col("place")]).alias("best"))
    rows = scored.join(best, track)
    double = F.col("best.bpm") * 2
    doubled = (F.col("best.bpm") < SLOW) & (F.col("bpm") >= FAST) & (F.abs(F.col("bpm") - double) / F.greatest(F.lit(1.0), double) <= NEAR_DOUBLE)
    primary = (F.col("bpm") >= SLOWEST) & (F.col("origin") == "autocorrelation")
    order = F.struct(-F.col("score"), F.col("place"))
    rows = rows.groupBy(track).agg(F.first("best").alias("best"), F.min_by(F.when(doubled, what), F.when(doubled, order)).alias("double"), F.min_by(F.when(primary, what), F.when(primary, order)).alias("primary"))
    chosen = F.coalesce("double", F.when(F.col("primary.score") >= F.col("best.score") * NEAR_BEST, F.col("primary")), "best")
    return rows.select(track, chosen.alias("_c")).select(track, "_c.*")
