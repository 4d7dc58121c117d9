"""Order-dependent folds: what depends on the last row kept, by track in pandas.

A track bounds the group: minutes of audio, some thousand rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_starts(pdf: pd.DataFrame) -> np.ndarray:
    """The starts in order; none for a track that this side lacks."""
    return np.sort(pdf["start"].to_numpy(float)) if "start" in pdf.columns else np.empty(0)


def renewed(df: DataFrame) -> DataFrame:
    """The same columns as new ones, so that both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def greedy_suppression(df: DataFrame, track: str, x: str, score: str, spacing: float) -> DataFrame:
    """Rows kept going down by score when no row kept before is nearer than ``spacing``."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, x], ascending=[False, True], kind="stable")
        held: list[float] = []
        chosen = []
        for value in pdf[x]:
            at = bisect_left(held, value)
            good = (at == len(held) or held[at] - value >= spacing) and (at == 0 or value - held[at - 1] >= spacing)
            chosen.append(good)
            if good:
                held.insert(at, value)
        return pdf[np.array(chosen, bool)]

    return df.groupBy(track).applyInPandas(keep, df.schema)


def segment_filter(df: DataFrame, track: str, distance: float = 1.0, confidence: float = 0.3) -> DataFrame:
    """Merges a segment into the last kept one when their first three timbres are within
    ``distance`` and its confidence is below ``confidence``; the kept one gets its duration.

    ``df`` has track, which, duration, confidence, timbre.
    """

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        for row in pdf.sort_values("which").to_dict("records"):
            if rows:
                a, b = (np.array(x["timbre"][:3], float) for x in (rows[-1], row))
                if row["confidence"] < confidence and np.sqrt(((a - b) ** 2).sum()) < distance:
                    rows[-1]["duration"] += row["duration"]
                    continue
            rows.append(row)
        return pd.DataFrame(rows, columns=pdf.columns)

    return df.groupBy(track).applyInPandas(merge, df.schema)


def claim(starts: np.ndarray, values: np.ndarray, tolerance: float) -> list[float]:
    """The errors of the values that, in order, take the nearest unused start within ``tolerance``."""
    lows, highs = (np.searchsorted(starts, values + x).tolist() for x in (-tolerance, tolerance + 1e-12))
    used, errors, starts = set(), [], starts.tolist()
    for value, low, high in zip(values.tolist(), lows, highs, strict=True):
        free = [(abs(starts[k] - value), k) for k in range(low, high) if k not in used and abs(starts[k] - value) <= tolerance]
        if free:
            error, best = min(free)
            used.add(best)
            errors.append(error)
    return errors


def greedy_match(reference: DataFrame, candidate: DataFrame, track: str, tolerance: float, offset: float = 0.0) -> DataFrame:
    """track, n_ref, n_cand, matched, precision, recall, f1, mean_error: candidates in order
    take the nearest unused reference within ``tolerance`` of their shifted start."""

    def match(key, ref: pd.DataFrame, cand: pd.DataFrame) -> pd.DataFrame:
        starts = sorted_starts(ref)
        errors = claim(starts, sorted_starts(cand) + offset, tolerance)
        n, m = len(errors), len(sorted_starts(cand))
        p, r = n / max(1, m), n / max(1, len(starts))
        return pd.DataFrame([[key[0], len(starts), m, n, p, r, 2 * p * r / (p + r) if n else 0.0, float(np.mean(errors)) if n else None]], columns=["k", "n_ref", "n_cand", "matched", "precision", "recall", "f1", "mean_error"])

    kind = reference.schema[track].dataType.simpleString()
    out = reference.groupBy(track).cogroup(renewed(candidate).groupBy(track)).applyInPandas(match, f"k {kind}, n_ref long, n_cand long, matched long, precision double, recall double, f1 double, mean_error double")
    return out.withColumnRenamed("k", track)


def beat_path(df: DataFrame, track: str, x: str, score: str, period: float, tightness: float = 100.0) -> DataFrame:
    """The chain of rows of greatest total score whose steps stay near ``period``.

    A step of g costs tightness * log(g / period)^2; steps under half or over twice the
    period aren't taken. Columns track, which (in the chain), start, total.
    """

    def best(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x)
        starts, scores = pdf[x].to_numpy(float), pdf[score].to_numpy(float)
        total, back = scores.copy(), np.full(len(starts), -1)
        for k in range(len(starts)):
            low, high = np.searchsorted(starts, [starts[k] - 2 * period, starts[k] - period / 2 + 1e-12])
            if high > low:
                step = total[low:high] - tightness * np.log((starts[k] - starts[low:high]) / period) ** 2
                j = int(step.argmax())
                if step[j] > 0:
                    total[k] += step[j]
                    back[k] = low + j
        k, chain = int(total.argmax()), []
        while k >= 0:
            chain.append((starts[k], total[k]))
            k = back[k]
        return pd.DataFrame([(key[0], n, s, t) for n, (s, t) in enumerate(reversed(chain))], columns=["k", "which", "start", "total"])

    kind = df.schema[track].dataType.simpleString()
    return df.groupBy(track).applyInPandas(best, f"k {kind}, which long, start double, total double").withColumnRenamed("k", track)


#: The share of the greatest onset that makes a peak, and tatums per beat at most (fixed values).
PEAK, CROWDED = 0.35, 2.6


def adaptive_tatums(beats: DataFrame, onsets: DataFrame, track: str, per_second: float) -> DataFrame:
    """track, which, start, duration, confidence: two to four tatums a beat, begun by the beat and
    the onset peaks inside it.

    ``beats`` has track, which, start, duration; ``onsets`` track, frame from 0 on, onset. Beyond
    two parts the peaks in order begin them; where that would make over CROWDED times all beats,
    or with one peak, the peak next to the middle does. A track without onsets, or with too many
    tatums in the end, gets halves.
    """

    def split(key, b: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        b = b.sort_values("which") if "start" in b.columns else pd.DataFrame({"start": [], "duration": []})
        starts, lengths = b["start"].to_numpy(float), b["duration"].to_numpy(float)
        x = o.sort_values("frame")["onset"].to_numpy(float) if "onset" in o.columns else np.empty(0)
        until = np.append(starts[1:], starts[-1:] + lengths[-1:])
        lengths = np.maximum(lengths, until - starts) if len(x) else np.where(until > starts, until - starts, lengths)
        top = max(1e-9, x.max()) if len(x) else 1.0
        inner = np.flatnonzero((x[1:-1] >= PEAK * top) & (x[1:-1] >= x[:-2]) & (x[1:-1] > x[2:])) + 1 if len(x) > 2 else np.empty(0, int)
        for start, long in zip(starts, lengths, strict=True) if len(x) else ():
            low = int(np.clip(np.rint(start * per_second), 0, len(x) - 1))
            high = int(np.clip(np.rint((start + long) * per_second), low + 1, len(x)))
            own = inner[(inner > low) & (inner < high - 1)]
            parts = int(np.clip(len(own) + 1, 2, 4))
            if parts > 2 and len(out) + parts > CROWDED * len(starts):
                parts = 2
            middle = own[np.argsort(np.abs(own - (low + high) / 2), kind="stable")]
            marks = [start, *((middle if parts == 2 else own)[: parts - 1] / per_second)]
            marks += [start + long * k / parts for k in range(len(marks), parts)]
            marks = sorted({round(m, 6): m for m in reversed(np.clip(marks, start, start + long).tolist())}.values())
            marks = sorted([*marks, start + long / 2]) if len(marks) < 2 else marks
            for m, end in zip(marks, [*marks[1:], start + long], strict=True):
                out.append((key[0], len(out), m, max(1e-6, end - m), float(np.clip(x[int(np.clip(np.rint(m * per_second), 0, len(x) - 1))] / top, 0, 1))))
        if not len(x) or len(out) > CROWDED * len(starts):
            out = [(key[0], 2 * k + h, s + h * d / 2, d / 2, None) for k, (s, d) in enumerate(zip(starts, lengths, strict=True)) for h in (0, 1)]
        return pd.DataFrame(out, columns=["k", "which", "start", "duration", "confidence"])

    kind = beats.schema[track].dataType.simpleString()
    both = beats.select(track, "which", "start", "duration").groupBy(track).cogroup(renewed(onsets.select(track, "frame", "onset")).groupBy(track))
    return both.applyInPandas(split, f"k {kind}, which long, start double, duration double, confidence double").withColumnRenamed("k", track)
