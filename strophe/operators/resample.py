"""Samples at another rate: a polyphase windowed sinc over blocks of samples.

Sample k of the result stands at k * rate / target of the input. With the ratio in lowest terms
there are only as many different distances to the inputs as the target's term, and the weights for each are
made once. Blocks of BLOCK inputs get the inputs within a filter's reach from both neighbours, and
phases follow from the sample's number in the track, so block borders leave no trace.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, LOBES = 8192, 16


def reach(rate: int, target: int, lobes: int = LOBES) -> int:
    """Inputs that weigh in on either side of a result."""
    return -(-lobes * max(rate, target) // target)


def phase_weights(rate: int, target: int, lobes: int = LOBES) -> np.ndarray:
    """A row of weights for each phase, over the inputs from ``reach`` - 1 before a place to ``reach`` after it; each
    row sums to 1. The sinc is cut off at the lower of both rates' halves, under a squared cosine."""
    common = gcd(rate, target)
    phases, half, cut = target // common, reach(rate, target, lobes), min(1.0, target / rate)
    t = np.arange(phases)[:, None] / phases - np.arange(1 - half, half + 1)[None]
    out = np.sinc(cut * t) * np.cos(np.pi * t / (2 * half)) ** 2
    return out / out.sum(axis=1, keepdims=True)


def resampled(samples: DataFrame, track: str, which: str, x: str, rate: str, target: int, lobes: int = LOBES) -> DataFrame:
    """(track, which, x) at ``target`` samples a second; ``rate`` (a whole number) is a column of the track.

    ``which`` counts from 0 without gaps; n inputs give ceil(n * target / rate) results. A null
    sample counts as 0, as does what lies outside the track. At equal rates samples stay as they are. Frequencies
    below (1 - 1 / lobes) of the lower rate's half come through with an error under 1 percent, away from the ends.
    """
    at, own = F.col(which), F.floor(F.col(which) / BLOCK)
    half = F.ceil(lobes * F.greatest(F.col(rate), F.lit(target)) / target)
    blocks = F.sequence(F.greatest(F.floor((at - half) / BLOCK), F.lit(0)), F.floor((at + half) / BLOCK))
    rows = samples.select(track, at.cast("long").alias("_at"), F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("_x"), F.col(rate).cast("long").alias("_rate"), own.alias("_own"), F.explode(blocks).alias("_block"))

    def run(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("_at", kind="stable")
        at, mine = held["_at"].to_numpy(), (held["_own"] == held["_block"]).to_numpy()
        if not mine.any():
            return pd.DataFrame({track: held[track].iloc[:0], which: [], x: []})
        source = int(held["_rate"].iloc[0])
        common = gcd(source, target)
        up, down, half = target // common, source // common, reach(source, target, lobes)
        first, end = int(at[mine][0]), int(at[mine][-1]) + 1
        number = np.arange(-(-first * up // down), -(-end * up // down))
        if source == target:
            values = held["_x"].to_numpy()[mine]
        else:
            padded = np.zeros(end - first + 2 * half + 1)
            inside = (at >= first - half) & (at <= end + half)
            padded[at[inside] - (first - half)] = held["_x"].to_numpy()[inside]
            place = number * down // up - first + 1
            values = (padded[place[:, None] + np.arange(2 * half)[None]] * phase_weights(source, target, lobes)[number * down % up]).sum(axis=1)
        return pd.DataFrame({track: [held[track].iloc[0]] * len(number), which: number, x: values})

    kind = samples.schema[track].dataType.simpleString()
    return rows.groupBy(track, "_block").applyInPandas(run, f"`{track}` {kind}, `{which}` long, `{x}` double")
