"""Frame features: samples of a track to one row per (track, frame) and columns on it.

A sample is a row (track, which, x), which counting from 0 without gaps. Frames are cut from blocks
of FRAMES frames' samples, each sample in its block and as halo in those it reaches into; what
compares many frames gets blocks of BLOCK frames with a halo of frames from both neighbours. So a
group never grows with the track. Transforms work on Arrow batches of frames.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from strophe.operators import timeline

VECTOR = ArrayType(DoubleType())
SILENCE = 1e-12
TINY = 1e-10
TOP_DB = 80.0
FRAMES, BLOCK = 64, 256
LOWEST_HZ, HIGHEST_HZ, CONCERT_A_HZ = 50.0, 5000.0, 440.0


def cut(samples: DataFrame, track: str, which: str, x: str, size: int, hop: int) -> DataFrame:
    """(track, frame, samples): frames every ``hop`` samples, the last one padded with zeros.

    A track of up to ``size`` samples has one frame, others have 1 + ceil((n - size) / hop);
    a null sample counts as 0.
    """
    counts = samples.groupBy(F.col(track).alias("_track")).agg(F.count("*").alias("_n"))
    at, n, span = F.col(which), F.col("_n"), FRAMES * hop
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / hop)).cast("long")
    first = F.greatest(F.floor((at - size + hop) / span), F.lit(0)).cast("long")
    final = F.least(F.floor(at / span), F.floor(F.col("_last") / FRAMES)).cast("long")
    rows = samples.join(counts, samples[track].eqNullSafe(counts["_track"])).withColumn("_last", last).where(first <= final)
    rows = rows.select(track, "_last", F.explode(F.sequence(first, final)).alias("_block"), F.struct(at.alias("i"), F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("x")).alias("_s"))
    blocks = rows.groupBy(track, "_block").agg(F.max("_last").alias("_last"), F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["x"]).alias("_x"))
    here = F.sequence(F.lit(0), F.least(F.lit(FRAMES - 1), F.col("_last") - F.col("_block") * FRAMES).cast("int"))
    held = blocks.select(track, "_block", F.posexplode(F.transform(here, lambda k: F.slice("_x", k * hop + 1, size))).alias("_k", "_x"))
    return held.select(track, (F.col("_block") * FRAMES + F.col("_k")).alias("frame"), F.concat("_x", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("_x"))).alias("samples"))


def pre_emphasis(samples: DataFrame, track: str, which: str, x: str, out: str, weight: float = 0.97) -> DataFrame:
    """x less ``weight`` times the sample before; the first sample stays."""
    before = F.lag(x).over(Window.partitionBy(track).orderBy(which))
    return samples.withColumn(out, F.col(x) - weight * F.coalesce(before, F.lit(0.0)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def rms(frame: Column) -> Column:
    """Root of the mean square, padding included."""
    return F.sqrt(total(F.transform(frame, lambda x: x * x)) / F.size(frame))


@F.pandas_udf(VECTOR)
def magnitudes(frames: pd.Series) -> pd.Series:
    """Magnitude spectrum, size / 2 + 1 bins, of frames of one size under a symmetric Hann window."""
    if not len(frames):
        return pd.Series([], dtype=object)
    stacked = np.stack(frames.to_numpy())
    return pd.Series(list(np.abs(np.fft.rfft(stacked * np.hanning(stacked.shape[1])))))


def mel_filters(rate: float, size: int, count: int, lowest: float = 20.0) -> np.ndarray:
    """Triangles even in mel from ``lowest`` to half the rate: (count, size // 2 + 1)."""
    mel = lambda hz: 2595.0 * np.log10(1.0 + hz / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(mel(lowest), mel(rate / 2), count + 2) / 2595.0) - 1.0)
    edges = np.clip(np.floor((size + 1) * edges / rate), 0, size // 2).astype(int)
    out, k = np.zeros((count, size // 2 + 1)), np.arange(size // 2 + 1)
    for row, start, top, end in zip(out, edges, edges[1:], edges[2:], strict=False):
        top += top == start
        end += end == top
        up, down = (k >= start) & (k < top), (k >= top) & (k < end)
        row[up] = (k[up] - start) / (top - start)
        row[down] = (end - k[down]) / (end - top)
    return out


def per_frame(f):
    """A column function from one on a (frames, bins) matrix of magnitudes."""

    @F.pandas_udf(VECTOR)
    def run(spectra: pd.Series) -> pd.Series:
        return pd.Series(list(f(np.stack(spectra.to_numpy()))) if len(spectra) else [], dtype=object)

    return run


def cepstrum(rate: float, size: int, bands: int = 40, coefficients: int = 13):
    """Column function: the cosine transform, not normalised, of the log mel energies."""
    filters = mel_filters(rate, size, bands)
    cosines = np.cos(np.pi * np.outer(np.arange(coefficients), np.arange(bands) + 0.5) / bands)
    return per_frame(lambda m: np.log(np.maximum(m**2 @ filters.T, TINY)) @ cosines.T)


def with_deltas(df: DataFrame, track: str, vector: str) -> DataFrame:
    """Appends half the difference of the next and the previous frame, ends standing for themselves."""
    w = Window.partitionBy(track).orderBy("frame")
    after, before = (F.coalesce(f(vector).over(w), F.col(vector)) for f in (F.lead, F.lag))
    return df.withColumn(vector, F.concat(vector, F.zip_with(after, before, lambda a, b: (a - b) / 2)))


def over_maximum(df: DataFrame, track: str, x: str) -> DataFrame:
    """x as a share of the track's maximum; 0 where that is not above 0."""
    top = F.max(x).over(Window.partitionBy(track))
    return df.withColumn(x, F.when(top > 0, F.greatest(F.col(x) / top, F.lit(0.0))).otherwise(F.lit(0.0)))


def rise(df: DataFrame, track: str, vector: str, out: str, mean: bool = False) -> DataFrame:
    """Sum, or mean, of what each element gained since the frame before, over the track's maximum."""
    before = F.lag(vector).over(Window.partitionBy(track).orderBy("frame"))
    gained = total(F.zip_with(vector, before, lambda a, b: F.greatest(a - b, F.lit(0.0))))
    gained = gained / F.size(vector) if mean else gained
    return over_maximum(df.withColumn(out, F.when(before.isNull(), F.lit(0.0)).otherwise(gained)), track, out)


def spectral_flux(df: DataFrame, track: str, spectrum: str = "spectrum", out: str = "flux") -> DataFrame:
    """Rise of the spectrum scaled to sum 1; a silent frame is all zeros."""
    whole = total(F.col(spectrum))
    even = F.transform(spectrum, lambda x: F.when(whole > SILENCE, x / whole).otherwise(F.lit(0.0)))
    return rise(df.withColumn("_even", even), track, "_even", out).drop("_even")


def onset_envelope(df: DataFrame, track: str, rate: float, size: int, spectrum: str = "spectrum", bands: int = 128, out: str = "onset") -> DataFrame:
    """Mean rise of the mel bands in dB, those 80 dB under the track's loudest one lifted to there."""
    filters = mel_filters(rate, size, bands)
    rows = df.withColumn("_db", per_frame(lambda m: 10 * np.log10(np.maximum(m**2 @ filters.T, TINY)))(spectrum))
    floor = F.max(F.array_max("_db")).over(Window.partitionBy(track)) - TOP_DB
    rows = rows.withColumn("_floor", floor).withColumn("_db", F.transform("_db", lambda x: F.greatest(x, F.col("_floor"))))
    return rise(rows, track, "_db", out, mean=True).drop("_db", "_floor")


def pitch_class_table(rate: float, size: int) -> np.ndarray:
    """(bins, 12): 1 where a bin of 50 to 5000 Hz sounds a pitch class, C being 0."""
    hz = np.arange(size // 2 + 1) * rate / size
    out = np.zeros((len(hz), 12))
    heard = np.flatnonzero((hz >= LOWEST_HZ) & (hz <= HIGHEST_HZ))
    out[heard, np.rint(12 * np.log2(hz[heard] / CONCERT_A_HZ) + 9).astype(int) % 12] = 1
    return out


def chroma(df: DataFrame, track: str, rate: float, size: int, spectrum: str = "spectrum", out: str = "chroma", r: int = 2) -> DataFrame:
    """Magnitudes by pitch class over the largest, each class the median of r frames to
    either side, again over the largest."""
    table = pitch_class_table(rate, size)
    scaled = lambda v: F.transform(v, lambda x: F.when(F.array_max(v) > 0, x / F.array_max(v)).otherwise(x))
    rows = df.withColumn("_c", per_frame(lambda m: m @ table)(spectrum))
    rows = rows.withColumn("_c", scaled(F.col("_c"))).withColumn("_near", F.collect_list("_c").over(timeline.around(track, "frame", r)))

    def middle(c):
        held = F.array_sort(F.transform("_near", lambda v: F.get(v, c)))
        n = F.size(held)
        return (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2

    rows = rows.withColumn("_m", F.transform(F.sequence(F.lit(0), F.lit(11)), middle))
    return rows.withColumn(out, scaled(F.col("_m"))).drop("_c", "_near", "_m")


def sliding_median(m: np.ndarray, r: int) -> np.ndarray:
    """Along the first axis the median of r rows to either side, as many as there are."""
    n = len(m)
    if not n:
        return m
    out = np.empty(m.shape)
    edge = min(r, n)
    for k in [*range(edge), *range(max(edge, n - r), n)]:
        out[k] = np.median(m[max(0, k - r) : k + r + 1], axis=0)
    if n > 2 * r:
        out[r : n - r] = np.median(np.lib.stride_tricks.sliding_window_view(m, 2 * r + 1, axis=0), axis=-1)
    return out


def separated(df: DataFrame, track: str, spectrum: str = "spectrum", r: int = 8, bins: int | None = None, harmonic_margin: float = 1.0, percussive_margin: float = 4.0, power: float = 1.0) -> DataFrame:
    """track, frame, spectrum, harmonic, percussive: spectra split by soft masks of each bin's median
    over ``r`` frames to either side against its median over ``bins`` (r) bins to either side.

    Medians over their margins are raised to ``power``; a mask is its share of both. Frames are
    numbered without gaps and have spectra of one length; magnitudes below 0 count as 0 there.
    """
    bins = r if bins is None else bins
    at, block = F.col("frame"), F.floor(F.col("frame") / BLOCK)
    ends = (F.floor((at - r) / BLOCK), F.floor((at + r) / BLOCK))
    rows = df.select(track, at.cast("long").alias("frame"), F.col(spectrum).alias("spectrum"), F.explode(F.sequence(F.greatest(ends[0], F.lit(0)), ends[1])).alias("_block"), block.alias("_own"))

    def run(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("frame", kind="stable")
        own = (held["_own"] == held["_block"]).to_numpy()
        if not own.any():
            return held.iloc[:0].assign(harmonic=None, percussive=None)[[track, "frame", "spectrum", "harmonic", "percussive"]]
        m = np.stack(held["spectrum"].to_numpy())
        kept = m[own]
        h, p = np.maximum(sliding_median(m, r)[own] / harmonic_margin, 0), np.maximum(sliding_median(kept.T, bins).T / percussive_margin, 0)
        h, p = h**power, p**power
        whole, kept = h + p + SILENCE, np.maximum(kept, 0)
        out = held.loc[own, [track, "frame", "spectrum"]]
        return out.assign(harmonic=list(kept * h / whole), percussive=list(kept * p / whole))

    kind = rows.select(track, "frame", "spectrum").schema.simpleString().removeprefix("struct<").removesuffix(">")
    return rows.groupBy(track, "_block").applyInPandas(run, f"{kind},harmonic:array<double>,percussive:array<double>")


def separate(df: DataFrame, track: str, spectrum: str = "spectrum", r: int = 8, harmonic_margin: float = 1.0, percussive_margin: float = 4.0) -> DataFrame:
    """(track, frame, dim, x, harmonic, percussive): a row for each bin of ``separated``."""
    out = separated(df, track, spectrum, r, None, harmonic_margin, percussive_margin)
    return out.select(track, "frame", F.posexplode(F.arrays_zip(F.col("spectrum").alias("x"), "harmonic", "percussive")).alias("dim", "_b")).select(track, "frame", "dim", "_b.x", "_b.harmonic", "_b.percussive")


def energy_ratios(split: DataFrame, track: str) -> DataFrame:
    """track, harmonic_ratio, percussive_ratio: the parts' share of the energy of ``separated`` spectra,
    0 without any."""
    energy = lambda v: F.sum(total(F.transform(v, lambda x: F.greatest(x, F.lit(0.0)) * F.greatest(x, F.lit(0.0)))))
    rows = split.groupBy(track).agg(*(energy(x).alias(f"_{x}") for x in ("spectrum", "harmonic", "percussive")))
    share = lambda x: F.when(F.col("_spectrum") > SILENCE, F.col(f"_{x}") / F.col("_spectrum")).otherwise(0.0).alias(f"{x}_ratio")
    return rows.select(track, share("harmonic"), share("percussive"))


def part_features(split: DataFrame, track: str, rate: float, size: int, bands: int = 128) -> DataFrame:
    """Of ``separated`` spectra, for each frame: harmonic_flux, harmonic_onset, harmonic_rms and the same of the
    percussive part."""
    rows = split
    for part in ("harmonic", "percussive"):
        rows = spectral_flux(rows, track, part, f"{part}_flux")
        rows = onset_envelope(rows, track, rate, size, part, bands, f"{part}_onset")
        rows = loudness(rows, track, part, f"{part}_rms")
    return rows.drop("spectrum", "harmonic", "percussive")


def loudness(rows: DataFrame, track: str, spectrum: str, out: str) -> DataFrame:
    """Adds the root of a spectrum's mean power over the track's greatest."""
    power = total(F.transform(spectrum, lambda x: x * x))
    rows = rows.withColumn(out, F.sqrt(power / F.greatest(F.lit(1), F.size(spectrum))))
    top = F.max(out).over(Window.partitionBy(track))
    return rows.withColumn(out, F.when((top > 0) & (top < float("inf")), F.least(F.lit(1.0), F.col(out) / top)).otherwise(F.col(out)))


def spectral_rms(rows: DataFrame, track: str) -> DataFrame:
    """track, frame, rms: ``loudness`` of the column ``spectrum``."""
    return loudness(rows.select(track, "frame", "spectrum"), track, "spectrum", "rms").drop("spectrum")


def assembled(track: str, *parts: DataFrame) -> DataFrame:
    """One row per frame that every part (track, frame, features) has: the matrix of features."""
    return reduce(lambda a, b: a.join(b, [track, "frame"]), parts)
