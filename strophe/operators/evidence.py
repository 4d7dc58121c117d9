"""One beat evidence per frame out of several channels, each scaled by its 95th percentile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions.columns import clamp, finite, l2
from strophe.operators.ranks import quantiles
from strophe.operators.timeline import around
from strophe.plans.tables import settled

#: Fixed values.
WEIGHTS = {"onset": 0.35, "low": 0.20, "mid": 0.15, "high": 0.0, "rms_delta": 0.10, "mfcc_delta": 0.10, "chroma_delta": 0.05, "novelty": 0.05}
PARTS = {"full": 0.0, "percussive": 1.0, "harmonic": 0.0}


def percentile_scaled(df: DataFrame, track: str, names: list[str], p: float = 0.95) -> DataFrame:
    """The columns ``names`` over their nearest-rank percentile in the track, within 0 and 1.

    ``df`` is written once, as it is read for the percentiles and for the rows."""
    df = settled(df, "channels")
    long = df.select(track, F.explode(F.array(*[F.struct(F.lit(x).alias("name"), finite(F.col(x).cast("double")).alias("x")) for x in names])).alias("_v")).select(track, "_v.*")
    found = quantiles(long, [track, "name"], "x", {"top": p})
    tops = found.groupBy(track).agg(*[F.max(F.when(F.col("name") == x, F.col("top"))).alias(f"_{x}") for x in names])
    scaled = {x: clamp(F.col(x) / F.greatest(F.lit(1e-9), F.coalesce(F.col(f"_{x}"), F.lit(1.0))), 0.0, 1.0) for x in names}
    return df.join(tops, track, "left").withColumns(scaled).drop(*[f"_{x}" for x in names])


def composite(df: DataFrame, track: str, order: str, parts: dict[str, float] | None = None) -> DataFrame:
    """Adds rms_delta, mfcc_delta, chroma_delta, novelty, low, mid, high and evidence.

    ``df`` has track, ``order``, onset, flux, rms and the vectors mfcc and chroma; onset and
    flux come back scaled. A track's first frame has no change.

    ``parts`` gives the weights of full, percussive and harmonic onsets, PARTS for the usual ones: onset and
    flux then are the weighted mean of those above 0. ``df`` has percussive_onset, percussive_flux, percussive_rms
    and harmonic_onset besides (as ``frames.part_features`` gives); the first three come back scaled, the third as
    percussive_rms_delta.
    """
    w = Window.partitionBy(track).orderBy(order)
    none = F.lit(0.0)
    rise = lambda x: F.coalesce(F.greatest(none, F.col(x) - F.lag(x).over(w)), none)
    rows = df.withColumns({
        "rms_delta": rise("rms"),
        "mfcc_delta": F.coalesce(l2(F.col("mfcc"), F.lag("mfcc").over(w)), none),
        "chroma_delta": F.coalesce(l2(F.col("chroma"), F.lag("chroma").over(w)), none),
    })
    names, low, change = ["onset", "flux", "rms_delta", "mfcc_delta", "chroma_delta"], F.col("flux"), F.col("rms_delta")
    if parts is not None:
        rows = rows.withColumn("percussive_rms_delta", rise("percussive_rms"))
        names += ["percussive_onset", "percussive_flux", "percussive_rms_delta", "harmonic_onset"]
        low, change = (F.col("flux") + F.col("percussive_flux")) / 2, F.greatest("rms_delta", "percussive_rms_delta")
    rows = percentile_scaled(rows, track, names)
    if parts is not None:
        used = {x: weight for x, weight in parts.items() if weight > 0}
        mean = lambda full: sum((F.col({"full": full, "percussive": f"percussive_{full}", "harmonic": "harmonic_onset"}[x]) * (weight / sum(used.values())) for x, weight in used.items()), none)
        rows = percentile_scaled(rows.withColumns({"onset": mean("onset"), "flux": mean("flux")}), track, ["onset", "flux"])
    rows = rows.withColumns({
        "novelty": (F.col("mfcc_delta") + F.col("chroma_delta") + F.col("rms_delta")) / 3,
        "low": F.avg(low).over(around(track, order, 3)),
        "mid": F.avg((F.col("flux") + F.col("mfcc_delta")) / 2).over(around(track, order, 5)),
        "high": F.greatest(none, F.col("onset") - 0.35 * F.col("flux")),
    })
    rows = percentile_scaled(rows, track, ["novelty", "low", "mid", "high"]).withColumn("_change", change)
    total = sum((F.col("_change" if x == "rms_delta" else x) * weight for x, weight in WEIGHTS.items()), none)
    return rows.withColumn("evidence", clamp(total, 0.0, 1.0)).drop("_change")
