"""Sanity of an analysis: broken rules as rows, counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How the vectors of a level are called where one is empty, and where one isn't finite.
EMPTY = {
    "segment": {"timbre": "Segment timbre cannot be empty.", "pitches": "Segment pitches cannot be empty."},
    "beat": {"timbre": "Beat timbre cannot be empty.", "pitches": "Beat pitches cannot be empty.", "loudness": "Beat loudness cannot be empty.", "bar_position": "Beat bar position cannot be empty."},
}
NOT_FINITE = {
    "segment": {"loudness": "Segment loudness values must be finite.", "timbre": "Segment timbre values must be finite.", "pitches": "Segment pitch values must be finite."},
    "beat": dict.fromkeys(("timbre", "pitches", "loudness", "bar_position"), "Beat feature values must be finite."),
}
ABOVE_ZERO = {"duration": "duration", "sample_rate": "sample rate", "tempo": "tempo", "time_signature": "time signature"}
REQUIRED = {"file_hash": "file hash", "file_path": "file path", "schema_version": "schema version"}


def _not_finite(vector: str) -> Column:
    return F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def _told(rows: DataFrame, track: str, rules: dict[str, Column]) -> DataFrame:
    """track, error: a row for every rule that a row breaks."""
    told = F.array_compact(F.array(*[F.when(broken, F.lit(error)) for error, broken in rules.items()]))
    return rows.select(track, F.explode(told).alias("error"))


def level_errors(level: str, rows: DataFrame, tracks: DataFrame, track: str) -> DataFrame:
    """track, error of the rows (track, start, duration, ...) of a level; vectors that ``rows`` lacks aren't judged."""
    name, columns = level.capitalize(), set(rows.columns)
    rules = {f"{name} start cannot be negative.": F.col("start") < 0, f"{name} duration must be greater than zero.": F.col("duration") <= 0}
    if level == "section":
        rules["Section tempo must be greater than zero."] = F.col("tempo") <= 0
    rules |= {error: F.coalesce(F.size(x), F.lit(0)) <= 0 for x, error in EMPTY.get(level, {}).items() if x in columns}
    for x, error in NOT_FINITE.get(level, {}).items():
        if x in columns:
            bad = F.coalesce(_not_finite(x), F.lit(False))
            rules[error] = rules[error] | bad if error in rules else bad
    lacking = tracks.select(track).join(rows.select(track).distinct(), track, "left_anti")
    return _told(rows, track, rules).unionByName(lacking.select(track, F.lit(f"Analysis must contain at least one {level}.").alias("error")))


def sanity_errors(tracks: DataFrame, levels: dict[str, DataFrame], track: str) -> DataFrame:
    """track, error, n: how many rows of a track break a rule; a sound track has no row.

    ``tracks`` has one row per track with what it has of ABOVE_ZERO and REQUIRED; ``levels`` names the
    rows of segment, beat, bar, tatum and section. Null numbers aren't judged, null texts are missing.
    """
    rules = {f"Metadata {name} must be greater than zero.": F.col(x) <= 0 for x, name in ABOVE_ZERO.items() if x in tracks.columns}
    rules |= {f"Metadata {name} is required.": F.coalesce(F.trim(x), F.lit("")) == "" for x, name in REQUIRED.items() if x in tracks.columns}
    parts = [_told(tracks, track, rules), *[level_errors(level, rows, tracks, track) for level, rows in levels.items()]]
    return reduce(DataFrame.unionByName, parts).groupBy(track, "error").agg(F.count("*").alias("n"))
