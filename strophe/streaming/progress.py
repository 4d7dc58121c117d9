"""Progress of running analyses as a stream: a track's percentage never falls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def monotone(events: DataFrame, track: str = "track", percent: str = "percent") -> DataFrame:
    """(track, percent): for each batch the highest percentage of every track that it names,
    clamped to 0..100 and never under an earlier batch's. The state is one number a track.
    """
    kind = events.schema[track].dataType.simpleString()

    def advance(key: tuple, batches, state: GroupState):
        best = state.get[0] if state.exists else 0.0
        for rows in batches:
            best = max(best, min(100.0, float(rows[percent].fillna(0).max())))
        state.update((best,))
        yield pd.DataFrame({track: [key[0]], percent: [best]})

    return events.select(track, percent).groupBy(track).applyInPandasWithState(advance, f"{track} {kind}, {percent} double", "best double", "update", GroupStateTimeout.NoTimeout)
