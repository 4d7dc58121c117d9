"""The walk as a stream: sessions that play a track, advanced by control events."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strophe.operators.walk import WalkOptions, track_graphs, walk_of


def play(events: DataFrame, quanta: DataFrame, edges: DataFrame, track: str = "track", session: str = "session", seed: int = 7, options: WalkOptions = WalkOptions()) -> DataFrame:
    """session, step, beat, next, jump_from, reason: the beats that a session's events play.

    ``events`` is a stream of session, track, at, steps, seek: in order of ``at`` an event sets
    the beat to ``seek``, unless null, which also resets the walk, and plays ``steps`` beats. A
    beat outside the track is held to its ends; null steps are none. The state of a session is
    its walk (some kilobytes), not the graph, which joins in from the tables. A session that
    plays the key of its track gives what ``walk.simulate`` gives, however its events fall
    into batches. Events of unknown tracks give nothing.
    """
    kind = events.schema[session].dataType.simpleString()
    rows = events.select(session, track, "at", "steps", "seek").join(track_graphs(quanta, edges, track), track)

    def advance(key: tuple, batches, state: GroupState):
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        walk, beat, step = walk_of(rows["beats"].iloc[0], rows["graph"].iloc[0], f"{seed}:{key[0]}", options), 0, 0
        if state.exists:
            beat, step, kept = pickle.loads(state.get[0])
            walk.go_on(kept)
        found = []
        for seek, steps in zip(rows["seek"], rows["steps"], strict=True):
            if not pd.isna(seek):
                beat = min(max(0, int(seek)), len(walk.durations) - 1)
                walk.reset()
            for _ in range(0 if pd.isna(steps) else int(steps)):
                after, source, reason = walk.decide(beat)
                found.append((key[0], step, beat, after, source, reason))
                beat, step = after, step + 1
        state.update((pickle.dumps((beat, step, walk.kept())),))
        yield pd.DataFrame(found, columns=[session, "step", "beat", "next", "jump_from", "reason"]).astype({"jump_from": "Int64"})

    schema = f"{session} {kind}, step long, beat long, next long, jump_from long, reason string"
    return rows.groupBy(session).applyInPandasWithState(advance, schema, "walk binary", "append", GroupStateTimeout.NoTimeout)
