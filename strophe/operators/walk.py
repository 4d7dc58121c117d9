"""The seeded walk over the graph: one decision per beat, state per (track, seed)."""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.operators.graph import adjacency

REFERENCE_BEAT = 0.5


@dataclass(frozen=True)
class WalkOptions:
    """Defaults of the walk (fixed values)."""

    continuous: bool = True
    least_chance: float = 0.18
    most_chance: float = 0.50
    chance_step: float = 0.018
    jump_probability: float = 0.22
    cooldown: int = 12
    first_pass: float = 0.78
    repeat_penalty: float = 0.35
    end_zone: float = 0.9
    escape_depth: int = 3
    escape_beats: int = 24


class Walk:
    """State of one walk: chance, beats since the last jump, first pass, last destinations."""

    def __init__(self, durations: list[float], out: dict[int, list[tuple[float, int]]], seed: int, options: WalkOptions = WalkOptions()):
        self.durations, self.out, self.options = durations, out, options
        self.random = random.Random(seed)
        self.reset()

    def reset(self) -> None:
        """As at the start, but for the random numbers already drawn."""
        self.chance, self.since, self.passed, self.last = self.options.least_chance, self.options.cooldown, False, {}

    def kept(self) -> tuple:
        """What a later ``Walk`` over the same graph goes on from."""
        return self.chance, self.since, self.passed, self.last, self.random.getstate()

    def go_on(self, kept: tuple) -> None:
        self.chance, self.since, self.passed, self.last, drawn = kept
        self.random.setstate(drawn)

    def leads_out(self, beat: int, depth: int, seen: set) -> bool:
        """Whether a beat in the end zone has a way out: a jump within the next beats that
        ends before the zone, or in it with a way out of its own."""
        zone = self.options.end_zone * len(self.durations)
        if beat < zone:
            return True
        if depth == 0 or beat in seen:
            return False
        seen.add(beat)
        stop = min(len(self.durations), beat + self.options.escape_beats)
        return any(self.leads_out(dst, depth - 1, seen) for k in range(beat, stop) for _, dst in self.out.get(k, []))

    def decide(self, beat: int) -> tuple[int, int | None, str]:
        """(next beat, jump source or None, reason) after playing ``beat``."""
        o, n = self.options, len(self.durations)
        seed = beat + 1 if beat + 1 < n else 0
        self.passed |= seed >= o.first_pass * n or seed == 0
        if not o.continuous:
            return seed, None, "continuous-off"
        safe = [e for e in self.out.get(seed, []) if self.leads_out(e[1], o.escape_depth, set())]
        reason = None
        if not safe:
            reason = "blocked-by-escape-guard" if self.out.get(seed) else "no-branch"
        elif seed < o.end_zone * n:
            if not self.passed:
                reason = "first-pass"
            elif self.since < o.cooldown:
                reason = "cooldown"
            elif not self.random.random() <= min(1.0, self.chance * o.jump_probability):
                reason = "chance"
        if reason:
            length = self.durations[beat] if self.durations[beat] > 0 else REFERENCE_BEAT
            self.chance = min(o.most_chance, self.chance + o.chance_step * length / REFERENCE_BEAT)
            self.since += 1
            return seed, None, reason
        weights = [(1 / (1 + max(0.0, d))) * (o.repeat_penalty if dst == self.last.get(seed) else 1) for d, dst in safe]
        dst = self.random.choices([dst for _, dst in safe], weights)[0]
        self.last[seed], self.chance, self.since = dst, o.least_chance, 0
        return dst, seed, "jump" if seed < o.end_zone * n else "forced-in-end-zone"


def track_graphs(quanta: DataFrame, edges: DataFrame, track: str) -> DataFrame:
    """track, beats, graph: what a walk needs of a track in one row."""
    beats = quanta.groupBy(track).agg(F.array_sort(F.collect_list(F.struct("which", "duration"))).alias("beats"))
    graph = adjacency(edges, track).groupBy(track).agg(F.collect_list(F.struct("src", "out")).alias("graph"))
    return beats.join(graph, track, "left")


def walk_of(beats, graph, key: str, options: WalkOptions) -> Walk:
    """The walk over a row of ``track_graphs``, its seed made from ``key``."""
    out = {int(g["src"]): [(e["distance"], int(e["dst"])) for e in g["out"]] for g in (graph if graph is not None else [])}
    return Walk([b["duration"] for b in beats], out, zlib.crc32(key.encode()), options)


def simulate(quanta: DataFrame, edges: DataFrame, track: str, steps: int, seed: int = 7, options: WalkOptions = WalkOptions()) -> DataFrame:
    """track, step, beat, next, jump_from, reason for ``steps`` beats of every track.

    ``quanta`` has track, which, duration; the seed of a track is ``seed`` and its key.
    """
    rows = track_graphs(quanta, edges, track)
    kind = quanta.schema[track].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                walk, beat, found = walk_of(row.beats, row.graph, f"{seed}:{row[0]}", options), 0, []
                for step in range(steps):
                    after, source, reason = walk.decide(beat)
                    found.append((row[0], step, beat, after, source, reason))
                    beat = after
                yield pd.DataFrame(found, columns=[track, "step", "beat", "next", "jump_from", "reason"]).astype({"jump_from": "Int64"})

    return rows.select(track, "beats", "graph").mapInPandas(run, f"{track} {kind}, step long, beat long, next long, jump_from long, reason string")
