"""Exact nearest quanta in blocks: the k best of each source without all pairs of a track.

Quanta of a track and an index in the parent fall into cells of their vector's norm, as wide as
the greatest distance, so neighbours lie in the same or the next cell (norms differ by no more
than vectors do). A cell of over ``BLOCK`` quanta is dealt to several blocks by a hash of the
quantum. A task compares one block of sources with one of destinations, ``STRIP`` sources at a
time, and gives back each source's k best; only these are shuffled again.

Distances that a product of matrices puts near a limit, or among the k best, are computed anew as
the root of summed squares, so rows equal those of a join of all pairs.

``all_pairs`` gives every pair: blocks are stretches of a track there, and a task compares two of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.operators.graph import BONUS, MISSING_PENALTY, PENALTY

BLOCK, STRIP, EXACT = 4096, 256, 50_000
#: Share of the squared norms by which a product of matrices may be wrong.
SLACK = 1e-12
#: Quanta of a stretch of a track, and how many sources are compared with one at a time.
STRETCH, NARROW = 4096, 64


def long_jump_penalty(beats_per_bar: int = 4, section_bars: int = 8, short_bars: int = 4, phrase_bars: int = 8, boundary_bars: int = 1) -> Callable[..., np.ndarray]:
    """The penalty that ``graph.structural_score`` gives jumps of ``short_bars`` or more, which are
    never rejected: a function of arrays src, dst, distance and the track's n."""

    def penalty(src: np.ndarray, dst: np.ndarray, distance: np.ndarray, n: int) -> np.ndarray:
        jump, a, b = abs(dst - src), src // beats_per_bar, dst // beats_per_bar
        at_edge = lambda bar: (bar % section_bars < boundary_bars) | (bar % section_bars >= section_bars - boundary_bars)
        far = jump >= beats_per_bar * phrase_bars
        bonus = BONUS["long-jump"] * far + BONUS["phrase"] * ((a % 4 == b % 4) * 1 + (a % 8 == b % 8) + (far & (a % 16 == b % 16)))
        bonus = bonus + BONUS["section-change"] * (a // section_bars != b // section_bars) + BONUS["boundary"] * (at_edge(a) | at_edge(b))
        bonus = bonus + BONUS["reach-gain"] * (jump >= max(beats_per_bar * short_bars, n // 2)) + BONUS["exceptional"] * (distance <= 8.0)
        return np.where(src % beats_per_bar == dst % beats_per_bar, 0, np.maximum(0, PENALTY["phase"] - bonus))

    return penalty


def _distances(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for k in range(0, len(rows), EXACT):
        out[k : k + EXACT] = np.sqrt(((a[rows[k : k + EXACT]] - b[columns[k : k + EXACT]]) ** 2).sum(axis=1))
    return out


def _under(a: np.ndarray, b: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distances by a product, where they may be below ``limit``, and where they must be."""
    square = lambda v: (v * v).sum(axis=1)
    high, wide = square(a)[:, None], square(b)[None]
    near = high + wide - 2 * (a @ b.T)
    slack = SLACK * (high + wide + limit * limit) * a.shape[1]
    return near, near < limit * limit + slack, near < limit * limit - slack


def block_neighbours(sources: pd.DataFrame, targets: pd.DataFrame, scale: float, limit: float, k: int, short: int, ahead: bool, penalty: Callable[..., np.ndarray]) -> pd.DataFrame:
    """src, dst, distance of a block: all pairs jumping less than ``short``, the k best others."""
    found, b, dst = [], np.stack(targets["v"]), targets["which"].to_numpy()
    if ahead:
        targets_next = np.array([x is not None for x in targets["after"]])
        after_b = np.stack([x if x is not None else b[0] for x in targets["after"]])
    for low in range(0, len(sources), STRIP):
        part = sources.iloc[low : low + STRIP]
        a, src = np.stack(part["v"]), part["which"].to_numpy()
        near, may, _ = _under(a, b, limit / scale)
        may &= src[:, None] != dst[None]
        if ahead:
            has = np.array([x is not None for x in part["after"]])
            may &= has[:, None] & targets_next[None] & (part["turn"].to_numpy()[:, None] == targets["turn"].to_numpy()[None])
            after_a = np.stack([x if x is not None else a[0] for x in part["after"]])
            _, may_next, must_next = _under(after_a, after_b, limit / scale)
            may &= may_next
            rows, columns = np.nonzero(may & ~must_next)
            may[rows, columns] = scale * _distances(after_a, after_b, rows, columns) < limit
        jump = abs(src[:, None] - dst[None])
        far = np.where(may & (jump >= short), near, np.inf)
        if k < far.shape[1]:
            worst = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
            slack = SLACK * ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] + np.where(np.isfinite(worst), abs(worst), 0)) * a.shape[1]
            far = np.where(far <= worst + 2 * slack, far, np.inf)
        rows, columns = np.nonzero(np.isfinite(far) | (may & (jump < short)))
        distance = scale * _distances(a, b, rows, columns)
        keep = distance < limit
        rows, columns, distance = rows[keep], columns[keep], distance[keep]
        s, d = src[rows], dst[columns]
        gap = abs(d - s)
        own = penalty(s, d, distance, int(sources["n"].iloc[0]))
        order = np.lexsort((d, -gap, own, distance, gap < short, rows))
        kind = rows[order] * 2 + (gap[order] < short)
        first = np.append(True, kind[1:] != kind[:-1])[: len(kind)]
        rank = np.arange(len(kind)) - np.maximum.accumulate(np.where(first, np.arange(len(kind)), 0)) if len(kind) else kind
        order = order[(rank < k) | (gap[order] < short)]
        found.append((s[order], d[order], distance[order]))
    return pd.DataFrame(dict(zip(("src", "dst", "distance"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def nearest(quanta: DataFrame, sizes: DataFrame, track: str, vector: str, scale: float, limit: float, k: int, short_bars: int = 4, beats_per_bar: int = 4, ahead: bool = True) -> DataFrame:
    """track, src, dst, distance under ``limit`` between quanta of one index in their parent.

    All pairs that jump less than ``short_bars`` bars, and of the others a source's k best by block, in
    the order of ``graph.top_neighbours``; with ``ahead`` only pairs whose next quanta are near, too. So ``structural_score``
    and ``top_neighbours`` give the same rows as on all pairs.

    ``quanta`` has track, which, index_in_parent and the vector (no null); ``sizes`` the number n of a
    track's quanta. ``limit`` may be ``graph.MISSING_PENALTY`` at most, as another index costs that much.
    """
    if limit > MISSING_PENALTY:
        raise ValueError("beyond the penalty for another index, indexes don't keep pairs apart")
    group = [F.col(track).alias("_track"), F.col("index_in_parent").alias("_index")]
    order = Window.partitionBy(track).orderBy("which")
    turn = F.coalesce(F.lead("index_in_parent").over(order) - F.col("index_in_parent"), F.lit(0))
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    rows = quanta.join(sizes.select(F.col(track), "n"), track).select(*group, F.col("which").cast("long").alias("which"), F.col("n").cast("long").alias("n"), F.col(vector).alias("v"), F.lead(vector).over(order).alias("after"), turn.cast("long").alias("turn"), F.floor(norm / (limit / scale)).alias("_cell"))
    cells = rows.groupBy("_track", "_index", "_cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_shares"))
    beside = Window.partitionBy("_track", "_index").orderBy("_cell")
    shares_at = lambda f, gap: F.when(f("_cell").over(beside) == F.col("_cell") + gap, f("_shares").over(beside)).otherwise(0)
    cells = cells.select("*", shares_at(F.lag, -1).alias("_below"), shares_at(F.lead, 1).alias("_above"))
    rows = rows.join(cells, ["_track", "_index", "_cell"]).withColumn("_share", F.pmod(F.xxhash64("which"), F.col("_shares")).cast("int"))

    def blocks(gap: int, shares: str):
        each = F.when(F.col(shares) > 0, F.sequence(F.lit(0), F.col(shares) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(each, lambda share: F.struct((F.col("_cell") + gap).alias("cell"), share.alias("share")))

    others = F.concat(blocks(-1, "_below"), blocks(0, "_shares"), blocks(1, "_above"))
    dealt = rows.withColumn("_other", F.explode(others))
    own = F.struct(F.col("_cell").alias("cell"), F.col("_share").alias("share"))
    ends = ["_track", "_index", "which", "n", "v", "after", "turn"]
    sources = dealt.select(*ends, own.alias("_from"), F.col("_other").alias("_to"), F.lit(True).alias("_is_source"))
    targets = dealt.select(*ends, F.col("_other").alias("_from"), own.alias("_to"), F.lit(False).alias("_is_source"))
    penalty, short = long_jump_penalty(beats_per_bar, short_bars=short_bars), beats_per_bar * short_bars
    kind = quanta.schema[track].dataType.simpleString()

    def run(both: pd.DataFrame) -> pd.DataFrame:
        marked = both["_is_source"].to_numpy(bool)
        if marked.all() or not marked.any():
            return pd.DataFrame({"track": [], "src": [], "dst": [], "distance": []})
        out = block_neighbours(both[marked], both[~marked], scale, limit, k, short, ahead, penalty)
        out.insert(0, "track", both["_track"].iloc[0])
        return out

    found = sources.unionByName(targets).groupBy("_track", "_index", "_from", "_to").applyInPandas(run, f"track {kind}, src long, dst long, distance double")
    return found.withColumnRenamed("track", track)


class _Vectors:
    """The vectors of a block by dimension; ``held`` tells which elements there are, None if all."""

    def __init__(self, lists: pa.Array, width: int):
        values, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        if not values.null_count and len(values) == len(lists) * width and (np.diff(ends) == width).all():
            self.by_dim, self.held = np.ascontiguousarray(values.to_numpy().reshape(-1, width).T), None
            return
        self.by_dim, self.held = np.zeros((width, len(lists))), np.zeros((width, len(lists)), bool)
        row = np.repeat(np.arange(len(lists)), np.diff(ends))
        place, there = np.arange(len(values)) - ends[row], values.is_valid().to_numpy(zero_copy_only=False)
        self.held[place[there], row[there]] = True
        self.by_dim[place[there], row[there]] = values.drop_null().to_numpy()


def _squares(a: _Vectors, b: _Vectors, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Summed squares of differences, dimension by dimension as ``columns.l2`` adds them; an element that one side lacks counts 0."""
    total = np.zeros(np.broadcast_shapes(rows.shape, columns.shape))
    for k, (x, y) in enumerate(zip(a.by_dim, b.by_dim, strict=True)):
        gap = x[rows] - y[columns]
        if a.held is not None or b.held is not None:
            there = np.logical_and(True if a.held is None else a.held[k][rows], True if b.held is None else b.held[k][columns])
            gap = np.where(there, gap, 0.0)
        gap *= gap
        total += gap
    return total


def _near(a: _Vectors, b: _Vectors, rows: np.ndarray, columns: np.ndarray, scale: float, under: Callable[[np.ndarray], np.ndarray], limit: float) -> np.ndarray:
    """Which pairs of rows and columns are ``under``: by a product of matrices, and where that could be wrong about
    ``limit`` (or isn't a number) by the exact distance."""
    if a.held is not None or b.held is not None:
        return np.concatenate([under(scale * np.sqrt(_squares(a, b, rows[k : k + NARROW, None], columns[None]))) for k in range(0, len(rows), NARROW)])
    out = np.empty((len(rows), len(columns)), bool)
    right = b.by_dim[:, columns]
    wide, square = (right * right).sum(axis=0)[None], (limit / scale) ** 2
    for k in range(0, len(rows), STRIP):
        left = a.by_dim[:, rows[k : k + STRIP]]
        high = (left * left).sum(axis=0)[:, None]
        slack = SLACK * (high + wide + square) * len(left)
        rough = high + wide - 2 * (left.T @ right)
        own = out[k : k + STRIP] = rough < square - slack
        r, c = np.nonzero(~own & ~(rough >= square + slack))
        for low in range(0, len(r), EXACT):
            at, to = r[low : low + EXACT], c[low : low + EXACT]
            out[k + at, to] = under(scale * np.sqrt(_squares(a, b, rows[k + at], columns[to])))
    return out


def stretch_pairs(sources: pa.Table, targets: pa.Table, low: tuple[int, int], scale: float, limit: float, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of sources and targets and distances of the pairs of two stretches that begin at ``low``, some at a time."""
    width = max([0, *(int(v.value_lengths().to_numpy().max()) for v in (t["v"].combine_chunks() for t in (sources, targets)) if len(v))])
    a, b = (_Vectors(t["v"].combine_chunks(), width) for t in (sources, targets))
    src, dst = (t["which"].to_numpy() for t in (sources, targets))
    applied = float(sources["applied"][0].as_py())
    under = lambda d: (d < limit) & (d <= applied)
    own, other = (t["_index"].to_numpy() for t in (sources, targets))
    same = [(np.flatnonzero(own == x), np.flatnonzero(other == x)) for x in np.intersect1d(own, other)]
    if depth == 1:
        for rows, columns in same:
            for k in range(0, len(rows), NARROW):
                at = rows[k : k + NARROW]
                distance = scale * np.sqrt(_squares(a, b, at[:, None], columns[None]))
                r, c = np.nonzero(under(distance) & (src[at][:, None] != dst[columns][None]))
                yield at[r], columns[c], distance[r, c]
        return
    at_a, at_b = src - low[0], dst - low[1]
    high, wide = (min(STRETCH, int(at.max()) + 1) for at in (at_a, at_b))
    near = np.zeros((high + depth - 1, wide + depth - 1), bool)
    for rows, columns in same:
        near[np.ix_(at_a[rows], at_b[columns])] = _near(a, b, rows, columns, scale, under, min(limit, applied))
    if low[0] == low[1]:
        np.fill_diagonal(near, False)
    follow = near[:high, :wide].copy()
    for o in range(1, depth):
        follow &= near[o : high + o, o : wide + o]
    row_of, column_of = (np.zeros(n, int) for n in near.shape)
    row_of[at_a], column_of[at_b] = np.arange(len(src)), np.arange(len(dst))
    for k in range(0, high, STRIP):
        r, c = np.nonzero(follow[k : k + STRIP])
        for first in range(0, len(r), EXACT):
            rows, columns = row_of[k + r[first : first + EXACT]], column_of[c[first : first + EXACT]]
            yield rows, columns, scale * np.sqrt(_squares(a, b, rows, columns))


def all_pairs(quanta: DataFrame, track: str, vector: str, scale: float, limit: float, depth: int = 1, applied: Column | float = float("inf"), keep: tuple[str, ...] = ()) -> DataFrame:
    """track, src, dst, distance and the columns ``keep`` of all pairs of quanta of one index in their parent under
    ``limit`` and up to ``applied``: what ``graph.candidate_pairs`` joins, and with a ``depth`` what ``graph.look_ahead``
    leaves of it.

    ``quanta`` has track, which, index_in_parent and the vector; (track, which) is unique, ``applied`` and ``keep``
    are the track's own. A track is cut into stretches of ``STRETCH`` places; a task compares two of them (with
    the ``depth`` - 1 places that follow) in pieces and gives pairs away as it finds them, so it holds no pair list.
    """
    if limit > MISSING_PENALTY:
        raise ValueError("beyond the penalty for another index, indexes don't keep pairs apart")
    kept = [F.col(x).alias(f"_keep{k}") for k, x in enumerate(keep)]
    applied = applied if isinstance(applied, Column) else F.lit(float(applied))
    rows = quanta.where(F.col(track).isNotNull() & F.col("index_in_parent").isNotNull()).select(
        F.col(track).alias("_track"), F.col("which").cast("long").alias("which"), F.col("index_in_parent").cast("long").alias("_index"), F.col(vector).cast("array<double>").alias("v"), applied.cast("double").alias("applied"), *kept,
        F.floor(F.max("which").over(Window.partitionBy(track)) / STRETCH).cast("int").alias("_last"),
    )
    own = F.floor(F.col("which") / STRETCH).cast("int")
    before = (F.col("which") % STRETCH < depth - 1) & (F.col("which") >= STRETCH)
    rows = rows.where("v IS NOT NULL AND applied IS NOT NULL").withColumn("_own", F.explode(F.when(before, F.array(own, own - 1)).otherwise(F.array(own))))
    dealt = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), "_last"))).withColumn("_source", F.explode(F.array(F.lit(True), F.lit(False))))
    ends = {"_from": F.when(F.col("_source"), F.col("_own")).otherwise(F.col("_other")), "_to": F.when(F.col("_source"), F.col("_other")).otherwise(F.col("_own"))}
    dealt = dealt.withColumns(ends).drop("_own", "_other", "_last")
    types = [quanta.schema[x].dataType.simpleString() for x in (track, *keep)]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in zip(("_track", "src", "dst", "distance", *(f"_keep{k}" for k in range(len(keep)))), (types[0], "long", "long", "double", *types[1:]), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(batches)
        marked = both["_source"].combine_chunks()
        sources, targets = (x.combine_chunks() for x in (both.filter(marked), both.filter(pc.invert(marked))))
        if not len(sources) or not len(targets):
            return
        src, dst = (t["which"].to_numpy() for t in (sources, targets))
        low = tuple(both[x][0].as_py() * STRETCH for x in ("_from", "_to"))
        for at, to, distance in stretch_pairs(sources, targets, low, scale, limit, depth):
            constant = lambda name: pa.repeat(sources[name][0], len(at))  # noqa: B023, E731
            yield pa.record_batch([constant("_track"), pa.array(src[at]), pa.array(dst[to]), pa.array(distance), *(constant(f"_keep{k}") for k in range(len(keep)))], names=["_track", "src", "dst", "distance", *(f"_keep{k}" for k in range(len(keep)))])

    # dealt out by both stretches, else all of a track's stay where its window put them; not merged again by size, as work isn't in proportion to it
    found = dealt.repartition(int(quanta.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_track", "_from", "_to").groupBy("_track", "_from", "_to").applyInArrow(run, schema)
    return found.withColumnsRenamed({"_track": track} | {f"_keep{k}": x for k, x in enumerate(keep)})
