"""Runs of repeated words, found by recompression.

The words of some documents, with a symbol of its own between any two, become a run-length
grammar: in turn, stretches of one symbol become a symbol (block compression), and neighbours of
which the first is on the left and the second on the right side of a split of the alphabet become
a symbol (pair compression). Equal stretches are parsed alike but for their ends, so how far two
places agree is found by climbing from both while their symbols agree and coming down where they
don't, with a step or two on each level, forwards as well as backwards.

A run of period q and length of at least max(12, 2q) has w[i] = w[i + q] on at least
max(12 - q, q) places i in a row, so one of them is a multiple of that number. These places are the
harmonic grid of q, about n log n in all. Where the two words of such a place agree, the grammar gives
the exact stretch with that period. Of equal stretches the smallest period stands, which is the
stretch's own.

Defined results: a null or wordless text has no runs and collapses to the empty text. Runs may
overlap; a word goes if any run contains it behind that run's first period. Rows keep their
other columns; columns named as an added one are replaced. An empty table gives an empty result.
A task holds the words of about AT_ONCE characters at a time, or of one longer text.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import WORD, with_fields

LEAST = 12
AT_ONCE, GRID = 1_000_000, 1_000_000
MADE = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


@dataclass
class Level:
    """Symbols of a level; for all but the top one each symbol's parent and each parent's first
    symbol, with the number of symbols at the end."""

    symbols: np.ndarray
    parent: np.ndarray | None = None
    first: np.ndarray | None = None

    def grown(self, inner: np.ndarray, names: np.ndarray) -> Level:
        """The level above: ``inner`` marks symbols that hang on the one before them, ``names`` has a
        number for each of the others, the same for the same content."""
        self.parent = np.cumsum(~inner) - 1
        self.first = np.append(np.flatnonzero(~inner), len(inner))
        return Level(np.unique(names, return_inverse=True)[1].astype(np.int64))


def recompressed(symbols: np.ndarray, least: int) -> list[Level]:
    """The levels of the grammar of ``symbols``, up to one of ``least`` symbols or fewer."""
    levels, still = [Level(np.unique(symbols, return_inverse=True)[1].astype(np.int64))], 0
    while len(levels[-1].symbols) > max(least, 1) and still < 8:
        at = levels[-1].symbols
        equal = np.append(False, at[1:] == at[:-1])
        if equal.any():
            start = np.flatnonzero(~equal)
            size = np.diff(np.append(start, len(at)))
            levels.append(levels[-1].grown(equal, at[start] * (len(at) + 1) + size))
            at = levels[-1].symbols
        right = np.random.default_rng(len(levels)).integers(0, 2, int(at.max()) + 1).astype(bool)[at]
        ahead, behind = ~right[:-1] & right[1:], right[:-1] & ~right[1:]
        pair = ahead if ahead.sum() >= behind.sum() else behind
        still = 0 if pair.any() else still + 1
        if pair.any():
            inner = np.append(False, pair)
            partner = np.append(np.where(pair, at[1:] + 1, 0), 0)
            levels.append(levels[-1].grown(inner, (at * (int(at.max()) + 2) + partner)[~inner]))
    return levels


def extension(levels: list[Level], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """On how many symbols the places ``a`` and ``b`` agree, forwards (step 1) or backwards (-1).

    Each end of the bottom level must be a symbol that occurs nowhere else.
    """
    begin, a, b = a, a.copy(), b.copy()
    stopped, live = np.zeros(len(a), np.int64), np.arange(len(a))

    def left(level: Level, at: np.ndarray) -> np.ndarray:
        """Symbols from a place to the end of its parent."""
        parent = level.parent[at]
        return level.first[parent + 1] - at if step > 0 else at - level.first[parent] + 1

    def whole(level: Level, at: np.ndarray) -> np.ndarray:
        """Whether a place is where its parent begins, seen in the direction."""
        parent = level.parent[at]
        return (at == level.first[parent]) if step > 0 else (at == level.first[parent + 1] - 1)

    def onward(level: Level, rows: np.ndarray) -> None:
        """Past symbols that agree: those of a parent at once if both have only equal ones there."""
        size = 1
        if level.parent is not None:
            x, y = a[rows], b[rows]
            size = np.minimum(left(level, x), left(level, y))
            size = np.where(level.symbols[x + step * (size - 1)] == level.symbols[x], size, 1)
            size = np.where(level.symbols[y + step * (size - 1)] == level.symbols[y], size, 1)
        a[rows] += step * size
        b[rows] += step * size

    for k, level in enumerate(levels):
        up, rows = [], live
        while len(rows):
            same = level.symbols[a[rows]] == level.symbols[b[rows]]
            stopped[rows[~same]] = k
            rows = rows[same]
            if level.parent is not None:
                both = whole(level, a[rows]) & whole(level, b[rows])
                up.append(rows[both])
                rows = rows[~both]
            onward(level, rows)
        live = np.concatenate(up) if up else live[:0]
        if level.parent is None or not len(live):
            break
        a[live], b[live] = level.parent[a[live]], level.parent[b[live]]
    for k in range(int(stopped.max(initial=0)), 0, -1):
        level, rows = levels[k - 1], np.flatnonzero(stopped >= k)
        for x in (a, b):
            x[rows] = level.first[x[rows]] if step > 0 else level.first[x[rows] + 1] - 1
        while len(rows):
            rows = rows[level.symbols[a[rows]] == level.symbols[b[rows]]]
            onward(level, rows)
    return (a - begin) * step


def word_runs(sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """All runs of some documents, whose numbered words stand one after another in ``words``: the
    document, start, length and period of each, ordered by these but for the length."""
    first = np.append(0, np.cumsum(sizes))[:-1] + np.arange(len(sizes)) + 1
    marks = int(words.max(initial=-1)) + 1 + np.arange(len(sizes) + 1)
    symbols = np.insert(words, np.append(0, np.cumsum(sizes)), marks)
    doc = np.repeat(np.arange(len(sizes)), np.where(sizes >= LEAST, sizes // 2, 0))
    if not len(doc):
        return (np.zeros(0, np.int64),) * 4
    levels = None
    period = np.arange(len(doc)) - np.searchsorted(doc, doc) + 1
    stride = np.maximum(LEAST - period, period)
    places = np.append(0, np.cumsum((sizes[doc] - 1 - period) // stride + 1))
    found, row = [], 0
    while row < len(doc):
        stop = max(row + 1, int(np.searchsorted(places, places[row] + GRID, "right")) - 1)
        of = np.repeat(np.arange(row, stop), np.diff(places[row : stop + 1]))
        at = first[doc[of]] + (np.arange(places[row], places[stop]) - places[of]) * stride[of]
        same = symbols[at] == symbols[at + period[of]]
        at, of, row = at[same], of[same], stop
        if not len(at):
            continue
        levels = levels or recompressed(symbols, 2 * len(sizes))
        start = at - extension(levels, at - 1, at - 1 + period[of], -1)
        end = at + period[of] + extension(levels, at, at + period[of], 1)
        long = end - start >= np.maximum(LEAST, 2 * period[of])
        found.append(np.unique(np.stack([doc[of], start, end, period[of]])[:, long], axis=1))
    made = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    made = made[:, np.lexsort(made[::-1])]
    own = np.append(True, (made[:3, 1:] != made[:3, :-1]).any(axis=0))[: made.shape[1]]
    doc, start, end, period = made[:, own]
    order = np.lexsort((period, start, doc))
    return doc[order], (start - first[doc])[order], (end - start)[order], period[order]


def _found(texts: list[str | None]) -> list[pa.Array]:
    number = defaultdict()
    number.default_factory = number.__len__
    words = [(x or "").encode().split() for x in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((number[w] for x in words for w in x), np.int64, int(sizes.sum()))
    doc, start, length, period = word_runs(sizes, flat)
    before = np.append(0, np.cumsum(sizes))
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, before[doc] + start + period, 1)
    np.add.at(change, before[doc] + start + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    collapsed = [b" ".join(x if k.all() else [w for w, y in zip(x, k, strict=True) if y]) for x, k in ((x, kept[a:b]) for x, (a, b) in zip(words, pairwise(before), strict=True))]
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
    return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)), runs), pa.array(collapsed, pa.binary()).cast(pa.string())]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Adds to ``docs`` the number of words of ``text``, its runs (start and length in words, smallest
    period, ordered by start and period) and the text without their repetitions."""
    added = [x.split()[0] for x in MADE.replace("<start:long,length:long,period:long>", "").split(", ")]
    docs = docs.drop(*added)
    place, names = docs.columns.index("text"), [*docs.columns, *added]

    def run(batches):
        for batch in batches:
            texts, start, held = batch.column(place).to_pylist(), 0, 0
            for k in range(len(texts) + 1):
                size = len(texts[k] or "") if k < len(texts) else 0
                if k == len(texts) or (held and held + size > AT_ONCE):
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, k - start).columns, *_found(texts[start:k])], names=names)
                    start, held = k, 0
                held += size

    return docs.mapInArrow(run, with_fields(docs, MADE))


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a periodic tail where crc32 of the id is a multiple of ten: from word a on,
    words repeat with period p, both picked by that checksum. Other texts stay as they are."""
    hashed = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, pick = F.size(words), F.floor(hashed / 10)
    start = F.pmod(pick, F.greatest(n, F.lit(1))).cast("int")
    period = (1 + F.floor((n - start) / (3 + F.pmod(pick, F.lit(8))))).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(words, start + 1, period), F.ceil((n - start) / period).cast("int")))
    tail = F.array_join(F.concat(F.slice(words, F.lit(1), start), F.slice(repeated, F.lit(1), n - start)), " ")
    return F.when((F.pmod(hashed, F.lit(10)) == 0) & (n > 0), tail).otherwise(text)
