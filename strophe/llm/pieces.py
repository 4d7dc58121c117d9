"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the longest rule of the model's compiled character map that fits at
each place; every normalised character keeps the byte of the text it came from. The normalised
text is cut between characters that are neighbours in no piece of the vocabulary, each cut is merged by the pieces'
scores (best score first, then leftmost), and every piece is projected to the bytes of the
original text it stands for. A character that is no piece becomes its bytes, of which the last
one has the character's span.

Cuts repeat, so a task keeps about ``CACHE`` of them merged. Texts are encoded about ``AT_ONCE``
characters at a time, as one array of characters: all its cuts are looked up at once, by hashes, and compared with what
they were found as. Those that aren't known are merged together: as rows of a table, where each
step merges the best pair of every row.

Defined results: a null or empty text has no pieces and decodes to the empty text. The model is a
byte-pair model with byte fallback and without user-defined symbols; another one is refused. Rows
keep their other columns; columns named as an added one are replaced. An empty table gives an
empty result.
"""

from __future__ import annotations

import codecs
import heapq
import re
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as proto

from strophe.llm.common import with_fields

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE, AT_ONCE, SQUARE, ROWS, FEW = 500_000, 1_000_000, 8_000, 4_096, 64
#: Characters up to which a stretch is merged without a heap; the cost of no pair.
SHORT, NONE = 64, float("inf")
#: Types of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: A piece's id and its length in characters share one number.
SHIFT = 24
SPANS = "ids array<int>, begins array<int>, ends array<int>"

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class CharacterMap:
    """The rules of a compiled character map: a double-array trie over UTF-8 and their results."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.results = blob[4 + size :]
        self._begins: dict[str, bool] = {}

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, key: bytes) -> tuple[int, int]:
        """Bytes of the longest rule that is a prefix of ``key`` and its number (0, -1: none);
        reading stops where the trie ends, so ``key`` may be any length."""
        units, found, at = self.units, (0, -1), self._child(self.units[0])
        for k, byte in enumerate(key):
            unit = units[at ^ byte]
            if unit & 0x800000FF != byte:
                break
            at ^= byte ^ self._child(unit)
            if unit & 256:
                found = k + 1, units[at] & 0x7FFFFFFF
        return found

    def begins(self, char: str) -> bool:
        """Whether a rule may begin with ``char``."""
        if char not in self._begins:
            at, fits = self._child(self.units[0]), True
            for byte in char.encode():
                unit = self.units[at ^ byte]
                if unit & 0x800000FF != byte:
                    fits = False
                    break
                at ^= byte ^ self._child(unit)
            self._begins[char] = fits
        return self._begins[char]

    def result(self, number: int) -> str:
        return self.results[number : self.results.index(b"\0", number)].decode()

    def apply(self, text: str, starts: np.ndarray) -> tuple[str, np.ndarray]:
        """The mapped text and for each of its characters the byte it came from; ``starts`` are
        the first bytes of the characters of ``text`` and its length in bytes."""
        first = "".join(sorted(c for c in set(text) if self.begins(c))) if self.units else ""
        if not first:
            return text, starts[:-1]
        raw, out, origin, done = text.encode(), [], [], 0
        for m in re.finditer(f"[{re.escape(first)}]", text):
            at = m.start()
            if at < done:
                continue
            size, number = self.longest(raw[starts[at] : starts[at] + 256])
            if not size:
                continue
            made = self.result(number)
            out += [text[done:at], made]
            origin += [starts[done:at], np.full(len(made), starts[at])]
            done = int(np.searchsorted(starts, starts[at] + size))
        return "".join([*out, text[done:]]), np.concatenate([*origin, starts[done:-1]])


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.int32)


class Known:
    """Stretches that were merged, numbered from 1: their characters and their pieces, each behind those of the one before,
    and a hash table with open slots. A stretch found by its hash is to be compared."""

    def __init__(self):
        self.weights = np.random.default_rng(13).integers(0, 2**64, 1024, np.uint64) | np.uint64(1)
        self.clear()

    def clear(self) -> None:
        self.slots, self.hashes = np.zeros(1 << 16, np.int32), np.zeros(1, np.uint64)
        self.chars, self.pieces = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.char_at, self.piece_at = np.zeros(2, np.int64), np.zeros(2, np.int64)

    def __len__(self) -> int:
        return len(self.hashes) - 1

    def hashed(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The hashes of the stretches of ``codes`` that begin at ``starts``."""
        place = np.arange(len(codes)) - np.repeat(starts, sizes)
        return np.add.reduceat((codes + 1).astype(np.uint64) * self.weights.take(place & 1023), starts)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of the stretches with these hashes, 0 if none."""
        at = self._slot(hashes)
        found = self.slots.take(at)
        other = np.flatnonzero((found > 0) & (self.hashes.take(found) != hashes))
        while len(other):
            at[other] = at[other] + 1 & len(self.slots) - 1
            found[other] = now = self.slots.take(at[other])
            other = other[(now > 0) & (self.hashes.take(now) != hashes[other])]
        return found

    def add(self, hashes: np.ndarray, stretches: list[str], pieces: list[bytes]) -> None:
        """Adds stretches with hashes that are not there yet and differ."""
        first = len(self.hashes)
        self.hashes = np.append(self.hashes, hashes)
        self.chars = np.append(self.chars, characters("".join(stretches)))
        self.pieces = np.append(self.pieces, np.frombuffer(b"".join(pieces), np.int64))
        self.char_at = np.append(self.char_at, self.char_at[-1] + np.cumsum([len(x) for x in stretches]))
        self.piece_at = np.append(self.piece_at, self.piece_at[-1] + np.cumsum([len(x) // 8 for x in pieces]))
        if 3 * len(self.hashes) > len(self.slots):
            self.slots, first = np.zeros(1 << (4 * len(self.hashes)).bit_length(), np.int32), 1
        number = np.arange(first, len(self.hashes), dtype=np.int32)
        at = self._slot(self.hashes[first:])
        while len(number):
            free = self.slots.take(at) == 0
            self.slots[at[free]] = number[free]
            left = self.slots.take(at) != number
            number, at = number[left], at[left] + 1 & len(self.slots) - 1


class Model:
    """A byte-pair piece model read from its file."""

    def __init__(self, file: bytes):
        model = proto.ModelProto()
        model.ParseFromString(file)
        self.pieces, self.rules = list(model.pieces), model.normalizer_spec
        kinds = {p.type for p in self.pieces}
        if model.trainer_spec.model_type != BPE or not model.trainer_spec.byte_fallback or kinds & {USER_DEFINED, UNUSED} or not self.rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only byte-pair models with byte fallback, escaped blanks before words and no user-defined symbols")
        self.map = CharacterMap(self.rules.precompiled_charsmap)
        self.ids = {p.piece: k for k, p in enumerate(self.pieces) if p.type == NORMAL}
        self.cost = {p.piece: -p.score for p in self.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:-1], 16): k for k, p in enumerate(self.pieces) if p.type == BYTE}
        self.known = Known()

    @cached_property
    def _neighbours(self) -> tuple[np.ndarray, int, np.ndarray]:
        """A number for each character of a piece (0: none), how many there are, and the neighbours inside pieces:
        up to SQUARE characters a table at first * many + second, else these places, sorted."""
        chars = sorted(set().union(*self.ids))
        number, many = np.zeros(0x110000, np.int32), len(chars) + 1
        number[[ord(c) for c in chars]] = np.arange(1, many)
        inside = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        places = np.array(sorted(int(number[ord(a)]) * many + int(number[ord(b)]) for a, b in inside), np.int64)
        if many > SQUARE:
            return number, many, places
        table = np.zeros(many * many, bool)
        table[places] = True
        return number, many, table

    def _apart(self, codes: np.ndarray) -> np.ndarray:
        """Whether a character and the next one are neighbours in no piece."""
        number, many, known = self._neighbours
        codes = number.take(codes)
        places = codes[:-1] * (many if known.dtype == bool else np.int64(many)) + codes[1:]
        return ~(known.take(places) if known.dtype == bool else np.isin(places, known))

    def stretches(self, text: str) -> list[str]:
        """A normalised text cut between all characters that are neighbours in no piece."""
        cuts = (np.flatnonzero(self._apart(characters(text))) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters the byte it starts at, then the end."""
        raw = np.frombuffer(text.encode(), np.uint8)
        starts = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))
        text, origin = self.map.apply(text, starts)
        end = len(raw)
        if self.rules.remove_extra_whitespaces:
            blank = np.frombuffer(text.encode("utf-32-le"), "<u4") == 32
            keep = ~(blank & np.append(True, blank[:-1])) if len(blank) else blank
            last = np.flatnonzero(~blank)
            if not len(last):
                return "", np.zeros(1, np.int64)
            if last[-1] + 1 < len(blank):
                end, keep[last[-1] + 1 :] = origin[last[-1] + 1], False
            text = "".join(np.array(list(text), dtype=object)[keep])
            origin = origin[keep]
        if not text:
            return "", np.zeros(1, np.int64)
        text = text.replace(" ", SPACE)
        if self.rules.add_dummy_prefix:
            text, origin = SPACE + text, np.append(origin[0] if self.rules.remove_extra_whitespaces else 0, origin)
        return text, np.append(origin, end)

    def joined(self, part: list[str]) -> list[str]:
        """Characters merged to pieces: the cheapest pair first, of equal ones the leftmost."""
        cost = self.cost.get
        costs = [cost(a + b, NONE) for a, b in zip(part, part[1:], strict=False)]
        while costs and (least := min(costs)) < NONE:
            k = costs.index(least)
            part[k : k + 2] = [part[k] + part[k + 1]]
            del costs[k]
            if k:
                costs[k - 1] = cost(part[k - 1] + part[k], NONE)
            if k < len(costs):
                costs[k] = cost(part[k] + part[k + 1], NONE)
        return part

    def joined_long(self, part: list[str]) -> list[str]:
        """``joined`` with a heap, for stretches where looking through all pairs takes too long."""
        n, cost, heap = len(part), self.cost.get, []
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n and (found := cost(part[left] + part[right])) is not None:
                heapq.heappush(heap, (found, left, right, len(part[left]) + len(part[right])))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if not part[left] or not part[right] or after[left] != right or len(part[left]) + len(part[right]) != size:
                continue
            part[left], part[right] = part[left] + part[right], ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [x for x in part if x]

    def merged(self, stretch: str) -> bytes:
        """The pieces of a stretch, each as its id and its characters << SHIFT in eight bytes."""
        out = []
        for p in (self.joined if len(stretch) <= SHORT else self.joined_long)(list(stretch)):
            if (known := self.ids.get(p)) is not None:
                out.append(known | len(p) << SHIFT)
            else:
                own = [self.bytes[b] for b in p.encode()]
                out += [*own[:-1], own[-1] | len(p) << SHIFT]
        return np.array(out, np.int64).tobytes()

    @cached_property
    def _symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols are pieces and the characters in them, numbered from 1: that of each character (0: none), the sorted
        pairs first * many + second that make a piece and that piece, and for each symbol its cost and packed form."""
        names = [*self.ids, *sorted(set().union(*self.ids) - self.ids.keys())]
        symbol, many = {x: k for k, x in enumerate(names, 1)}, len(names) + 1
        pairs = sorted((symbol[p[:k]] * many + symbol[p[k:]], symbol[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
        of_char = np.zeros(0x110000, np.int32)
        single = [x for x in names if len(x) == 1]
        of_char[[ord(x) for x in single]] = [symbol[x] for x in single]
        costs, packed = np.full(many, NONE, np.float32), np.full(many, -1, np.int64)
        costs[1 : len(self.ids) + 1] = [self.cost[x] for x in self.ids]
        packed[1 : len(self.ids) + 1] = [k | len(x) << SHIFT for x, k in self.ids.items()]
        keys, makes = np.array([*pairs, (many * many, 0)], np.int64).T
        return of_char, np.ascontiguousarray(keys), makes.astype(np.int32), costs, packed

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that two make, 0 if none."""
        _, keys, makes, costs, _ = self._symbols
        wanted = left.astype(np.int64) * len(costs) + right
        at = np.searchsorted(keys, wanted)
        return np.where(keys.take(at) == wanted, makes.take(at), 0)

    def _merged_rows(self, stretches: list[str]) -> list[bytes]:
        """``merged`` of stretches, all at once. Columns stand for their characters, with an empty one on either side;
        a pair is held in the column of its first symbol, and a symbol in that of its first character."""
        of_char, _, _, costs, packed = self._symbols
        sizes = np.array([len(x) for x in stretches])
        n, width = len(stretches), int(sizes.max())
        place = np.arange(1, width + 1)
        alive = np.zeros((n, width + 2), bool)
        alive[:, 1:-1] = place <= sizes[:, None]
        symbols = np.zeros((n, width + 2), np.int32)
        symbols[alive] = of_char.take(np.frombuffer("".join(stretches).encode("utf-32-le"), np.int32))
        made = np.zeros_like(symbols)
        inner = alive[:, :-1] & alive[:, 1:]
        made[:, :-1][inner] = self._made(symbols[:, :-1][inner], symbols[:, 1:][inner])
        cost = costs.take(made)
        after, before = (np.tile(np.arange(width + 2, dtype=np.int16) + k, (n, 1)) for k in (1, -1))
        after[:, -1], before[:, 0] = width + 1, 0
        rows = np.arange(n)
        while len(rows):
            best = cost[rows].argmin(1)
            found = cost[rows, best] < NONE
            rows, best = rows[found], best[found]
            gone = after[rows, best]
            beyond, ahead = after[rows, gone], before[rows, best]
            symbols[rows, best] = made[rows, best]
            symbols[rows, gone], cost[rows, gone], alive[rows, gone] = 0, NONE, False
            after[rows, best], before[rows, beyond] = beyond, best
            for left, right in ((best, beyond), (ahead, best)):
                new = self._made(symbols[rows, left], symbols[rows, right])
                made[rows, left], cost[rows, left] = new, costs.take(new)
        flat, ends = packed.take(symbols[alive]), np.cumsum(alive.sum(1))
        known = np.minimum.reduceat(flat, np.append(0, ends[:-1])) >= 0
        out, flat, at = [], flat.tobytes(), 0
        for stretch, end, fine in zip(stretches, (8 * ends).tolist(), known.tolist(), strict=True):
            out.append(flat[at:end] if fine else self.merged(stretch))
            at = end
        return out

    def _merged_all(self, stretches: list[str]) -> list[bytes]:
        """``merged`` of stretches, short ones of similar lengths together; FEW of them, each for itself."""
        out, order = [b""] * len(stretches), sorted(range(len(stretches)), key=lambda k: len(stretches[k]))
        for start in range(0, len(order), ROWS):
            places = order[start : start + ROWS]
            part = [stretches[k] for k in places]
            for k, made in zip(places, map(self.merged, part) if len(part) < FEW or len(part[-1]) > SHORT else self._merged_rows(part), strict=True):
                out[k] = made
        return out

    def _pieces(self, text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The packed pieces of the stretches of ``text`` that begin at ``starts``, and how many each has."""
        known, codes = self.known, characters(text)
        stops = np.append(starts[1:], len(codes))
        sizes = stops - starts

        def cut(places: np.ndarray) -> list[str]:
            return [text[a:b] for a, b in zip(starts[places].tolist(), stops[places].tolist(), strict=True)]

        hashes = known.hashed(codes, starts, sizes)
        found = known.find(hashes)
        missing = np.flatnonzero(found == 0)
        if len(missing):
            fresh, first = np.unique(hashes[missing], return_index=True)
            if len(known) + len(fresh) > CACHE or len(known.chars) > 16 * CACHE:
                known.clear()
                missing = np.arange(len(starts))
                fresh, first = np.unique(hashes, return_index=True)
            new = cut(missing[first])
            known.add(fresh, new, self._merged_all(new))
            found[missing] = known.find(hashes[missing])
        begin = known.char_at.take(found)
        other = known.chars.take(np.repeat(begin - starts, sizes) + np.arange(len(codes)), mode="clip") != codes
        other = np.flatnonzero((known.char_at.take(found + 1) - begin != sizes) | (np.logical_or.reduceat(other, starts) if other.any() else False))
        pool, begin = known.pieces, known.piece_at.take(found)
        count = known.piece_at.take(found + 1) - begin
        if len(other):
            own = self._merged_all(cut(other))
            count[other] = [len(x) // 8 for x in own]
            begin[other] = len(pool) + np.cumsum(count[other]) - count[other]
            pool = np.append(pool, np.frombuffer(b"".join(own), np.int64))
        stop = np.cumsum(count)
        return pool.take(np.repeat(begin - stop + count, count) + np.arange(stop[-1])), count

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all texts, behind each other, the ids of their pieces and the bytes of the own text where each begins and ends;
        before these, the places where each text's pieces start, and the end."""
        normal = [self.normalised(x) for x in texts]
        text = "".join(x for x, _ in normal)
        if not text:
            return np.zeros(len(texts) + 1, np.int32), *np.zeros((3, 0), np.int32)
        borders = np.cumsum([0, *(len(x) for x, _ in normal)])
        first = np.append(True, self._apart(characters(text)))
        first[borders[borders < len(text)]] = True
        starts = np.flatnonzero(first)
        parts = np.unique(np.searchsorted(starts, [*range(0, len(text), AT_ONCE), len(text)]))
        made = [self._pieces(text[starts[a] : starts[b] if b < len(starts) else None], starts[a:b] - starts[a]) for a, b in zip(parts, parts[1:], strict=False)]
        packed, count = (np.concatenate(x) for x in zip(*made, strict=True))
        offsets = np.append(0, np.cumsum(count))[np.searchsorted(starts, borders)]
        # The places of a text's characters end with one more, that of its end.
        origin = np.concatenate([x for _, x in normal])
        stop = np.cumsum(packed >> SHIFT) + np.repeat(np.arange(len(texts)), np.diff(offsets))
        ids, begins, ends = packed & (1 << SHIFT) - 1, origin.take(stop - (packed >> SHIFT)), origin.take(stop)
        return tuple(x.astype(np.int32) for x in (offsets, ids, begins, ends))

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the ids of its pieces and the bytes of it where each begins and ends."""
        offsets, *made = self.encode_flat(texts)
        return [tuple(x[a:b] for x in made) for a, b in zip(offsets, offsets[1:], strict=False)]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``encode_all`` of one text."""
        return self.encode_all([text])[0]

    @cached_property
    def _surface(self) -> list[str]:
        """What each id reads as; bytes over 127 as the escapes of undecodable bytes."""
        kinds = {UNKNOWN: lambda p: " ⁇ ", CONTROL: lambda p: "", BYTE: lambda p: bytes([int(p[3:-1], 16)]).decode("utf-8", "surrogateescape")}
        return [kinds.get(p.type, lambda p: p.replace(SPACE, " "))(p.piece) for p in self.pieces]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that are no UTF-8 read as U+FFFD, the blank put before a text goes."""
        text = "".join(map(self._surface.__getitem__, ids))
        if self.rules.add_dummy_prefix or self.rules.remove_extra_whitespaces:
            first = next((k for k in ids if self._surface[k]), None)
            if first is not None and self.pieces[first].piece.startswith(SPACE):
                text = text[1:]
        if text.isascii():
            return text
        try:
            text.encode()
            return text
        except UnicodeEncodeError:
            return text.encode("utf-8", "surrogateescape").decode("utf-8", "each_byte")


@cache
def model(path: str) -> Model:
    with open(path, "rb") as file:
        return Model(file.read())


def _shares(sizes: list[int], most: int):
    """Consecutive stretches of rows of about ``most`` in sum."""
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield start, k
            start, held = k, 0
        held += size
    yield start, len(sizes)


def encoded(docs: DataFrame, path: str = MODEL, back: str | None = None) -> DataFrame:
    """Adds to ``docs`` the pieces of ``text``: ids, and begins and ends, the first byte of each in the
    text's UTF-8 and the byte behind its last; with ``back`` also this column, the text that the ids decode to,
    as ``decoded`` adds it, but in the same pass.

    The file ``path`` must lie there on every executor.
    """
    fields = SPANS + (f", `{back}` string" if back else "")
    docs = docs.drop(*(x.split()[0] for x in SPANS.split(", ")), *([back] if back else []))
    schema, place = with_fields(docs, fields), docs.columns.index("text")

    def run(batches):
        own = model(path)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for start, stop in _shares([len(x or "") + 1 for x in texts], AT_ONCE):
                offsets, *made = own.encode_flat([x or "" for x in texts[start:stop]])
                added = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in made]
                if back:
                    ids, ends = made[0].tolist(), offsets.tolist()
                    added.append(pa.array([own.decode(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.slice(start, stop - start).columns, *added], names=schema.names)

    return docs.mapInArrow(run, schema)


def decoded(pieces: DataFrame, path: str = MODEL, out: str = "decoded") -> DataFrame:
    """Adds the column ``out``, the text of the column ``ids``; null ids read as none."""
    pieces = pieces.drop(out)
    place, names = pieces.columns.index("ids"), [*pieces.columns, out]

    def run(batches):
        decode = model(path).decode
        for batch in batches:
            column = batch.column(place)
            sizes = [x or 0 for x in column.value_lengths().to_pylist()]
            for start, stop in _shares([x + 1 for x in sizes], AT_ONCE):
                part = batch.slice(start, stop - start)
                texts = [decode(x or []) for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return pieces.mapInArrow(run, with_fields(pieces, f"`{out}` string"))
