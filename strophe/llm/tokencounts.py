"""Token counts that follow edits.

The index keeps, for each document, a segment tree over its pre-tokens: leaves are runs of
LEAF pre-tokens with their characters and tokens, every inner node has the sums of its two
children. All nodes are stored, so loading a tree sums nothing. An edit (start, stop, text)
finds its leaf by walking down the character sums. From two leaves before the edit, the text
is cut into pre-tokens anew until a boundary behind the edit falls on the end of a leaf; only
those pre-tokens are encoded again. They are dealt to the leaves they cover, and the sums on
the way from these to the root are updated. Where they would need leaves of over 2 * LEAF
pre-tokens, new leaves are put in and the nodes are summed anew, encoding nothing more.

Cutting looks one character past a pre-token at most (a run of white space gives its last
character to what follows), so starting that early and stopping at a boundary that was one
before gives what a full count gives.

Defined results: a null text is counted as empty. Edits apply in order, each to the text the
ones before left; starts and stops outside the text are moved to its ends, a stop before
its start is the start; null edits or parts of one count as none, a null replacement as
empty. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import with_fields, written

LEAF = 16
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published cutting pattern of the byte-level vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = regex.compile(PATTERN)
CACHE = 500_000
INDEX = "node_chars array<int>, node_tokens array<int>"
MADE = "tokens_before long, tokens_after long, pieces_encoded long, nodes_updated long"
EDIT = "array<struct<start:int,stop:int,text:string>>"


@cache
def encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class PieceCounts(dict):
    """Tokens of each pre-token seen; emptied when it holds CACHE of them."""

    def __init__(self, vocabulary: str):
        super().__init__()
        self.encode = encoding(vocabulary).encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


def leaves(pieces: list[str], counts: PieceCounts) -> tuple[list[int], list[int]]:
    """Characters and tokens of each run of LEAF pre-tokens."""
    if not pieces:
        return [], []
    starts = np.arange(0, len(pieces), LEAF)
    chars = np.fromiter(map(len, pieces), np.int32, len(pieces))
    tokens = np.fromiter(map(counts.__getitem__, pieces), np.int32, len(pieces))
    return np.add.reduceat(chars, starts).tolist(), np.add.reduceat(tokens, starts).tolist()


class Tree:
    """Sums of characters and tokens over leaves: node k has the children 2k and 2k + 1.

    ``Tree(*nodes)`` takes stored nodes as they are, ``Tree.over`` sums leaves.
    """

    def __init__(self, chars: list[int] = (), tokens: list[int] = ()):
        self.chars, self.tokens = list(chars) or [0, 0], list(tokens) or [0, 0]
        self.width = len(self.chars) // 2
        self.touched = 0

    @classmethod
    def over(cls, chars: list[int], tokens: list[int]) -> Tree:
        width = 1 << max(0, len(chars) - 1).bit_length()
        tree = cls(*([0] * width + list(x) + [0] * (width - len(x)) for x in (chars, tokens)))
        for k in range(width - 1, 0, -1):
            tree._sum(k)
        return tree

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one at the text's end) and its first character."""
        k, before = 1, 0
        while k < self.width:
            k *= 2
            if char >= before + self.chars[k] and self.chars[k + 1]:
                before += self.chars[k]
                k += 1
        return k - self.width, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.width
        self.chars[k], self.tokens[k] = chars, tokens
        while k > 1:
            k //= 2
            self._sum(k)
            self.touched += 1


def apply_edit(text: str, tree: Tree, edit: tuple, counts: PieceCounts) -> tuple[str, int]:
    """The text after an edit and the number of pre-tokens encoded again; updates the tree.

    Cutting starts two leaves early and stops at the end of a leaf, so other leaves keep
    their characters and tokens.
    """
    start, stop, new = edit
    start = min(max(0, start), len(text))
    stop = min(max(start, stop), len(text))
    edited = text[:start] + new + text[stop:]
    shift = len(edited) - len(text)
    first, at = tree.leaf_at(start)
    for _ in range(2):
        while first > 0:
            first -= 1
            size = tree.chars[first + tree.width]
            at -= size
            if size:
                break
    last, last_at = tree.leaf_at(stop)
    end = last_at + tree.chars[last + tree.width]
    pieces = []
    for m in CUT.finditer(edited, at):
        pieces.append(m.group())
        place = m.end() - shift
        while place > end and last + 1 < tree.width:
            last += 1
            end += tree.chars[last + tree.width]
        if place == end and place >= stop:
            break
    else:
        last = tree.width - 1
    slots = last + 1 - first
    if len(pieces) > 2 * LEAF * slots:
        own, made = tree.width, list(zip(*leaves(pieces, counts), strict=True))
        old = list(zip(tree.chars[own:], tree.tokens[own:], strict=True))
        grown = Tree.over(*zip(*(x for x in old[:first] + made + old[last + 1 :] if x[0]), strict=True))
        tree.chars, tree.tokens, tree.width, tree.touched = grown.chars, grown.tokens, grown.width, tree.touched + grown.width
        return edited, len(pieces)
    per = max(LEAF, -(-len(pieces) // slots))
    for k in range(slots):
        held = pieces[k * per : (k + 1) * per]
        if held or tree.chars[first + k + tree.width]:
            tree.put(first + k, sum(map(len, held)), sum(map(counts.__getitem__, held)))
    return edited, len(pieces)


def token_index(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds the nodes of the segment tree to ``docs``: node_chars and node_tokens, which replace
    columns of these names. Written as a table, it is the index that edits are applied to.

    The file ``vocabulary`` must lie at that path on every executor.
    """
    docs = docs.drop("node_chars", "node_tokens")
    place = docs.columns.index("text")

    def run(batches):
        counts = PieceCounts(vocabulary)
        for batch in batches:
            made = [Tree.over(*leaves(CUT.findall(x or ""), counts)) for x in batch.column(place).to_pylist()]
            more = [pa.array([getattr(x, k) for x in made], pa.list_(pa.int32())) for k in ("chars", "tokens")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "node_chars", "node_tokens"])

    return docs.mapInArrow(run, with_fields(docs, INDEX))


def apply_edits(index: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Applies the column ``edits`` of an index table to its texts and trees.

    ``edits`` is an array of structs start, stop (characters), text. Adds tokens_before,
    tokens_after, pieces_encoded and nodes_updated, which replace columns of these names, and
    updates text, node_chars and node_tokens.
    """
    added = [x.split()[0] for x in MADE.split(", ")]
    index = index.drop(*added)
    at = {c: index.columns.index(c) for c in ("text", "edits", "node_chars", "node_tokens")}
    names = [*index.columns, *added]

    def run(batches):
        counts = PieceCounts(vocabulary)
        for batch in batches:
            columns, out = list(batch.columns), []
            for text, edits, chars, tokens in zip(*(batch.column(at[c]).to_pylist() for c in at), strict=True):
                tree, pieces, text = Tree(chars or [], tokens or []), 0, text or ""
                before = tree.tokens[1]
                for edit in edits or []:
                    if edit and edit["start"] is not None and edit["stop"] is not None:
                        text, n = apply_edit(text, tree, (edit["start"], edit["stop"], edit["text"] or ""), counts)
                        pieces += n
                out.append((text, tree.chars, tree.tokens, before, tree.tokens[1], pieces, tree.touched))
            text, chars, tokens, *sums = zip(*out, strict=True) if out else ([],) * 7
            columns[at["text"]] = pa.array(text, pa.string())
            columns[at["node_chars"]], columns[at["node_tokens"]] = (pa.array(x, pa.list_(pa.int32())) for x in (chars, tokens))
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in sums)], names=names)

    return index.mapInArrow(run, with_fields(index, MADE))


def edited(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``apply_edits`` of ``docs`` (text, edits) by an index that is written and read back."""
    return apply_edits(written(token_index(docs, vocabulary), "token-index", "zstd"), vocabulary)


def sample_edits() -> F.Column:
    """Three edits of a document made from itself: its first 40 characters are put at a place
    its id picks, 25 characters are deleted at another, and a third stretch is swapped for
    the text's last 12 characters."""
    n = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1))
    place = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), n).cast("int")
    edit = lambda start, size, text: F.struct(start.alias("start"), (start + size).alias("stop"), text.alias("text"))
    return F.array(edit(place(1), 0, F.substring("text", 1, 40)), edit(place(2), 25, F.lit("")), edit(place(3), 9, F.substring("text", -12, 12)))
