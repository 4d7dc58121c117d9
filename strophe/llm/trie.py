"""The trie of conversation prefixes from vertical bitmaps.

Conversations are dealt to shards of consecutive ids. A shard indexes each (place, turn) by the
bitset of the conversations that have that turn there. Depth first, a node's bitset is
intersected with the postings of the turn that its first conversation not yet in a child has
next, which gives a child, its members (popcount) and, of those whose turns end there, the ids.
A node is known everywhere by a digest of its turns.

Nodes of all shards meet by digest. Sums over subtrees are made where the data is small again:
the first shard that has a node also has all nodes above it, so each node's gains go to that shard,
which sums them up over its preorder, and one more grouping by digest adds the shards up, whatever the depth.
The ids that end at a node are hashed as a stream of pieces in order.

Defined results: turns are ordered by turn (nulls first), ties by role, then text; a null role or
text is empty; rows without conv_id are no conversation. A conversation without turns is a member
of the root. No conversations give no nodes. A task holds the turns' digests of about TURNS turns, or of
one longer conversation.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import spread_join, written

CONVERSATIONS, TURNS = 4096, 50_000
#: Ids of a piece of an end list.
PIECE = 1024
#: Turns that may be taken from another conversation.
OPENING = 5
LOCAL = "shard long, node int, last int, key binary, parent binary, depth long, conv_id long, n_convs long, n_children long, chars long, ends array<string>"
ROOT = hashlib.sha256(b"").digest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and chars (code points of the text) of each turn."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.encode(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), "UTF-8"), 256))
    return rows.select("conv_id", F.row_number().over(order).alias("place"), digest.alias("digest"), F.length("text").cast("long").alias("chars"))


def with_shared_openings(found: DataFrame) -> DataFrame:
    """Conversations that begin alike: the first h turns of c are those of c - c % 100, h being
    crc32(c) % 6. ``found`` as from ``turns``, a written table; each conversation has a row of
    place 0 besides, without digest."""
    opening = lambda c: F.pmod(F.crc32(c.cast("string")), F.lit(6))
    ids = found.select("conv_id").distinct()
    own = found.where((F.col("place") > opening(F.col("conv_id"))))
    lent = found.where(F.col("place") <= OPENING).withColumnRenamed("conv_id", "_lender")
    taken = ids.withColumn("_lender", F.col("conv_id") - F.col("conv_id") % 100).join(lent, "_lender").where(F.col("place") <= opening(F.col("conv_id")))
    return own.unionByName(taken.select(*found.columns)).unionByName(ids.select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars")))


def shard_trie(ids: list[int], paths: list[list[tuple[bytes, int]]]) -> list[tuple]:
    """The nodes of a shard in preorder, with the fields of LOCAL; ``ids`` ascend."""
    postings, ending, longer = defaultdict(int), defaultdict(int), defaultdict(int)
    for k, path in enumerate(paths):
        bit = 1 << k
        ending[len(path)] |= bit
        for place, turn in enumerate(path):
            postings[place, turn] |= bit
            longer[place] |= bit
    nodes, open_nodes = [], []

    def enter(bits: int, key: bytes, parent: bytes, depth: int, chars: int) -> None:
        ended, own = bits & ending[depth], []
        while ended:
            low = ended & -ended
            own.append(str(ids[low.bit_length() - 1]))
            ended ^= low
        ends = [",".join(own[k : k + PIECE]) for k in range(0, len(own), PIECE)] or None
        nodes.append([ids[0], len(nodes), 0, key, parent, depth, ids[(bits & -bits).bit_length() - 1], bits.bit_count(), 0, chars, ends])
        open_nodes.append((len(nodes) - 1, bits, bits & longer[depth]))

    enter((1 << len(ids)) - 1, ROOT, b"", 0, 0)
    while open_nodes:
        at, bits, rest = open_nodes.pop()
        node = nodes[at]
        if not rest:
            node[2] = len(nodes) - 1
            continue
        depth = node[5]
        turn = paths[(rest & -rest).bit_length() - 1][depth]
        child = bits & postings[depth, turn]
        open_nodes.append((at, bits, rest & ~child))
        node[8] += 1
        enter(child, hashlib.sha256(node[3] + turn[0]).digest(), node[3], depth + 1, turn[1])
    return nodes


def shard_tries(found: DataFrame) -> DataFrame:
    """The nodes of every shard: ``found`` has conv_id, place, digest and chars; a row without digest
    stands for a conversation as such."""

    def run(batches):
        ids, paths, held = [], [], 0

        def made():
            columns = zip(*shard_trie(ids, paths), strict=True)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.list_(pa.string())]
            names = [x.split()[0] for x in LOCAL.split(", ")]
            table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
            return table.to_batches(max_chunksize=10_000)

        for batch in batches:
            for conv, digest, chars in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not ids or ids[-1] != conv:
                    if len(ids) >= CONVERSATIONS or held >= TURNS:
                        yield from made()
                        ids, paths, held = [], [], 0
                    ids.append(conv)
                    paths.append([])
                if digest is not None:
                    paths[-1].append((digest, chars))
                    held += 1
        if ids:
            yield from made()

    rows = found.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "digest", "chars")
    return rows.mapInArrow(run, LOCAL)


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """For each node of a shard the sums of ``leaves`` and ``saved`` over its subtree."""
    local, gains = rows[rows["key"].notna()], rows[rows["key"].isna()]
    size = int(local["last"].max()) + 2
    out = {"key": local["key"].to_numpy()}
    for name in ("leaves", "saved"):
        before = np.zeros(size, np.int64)
        np.add.at(before, gains["node"].to_numpy(np.int64) + 1, gains[name].to_numpy(np.int64))
        before = np.cumsum(before)
        out[name] = before[local["last"].to_numpy(np.int64) + 1] - before[local["node"].to_numpy(np.int64)]
    made = pd.DataFrame(out)
    return made[(made["leaves"] != 0) | (made["saved"] != 0)]


def _hashed(pieces: DataFrame) -> DataFrame:
    """key and ends_sha256 of end lists in pieces (key, shard, piece, ids), read as a stream."""

    def run(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    rows = pieces.repartition("key").sortWithinPartitions("key", "shard", "piece").select("key", "ids")
    return rows.mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(found: DataFrame) -> DataFrame:
    """A row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 and its digest ``key``.

    saved_tokens sums, over the subtree, the code points of a node's last text times its members
    but one. ``found`` as for ``shard_tries``.
    """
    local = written(shard_tries(found), "trie-shards")
    first = F.min(F.struct("shard", "node"))
    nodes = local.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("n_children").alias("_inner"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), F.max("parent").alias("parent"), first.alias("_first"))
    nodes = written(nodes, "trie-nodes")
    leaf, saved = (F.col("_inner") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    none = F.lit(0).cast("long")
    gains = nodes.select("_first.shard", "_first.node", F.lit(None).cast("int").alias("last"), F.lit(None).cast("binary").alias("key"), leaf.alias("leaves"), saved.alias("saved"))
    rows = local.select("shard", "node", "last", "key", none.alias("leaves"), none.alias("saved")).unionByName(gains.where("leaves <> 0 OR saved <> 0"))
    sums = rows.groupBy("shard").applyInPandas(_summed, "key binary, leaves long, saved long").groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    ends = _hashed(local.where("ends IS NOT NULL").select("key", "shard", F.posexplode("ends").alias("piece", "ids")))
    zero = lambda name: F.coalesce(F.col(name), none).alias(name)
    whole = nodes.join(children, "key", "left").join(sums, "key", "left").join(ends, "key", "left")
    whole = whole.select("key", "parent", "conv_id", "depth", "n_convs", zero("n_children"), zero("n_leaves"), zero("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    return with_parents(written(whole, "trie"))


def with_parents(whole: DataFrame) -> DataFrame:
    """Adds parent_conv_id; children of one node are spread over tasks."""
    parents = whole.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_siblings"))
    below = spread_join(whole.where("depth > 0"), parents, "parent", "_siblings").drop("_siblings")
    top = whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.unionByName(top).drop("parent")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of conversations (conv_id, turn, role, text) as they are."""
    found = written(turns(conversations), "turns")
    ids = found.select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars")).distinct()
    return prefix_trie(found.unionByName(ids))


def shared_opening_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of conversations that share openings."""
    return prefix_trie(with_shared_openings(written(turns(conversations), "turns")))
