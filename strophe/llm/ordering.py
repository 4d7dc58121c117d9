"""Token ids in training order.

Documents are encoded and cut into sequences of fixed length, the last one padded. Every
sequence has a number in the order of doc_id and text, and a keyed Feistel network with cycle-walking turns
numbers below N into global slots below N, one to one, without a shuffle table. Slot s lies
in shard s // rows_per_shard; each shard is one Spark partition and one file of fixed-stride
records in slot order, so a reader finds any slot by division and resumes anywhere.

A record is ``seq_len`` little-endian 16-bit ids and a 16-bit zero that ends it (the text
writer's line separator), so a file maps to an array of shape (rows, seq_len + 1).

The shards are written in WAVES runs of consecutive shards. A wave reads the encoded table
again, but shuffles its own records only, and its shuffle files go when its shards stand, so
the disk never holds the whole shuffle. A shard that exists already is replaced, so a run that
broke off is simply run again, whole or from the shard where it stopped.

Numbers come from range partitions of (doc_id, text hash) and prefix sums over them. Equal
rows, which may be a third of all, spread over partitions by a third key and take each
other's numbers without a trace, so the same rows and key give the same shards, however
the input is split.

Defined results: null and empty texts give no sequence; null ids come first; equal rows give
sequences of their own. An empty table writes no shard and gives an empty result. Further
columns are ignored. While shards are written, Spark's setting that deletes the shuffle
files of finished writes holds for the whole session. The file ``vocabulary`` must lie at that
path on every executor.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.llm.common import new_path, releasing_shuffles, written

SEQ_LEN = 512
ROWS_PER_SHARD = 8_192
KEY = 0x5EED
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PAD = 50_256
RECORD_END = "\u0000\u0000"
ROUNDS = 6
WAVES = 3


def feistel(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1. Values that leave the range walk on until they are back."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(xxhash.xxh64_intdigest(struct.pack("<QI", key, r))) for r in range(ROUNDS)]
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> shift, out[walking] & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[walking] = (left << shift) | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def encoded(docs: DataFrame, seq_len: int, vocabulary: str) -> DataFrame:
    """doc_id, part, first, n_tokens, tokens: ids as 16-bit bytes; ``first`` counts the
    sequences of the documents before this one in its range partition ``part``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from strophe.llm.tokencounts import encoding

        encode, part, first = encoding(vocabulary).encode_ordinary, TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                cut = batch.slice(at, 500)
                ids = [np.array(encode(x), np.uint16) for x in cut.column(1).to_pylist()]
                firsts = first + np.cumsum([0, *(-(-len(x) // seq_len) for x in ids)])
                first = int(firsts[-1])
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(firsts[:-1], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "part", "first", "n_tokens", "tokens"])

    rows = docs.where(F.length("text") > 0).select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_any"))
    rows = rows.repartitionByRange("doc_id", "_hash", "_any").sortWithinPartitions("doc_id", "_hash").select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {kind}, part int, first long, n_tokens long, tokens binary")


def _sequences(rows: DataFrame, n: int, key: int, seq_len: int, slots_of: range | None = None) -> DataFrame:
    """Index rows; with ``slots_of`` those of its slots only, each with its padded record."""
    payload = slots_of is not None
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "seq", "n_tokens", "slot", *["record"] * payload]

    def run(batches):
        pad = struct.pack("<H", PAD) * seq_len
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                cut = batch.slice(at, 200)
                counts = cut.column(2).to_numpy()
                many = -(-counts // seq_len)
                owner = np.repeat(np.arange(len(counts)), many)
                seq = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                sizes = np.minimum(seq_len, counts[owner] - seq * seq_len)
                slots = feistel(cut.column(1).to_numpy()[owner] + seq, n, key)
                if payload:
                    mine = np.flatnonzero((slots >= slots_of.start) & (slots < slots_of.stop))
                    owner, seq, sizes, slots = owner[mine], seq[mine], sizes[mine], slots[mine]
                out = [cut.column(0).take(pa.array(owner)), pa.array(seq), pa.array(sizes), pa.array(slots)]
                if payload:
                    tokens = cut.column(3).to_pylist()
                    cuts = [tokens[o][2 * seq_len * s : 2 * seq_len * (s + 1)] for o, s in zip(owner, seq, strict=True)]
                    out.append(pa.array([x + pad[len(x) :] for x in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    columns = ["doc_id", "number", "n_tokens", *["tokens"] * payload]
    return rows.select(*columns).mapInArrow(run, f"doc_id {kind}, seq long, n_tokens long, slot long" + ", record binary" * payload)


def materialise(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, rows_per_shard: int = ROWS_PER_SHARD, key: int = KEY, vocabulary: str = VOCABULARY, waves: int = WAVES, from_shard: int = 0) -> DataFrame:
    """Writes the shards from ``from_shard`` on under ``path`` and returns the index: doc_id, seq,
    n_tokens, slot, shard, row (in its shard). One driver value, the number of sequences, is read back."""
    return _materialise(docs, path, seq_len, rows_per_shard, key, vocabulary, waves, from_shard)[0]


def _materialise(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, rows_per_shard: int = ROWS_PER_SHARD, key: int = KEY, vocabulary: str = VOCABULARY, waves: int = WAVES, from_shard: int = 0) -> tuple[DataFrame, int]:
    with releasing_shuffles(docs.sparkSession):
        rows = written(encoded(docs, seq_len, vocabulary), "encoded", "zstd")
        sizes = rows.groupBy("part").agg(F.sum(F.ceil(F.col("n_tokens") / seq_len)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = written(sizes.select("part", "n", before.alias("start")), "starts")
        n = starts.agg(F.sum("n")).first()[0] or 0
        numbered = rows.join(starts, "part").withColumn("number", F.col("start") + F.col("first"))
        shard = F.floor(F.col("slot") / rows_per_shard).cast("int")
        n_shards = -(-n // rows_per_shard)
        step = max(1, -(-n_shards // waves))
        for first in range(from_shard, n_shards, step):
            last = min(first + step, n_shards)
            out = _sequences(numbered, n, key, seq_len, range(first * rows_per_shard, last * rows_per_shard)).select(shard.alias("shard"), "slot", "record")
            out = out.repartitionById(last - first, F.col("shard") - first).sortWithinPartitions("shard", "slot")
            shards = out.select(F.col("record").cast("string").alias("value"), "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            shards.option("lineSep", RECORD_END).partitionBy("shard").text(path)
    return _sequences(numbered, n, key, seq_len).select("*", shard.alias("shard"), (F.col("slot") % rows_per_shard).alias("row")), n


def read_records(spark: SparkSession, path: str, seq_len: int = SEQ_LEN, rows_per_shard: int = ROWS_PER_SHARD, first_slot: int = 0) -> DataFrame:
    """slot, tokens (binary) of the shards from ``first_slot`` on; earlier shards aren't opened."""
    stride = 2 * seq_len + len(RECORD_END.encode())
    files = spark.read.format("binaryFile").load(path).where(F.col("shard") >= first_slot // rows_per_shard).select("shard", "content")

    def run(batches):
        for batch in batches:
            for shard, data in zip(batch.column(0), batch.column(1), strict=True):
                shard, data = shard.as_py(), data.as_py()
                if len(data) % stride:
                    raise ValueError(f"shard {shard} has {len(data)} bytes, not a multiple of {stride}")
                for at in range(0, len(data) // stride, 2000):
                    rows = range(at, min(at + 2000, len(data) // stride))
                    slots = [shard * rows_per_shard + k for k in rows]
                    keep = [k for k in rows if shard * rows_per_shard + k >= first_slot]
                    slots = [shard * rows_per_shard + k for k in keep]
                    yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([data[k * stride : k * stride + 2 * seq_len] for k in keep], pa.binary())], names=["slot", "tokens"])

    return files.mapInArrow(run, "slot long, tokens binary")


def ordered(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Materialises ``docs``, reads the shards back and returns the index with each record's crc32."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-shards")
    index, n = _materialise(docs, path, **options)
    if not n:
        return index.withColumn("record_crc32", F.lit(None).cast("long"))
    read = {k: options[k] for k in ("seq_len", "rows_per_shard") if k in options}
    back = read_records(spark, path, **read).select("slot", F.crc32("tokens").alias("record_crc32"))
    return index.join(back, "slot")
