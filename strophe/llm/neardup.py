"""Near-duplicate components by circulant MinHash, banding and exact verification.

1. Every text becomes its set of word shingles; documents with equal sets form a class,
   named by its smallest doc_id. Two permutations give each class ``bands * rows`` MinHash
   values, cut into bands. At a similarity of 0.75 a pair of classes misses all 32 bands of
   4 rows with probability 5e-6.
2. Classes that share a band are compared with the band's smallest class, its leader, on
   their full sets (``stars``). This is linear in the size of a band.
3. Classes of a leader that are not linked to it are compared with all others of that
   leader on full sets, in blocks of about ``BLOCK`` classes or ``SHINGLES`` shingles a side,
   whichever is fewer (``rest``), so that no link is lost and a block's size is bounded. Blocks report only links that join classes not joined yet: pairs are never emitted.
   Joins that carry texts or sets are merge joins at every size, so a small run shows the
   shuffles of a large one.

4. Links become components by min-label propagation with written tables between rounds.

Defined results: a null or wordless text has no shingles and is its own component. A null
doc_id takes part in no link; its component is null and it is kept. Rows that share a
doc_id share a component. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import free_name, written
from strophe.llm.shingles import PLACES, WIDTH, WordHashes, circulant_signatures, mix, shingle_set, similar

BANDS, ROWS = 32, 4
PERCENT = 75
#: Documents whose signatures are made at once, members of a leader in one task's share.
AT_ONCE, BLOCK = 64, 512
#: Shingles of one side of a block of ``rest``, 8 bytes each, beyond a first text.
SHINGLES = 2_000_000


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each set and band; equal keys mean equal band and MinHash values."""
    values = circulant_signatures(sets, bands * rows).astype(np.uint64).reshape(len(sets), bands, rows)
    total = (values * PLACES[:rows]).sum(axis=2, dtype=np.uint64)
    return mix(total * np.uint64(2) + PLACES[0] * np.arange(bands, dtype=np.uint64)).astype(np.int64)


def fingerprints(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, class_key (128 bits of the set's hash) and bands of every document."""

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                sets = [shingle_set(x, cache, width) for x in part.column(1).to_pylist()]
                full = [k for k, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    for k, row in zip(full, band_keys([sets[k] for k in full], bands, rows), strict=True):
                        keys[k] = row
                marks = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "class_key", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, class_key binary, bands array<long>")


def candidates(classes: DataFrame) -> DataFrame:
    """(leader, doc_id) of classes that share a band with a smaller class; once each."""
    rows = written(classes.select("doc_id", F.explode("bands").alias("band")), "bands")
    leaders = rows.groupBy("band").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = rows.join(written(leaders, "leaders").hint("merge"), "band").where("doc_id <> leader")
    return pairs.groupBy("leader", "doc_id").agg(F.lit(1).alias("_")).drop("_")


def shingle_table(docs: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and shingles (array) of the documents whose id is in ``wanted``."""

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                sets = [shingle_set(x, cache, width).astype(np.int64) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(run, f"doc_id {kind}, shingles array<long>")


def _sets(column: pa.Array) -> list[np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    ends = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def stars(pairs: DataFrame, shingles: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``pairs`` (leader, doc_id) with ``linked``, whether the two are similar enough, and ``size``, doc_id's shingles.

    A leader's set is sent once to each share of at most about BLOCK members, and a share
    is read as a stream: leader first, then its members.
    """
    shares = written(pairs.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).alias("shares")), "shares")
    share = F.pmod(F.xxhash64("doc_id"), F.col("shares"))
    members = pairs.join(shares, "leader").select("leader", share.alias("share"), F.lit(1).alias("role"), "doc_id")
    firsts = shares.select("leader", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role"), F.col("leader").alias("doc_id"))
    rows = members.unionByName(firsts).join(shingles.hint("merge"), "doc_id").select("leader", "share", "role", "doc_id", "shingles")
    rows = rows.repartition("leader", "share").sortWithinPartitions("leader", "share", "role")

    def run(batches):
        at, leaders = None, []
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(4)]
            out = []
            for leader, part, role, doc, found in zip(*cols, _sets(batch.column(4)), strict=True):
                if (leader, part) != at:
                    at, leaders = (leader, part), []
                if role == 0:
                    leaders.append(found.copy())
                else:
                    out.append((leader, doc, any(similar(x, found, percent) for x in leaders), len(found)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (kind, kind, pa.bool_(), pa.int64()), strict=True)], names=["leader", "doc_id", "linked", "size"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(pairs.schema["doc_id"].dataType)
    spark_kind = pairs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"leader {spark_kind}, doc_id {spark_kind}, linked boolean, size long")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Intersection sizes of every set of ``a`` with every set of ``b``."""
    rows_a, rows_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(all_a, all_b)
    out = np.zeros((len(a), len(b)), np.float64)
    keep_a, keep_b = (np.isin(x, common) for x in (all_a, all_b))
    at_a, rows_a = np.searchsorted(common, all_a[keep_a]), rows_a[keep_a]
    at_b, rows_b = np.searchsorted(common, all_b[keep_b]), rows_b[keep_b]
    for start in range(0, len(common), columns):
        pick_a, pick_b = (at_a // columns == start // columns), (at_b // columns == start // columns)
        left, right = np.zeros((len(a), columns), np.float32), np.zeros((len(b), columns), np.float32)
        left[rows_a[pick_a], at_a[pick_a] - start] = 1
        right[rows_b[pick_b], at_b[pick_b] - start] = 1
        out += left @ right.T
    return out.astype(np.int64)


def rest(tested: DataFrame, shingles: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between members of a leader of which one at least isn't linked to it.

    Of what links a cell finds, it reports those that join rows not joined before, the rows
    linked to the leader counting as joined.
    """
    free = F.when(~F.col("linked"), F.col("size")).otherwise(F.lit(0))
    groups = tested.groupBy("leader").agg(F.count("*").alias("n"), F.sum("size").alias("_all"), F.count_if(~F.col("linked")).alias("loose"), F.sum(free).alias("_free")).where("loose > 0 and n > 1")
    blocks = lambda rows, size: F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(size) / SHINGLES)).cast("int")
    groups = groups.select("leader", blocks("loose", "_free").alias("_i"), blocks("n", "_all").alias("_j"))
    sized = tested.join(written(groups, "loose-groups"), "leader")
    sized = written(sized, "loose")
    row, col = (F.pmod(F.xxhash64("doc_id"), F.col(x)).cast("int") for x in ("_i", "_j"))
    side = lambda df, role, i, j: df.select("leader", i.alias("i"), j.alias("j"), F.lit(role).alias("role"), "doc_id", "linked")
    cells = side(side_explode(sized.where(~F.col("linked")), "_j"), 0, row, F.col("_at")).unionByName(side(side_explode(sized, "_i"), 1, F.col("_at"), col))
    rows = cells.join(shingles.hint("merge"), "doc_id").select("leader", "i", "j", "role", "doc_id", "linked", "shingles")
    rows = rows.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "role", "doc_id")

    def compare(cell):
        loose, every = ([x for x in cell if x[0] == role] for role in (0, 1))
        if not loose or not every:
            return []
        both = shared_counts([x[3] for x in loose], [x[3] for x in every])
        union = np.array([[len(x[3])] for x in loose]) + np.array([len(x[3]) for x in every]) - both
        joined = {x[1]: x[1] for x in cell}
        top = next((x[1] for x in every if x[2]), None)
        joined |= {x[1]: top for x in cell if x[2]}

        def find(x):
            while joined[x] != x:
                joined[x] = x = joined[joined[x]]
            return x

        found = []
        for i, j in zip(*np.nonzero(100 * both >= percent * union), strict=True):
            a, b = find(loose[i][1]), find(every[j][1])
            if a != b:
                joined[a] = b
                found.append((loose[i][1], every[j][1]))
        return found

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(tested.schema["doc_id"].dataType)

    def run(batches):
        at, cell = None, []

        def closed():
            if out := compare(cell):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in zip(*out, strict=True)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(6)]
            for leader, i, j, role, doc, linked, found in zip(*cols, _sets(batch.column(6)), strict=True):
                if (leader, i, j) != at:
                    yield from closed()
                    at, cell = (leader, i, j), []
                cell.append((role, doc, linked, found.copy()))
        yield from closed()

    spark_kind = tested.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"a {spark_kind}, b {spark_kind}")


def side_explode(df: DataFrame, n: str) -> DataFrame:
    return df.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``links`` (a, b); component is the least node reachable.

    Each round sends every node's label to its neighbours and then follows the label's own
    label, which halves the distance to the least node. Rounds end when nothing changes.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        sent = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("got"))
        near = labels.join(sent, labels["node"] == sent["a"]).select("node", F.col("component").alias("was"), F.least("component", "got").alias("component"))
        near = written(near, "labels-near")
        up = near.select(F.col("node").alias("component"), F.col("component").alias("above"))
        new = written(near.join(up, "component").select("node", "was", F.least("component", "above").alias("component")), "labels")
        if new.where("was <> component").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    marks = written(fingerprints(docs, bands, rows, width), "fingerprints")
    usable = marks.where("class_key is not null and doc_id is not null")
    classes = written(usable.groupBy("class_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.any_value("bands").alias("bands")), "classes")
    pairs = written(candidates(classes), "candidates")
    wanted = pairs.select("doc_id").union(pairs.select("leader")).distinct()
    shingles = written(shingle_table(docs, wanted, width), "shingles")
    tested = written(stars(pairs, shingles, percent).groupBy("leader", "doc_id").agg(F.max("linked").alias("linked"), F.max("size").alias("size")), "stars")
    links = tested.where("linked").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).unionByName(rest(tested, shingles, percent))
    # rows that share an id share a component: an id in several classes links them by itself
    again = usable.groupBy("doc_id").agg(F.min("class_key").alias("k"), F.max("class_key").alias("l")).where("k <> l").select(F.col("doc_id").alias("own"))
    twice = usable.join(again, usable["doc_id"] == again["own"]).select("own", "class_key").join(classes.select("class_key", "doc_id"), "class_key").select(F.col("own").alias("a"), F.col("doc_id").alias("b"))
    found = components(links.unionByName(twice))
    named = classes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").where("n > 1 or component is not null")
    named = written(named.select("class_key", F.coalesce("component", "doc_id").alias("component")), "named")
    out = marks.select("doc_id", "n_shingles", "class_key").join(named, "class_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def versions(docs: DataFrame) -> Column:
    """What tells the rows of ``docs`` with an id apart: the id, or where rows of one id have unlike texts,
    a text that starts with the id and sorts like it, and ends with the digest of the row's text."""
    digest = F.coalesce(F.md5("text"), F.lit(""))
    own = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
    if own.where("low <> high").isEmpty():
        return F.col("doc_id")
    place = (F.col("doc_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string")
    return F.concat(F.lpad(place, 20, "0"), digest)


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that represent their component, one for each.

    A row is told apart by its doc_id and text: rows with unlike texts stand for themselves even where they share
    an id, and are dropped only for a link of their own text; of rows with equal id and text one stays. Of a
    component the row with the least doc_id stays. Rows with a null doc_id all stay.
    """
    row, known = free_name(docs, "_version"), docs.where("doc_id is not null")
    mine = versions(docs)
    kept = near_duplicates(known.select(mine.alias("doc_id"), "text"), percent).where("kept").select(F.col("doc_id").alias(row)).distinct()
    once = known.withColumn(row, mine).join(written(kept, "kept"), row, "left_semi")
    first = once.groupBy(row).agg(F.min_by(F.struct(*docs.columns), F.struct("text")).alias("_row"))
    return first.select("_row.*").unionByName(docs.where("doc_id is null"))
