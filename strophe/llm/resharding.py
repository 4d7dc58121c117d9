"""Resharding by minimum-cost flow.

Old shard sizes and new capacities are the ends of a flow network: a byte that stays costs
nothing, a byte that changes shards costs one (or what a cost matrix says). The cheapest
flow says how many bytes each old shard sends to each new one; documents of an old shard,
in hash order, are then cut into runs of those lengths. Only shards that lose or gain
documents are rewritten. The flow is solved on the driver over shards, never documents:
its matrix is old shards times new shards (a thousand by a thousand take half a second, with costs that
differ everywhere half a minute).

Cuts fall between documents, so a second and third flow over what each shard has too much
or too little moves small documents until shards are equal to within a small document.

Defined results: a null text has no bytes and size 1; a null source is in old shard 0;
equal rows may take each other's slots; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.llm.common import new_path, releasing_shuffles, running_total, written

CELL_ROWS = 20_000
ROUNDS = 3
#: Old shards are rewritten in so many goes, so that only a part of the texts is shuffled at once.
WAVES = 3


def min_cost_flow(supply: dict, demand: dict, cost) -> dict:
    """{(old, new): bytes} of least total cost; supplies and demands have equal sums.

    Primal-dual: prices make the reduced cost of every arc nonnegative, and bytes flow over
    arcs of reduced cost 0 only. First straight from shards with bytes left to shards with room;
    where that ends, a search over such arcs, back along flows too, finds the next path, and
    when it is stuck, prices rise by the least reduced cost that leads on. Every step works on
    whole rows of the matrix, and paths number about as many as shards.
    """
    olds, news = list(supply), list(demand)
    left, room = (np.array([x[k] for k in names], np.int64) for x, names in ((supply, olds), (demand, news)))
    if not left.any():
        return {}
    reduced = np.array([[cost(i, j) for j in news] for i in olds], np.float64)
    reduced -= reduced.min(axis=1, keepdims=True)
    flow = np.zeros(reduced.shape, np.int64)
    while True:
        for i in np.flatnonzero(left):
            for j in np.flatnonzero((reduced[i] == 0) & (room > 0)):
                amount = min(left[i], room[j])
                flow[i, j] += amount
                left[i] -= amount
                room[j] -= amount
        if not left.any():
            return {(olds[i], news[j]): int(flow[i, j]) for i, j in zip(*np.nonzero(flow), strict=True)}
        seen, reached = left > 0, np.zeros(len(news), bool)
        least, above = reduced[seen].min(axis=0), np.flatnonzero(seen)[reduced[seen].argmin(axis=0)]
        below = np.full(len(olds), -1)
        while not (reached & (room > 0)).any():
            step = least[~reached].min()
            if step > 0:
                reduced[seen] -= step
                reduced[:, reached] += step
                least[~reached] -= step
            new = ~reached & (least <= 0)
            reached |= new
            for i in np.flatnonzero(~seen & (flow[:, new] > 0).any(axis=1)):
                seen[i] = True
                below[i] = np.flatnonzero(new)[(flow[i, new] > 0).argmax()]
                nearer = ~reached & (reduced[i] < least)
                least[nearer], above[nearer] = reduced[i, nearer], i
        at = np.flatnonzero(reached & (room > 0))[0]
        path = [(above[at], at)]
        while below[path[-1][0]] >= 0:
            at = below[path[-1][0]]
            path.append((above[at], at))
        back = [(a[0], b[1]) for a, b in zip(path[:-1], path[1:], strict=True)]
        amount = min([left[path[-1][0]], room[path[0][1]], *(flow[x] for x in back)])
        for x in path:
            flow[x] += amount
        for x in back:
            flow[x] -= amount
        left[path[-1][0]] -= amount
        room[path[0][1]] -= amount


def capacities(total: int, n: int) -> dict:
    """Equal capacities of shards 0 to n - 1 that add up to ``total``."""
    return {j: total // n + (j < total % n) for j in range(n)}


def _runs(spark: SparkSession, flows: dict) -> DataFrame:
    """One row per old shard: shard, stops (where its runs of bytes end) and news (whose they are).

    A cheapest flow has fewer arcs than there are shards, old and new, so the table is broadcast.
    """
    rows = []
    for i in sorted({i for i, _ in flows}):
        news = sorted((j for a, j in flows if a == i), key=lambda j: (j != i, j))
        rows.append((i, np.cumsum([flows[i, j] for j in news]).tolist(), news))
    return spark.createDataFrame(rows, "shard int, stops array<long>, news array<int>")


def _cut(placed: DataFrame, flows: dict, moves: Column) -> DataFrame:
    """``placed`` with _new: the shard in whose run the middle byte of a document lies, if it moves."""
    middle = F.col("_sum") - F.col("size") / 2
    run = F.least(F.size(F.filter("stops", lambda stop: stop <= middle)) + 1, F.size("stops"))
    new = F.when(moves & F.col("stops").isNotNull(), F.element_at("news", run)).otherwise(F.col("shard"))
    return placed.join(F.broadcast(_runs(placed.sparkSession, flows)), "shard", "left").withColumn("_new", new.cast("int")).drop("stops", "news")


def reshard(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, cost=lambda i, j: int(i != j), old_slot: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, old_shard, old_slot, shard, slot.

    ``old_shard`` gives each row of ``docs`` (doc_id, text) its present shard below n_old.
    New shards get equal bytes. Slots follow hash order, but a shard that no document enters
    or leaves keeps its slots where ``old_slot`` gives them.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"), F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"), (F.lit(None) if old_slot is None else old_slot).cast("long").alias("old_slot"))
    rows = written(rows.withColumn("_hash", F.xxhash64("doc_id", "text_crc32")), "shard-rows")
    cells = max(1, -(-rows.count() // CELL_ROWS))
    # hash order, and the hash's cell in that order
    rows = rows.withColumn("_bucket", F.floor((F.col("_hash") / float(2**64) + 0.5) * cells).cast("long")).withColumn("shard", F.col("old_shard"))
    order = [F.col("_hash"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    target: dict = {}
    for k in range(ROUNDS):
        have = {r["shard"]: r["bytes"] for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
        if not have:
            break
        target = target or capacities(sum(have.values()), n_new)
        if k == 0:
            flows = min_cost_flow({i: have.get(i, 0) for i in range(n_old)}, target, cost)
            placed, moves = running_total(rows, ["shard"], "_bucket", order, F.col("size"), "_sum"), F.lit(True)
        else:
            over = {j: have.get(j, 0) - target[j] for j in target}
            flows = min_cost_flow({j: x for j, x in over.items() if x > 0}, {j: -x for j, x in over.items() if x < 0}, cost)
            if not flows:
                break
            surplus = spark.createDataFrame([(j, x) for j, x in over.items() if x > 0], "shard int, _gives long")
            rows = rows.join(F.broadcast(surplus), "shard", "left")
            gives = F.coalesce("_gives", F.lit(0))
            amount = F.when(F.col("size") <= gives, F.col("size")).otherwise(0)
            placed = running_total(rows, ["shard"], "_bucket", order, amount, "_sum")
            moves = (F.col("size") <= gives) & (F.col("_sum") <= gives)
        rows = written(_cut(placed, flows, moves).drop("_sum", "shard", "_gives").withColumnRenamed("_new", "shard"), f"shard-round{k}")
    ranked = running_total(rows, ["shard"], "_bucket", order, F.lit(1), "_rank")
    slot = F.when(F.col("shard").isin(_moved(rows)), F.lit(None)).otherwise(F.col("old_slot"))
    return ranked.select("doc_id", "size", "text_crc32", "old_shard", "old_slot", "shard", F.coalesce(slot, F.col("_rank") - 1).cast("long").alias("slot"))


def _moved(plan: DataFrame) -> list[int]:
    """The shards that any document enters or leaves."""
    ends = F.explode(F.array("shard", "old_shard")).alias("shard")
    return sorted(r["shard"] for r in plan.where("shard <> old_shard").select(ends).distinct().collect())


def source_shard(n_old: int) -> Column:
    """A layout to start from: documents filed by source, as a crawl leaves them."""
    return F.pmod(F.crc32("source"), F.lit(n_old))


def placed(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their shard and slot.

    Rows and plan meet by doc_id and text checksum; the copies of a row share these and take
    the group's slots in turn, by number. Columns shard and slot of ``docs`` are replaced.
    """
    keys = ["doc_id", "text_crc32"]
    numbered = plan.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "shard", "slot", F.row_number().over(Window.partitionBy(*keys).orderBy("shard", "slot")).alias("_n"))
    rows = docs.drop("shard", "slot").select(F.struct("*").alias("row"), "doc_id", F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"))
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_crc32") == F.col("_crc")) & (F.col("_copy") == F.col("_n"))
    return rows.join(numbered, match).select("row.*", "shard", "slot")


def write_layout(docs: DataFrame, old_shard: Column, path: str) -> DataFrame:
    """Writes ``docs`` into ``path/shard=K``, with their slots, and reads them back.

    Columns shard and slot of ``docs`` are replaced, after ``old_shard`` has been taken.
    """
    inner = F.struct(*[c for c in docs.columns if c.lower() not in ("shard", "slot")])
    rows = docs.select(inner.alias("row"), "doc_id", F.coalesce(old_shard, F.lit(0)).cast("int").alias("_shard"), F.xxhash64("doc_id", "text").alias("_hash"))
    cells = max(1, -(-docs.count() // CELL_ROWS))
    rows = rows.withColumn("_bucket", F.floor((F.col("_hash") / float(2**64) + 0.5) * cells).cast("long"))
    rows = running_total(rows, ["_shard"], "_bucket", [F.col("_hash"), F.col("doc_id")], F.lit(1), "_rank")
    out = rows.select("row.*", (F.col("_rank") - 1).cast("long").alias("slot"), F.col("_shard").alias("shard"))
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path, compression="zstd")
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def write_shards(layout: DataFrame, plan: DataFrame, path: str) -> list[int]:
    """Rewrites the affected shards of ``layout`` into ``path/shard=K`` and returns their numbers.

    Affected are the shards that any document enters or leaves; the files of the others are
    right as they are and stay. Each file is sorted by slot. A row's address is its old
    shard and slot.
    """
    moved = _moved(plan)
    old = layout.withColumnsRenamed({"shard": "old_shard", "slot": "old_slot"})
    for k in range(WAVES):
        wave = F.col("old_shard").isin(moved[k::WAVES])
        goes = plan.where(wave).select("old_shard", "old_slot", "shard", "slot")
        rows = old.where(wave).join(goes, ["old_shard", "old_slot"]).drop("old_slot").withColumn("_block", F.floor(F.col("slot") / CELL_ROWS))
        rows = rows.repartition("shard", "_block").sortWithinPartitions("shard", "slot").drop("_block")
        rows.write.partitionBy("shard").parquet(path, mode="append", compression="zstd")
    return moved


def resharded(docs: DataFrame, old_shard: Column, n_old: int, n_new: int) -> DataFrame:
    """``docs`` with old_shard, slot and shard, as read from the files of the new layout: the
    old layout is written, and its affected shards are rewritten. Columns of these names are
    replaced, and so is old_slot."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot", "old_shard", "old_slot")]
    with releasing_shuffles(spark):
        layout = write_layout(docs.select(*names, F.coalesce(old_shard, F.lit(0)).cast("int").alias("shard")), F.col("shard"), new_path(spark, "old-shards"))
        plan = written(reshard(layout, F.col("shard"), n_old, n_new, old_slot=F.col("slot")), "shard-plan")
        path = new_path(spark, "new-shards")
        moved = write_shards(layout, plan, path)
    columns = [*names, "old_shard", "slot", "shard"]
    kept = layout.where(~F.col("shard").isin(moved)).withColumn("old_shard", F.col("shard")).select(*columns)
    return spark.read.schema(kept.schema).parquet(path).select(*columns).unionByName(kept)
