"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are counted in words. Words are seats: they are allocated to sources by the highest
quotients target / (2 * seats + 1). A source's words are cut into equal blocks, which are
allocated in the same way to shards by the shards' sizes, as many as fit into a shard's limit;
words that fill no block, or no shard's block, are allocated to the room that shards have left.
A shard's documents stand in seeded order on a ring; its quota takes whole turns of the ring,
then a run of words from a seeded block. So quotas are integers per shard, they sum up to the
source's seats at every size, and every shard selects by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

#: Words of a block at most; smaller inputs get smaller blocks, so that there are BLOCKS of them.
MAX_BLOCK = 8192
BLOCKS = 1 << 20
#: Rows of a shard (over all sources) on average, and shards at most.
SHARD_ROWS = 2000
MAX_SHARDS = 4096
#: Blocks of words that a source's shards hold at least on average; smaller sources get fewer shards.
SHARD_BLOCKS = 16


def sainte_lague(weights: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients weight / (2 k + 1), k = 0, 1, ...; equal quotients go to the
    earlier entry. `most` bounds an entry's seats (the others get the rest). Done by divisor: the
    seats at a divisor d are round(weight / d), and d is found by bisection, then the last few
    seats are given one by one."""
    weights = np.asarray(weights, np.float64)
    most = np.full(len(weights), np.iinfo(np.int64).max) if most is None else np.asarray(most, np.int64)
    seats = int(min(seats, most[weights > 0].astype(object).sum())) if (weights > 0).any() else 0
    if seats <= 0:
        return np.zeros(len(weights), np.int64)

    def at(d: float) -> np.ndarray:
        return np.minimum(np.floor(np.minimum(weights / d + 0.5, 2**62)).astype(np.int64), most)

    low, high = weights[weights > 0].min() / (2.0 * seats + 2), weights.max() * 2.1
    for _ in range(200):
        middle = (low + high) / 2
        if at(middle).sum() <= seats:
            high = middle
        else:
            low = middle
    given = at(high)
    for _ in range(int(seats - given.sum())):
        quotients = np.where(given < most, weights / (2.0 * given + 1), -1.0)
        given[int(np.argmax(quotients))] += 1
    return given


def capped_targets(sizes: DataFrame, weights: tuple[float, ...], limit: float) -> DataFrame:
    """Rows (source, source_size) with weight and target: sources by code point (null last) weigh
    weights[0], weights[1], ..., repeating, and share the sum of all sizes; a target stops at
    limit times its source's size and the excess is shared again by weight. The level is found
    in closed form: in order of size / weight, a source is at its limit as long as the words left
    for it and all later ones, shared by weight, exceed the limit. One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (pick + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(float(limit)))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    rows = rows.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("weight") <= F.col("_cap"))
    level = F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level")))).over(every)
    return rows.withColumn("target", F.coalesce(F.least(level["_level"] * F.col("weight"), F.col("_cap")), F.col("_cap"))).drop("_cap", "_level", "_free")


def _place(docs: DataFrame, weights, limit, size, source, doc_id, seed) -> tuple[DataFrame, DataFrame]:
    """Narrow rows with taken, and docs with their size."""
    made = ["size", "source_size", "target", "taken"]
    size = word_count(F.col("text")) if size is None else size
    base = docs.withColumn("_size", size).drop(*made).withColumnRenamed("_size", "size")
    rows = base.select(F.col(doc_id).alias("_doc"), F.col(source).alias("_source"), "size")
    rows = materialise(rows.withColumn("_order", F.xxhash64("_doc", F.lit(seed))))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = int(min(MAX_SHARDS, max(1, -(-n // SHARD_ROWS))))
    block = int(min(MAX_BLOCK, max(1, total // BLOCKS)))
    sizes = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = materialise(capped_targets(sizes, weights, limit))

    def to_sources(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source", na_position="last", kind="stable")
        most = limit * rows["source_size"].to_numpy(np.int64)
        return rows.drop(columns="_all").assign(seats=sainte_lague(rows["target"].to_numpy(float), round(rows["target"].sum()), most))

    def to_shards(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_shard", kind="stable")
        held = rows["_cell_size"].to_numpy(np.int64)
        seats = int(rows["seats"].iloc[0])
        quota = block * sainte_lague(held.astype(float), seats // block, limit * held // block)
        room = limit * held - quota
        return rows.assign(quota=quota + sainte_lague(room.astype(float), seats - int(quota.sum()), room))[["_source", "_shard", "quota"]]

    seats = targets.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(to_sources, "source string, source_size long, weight double, target double, seats long")
    seats = materialise(seats.select(F.col("source").alias("_s"), "source_size", "target", "seats"))
    own = F.least(F.lit(shards), F.greatest(F.lit(1), F.floor(F.col("source_size") / (SHARD_BLOCKS * block))))
    own = F.when(F.col("size") > 0, own).otherwise(F.lit(shards))  # rows without words need no ring
    rows = rows.join(seats.select("_s", "source_size"), F.col("_source").eqNullSafe(F.col("_s")))
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("_doc", F.lit(seed + 1)), own).cast("int")).drop("_s", "source_size")
    cells = materialise(rows.groupBy("_source", "_shard").agg(F.sum("size").alias("_cell_size")))
    cells = cells.join(seats, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    quotas = cells.groupBy("_source").applyInPandas(to_shards, "_source string, _shard int, quota long")
    quotas = quotas.select(F.col("_source").alias("_q"), F.col("_shard").alias("_r"), "quota")
    cells = cells.join(quotas, F.col("_source").eqNullSafe(F.col("_q")) & (F.col("_shard") == F.col("_r"))).drop("_q", "_r")
    cells = cells.select(F.col("_source").alias("_s"), F.col("_shard").alias("_r"), "_cell_size", "source_size", "target", "quota")
    ring = Window.partitionBy("_source", "_shard").orderBy("_order", "_doc", "size")
    placed = rows.withColumn("_stop", F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = placed.join(cells, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_r")))
    words = F.col("quota")
    whole = F.greatest(F.col("_cell_size"), F.lit(1))
    placed = placed.withColumn("_turns", F.floor(words / whole).cast("long")).withColumn("_rest", words - F.col("_turns") * whole)
    starts = F.greatest(F.ceil(whole / F.lit(block)).cast("long"), F.lit(1))
    placed = placed.withColumn("_from", F.pmod(F.xxhash64("_source", "_shard", F.lit(seed + 2)), starts) * block)
    placed = placed.withColumn("_to", F.col("_from") + F.col("_rest"))

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("_stop"), b) - F.greatest(F.col("_stop") - F.col("size"), a))

    run = overlap(F.col("_from"), F.least(F.col("_to"), whole)) + overlap(F.lit(0), F.col("_to") - whole)
    placed = placed.withColumn("taken", (F.col("_turns") * F.col("size") + run).cast("long"))
    return placed, base


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: int = 3, size: Column | None = None, source: str = "source", doc_id: str = "doc_id", seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target (double) and taken (long) of every row: the words that
    the mix takes of a document, repeats counted (0: none).

    Null text has size 0; a source without words has target 0; null is a source of its own. No
    document gives more than `limit` times its size. The order within a shard depends on doc_id
    and seed only, so reruns agree; rows that repeat an id follow each other by size. Other
    columns are ignored. An empty table gives an empty result.

    A source's words lie within one word of its target.

    Only (doc_id, source, size) is shuffled, by source and shard; a source that holds a third of
    all rows is spread over all shards. Quotas take one row per source and shard.
    """
    placed, _ = _place(docs, weights, limit, size, source, doc_id, seed)
    return placed.select(F.col("_doc").alias(doc_id), F.col("size").cast("long"), F.col("source_size").cast("long"), "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: int = 3, size: Column | None = None, source: str = "source", doc_id: str = "doc_id", seed: int = 17) -> DataFrame:
    """The mix as whole documents, with the columns of docs: a document stands in it as often as
    its taken words make up its size, rounded half up (blocks that cut a document count for the
    part that they hold). Documents without words give nothing."""
    placed, base = _place(docs, weights, limit, size, source, doc_id, seed)
    times = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    copies = placed.select(F.col("_doc").alias("_d"), F.col("size").alias("_n"), times.alias("_times")).where("_times > 0")
    copies = copies.groupBy("_d", "_n").agg(F.max("_times").alias("_times"))
    out = base.join(copies, F.col(doc_id).eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_n")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)
