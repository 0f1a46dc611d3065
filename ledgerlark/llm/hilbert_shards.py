"""Sharding along a Hilbert curve.

Metadata dimensions (language, source, size by default) are quantised in the order of their
values, a row's cell gets its place on the Hilbert curve, rows are sorted along the curve and the
order is cut into runs. Each run covers few cells that lie together, so the minimum and maximum of
every dimension in a shard's files prune scans on any of them. All of it is column expressions and
range shuffles of narrow rows; texts move only where shards are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, materialise

BITS = 8


def hilbert_index(dimensions: list[Column], bits: int) -> Column:
    """Place of integer coordinates (0 <= x < 2**bits) on the Hilbert curve, by the transform
    published by J. Skilling (2004): undo the excess work bit by bit, Gray encode, interleave.
    Written as nested lets over array columns, so that the expression stays small."""
    n = len(dimensions)
    if n * bits > 62:
        raise ValueError("dimensions x bits must be 62 at most")
    x = F.array(*(d.cast("long") for d in dimensions))

    def let(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]

    def step(value: Column, level: int, i: int) -> Column:
        q = F.lit(1 << level).cast("long")
        p = F.lit((1 << level) - 1).cast("long")

        def use(v):
            swap = F.element_at(v, 1).bitwiseXOR(F.element_at(v, i + 1)).bitwiseAND(p)
            flip = F.element_at(v, i + 1).bitwiseAND(q) != 0
            first = F.when(flip, F.element_at(v, 1).bitwiseXOR(p)).otherwise(F.element_at(v, 1).bitwiseXOR(swap))
            other = F.when(flip, F.element_at(v, i + 1)).otherwise(F.element_at(v, i + 1).bitwiseXOR(swap))
            return F.array(*(first if k == 0 else other if k == i else F.element_at(v, k + 1) for k in range(n)))

        return let(value, use)

    for level in range(bits - 1, 0, -1):
        for i in range(n):
            x = step(x, level, i)

    def gray(v):
        out = [F.element_at(v, 1)]
        for k in range(1, n):
            out.append(F.element_at(v, k + 1).bitwiseXOR(out[-1]))
        return F.array(*out)

    x = let(x, gray)

    def tail(v):
        t = F.lit(0).cast("long")
        for level in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(F.element_at(v, n).bitwiseAND(F.lit(1 << level).cast("long")) != 0, F.lit((1 << level) - 1).cast("long")).otherwise(F.lit(0).cast("long")))
        return let(t, lambda s: F.transform(v, lambda e: e.bitwiseXOR(s)))

    x = let(x, tail)

    def interleave(v):
        total = F.lit(0).cast("long")
        for level in range(bits):
            for k in range(n):
                bit = F.shiftright(F.element_at(v, k + 1), level).bitwiseAND(F.lit(1).cast("long"))
                total = total.bitwiseOR(F.shiftleft(bit, level * n + n - 1 - k))
        return total

    return let(x, interleave)


def with_ranks(rows: DataFrame, order: list) -> DataFrame:
    """Adds _rank (from 0, in the given order) and _total. Rows are range partitioned, so nothing
    but one row per partition (running counts) passes through a global step."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # partition id in the upper 31 bits, place within the partition in the lower 33; the written
    # table fixes both
    placed = materialise(placed.withColumn("_at", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = offsets.withColumn("_total", F.sum("_n").over(Window.partitionBy())).select("_part", "_before", "_total")
    ranked = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_part")  # one row per partition
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.withColumn("_rank", rank).drop("_part", "_before", "_at")


def value_codes(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(value, code): the distinct values of a column in their order (null first), spread evenly
    over the codes 0 to 2**bits - 1, so that few values take part in the curve's coarse steps too;
    with at most so many values each has a code of its own."""
    ranked = with_ranks(rows.select(F.col(column).alias("value")).distinct(), [F.col("value").asc_nulls_first()])
    code = F.floor(F.col("_rank") * F.lit(1 << bits) / F.col("_total"))
    return ranked.select("value", code.cast("long").alias("code"))


def magnitude_codes(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(value, code): the magnitudes of a positive column (16 for each doubling) with codes that
    hold about equally many rows each. There are at most 1024 magnitudes of a long."""
    value = F.floor(F.log2(F.col(column).cast("double")) * 16)
    counts = rows.groupBy(value.alias("value")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = (before + F.col("_n") / 2) / F.sum("_n").over(Window.partitionBy())
    return counts.select("value", F.floor(middle * F.lit(1 << bits)).alias("code"))


def assign_shards(rows: DataFrame, dimensions: list[Column], shards: int, ties: list[str], bits: int = BITS) -> DataFrame:
    """Adds hilbert (long), shard (int) and slot (long) under the law `rows`: shard sizes differ
    by one at most, shards are runs along the curve, slots count from 0 without gaps within a
    shard in curve order. `ties` order rows of the same cell and must make rows distinct for a
    repeatable result (repeated rows may swap places, which doesn't show). A hot cell is split
    among tasks."""
    ranked = with_ranks(rows.withColumn("hilbert", hilbert_index(dimensions, bits)), ["hilbert", *ties])
    # the first (total mod shards) shards hold one row more
    small, more = F.expr(f"_total div {shards}"), F.col("_total") % F.lit(shards).cast("long")
    edge = more * (small + 1)
    in_large = F.col("_rank") < edge
    shard = F.when(in_large, F.expr(f"_rank div (_total div {shards} + 1)")).otherwise(
        more + F.when(small > 0, F.floor((F.col("_rank") - edge) / F.greatest(small, F.lit(1)))).otherwise(F.lit(0))
    )
    slot = F.when(in_large, F.col("_rank") % (small + 1)).otherwise((F.col("_rank") - edge) % F.greatest(small, F.lit(1)))
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long")).drop("_total", "_rank")


_MADE = ("size", "text_crc32", "shard", "slot", "hilbert", "lang_code", "source_code", "size_code")


def shard_rows(docs: DataFrame, shards: int = 40, text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 16; null text: 16), text_crc32 (null text counts
    as empty), shard, slot, hilbert and the coordinates lang_code, source_code and size_code; with
    `keep` all columns of docs besides (those with these names are replaced), else texts don't move.

    Rows with equal texts form a group, which has the coordinates of its smallest doc_id and stands
    together on the curve (ordered by text checksum and hash, then doc_id), so that only a shard's
    edge can cut it. Null language or source is a value of its own. Null doc_id sorts first. Other
    columns are ignored; an empty table gives an empty result; repeated rows each take a slot.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rest = [c for c in docs.columns if keep and c not in (*_MADE, "doc_id")]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(content) + 16).cast("long").alias("size"), F.crc32(content).cast("long").alias("text_crc32"),
        F.xxhash64(content).alias("_text"), F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"), *rest,
    )
    rows = materialise(rows)
    for name in ("lang", "source"):
        codes = few(value_codes(rows, f"_{name}").select(F.col("value").alias("_v"), F.col("code").alias(f"{name}_code")))
        rows = rows.join(codes, F.col(f"_{name}").eqNullSafe(F.col("_v"))).drop("_v", f"_{name}")
    sizes = magnitude_codes(rows, "size").select(F.col("value").alias("_v"), F.col("code").alias("size_code"))
    rows = rows.join(F.broadcast(sizes), F.floor(F.log2(F.col("size").cast("double")) * 16) == F.col("_v")).drop("_v")  # 1024 rows
    place = F.struct("doc_id", "lang_code", "source_code")
    groups = rows.groupBy(F.col("text_crc32").alias("_c"), F.col("_text").alias("_t"), F.col("size").alias("_s")).agg(F.min(place).alias("_first"), F.min(F.struct("lang_code", "source_code")).alias("_low"), F.max(F.struct("lang_code", "source_code")).alias("_high"))
    groups = few(materialise(groups.where("_low <> _high").select("_c", "_t", "_s", "_first")))  # groups that several cells hold
    rows = rows.join(groups, (F.col("text_crc32") == F.col("_c")) & (F.col("_text") == F.col("_t")) & (F.col("size") == F.col("_s")), "left")
    rows = rows.withColumns({c: F.coalesce(F.col(f"_first.{c}"), F.col(c)) for c in ("lang_code", "source_code")}).drop("_c", "_t", "_s", "_first")
    placed = assign_shards(rows, [F.col("lang_code"), F.col("source_code"), F.col("size_code")], shards, ["text_crc32", "_text", "doc_id"])
    return placed.drop("_text")


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text") -> DataFrame:
    """The rows of shard_rows() as doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard
    (null under this law) and hilbert."""
    return shard_rows(docs, shards, text).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, text: str = "text") -> None:
    """Write docs, with what shard_rows() adds, as Parquet under path/shard=N: a file per shard, its
    rows in curve order, so that scans skip shards by the minima and maxima of all dimensions."""
    placed = shard_rows(docs, shards, text, keep=True)
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
