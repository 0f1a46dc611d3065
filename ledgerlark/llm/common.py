"""What the operators of this subpackage share: tables, materialisation, word rules."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as the contracts write it: [\x20\x09-\x0D].
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir. Only on one
    machine (tests) a temporary one takes its place where that is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster intermediate tables need a folder that executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlark-"))
        named = sc.getCheckpointDir()
    return named


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back. This cuts the lineage, survives
    lost executors and fixes what is not deterministic; the folder goes by discard(), at the
    latest when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerlark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _folder(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and that nothing reads any more. Others (made from
    such a table) are left alone."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path:
            files, place = _folder(df.sparkSession, path)
            files.delete(place, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what has been written: it does so when the driver's
    garbage is collected, which may otherwise be long after a job of many steps has filled disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Keys that may be broadcast at most (8 bytes each).
MAX_BROADCAST_KEYS = 1_000_000


def few(side: DataFrame, weight: str = "1") -> DataFrame:
    """`side` marked for broadcast if its rows hold at most MAX_BROADCAST_KEYS / 4 values (weight: an
    expression for a row's), else as it is, so that both sides of the join are shuffled."""
    values = side.agg(F.coalesce(F.expr(f"sum({weight})"), F.lit(0))).first()[0]
    return F.broadcast(side) if values <= MAX_BROADCAST_KEYS // 4 else side


def among(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose `column` is one of the distinct long `key`s. Up to MAX_BROADCAST_KEYS they are
    broadcast, so that the rows aren't shuffled; beyond, both sides are."""
    small = keys.count() <= MAX_BROADCAST_KEYS
    side = keys.select(F.col("key").alias("_key"))
    return rows.join(F.broadcast(side) if small else side, F.col(column) == F.col("_key"), "left_semi")


def word_count(text):
    """Number of words (WORD) as a column; null text has none. Squeezing each run of
    white space to one separator leaves one separator fewer than words."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    flat = F.btrim(flat, F.lit(" "))
    return F.when(flat == "", F.lit(0)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def lower_ascii(text):
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, budget: int = 4 << 20):
    """Cut a record batch into runs of rows whose texts take about budget bytes (for a column of
    lists: whose lists have about budget elements), so that very long texts don't multiply a
    task's memory. A single longer text is a run by itself."""
    if not batch.num_rows:
        return
    at = batch.schema.get_field_index(column)
    length = pc.list_value_length if pa.types.is_list(batch.column(at).type) else pc.binary_length
    sizes = np.asarray(pc.fill_null(length(batch.column(at)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + budget, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def row_hash(*columns, seed: int = 0):
    """Seeded 64-bit hash of columns."""
    return F.xxhash64(*columns, F.lit(seed))


def placed(rows: DataFrame, order: list, into: str, within: str | None = None, count: str | None = None) -> DataFrame:
    """Adds `into` (long): each row's place, from 0, in the order of the columns, among the rows with
    the same value of `within` (null not allowed; None: among all), and `count`: how many rows these
    are. Rows are dealt by ranges of (within, order), so that a value of `within` that holds most
    rows is cut; only a row per range and value is summed up before the places are numbered within
    each range. The ranged rows are written: a range sampled again after a loss could differ. Rows
    that agree in the whole order are told apart by where they were read, so they spread as well.
    The names _part, _at, _group (but for `within`), _first and _all are taken."""
    if taken := {"_part", "_at", "_first", "_all", "_group"} & set(rows.columns) - {within}:
        raise ValueError(f"columns {sorted(taken)} can't be placed")
    spark = rows.sparkSession
    group = F.col(within) if within else F.lit("")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumns({"_group": group, "_at": F.monotonically_increasing_id()})
    dealt = materialise(dealt.repartitionByRange(parts, "_group", *order, "_at").withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_group", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(Window.partitionBy("_group")).alias("_all"))
    inside = Window.partitionBy("_group", "_part").orderBy(*order, "_at")
    out = dealt.withColumn("_at", F.row_number().over(inside) - 1).join(few(sums), ["_group", "_part"])
    out = out.withColumn(into, (F.col("_first") + F.col("_at")).cast("long"))
    if count:
        out = out.withColumn(count, F.col("_all").cast("long"))
    out = out.select(*rows.columns, into, *([count] if count else []))
    out._behind = dealt
    return out
