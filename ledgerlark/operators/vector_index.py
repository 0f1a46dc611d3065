"""A vector index as versioned tables: built anew, upserted by id, searched exactly by cosine for a
table of queries.

A version is a folder of rows (id, text, metadata, vector). It counts once its write has been
committed (Spark's _SUCCESS mark comes last), so readers see the old rows or the new ones, never
half of either; the version before stays for readers that have begun."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "id string, text string, metadata map<string, string>, vector array<double>"
#: Values of the query vectors that are sent to the tasks at a time (32 MB); more queries take more passes.
MAX_QUERY_VALUES = 1 << 22
#: Digits that distances are compared with, so that equal vectors tie whatever the order of their sums.
DIGITS = 10
#: Rows, and queries, that are compared at a time: a task holds a product of this many by this many.
ROWS = 1024


class _Best:
    """The k nearest rows so far of each query of a task: ids and distances, empty places infinitely far."""

    def __init__(self, queries: int, k: int):
        self.k, self.distance, self.id = k, np.full((queries, k), np.inf), np.full((queries, k), "", object)

    def meet(self, low: int, distance: np.ndarray, ids: list[str]) -> None:
        """Distances of the queries from `low` on to some rows. Only rows that are no farther than the k-th so
        far, here or before, are ordered."""
        kept, k = slice(low, low + len(distance)), self.k
        limit = self.distance[kept, -1]
        if distance.shape[1] > k:
            limit = np.minimum(limit, np.partition(distance, k - 1, axis=1)[:, k - 1])
        place, row = np.nonzero(distance <= limit[:, None])
        if not len(place):
            return
        touched = np.unique(place)
        old = np.repeat(touched, k)
        places = np.concatenate([place, old])
        far = np.concatenate([distance[place, row], self.distance[kept][touched].ravel()])
        names = np.concatenate([np.array(ids, object)[row], self.id[kept][touched].ravel()])
        _, rank = np.unique(names, return_inverse=True)
        order = np.lexsort((rank, far, places))
        places, far, names = places[order], far[order], names[order]
        within = np.arange(len(places)) - np.searchsorted(places, places)
        taken = within < k
        self.distance[low + places[taken], within[taken]], self.id[low + places[taken], within[taken]] = far[taken], names[taken]

    def rows(self, low: int, high: int) -> tuple[np.ndarray, list[str], np.ndarray]:
        place, rank = np.nonzero(np.isfinite(self.distance[low:high]))
        return low + place, list(self.id[low + place, rank]), self.distance[low + place, rank]


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _files(self):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return place(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def versions(self) -> list[int]:
        """Numbers of the versions that are complete."""
        files, place = self._files()
        if not files.exists(place(self.path)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(place(self.path)) if s.isDirectory()]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and files.exists(place(f"{self.path}/{n}/_SUCCESS")))

    def table(self) -> DataFrame:
        found = self.versions()
        if not found:
            raise ValueError(f"{self.path} holds no index")
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{found[-1]}")

    def _write(self, rows: DataFrame) -> int:
        """The next version; the number of rows. Versions older than the one before go."""
        files, place = self._files()
        found = self.versions()
        number = found[-1] + 1 if found else 1
        files.delete(place(f"{self.path}/v{number}"), True)  # what a failed write left
        rows.write.parquet(f"{self.path}/v{number}")
        for old in found[:-1]:
            files.delete(place(f"{self.path}/v{old}"), True)
        return self.table().count()

    def _checked(self, chunks: DataFrame) -> DataFrame:
        rows = chunks.select(F.col("id").cast("string"), F.col("text").cast("string"), F.col("metadata").cast("map<string, string>"), F.col("vector").cast("array<double>"))
        twice = rows.groupBy("id").count().where("count > 1 or id is null").limit(1).collect()
        if twice:
            raise ValueError(f"id {twice[0][0]!r} is missing or stands in several rows")
        return rows

    def build(self, chunks: DataFrame) -> int:
        """Replace the whole index by chunks (id, text, metadata, vector); a chunk that is gone leaves no
        row. Ids must be there and be unique. An empty table gives an empty index."""
        return self._write(self._checked(chunks))

    def upsert(self, chunks: DataFrame) -> int:
        """Replace or add the rows of the given ids; all others stay."""
        rows = self._checked(chunks)
        return self._write(self.table().join(rows.select("id"), "id", "left_anti").unionByName(rows))

    def nearest(self, queries: DataFrame, k: int = 6) -> DataFrame:
        """query_id, rank (from 1), id, distance, text, metadata: the k nearest rows of each query
        (query_id, vector) by cosine distance, compared by DIGITS digits, ties to the smaller id; all
        rows if there are fewer. Exact: every vector meets every query, as a matrix product of a batch of
        vectors with a block of queries; a task passes on k rows a query at most. Vectors that are null,
        of another length, zero or not finite take no part on either side. Query ids must be unique."""
        table = self.table()
        clean = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
        count, width = clean.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        blocks = max(1, -(-count * (width or 1) // MAX_QUERY_VALUES))
        found = None
        for block in range(blocks):
            part = clean.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else clean
            near = self._near(table, part.collect(), k)
            found = near if found is None else found.unionByName(near)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)
        rows = table.select("id", "text", "metadata")
        return ranked.join(rows, "id").select("query_id", "rank", "id", "distance", "text", "metadata")

    def _near(self, table: DataFrame, queries: list, k: int) -> DataFrame:
        """(query_id, id, distance): every task's k nearest of its rows, for a block of queries."""
        widths = {len(q["vector"]) for q in queries}
        matrices = {}
        for w in widths:
            names = [q["query_id"] for q in queries if len(q["vector"]) == w]
            matrices[w] = _unit(np.array([[np.nan if x is None else x for x in q["vector"]] for q in queries if len(q["vector"]) == w]), names)
        sent = self.spark.sparkContext.broadcast(matrices)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {w: _Best(len(names), k) for w, (names, _) in sent.value.items()}
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    rows = batch.slice(start, ROWS)
                    ids, vectors = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                    for w, (names, matrix) in sent.value.items():
                        at = [i for i, v in enumerate(vectors) if v is not None and len(v) == w and w]
                        own, unit = _unit(np.array([[np.nan if x is None else x for x in vectors[i]] for i in at]).reshape(len(at), w), [ids[i] for i in at])
                        for low in range(0, len(names) if len(own) else 0, ROWS):
                            best[w].meet(low, np.round(1 - matrix[low : low + ROWS] @ unit.T, DIGITS) + 0.0, own)
            for w, found in best.items():
                names = sent.value[w][0]
                for low in range(0, len(names), ROWS):
                    place, ids, distance = found.rows(low, low + ROWS)
                    if len(place):
                        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in place], pa.string()), pa.array(ids, pa.string()), pa.array(distance, pa.float64())], names=["query_id", "id", "distance"])

        return table.select("id", "vector").mapInArrow(run, "query_id string, id string, distance double")


def _unit(vectors: np.ndarray, names: list[str]) -> tuple[list[str], np.ndarray]:
    """Names and unit vectors of those rows that are finite and not zero."""
    if not len(names):
        return [], np.zeros((0, vectors.shape[1] if vectors.ndim == 2 else 0))
    size = np.sqrt((vectors * vectors).sum(1))
    good = np.isfinite(size) & (size > 0)
    return [n for n, g in zip(names, good, strict=True) if g], vectors[good] / size[good, None]
