"""Exact top-k inner products by best-first search of an M-tree.

Inner products become distances: with M the largest norm, a vector x gets one more coordinate
sqrt(M^2 - |x|^2) and a query q a zero, so |q' - x'|^2 = |q|^2 + M^2 - 2 q.x and the largest
products are the nearest vectors.

The tree has two levels of routing objects over the entries. A node's routing object has a
covering radius; below it stand pages, each with a routing object of its own, a covering radius
and its distance to the node's (parent distance); a page's entries are the vectors that are
nearest to it, sorted by their own parent distance. Routing objects are a bounded sample and are
given to every task; pages are rows of a written table. A page of more than PAGE_ROWS vectors
(many equal ones) is dealt into parts with the same routing object.

A query visits pages in the order of their lower bounds (distance to the routing object less the
covering radius; where the parent distance alone rules a page out, that distance isn't computed),
in rounds of 1, 4, 16, ... pages, and is done when the next bound exceeds its k-th best distance.
Within a page the stored parent distances exclude entries by the triangle inequality; what is left
is one matrix product per page and block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

#: Entries of a page or a page's part on average, and routing objects of pages at most: what is
#: given to every task is this many vectors. Beyond MAX_PAGES * PAGE_ROWS rows pages have parts.
PAGE_ROWS, MAX_PAGES = 1024, 16_384
#: Queries of a block, and queries that a copy of a page meets on average.
BLOCK_QUERIES, PAGE_QUERIES = 256, 4096
#: Bytes of queries that are made ready for pages at a time.
_SENT_BYTES = 1 << 25
#: Pages of the first round; each further round has GROWTH times as many.
FIRST, GROWTH = 1, 4
#: Distances are floating point; bounds are widened by this share so that no tie is lost.
SLACK = 1e-9


def integer_vectors(rows: DataFrame, vector_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and v (array<long>): floor(scale * x) of each component as a double. Rows with a
    null id or vector, or a null or non-finite component, are left out."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(1e15)))
    valid = rows.where(F.col(vector_id).isNotNull() & F.col(vector).isNotNull()).where(whole)
    return valid.select(F.col(vector_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an array column, padded with zeros to dims."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.int64)
    out = np.zeros((len(column), dims), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class _Metric:
    """Distances from integer products. Products are computed in the narrowest type that holds
    them exactly: all partial sums lie within the product of the largest norms."""

    def __init__(self, dims: int, largest: int, top: float):
        self.dims, self.top = dims, float(top)
        self.type = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
        self.stored = next(t for t in (np.int16, np.int32, np.int64) if largest <= np.iinfo(t).max)

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(self.type) @ b.astype(self.type).T

    def to_query(self, query_norm, products):
        """Distance of queries (squared norm) to vectors by their products."""
        return np.sqrt(np.maximum(query_norm + self.top - 2.0 * np.asarray(products, np.float64), 0.0))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances between vectors, with the added coordinate."""
        na, nb = _norms(a), _norms(b)
        ea, eb = np.sqrt(np.maximum(self.top - na, 0)), np.sqrt(np.maximum(self.top - nb, 0))
        square = na[:, None] + nb[None, :] - 2.0 * np.asarray(self.products(a, b), np.float64) + (ea[:, None] - eb[None, :]) ** 2
        return np.sqrt(np.maximum(square, 0.0))

    def narrow(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows, self.stored)

    def packed(self, rows: np.ndarray) -> pa.Array:
        rows = self.narrow(rows)
        width = self.dims * rows.itemsize
        whole = rows.tobytes()
        return pa.array([whole[i : i + width] for i in range(0, len(whole), width)], pa.binary())

    def unpacked(self, rows: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(rows), self.stored).reshape(-1, self.dims)


def _cut(rows: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of rows cuts[0]..cuts[1], cuts[1]..cuts[2] and so on."""
    width = rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _norms(rows: np.ndarray) -> np.ndarray:
    return (rows.astype(float) ** 2).sum(1)


class Tree:
    """Routing objects of nodes and pages with their radii and parent distances."""

    def __init__(self, metric: _Metric, centres: np.ndarray):
        self.metric, self.centres = metric, centres
        self.nodes = centres[: max(1, int(np.sqrt(len(centres))))]
        far = metric.between(centres, self.nodes)
        self.node = far.argmin(1)
        self.parent = far[np.arange(len(centres)), self.node]
        self.radius = np.full(len(centres), -np.inf)  # of a page without entries
        self.order = np.argsort(self.node, kind="stable")
        self.starts = np.searchsorted(self.node[self.order], np.arange(len(self.nodes) + 1))

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Page and parent distance of entries: the nearest page of the nearest node."""
        node = self.metric.between(rows, self.nodes).argmin(1)
        page, parent = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for k in np.unique(node):
            own, below = np.flatnonzero(node == k), self.order[self.starts[k] : self.starts[k + 1]]
            far = self.metric.between(rows[own], self.centres[below])
            nearest = far.argmin(1)
            page[own], parent[own] = below[nearest], far[np.arange(len(own)), nearest]
        return page, parent

    def bounds(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds of the distances to every page's entries, and distances to the pages'
        routing objects (computed where the parent distance leaves a page open for any query)."""
        norm = _norms(queries)[:, None]
        to_nodes = self.metric.to_query(norm, self.metric.products(queries, self.nodes))
        low = np.abs(to_nodes[:, self.node] - self.parent) - self.radius
        open_ = np.flatnonzero((low <= least[:, None]).any(0))
        far = np.full(low.shape, np.nan)
        far[:, open_] = self.metric.to_query(norm, self.metric.products(queries, self.centres[open_]))
        low[:, open_] = np.maximum(low[:, open_], far[:, open_] - self.radius[open_])
        return np.maximum(low, 0.0) * (1 - SLACK) - SLACK, far


def build(vectors: DataFrame, asked: DataFrame) -> tuple[Tree, DataFrame] | None:
    """The tree and its table of pages (page, part, ids, parents, data) over rows (vec_id, v).
    Every row is indexed; routing objects are the first rows in hash order of vec_id."""
    reach = [F.max(F.size("v")), F.max(F.greatest(F.lit(0), F.array_max(F.transform("v", F.abs)))), F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e))]
    n, *own = vectors.agg(F.count("*"), *reach).first()
    if not n:
        return None
    dims, largest, top = (max(a or 0, b or 0) for a, b in zip(own, asked.agg(*reach).first(), strict=True))
    metric = _Metric(max(dims, 1), int(largest), top)
    count = min(MAX_PAGES, -(-n // PAGE_ROWS))
    hashed = vectors.withColumn("_h", F.xxhash64("vec_id"))
    # a range of hashes that holds enough rows, so that few are sorted
    hashed = hashed.where(F.col("_h") <= F.lit(int(min(1.0, 1.2 * (count + 50) / n) * 2.0**64 - 2.0**63) if n > 2 * count + 100 else 2**63 - 1))
    chosen = hashed.orderBy("_h", "vec_id").limit(count).select("v").toArrow().column("v").combine_chunks()
    centres = _matrix(chosen, metric.dims)
    tree = Tree(metric, centres[np.sort(np.unique(centres, axis=0, return_index=True)[1])])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), metric.dims)
            page, parent = tree.place(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(page.astype(np.int32)), pa.array(parent), metric.packed(rows)], names=["vec_id", "page", "parent", "data"])

    placed = materialise(vectors.select("vec_id", "v").mapInArrow(assign, "vec_id long, page int, parent double, data binary"))
    found = placed.groupBy("page").agg(F.count("*").alias("n"), F.max("parent").alias("r"))
    for row in found.collect():  # MAX_PAGES rows
        tree.radius[row["page"]] = row["r"]
    parts = found.select(F.col("page").alias("_p"), F.ceil(F.col("n") / (2 * PAGE_ROWS)).alias("_parts"))
    dealt = placed.join(F.broadcast(parts), F.col("page") == F.col("_p")).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("_parts")).cast("int"))  # MAX_PAGES rows

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("parent").combine_chunks()
        ids, parents = (np.asarray(rows.column(c).combine_chunks()) for c in ("vec_id", "parent"))
        data = b"".join(rows.column("data").to_pylist())
        columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), parents.tobytes(), data))]
        return pa.Table.from_arrays(columns, names=["page", "part", "ids", "parents", "data"])

    pages = dealt.select("page", "part", "vec_id", "parent", "data").groupBy("page", "part")
    pages = materialise(pages.applyInArrow(pack, "page int, part int, ids binary, parents binary, data binary"))
    discard(placed)
    return tree, pages


def _search(metric: _Metric, page: tuple, block: tuple, k: int) -> tuple[list[np.ndarray], int]:
    """Of each query of a block (query_id, at, least, q): the page's entries that can be among its k best,
    as [queries, scores, ids], and the number of distances computed for each query."""
    ids, parents, data = page
    query_id, at, least, q = block
    bound = np.where(np.isnan(least), np.inf, metric.to_query(_norms(q), np.nan_to_num(least))) * (1 + SLACK) + SLACK
    low, high = np.searchsorted(parents, at - bound, side="left"), np.searchsorted(parents, at + bound, side="right")
    first, last = int(low.min()), int(high.max())
    if first >= last:
        return [np.zeros(0, np.int64)] * 3, 0
    place = np.arange(first, last)
    scores = metric.products(q, data[first:last]).astype(np.int64)
    usable = (place >= low[:, None]) & (place < high[:, None]) & (ids[first:last] != query_id[:, None])
    floor = np.where(np.isnan(least), np.iinfo(np.int64).min, np.nan_to_num(least)).astype(np.int64)
    if scores.shape[1] > k:  # the page's own k-th best score bounds what is worth sending
        kth = np.partition(np.where(usable, scores, np.iinfo(np.int64).min), -k, axis=1)[:, -k]
        floor = np.maximum(floor, kth)
    i, j = np.nonzero(usable & (scores >= floor[:, None]))
    return _first(query_id[i], scores[i, j], ids[first:last][j], k), last - first


def _first(query: np.ndarray, score: np.ndarray, entry: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best rows of each query, ties to the smaller entry."""
    order = np.lexsort((entry, -score, query))
    query, score, entry = query[order], score[order], entry[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query, side="left") < k
    return [query[kept], score[kept], entry[kept]]


class _Found:
    """The k best of each query among the pages of a task so far, and its number of distances."""

    def __init__(self, k: int):
        self.k, self.parts, self.size, self.counts = k, [], 0, []

    def add(self, best: list[np.ndarray], query_id: np.ndarray, computed: int) -> None:
        self.parts.append(best)
        self.counts.append((query_id, np.full(len(query_id), computed, np.int64)))
        self.size += len(best[0]) + len(query_id)
        if self.size > _KEPT_ROWS:
            self.shrink()

    def shrink(self) -> None:
        self.parts = [_first(*(np.concatenate([x[i] for x in self.parts]) for i in range(3)), self.k)] if self.parts else []
        if self.counts:
            query, place = np.unique(np.concatenate([x for x, _ in self.counts]), return_inverse=True)
            total = np.zeros(len(query), np.int64)
            np.add.at(total, place, np.concatenate([n for _, n in self.counts]))
            self.counts = [(query, total)]
        self.size = 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.shrink()
        names = ["query_id", "score", "vec_id", "computed"]
        for query, score, entry in self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(score), pa.array(entry), pa.array(np.zeros(len(query), np.int64))], names=names)
        for query, total in self.counts:
            none = pa.nulls(len(query), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(query), none, none, pa.array(total)], names=names)


_FOUND = "query_id long, score long, vec_id long, computed long"
#: Candidates that a task gathers before it drops those that can't be among a query's best.
_KEPT_ROWS = 1 << 20


def _visit(tree: Tree, pages: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Search pages with the blocks of queries (page, n, ids, at, least, q) sent to them. A task gives
    each query's k best of all pages that it holds. Rows without vec_id tell how many distances were
    computed. A page that many queries want is copied, its blocks are dealt to the copies."""
    metric = tree.metric
    copies = asked.groupBy(F.col("page").alias("_p")).agg(F.ceil(F.sum("n") / PAGE_QUERIES).cast("int").alias("_copies"))
    none = F.lit(None).cast("binary")
    names = ["page", "part", "copy", "kind", "a", "b", "c", "d"]
    wanted = pages.join(copies, F.col("page") == F.col("_p"))
    held = wanted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).select("page", "part", "copy", F.lit(0).alias("kind"), F.col("ids").alias("a"), F.col("parents").alias("b"), F.col("data").alias("c"), none.alias("d"))
    parts = wanted.select(F.col("page").alias("_q"), "part", "_copies")
    sent = asked.join(parts, F.col("page") == F.col("_q")).select(
        "page", "part", F.pmod(F.xxhash64("ids"), F.col("_copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), F.col("ids").alias("a"), F.col("at").alias("b"), F.col("least").alias("c"), F.col("q").alias("d")
    )
    met = held.select(names).unionByName(sent.select(names)).repartition("page", "part", "copy").sortWithinPartitions("page", "part", "copy", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, found = None, _Found(k)
        for batch in batches:
            for kind, a, b, c, d in zip(*(batch.column(i) for i in range(3, 8)), strict=True):
                a, b, c = (x.as_buffer() for x in (a, b, c))
                if kind.as_py() == 0:
                    page = np.frombuffer(a, np.int64), np.frombuffer(b, np.float64), metric.unpacked([c])
                    continue
                block = np.frombuffer(a, np.int64), np.frombuffer(b, np.float64), np.frombuffer(c, np.float64), metric.unpacked([d.as_buffer()])
                best, computed = _search(metric, page, block, k)
                found.add(best, block[0], computed)
        yield from found.rows()

    return met.mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a candidate that came more than once (from queries that share an
    id) counts each time. A row without vec_id keeps the query's count of distances."""
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id")
    ranked = found.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    counts = found.groupBy("query_id").agg(F.sum("computed").alias("computed"))
    return ranked.select("query_id", "score", "vec_id", F.lit(0).cast("long").alias("computed")).unionByName(counts.select("query_id", F.lit(None).cast("long").alias("score"), F.lit(None).cast("long").alias("vec_id"), "computed"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, vector_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k largest integer inner products
    with the rows of other ids, all of them if there are fewer, ties to the smaller vec_id; and
    n_computed, the number of distances to entries that were computed for the query.

    Rows and queries have the columns `vector_id` and `vector` (others are ignored). Vectors that
    are null or hold null or non-finite components take no part; shorter vectors count as padded
    with zeros. A repeated (id, vector) row is a candidate each time; repeated query ids with
    different vectors are searched together and give one list. No query or no row gives an empty
    result.
    """
    spark = rows.sparkSession
    vectors = materialise(integer_vectors(rows, vector_id, vector, scale))
    asked = materialise(integer_vectors(queries, vector_id, vector, scale))
    built = build(vectors, asked)
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, n_computed long")
    tree, pages = built
    metric = tree.metric
    discard(vectors)
    routed = "page int, n int, ids binary, at binary, least binary, q binary"
    near, seen, step = None, 0, FIRST
    while seen < len(tree.centres):
        start, stop = seen, seen + step

        def route(batches: Iterator[pa.RecordBatch], start: int = start, stop: int = stop) -> Iterator[pa.RecordBatch]:
            """Queries (vec_id, v, least) to the pages that stand at start..stop in their order: a row per
            block of queries and page that any of them wants, with those that do."""
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_QUERIES):
                    part = batch.slice(at, BLOCK_QUERIES)
                    q = _matrix(part.column(1), metric.dims)
                    least = np.asarray(part.column(2).cast(pa.float64()).fill_null(np.nan), float)
                    bound = np.where(np.isnan(least), np.inf, metric.to_query(_norms(q), np.nan_to_num(least)))
                    low, far = tree.bounds(q, bound * (1 + SLACK) + SLACK)
                    order = np.argsort(low, axis=1, kind="stable")[:, start:stop]
                    ahead = np.take_along_axis(low, order, 1)
                    i, j = np.nonzero((ahead <= bound[:, None]) & (tree.radius[order] > -np.inf))
                    page = order[i, j]
                    by = np.argsort(page, kind="stable")
                    i, page = i[by], page[by]
                    wanted, first = np.unique(page, return_index=True)
                    cuts = np.append(first, len(page))
                    ids, own, stored, limit = np.asarray(part.column(0), np.int64), far[i, page], metric.narrow(q), _SENT_BYTES // (metric.dims * 8)
                    first_page = 0
                    while first_page < len(wanted):  # some pages at a time
                        last_page = max(first_page + 1, int(np.searchsorted(cuts, cuts[first_page] + limit, side="right")) - 1)
                        held, own_cuts = slice(cuts[first_page], cuts[last_page]), cuts[first_page : last_page + 1] - cuts[first_page]
                        columns = [pa.array(wanted[first_page:last_page].astype(np.int32)), pa.array(np.diff(own_cuts).astype(np.int32))]
                        columns += [_cut(x, own_cuts) for x in (ids[i[held]], own[held], least[i[held]], stored[i[held]])]
                        yield pa.RecordBatch.from_arrays(columns, names=["page", "n", "ids", "at", "least", "q"])
                        first_page = last_page

        if near is None:
            known = asked.select("vec_id", "v", F.lit(None).cast("double").alias("least"))
        else:
            least = near.where("vec_id is not null").groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
            known = asked.join(least, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.when(F.col("n") == k, F.col("least").cast("double")).alias("least"))
        sent = materialise(known.mapInArrow(route, routed))
        if near is not None and sent.isEmpty():
            discard(sent)
            break
        found = _visit(tree, pages, sent, k)
        better = materialise(_best(found if near is None else near.unionByName(found), k))
        discard(sent, *([near] if near is not None else []))
        near, seen, step = better, stop, step * GROWTH
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    counts = near.where("vec_id is null").select(F.col("query_id").alias("_q"), F.col("computed").alias("n_computed"))
    ranked = near.where("vec_id is not null").withColumn("rank", F.row_number().over(order))
    discard(asked, pages)
    return ranked.join(counts, F.col("query_id") == F.col("_q")).select("query_id", "rank", "vec_id", "score", "n_computed")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
