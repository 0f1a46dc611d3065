"""Line deduplication by sharded minimal perfect hashes.

1. Every document's lines are keyed (stripped, A-Z lower-cased) and hashed to 128 bits; a
   map-side combined aggregate finds the hashes held by two or more documents and the smallest
   holder of each.
2. The repeated hashes are dealt to shards by their first half. Each shard builds a minimal
   perfect hash over its hashes, which indexes three compact arrays: fingerprints (the other
   half), keepers and document counts. A shard is one row of a few binary columns.
3. Documents probe the arrays: only hashes travel (no line texts), each to a salted copy of its
   shard, so that a line held by a third of all documents is probed by several tasks.
4. The hits come back as line hashes per document and the documents are cut in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices, texts_of

_WHITE = b" \t\n\x0b\x0c\r"
#: Hashes of a shard on average; about 24 bytes each.
SHARD_KEYS = 1 << 16
#: Copies of a shard, among which its probes are dealt.
SALTS = 16
_NULL_ID = np.iinfo(np.int64).max


def line_key(line: bytes) -> bytes:
    """The line stripped of ASCII white space and with A-Z lower-cased, in UTF-8."""
    return line.strip(_WHITE).lower()


def _hashes(lines: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the lines' keys (0, 0 for keys of fewer than `least` code points)."""
    raw = bytearray()
    for line in lines:
        key = line_key(line)
        long_enough = len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least
        raw += xxhash.xxh3_128_digest(key) if long_enough else bytes(16)
    pair = np.frombuffer(bytes(raw), "<i8").reshape(-1, 2)
    return pair[:, 0].copy(), pair[:, 1].copy()


# --- minimal perfect hash ------------------------------------------------------------------


def _mix(keys: np.ndarray, seed) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) ^ (np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_perfect_hash(keys: np.ndarray) -> np.ndarray:
    """Seeds of a minimal perfect hash over distinct 64-bit keys: a key's bucket is its hash
    modulo len(seeds), its slot in 0..len(keys)-1 comes from the bucket's seed (hash and
    displace; the largest buckets are placed first, all buckets of a size at the same time)."""
    n = len(keys)
    seeds = np.zeros(max(1, (n + 2) // 3), np.uint32)
    if not n:
        return seeds
    bucket = (_mix(keys, 0) % np.uint64(len(seeds))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    keys, bucket = keys[order], bucket[order]
    sizes = np.bincount(bucket, minlength=len(seeds))
    taken = np.zeros(n, bool)
    for size in range(int(sizes.max()), 0, -1):
        waiting = np.flatnonzero(sizes == size)
        if not len(waiting):
            continue
        members = keys[(np.cumsum(sizes) - sizes)[waiting][:, None] + np.arange(size)]
        if size == 1:  # single keys take the free slots in order: the seed's top bit marks that
            free = np.flatnonzero(~taken)[: len(waiting)]
            seeds[waiting] = free.astype(np.uint32) | np.uint32(1 << 31)
            break
        seed = 0
        while len(waiting):
            seed += 1
            slots = (_mix(members, seed) % np.uint64(n)).astype(np.int64)
            fits = ~taken[slots].any(1) & (np.diff(np.sort(slots, 1), axis=1) > 0).all(1)
            rows = np.flatnonzero(fits)[::-1]
            owner = np.full(n, -1)
            owner[slots[rows].ravel()] = np.repeat(rows, size)  # where two want a slot, the first has it
            rows = rows[(owner[slots[rows]] == rows[:, None]).all(1)]
            taken[slots[rows].ravel()] = True
            seeds[waiting[rows]] = seed
            left = np.ones(len(waiting), bool)
            left[rows] = False
            waiting, members = waiting[left], members[left]
    return seeds


def perfect_slots(seeds: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Slots of keys; a key outside the set gets any slot."""
    seed = seeds[(_mix(keys, 0) % np.uint64(len(seeds))).astype(np.int64)]
    direct = seed >> 31 == 1
    slots = (_mix(keys, seed) % np.uint64(max(n, 1))).astype(np.int64)
    return np.where(direct, seed & 0x7FFFFFFF, slots)


# --- Spark side ----------------------------------------------------------------------------

_LINES = T.StructType([T.StructField("_a", T.LongType()), T.StructField("_b", T.LongType()), T.StructField("_doc", T.LongType())])


def _line_hashes(docs: DataFrame, text: str, doc_id: str, least: int) -> DataFrame:
    """Distinct (_a, _b, _doc) of every document's long enough lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "_text"):
                ids = np.asarray(rows.column(0).fill_null(_NULL_ID), np.int64)
                split = [t.encode("utf-8", "replace").split(b"\n") for t in texts_of(rows.column(1))]
                a, b = _hashes([line for lines in split for line in lines], least)
                doc = np.repeat(ids, [len(lines) for lines in split])
                keep = (a != 0) | (b != 0)
                kept = np.unique(np.stack([doc[keep], a[keep], b[keep]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(kept[:, 1]), pa.array(kept[:, 2]), pa.array(kept[:, 0])], names=["_a", "_b", "_doc"])

    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(run, _LINES)


_SHARDS = "shard int, seeds binary, prints binary, keepers binary, counts binary"


def build_shards(repeated: DataFrame, shards: int) -> DataFrame:
    """One row per shard of `repeated` (_a, _b, _keeper, _n): seeds of the perfect hash (before
    them the salt that makes the shard's 64-bit keys distinct) and the arrays that it indexes."""

    def build(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        a, b, keeper, count = (np.asarray(group.column(n).combine_chunks(), np.int64) for n in ("_a", "_b", "_keeper", "_n"))
        salt = 1
        while len(np.unique(keys := _mix(a, salt) ^ b.astype(np.uint64))) < len(keys):
            salt += 1
        seeds = build_perfect_hash(keys)
        slots = perfect_slots(seeds, len(keys), keys)
        prints, keepers, counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
        prints[slots], keepers[slots], counts[slots] = a, keeper, np.minimum(count, np.iinfo(np.int32).max)
        stored = np.concatenate([np.array([salt], np.uint32), seeds])
        columns = [pa.array([key[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (stored, prints, keepers, counts))]
        return pa.Table.from_arrays(columns, names=["shard", "seeds", "prints", "keepers", "counts"])

    dealt = repeated.withColumn("shard", F.pmod(F.col("_a"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, _SHARDS)


_PROBES = "_doc long, _a long, _b long"


def probe(lines: DataFrame, shard_rows: DataFrame, shards: int, salts: int, holders: int = 2) -> DataFrame:
    """Rows of `lines` that a document loses: hashes in the arrays whose count is at least `holders`
    and whose keeper is another document. Arrays and probes meet in partitions sorted so that a shard's arrays come first;
    they are streamed, so memory holds one shard and one batch."""
    names = ["shard", "salt", "kind", "_doc", "_a", "_b", "seeds", "prints", "keepers", "counts"]
    null = F.lit(None)
    arrays = shard_rows.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(salts))))).select(
        "shard", "salt", F.lit(0).alias("kind"), *(null.cast("long").alias(c) for c in ("_doc", "_a", "_b")), "seeds", "prints", "keepers", "counts"
    )
    asked = lines.select(
        F.pmod(F.col("_a"), F.lit(shards)).cast("int").alias("shard"),
        F.pmod(F.xxhash64("_doc"), F.lit(salts)).cast("int").alias("salt"),
        F.lit(1).alias("kind"), "_doc", "_a", "_b", *(null.cast("binary").alias(c) for c in ("seeds", "prints", "keepers", "counts")),
    )
    met = arrays.select(names).unionByName(asked.select(names)).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, -1
        for batch in batches:
            shard, kind = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(2), np.int64)
            salt = np.asarray(batch.column(1), np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0), [True]]))
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if kind[start] == 0:
                    row = [batch.column(i)[start].as_py() for i in (6, 7, 8, 9)]
                    held, at = tuple(np.frombuffer(x, t) for x, t in zip(row, (np.uint32, np.int64, np.int64, np.int32), strict=True)), shard[start]
                elif at == shard[start]:
                    doc, a, b = (np.asarray(batch.column(i).slice(start, stop - start), np.int64) for i in (3, 4, 5))
                    seeds, prints, keepers, counts = held
                    slots = perfect_slots(seeds[1:], len(prints), _mix(a, seeds[0]) ^ b.astype(np.uint64))
                    lost = (prints[slots] == a) & (counts[slots] >= holders) & (keepers[slots] != doc)
                    if lost.any():
                        yield pa.RecordBatch.from_arrays([pa.array(x[lost]) for x in (doc, a, b)], names=["_doc", "_a", "_b"])

    return met.mapInArrow(run, _PROBES)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 10, holders: int = 2) -> DataFrame:
    """Replaces `text` by its kept lines and adds n_lines and n_dropped (long).

    A line whose key has at least `least` code points and is held by `holders` or more documents
    stays only in the document with the smallest id (all its occurrences there stay). Null or
    empty text is one empty line and gives empty text. Rows with the same id count as one
    document and are all cut alike; a null id counts as one document that comes last. All other
    columns stay; input columns named n_lines or n_dropped are replaced. An empty table gives an
    empty table.
    """
    lines = materialise(_line_hashes(docs, text, doc_id, least))
    each = lines.distinct() if holders > 2 else lines  # rows that share an id are one holder; two differ by their ids
    repeated = each.groupBy("_a", "_b").agg(F.min("_doc").alias("_keeper"), F.max("_doc").alias("_last"), F.count("*").alias("_n"))
    repeated = materialise(repeated.where("_keeper <> _last").drop("_last"))
    shards = max(1, -(-repeated.count() // SHARD_KEYS))
    lost = probe(lines, build_shards(repeated, shards), shards, SALTS, holders)
    cuts = lost.groupBy("_doc").agg(F.collect_set(F.struct("_a", "_b")).alias("_cuts"))  # at most a document's own lines
    kept = docs.drop("n_lines", "n_dropped")
    fields = kept.schema.fields
    keyed = kept.select(F.struct(*(kept[f.name] for f in fields)).alias("_row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_ID)).alias("_key"))
    joined = keyed.join(cuts.withColumnRenamed("_doc", "_cut_doc"), F.col("_key") == F.col("_cut_doc"), "left")
    joined = joined.select(*(F.col("_row").getField(f.name).alias(f.name) for f in fields), F.col("_cuts._a").alias("_cut_a"), F.col("_cuts._b").alias("_cut_b"))
    schema = T.StructType([*(T.StructField(f.name, T.StringType()) if f.name == text else f for f in fields), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names = [f.name for f in fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = names.index(text)
        for batch in batches:
            for rows in slices(batch, text):
                out, total, dropped = [], [], []
                drop = zip(rows.column(len(names)).to_pylist(), rows.column(len(names) + 1).to_pylist(), strict=True)
                for whole, (cut_a, cut_b) in zip(texts_of(rows.column(where)), drop, strict=True):
                    split = whole.split("\n")
                    stay = split
                    if cut_a:
                        gone = set(zip(cut_a, cut_b, strict=True))
                        a, b = _hashes([x.encode("utf-8", "replace") for x in split], least)
                        stay = [x for x, h in zip(split, zip(a.tolist(), b.tolist(), strict=True), strict=True) if h not in gone]
                    out.append("\n".join(stay))
                    total.append(len(split))
                    dropped.append(len(split) - len(stay))
                columns = [pa.array(out, pa.string()) if i == where else rows.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(cut, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         lower_key AS key
  FROM (
    SELECT doc_id, pos, line,
           translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
          FROM documents))),
repeated AS (
  SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE r.keeper IS NOT NULL AND r.keeper <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos)
              FILTER (WHERE r.keeper IS NULL OR r.keeper = l.doc_id), '')) AS kept_sha256
FROM lines l LEFT JOIN repeated r ON r.key = l.key
GROUP BY l.doc_id
"""
