"""Importance resampling towards a target set, by hashed n-gram features.

Words of a task's texts get integer ids in a dictionary; n-grams are id tuples, packed into one
integer each; every distinct tuple of a run of texts has its bytes rebuilt from the dictionary
and hashed once, and its bucket is joined back to all its occurrences by its number. Only bucket
counts leave the tasks: a row per bucket, document sets reduced before the shuffle. Gains of the
buckets (a fixed number of them) are broadcast and summed up per document in a second pass, so
no feature is written or shuffled. Dictionaries belong to tasks: one over the whole corpus would
shuffle every word of it and put the commonest in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, placed, slices, texts_of

#: Runs of ASCII digits, letters and everything beyond ASCII, after A-Z are lower-cased.
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Words that a task's dictionary holds at most before it starts anew.
_DICTIONARY = 400_000


class _Dictionary(dict):
    """Word -> id, in the order of first use."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self.words)
        self.words.append(word.encode())
        return number


class FeatureHasher:
    """Buckets of the n-grams of texts. A word's bucket is kept as long as the dictionary is."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets
        self.clear()

    def clear(self) -> None:
        self.dictionary, self.known = _Dictionary(), np.zeros(0, np.int32)

    def _of_words(self, ids: np.ndarray) -> np.ndarray:
        fresh = self.dictionary.words[len(self.known) :]
        if fresh:
            self.known = np.concatenate([self.known, np.array([zlib.crc32(w) % self.buckets for w in fresh], np.int32)])
        return self.known[ids]

    def _of_tuples(self, ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """Buckets of the n-grams that start at the given places."""
        number = ids[starts]
        for k in range(1, n):  # the distinct prefixes' numbers and the next word's id make a pair
            _, number = np.unique(number.astype(np.int64) << 32 | ids[starts + k], return_inverse=True)
        _, first, number = np.unique(number, return_index=True, return_inverse=True)
        words = self.dictionary.words
        tuples = (ids[starts[first]][:, None] if n == 1 else np.stack([ids[starts[first] + k] for k in range(n)], 1)).tolist()
        hashed = np.array([zlib.crc32(b" ".join([words[w] for w in t])) % self.buckets for t in tuples], np.int32)
        return hashed[number]

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each feature's text and bucket, and the texts' numbers of words."""
        if len(self.dictionary) > _DICTIONARY:
            self.clear()
        found = [_WORDS.findall(t.translate(_LOWER)) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        look = self.dictionary.__getitem__
        ids = np.fromiter((look(w) for words in found for w in words), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        owners, buckets = [owner], [self._of_words(ids)]
        for n in range(2, self.longest + 1):
            starts = np.arange(len(ids) - n + 1) if len(ids) >= n else np.zeros(0, np.int64)
            starts = starts[owner[starts] == owner[starts + n - 1]]
            owners.append(owner[starts])
            buckets.append(self._of_tuples(ids, starts, n) if len(starts) else np.zeros(0, np.int32))
        return np.concatenate(owners), np.concatenate(buckets), sizes


def bucket_counts(rows: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often features fall into each bucket, over all rows. A task gives one row a
    bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = FeatureHasher(longest, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                total += np.bincount(hasher.features(texts_of(part.column(0)))[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    return rows.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket, floor of 1000 times the logarithm of the smoothed ratio of the target's share to the
    documents'; the driver gets a row per bucket."""
    both = bucket_counts(docs, text, longest, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(bucket_counts(target, target_text, longest, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    whole = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = whole.unionByName(both).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toPandas().sort_values("bucket")  # `buckets` rows
    s, t = counts["s"].to_numpy(np.float64), counts["t"].to_numpy(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", longest: int = 1) -> DataFrame:
    """Adds n_words, n_features and weight (sum of the gains of all features), long. Null or empty
    texts have 0 of each; columns of these names are replaced; other columns stay. Narrow."""
    added = ("n_words", "n_features", "weight")
    kept = docs.drop(*added)
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", " + ", ".join(f"{c} long" for c in added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = sent.value
        hasher = FeatureHasher(longest, len(value))
        for batch in batches:
            for rows in slices(batch, text, 1 << 20):
                owner, bucket, sizes = hasher.features(texts_of(rows.column(rows.schema.get_field_index(text))))
                n = np.bincount(owner, minlength=len(sizes)).astype(np.int64)
                ends = np.zeros(len(owner) + 1, np.int64)
                order = np.argsort(owner, kind="stable") if longest > 1 else slice(None)
                np.cumsum(value[bucket[order]], out=ends[1:])  # whole numbers, exact
                stops = np.cumsum(n)
                weight = ends[stops] - ends[stops - n]
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x, pa.int64()) for x in (sizes, n, weight))], names=[*rows.schema.names, *added])

    return kept.mapInArrow(run, schema)


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", *,
    longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """All documents' key, n_words, n_features, weight, score and rank. score is weight plus a Gumbel
    draw from the seeded hash of the key, in thousandths; of the documents with at least
    `least_words` words the given percentage with the highest scores have a rank from 1 on.

    Null and empty texts have no features and weigh 0, and may be scored but aren't drawn; a null key
    is hashed as an empty one and comes last among equal scores. Repeated rows are scored alike and
    each may be drawn. An empty target weighs all features by the documents' counts alone; an empty
    table gives none. Columns beside key and text don't matter."""
    gain = gains(docs, target, text, target_text, longest, buckets)
    rows = weigh(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), gain, "_text", longest).drop("_text")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = materialise(rows.withColumn("score", F.col("weight") + gumbel.cast("long")))
    fit = rows.where(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc_nulls_last("_key"), F.col("n_features"), F.col("weight")]
    drawn = placed(fit, order, "_place", count="_of")
    rank = F.when(F.col("_place") < F.floor(F.col("_of") * percent / 100), F.col("_place") + 1)
    out = drawn.withColumn("rank", rank.cast("long")).drop("_place", "_of")
    out = out.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("_key").alias(key), "n_words", "n_features", "weight", "score", "rank")


def verdicts(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
