"""N-gram Jaccard join: a size-aware join of shingle sets with a threshold of 0.8.

Small sets (light): every subset of the size that a link needs is enumerated as one key; sets
that share a key of enough elements are linked, nothing else has to be compared. Large sets:
inverted lists over the shingles that a link can't avoid (the prefix in a common order) are
scanned, and candidates are verified on their whole sets. The boundary between the two is the
size at which the estimated costs, over the corpus's own histogram of sizes, are least.

Skew. Equal sets are one class. Shingles that stand in many lists are heavy and go to the end
of the common order, so prefixes avoid shared passages; documents made of heavy shingles only
(families of near copies) still meet in long lists. A list isn't expanded into pairs: its members
are first compared with a representative, its first member in an order that all lists share.
Members of a list that are then still in different components all have to be compared; lists with
the same representative are put together for that, their members are cut into blocks by size and
component, and pairs of blocks are compared by one matrix product each. Pairs of blocks of one and
the same component, or whose sizes can't be linked, are left out.

Both comparisons look at fingerprints first: a set with each shingle cut to 16 (for large sets 32)
bits, where equal values are told apart by counting. Two sets have at most as many shingles in
common as their fingerprints, so this never loses a link, and a fingerprint takes a quarter of the
set. Whole sets travel only for what fingerprints don't rule out, which is little more than the
links. So pairs are never rows, no link between different components is lost, and sets travel once
per pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import among, discard, few, materialise, release_shuffles, slices, texts_of

WORDS = 5
#: Largest set that may be enumerated.
MAX_SMALL = 14
#: A shingle in the heads of more classes than this is heavy.
HEAVY = 4
#: Partners of a representative in one group.
GROUP = 256
#: Shingles of a block's sets; a set of fewer than LEAST_WEIGHT counts as so many.
BLOCK, LEAST_WEIGHT = 512_000, 1000
#: Sets of more shingles than this have fingerprints of 32 bits a shingle instead of 16.
NARROW = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def overlap(n: int, m: int) -> int:
    """Least intersection of sets of n and m elements with 100 |both| >= 80 |either|."""
    return -(-4 * (n + m) // 9)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's WORDS-word shingles, A-Z lower-cased; with
    fewer words of the whole sequence; of nothing for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    s = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        s = s * _MIX + h[j : j + len(s)]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s.view(np.int64))


def _class(tokens: np.ndarray) -> int:
    """Hash of a whole set."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(tokens.tobytes()), np.int64)[0])


def fingerprint(tokens: np.ndarray) -> bytes:
    """The set's shingles, each cut to its low 16 bits (beyond NARROW shingles: 32)."""
    return tokens.astype(np.uint16 if len(tokens) <= NARROW else np.uint32).tobytes()


def _codes(prints: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """Fingerprints as sorted sets of numbers, all of the narrowest one's width: a value's second,
    third... occurrence has a number of its own, so what two of them have in common is at least
    what their sets have."""
    out = []
    narrow = any(n <= NARROW for n in sizes)
    for data, n in zip(prints, sizes, strict=True):
        values = np.frombuffer(data, np.uint16 if n <= NARROW else np.uint32)
        values = np.sort(values.astype(np.uint16) if narrow else values).astype(np.int64)
        first = np.searchsorted(values, values, side="left")
        out.append(values << 28 | (np.arange(len(values)) - first))
    return out


def _prefix(n: Column) -> Column:
    """Length of a prefix of which a linked set must hold a part: n - ceil(0.8 n) + 1."""
    return n - F.floor((n * 4 + 4) / 5) + 1


def _head(n: Column) -> Column:
    """Length of the head, which holds the prefix also after a few heavy shingles are left out."""
    return F.least(n, F.floor((n + 3) / 4) + 1)


def shingle_heads(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_id, n (set size), cls (hash of the whole set), head (the first shingles in hash order; all
    of them up to MAX_SMALL) and prints (fingerprint) of every row; within a batch an equal set's
    head and fingerprint come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "_text"):
                seen: set[int] = set()
                sizes, classes, heads, prints = [], [], [], []
                for i, t in zip(rows.column(0).to_pylist(), texts_of(rows.column(1)), strict=True):
                    tokens = shingles(t)
                    n, c = len(tokens), _class(tokens)
                    sizes.append(n)
                    classes.append(c)
                    fresh = i is not None and c not in seen
                    if fresh:
                        seen.add(c)
                    heads.append(tokens[: n if n <= MAX_SMALL else (n + 3) // 4 + 1] if fresh else tokens[:0])
                    prints.append(fingerprint(tokens) if fresh else None)
                offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
                flat = np.concatenate(heads) if heads else np.zeros(0, np.int64)
                head = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                columns = [rows.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), head, pa.array(prints, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "n", "cls", "head", "prints"])

    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(run, "_id long, n long, cls long, head array<long>, prints binary")


# --- small sets -----------------------------------------------------------------------------


def _subset_sizes(n: int, most: int) -> list[int]:
    """Sizes of the intersections that sets of n elements need with sets of up to `most`."""
    return sorted({overlap(n, m) for m in range(-(-4 * n // 5), min(5 * n // 4, most) + 1) if overlap(n, m) <= min(n, m)})


def boundary(histogram: dict[int, int]) -> int:
    """Size up to which sets are enumerated. A set costs its keys if it is enumerated; if it goes
    to the lists, its head and twice its elements (verified sets travel). Cost in rows moved."""
    best, least = 0, None
    for x in range(MAX_SMALL + 1):
        cost = 0
        for n, count in histogram.items():
            if 0 < n <= x:
                cost += count * sum(comb(n, s) for s in _subset_sizes(n, x))
            if n > x or 5 * n // 4 > x:
                cost += count * ((n + 3) // 4 + 1 + 2 * n)
        if least is None or cost < least:
            best, least = x, cost
    return best


def _small_links(heads: DataFrame, most: int) -> DataFrame:
    """Links (a, b) of classes of up to `most` elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, needs, classes = [], [], [], []
            for n, c, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens = [t & (2**64 - 1) for t in head]
                whole = sum(tokens)
                for size in _subset_sizes(n, most):
                    for gone in combinations(tokens, n - size):
                        key = (whole - sum(gone)) * 0x9E3779B97F4A7C15 + size & (2**64 - 1)
                        keys.append(key - 2**64 if key >> 63 else key)
                        sizes.append(n)
                        needs.append(size)
                        classes.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, sizes, needs, classes)], names=["key", "n", "need", "cls"])

    keyed = heads.select("n", "cls", "head").mapInArrow(run, "key long, n long, need long, cls long")
    # a link's need grows with the sizes, so all that are linked by a key are linked to its smallest set
    least = F.min(F.struct("n", "cls")).over(Window.partitionBy("key", "need"))
    near = keyed.withColumn("_least", least).where(F.col("cls") != F.col("_least.cls"))
    near = near.where(F.col("need") * 9 >= 4 * (F.col("n") + F.col("_least.n")))
    return near.select(F.col("cls").alias("a"), F.col("_least.cls").alias("b")).distinct()


# --- large sets -----------------------------------------------------------------------------


def _rows_of(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, weight: str = "1") -> DataFrame:
    """Texts of the documents in `wanted` (_id, ...), whose rows hold `weight` values each. Texts
    are shuffled only if these are very many."""
    rows = among(docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("_text")), "_doc", wanted.select(F.col("_id").alias("key")).distinct())
    return rows.join(few(wanted, weight), F.col("_doc") == F.col("_id")).drop("_doc")


def _all_shingles(rows: DataFrame) -> DataFrame:
    """(token, cls, n) for every shingle of rows (_text, cls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, c in _sets_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.full(len(tokens), c)), pa.array(np.full(len(tokens), len(tokens)))], names=["token", "cls", "n"])

    return rows.select("_text", "cls").mapInArrow(run, "token long, cls long, n long")


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    """Sets and classes of rows (_text, cls) whose text has that class."""
    for batch in batches:
        for part in slices(batch, "_text"):
            for t, c in zip(texts_of(part.column(0)), part.column(1).to_pylist(), strict=True):
                tokens = shingles(t)
                if len(tokens) and _class(tokens) == c:
                    yield tokens, c


_PREFIXES = "token long, cls long, n long, level long"


def _prefixes(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """(token, cls, n, level) of the prefixes of rows (_text, cls) in the order (level, token), the
    levels of heavy shingles being in `heavy` (token, level). Up to common.MAX_BROADCAST_KEYS of
    these are given to the tasks, which then choose prefixes by themselves; beyond, shingles are
    joined with them."""
    if heavy.count() > common.MAX_BROADCAST_KEYS:
        full = _all_shingles(rows).dropDuplicates(["cls", "token"])
        full = full.join(heavy, "token", "left").withColumn("level", F.coalesce("level", F.lit(0)))
        place = F.row_number().over(Window.partitionBy("cls").orderBy("level", "token"))
        return full.withColumn("_place", place).where(F.col("_place") <= _prefix(F.col("n"))).select("token", "cls", "n", "level")
    table = heavy.orderBy("token").toArrow()
    known = rows.sparkSession.sparkContext.broadcast(tuple(np.asarray(table.column(c).combine_chunks(), np.int64) for c in ("token", "level")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, levels = known.value
        for tokens, c in _sets_of(batches):
            level = np.zeros(len(tokens), np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
                level = np.where(names[at] == tokens, levels[at], 0)
            n = len(tokens)
            first = np.argsort(level, kind="stable")[: n - -(-4 * n // 5) + 1]  # tokens are in order already
            yield pa.RecordBatch.from_arrays([pa.array(tokens[first]), pa.array(np.full(len(first), c)), pa.array(np.full(len(first), n)), pa.array(level[first])], names=["token", "cls", "n", "level"])

    return rows.select("_text", "cls").mapInArrow(run, _PREFIXES).dropDuplicates(["cls", "token"])


def _lists(docs: DataFrame, heads: DataFrame, holders: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Inverted lists (token, cls, n) of the prefixes, lists of one left out, with each member's
    place in its list (rank, from 1) and the list's first member (to, to_n). The order within
    lists is common to all, so the lists of a family mostly have the same first members.

    The common order of shingles is (level, hash); a light one has level 0, a heavy one the number
    of heads that it stands in, so the commonest come last. A class whose head holds enough light
    shingles has its prefix there; the few others (dense) take theirs from all their shingles. A
    dense class's light shingles beyond its head were in no count, so heads are asked for them
    once more.
    """
    exploded = heads.select("cls", "n", F.posexplode("head").alias("pos", "token")).where(F.col("pos") < _head(F.col("n")))
    rows = exploded.repartition("token").dropDuplicates(["token", "cls"])
    rows = rows.withColumn("cnt", F.count("*").over(Window.partitionBy("token"))).where("cnt > 1")
    shared = materialise(rows.select("token", "cls", "n", "pos", F.when(F.col("cnt") > HEAVY, F.col("cnt")).otherwise(F.lit(0)).alias("level"), (F.col("cnt") > HEAVY).alias("heavy")))
    release_shuffles(docs.sparkSession)
    by_class = Window.partitionBy("cls").orderBy("pos")
    gone = F.coalesce(F.sum(F.col("heavy").cast("int")).over(by_class.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum(F.col("heavy").cast("int")).over(Window.partitionBy("cls"))
    ranked = shared.withColumn("_gone", gone).withColumn("_dense", _head(F.col("n")) - every < _prefix(F.col("n")))
    ranked = materialise(ranked.select("token", "cls", "n", "_dense", (~F.col("heavy") & (F.col("pos") - F.col("_gone") < _prefix(F.col("n")))).alias("_first")))
    light = ranked.where("not _dense and _first").select("token", "cls", "n")
    dense = materialise(ranked.where("_dense").select("cls").distinct().join(holders, "cls"))
    heavy = shared.where("heavy").select("token", "level").distinct()
    packed = materialise(_prefixes(_rows_of(docs, dense, doc_id, text), heavy))
    beyond = materialise(packed.where("level = 0").select(F.col("token").alias("key")).distinct())
    again = among(exploded.select("token", "cls", "n"), "token", beyond)
    lists = light.unionByName(packed.drop("level")).unionByName(again).repartition("token").dropDuplicates(["token", "cls"])
    order = Window.partitionBy("token").orderBy("_h", "cls")
    lists = lists.withColumn("_n", F.count("*").over(Window.partitionBy("token"))).where("_n > 1").withColumn("_h", F.xxhash64("cls", F.lit(0)))
    lists = lists.withColumns({"rank": F.row_number().over(order), "to": F.first("cls").over(order), "to_n": F.first("n").over(order)}).drop("_n", "_h")
    lists = materialise(lists)
    discard(shared, ranked, dense, packed, beyond)
    return lists


def _groups(pairs: DataFrame, holders: DataFrame) -> DataFrame:
    """Classes of pairs (a, b) with their roles: the groups (to, salt) in which a class is compared,
    as the representative b (kind 0) or as one of its partners. A representative with many
    partners has several groups."""
    sized = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("_groups"))
    dealt = pairs.join(sized, "b").select(F.col("a").alias("cls"), F.col("b").alias("to"), F.pmod(F.xxhash64("a"), F.col("_groups")).cast("int").alias("salt"), F.lit(1).alias("kind"))
    own = sized.select(F.col("b").alias("cls"), F.col("b").alias("to"), F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("salt"), F.lit(0).alias("kind"))
    roles = dealt.unionByName(own).groupBy("cls").agg(F.collect_list(F.struct("to", "salt", "kind")).alias("roles"))
    return materialise(roles.join(holders, "cls"))


def _prints_of(heads: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """A row (cls, n, prints, *columns, role) for every role of the classes in `wanted`."""
    rows = among(heads.where("prints is not null"), "_id", wanted.select(F.col("_held").alias("key")).distinct())
    side = few(wanted.select(F.col("cls").alias("_c"), F.col("_held").alias("_h"), "roles", *columns), "size(roles)")
    return rows.join(side, (F.col("_id") == F.col("_h")) & (F.col("cls") == F.col("_c"))).select("cls", "n", "prints", *columns, F.explode("roles").alias("role"))


def _common(one: np.ndarray, other: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    few_, many = (one, other) if len(one) <= len(other) else (other, one)
    if not len(few_):
        return 0
    where = np.searchsorted(many, few_)
    return int((many[np.minimum(where, len(many) - 1)] == few_).sum())


def _possible(heads: DataFrame, pairs: DataFrame, holders: DataFrame) -> DataFrame:
    """The pairs (a, b) that their fingerprints don't rule out."""
    wanted = _groups(pairs, holders)
    rows = _prints_of(heads, wanted).select("role.to", "role.salt", "role.kind", "cls", "n", "prints")
    met = rows.repartition("to", "salt").sortWithinPartitions("to", "salt", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, size, at = b"", 0, None
        for batch in batches:
            left, right = [], []
            for to, kind, c, n, prints in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if kind == 0:
                    base, size, at = prints, n, to
                elif at == to and _common(*_codes([prints, base], [n, size])) >= overlap(n, size):
                    left.append(c)
                    right.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    found = materialise(met.mapInArrow(compare, "a long, b long").distinct())
    discard(wanted)
    return found


def _verify(docs: DataFrame, pairs: DataFrame, holders: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Pairs (a, b) whose whole sets are linked. A set travels once to each group that it is
    compared in."""
    wanted = _groups(pairs, holders)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "_text", 1 << 20):
                out: list[tuple] = []
                for t, c, roles in zip(texts_of(rows.column(0)), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                    tokens = shingles(t)
                    if _class(tokens) == c:
                        data = tokens.tobytes()
                        out += [(r["to"], r["salt"], r["kind"], c, data) for r in roles]
                        if len(out) > 2000:
                            yield _rows(_ROLES, out)
                            out = []
                yield _rows(_ROLES, out)

    schema = "to long, salt int, kind int, cls long, data binary"
    travelling = _rows_of(docs, wanted, doc_id, text, "size(roles)").select("_text", "cls", "roles").mapInArrow(sets, schema)
    met = travelling.repartition("to", "salt").sortWithinPartitions("to", "salt", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, at = np.zeros(0, np.int64), None
        for batch in batches:
            left, right = [], []
            for to, kind, c, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                tokens = np.frombuffer(data, np.int64)
                if kind == 0:
                    base, at = tokens, to
                elif at == to and _common(tokens, base) >= overlap(len(tokens), len(base)):
                    left.append(c)
                    right.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable by links (a, b), for all nodes in links. Labels
    go along links and then jump to their own label's label, so rounds grow with the logarithm
    of a component's diameter. Minima are combined on the map side."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(both.where("a <> b").distinct())
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        told = edges.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("_node")).agg(F.min("label").alias("_least"))
        better = labels.join(told, F.col("node") == F.col("_node"), "left").select("node", F.col("label").alias("_was"), F.least("label", "_least").alias("label"))
        jump = labels.select(F.col("node").alias("_at"), F.col("label").alias("_next"))
        better = better.join(jump, F.col("label") == F.col("_at"), "left").select("node", "_was", F.least("label", "_next").alias("label"))
        better = materialise(better)
        labels = better.select("node", "label")
        if not better.where("label <> _was").take(1):
            return labels


def _near(n: Column, m: Column) -> Column:
    """Sets of these sizes can be linked."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _block_links(docs: DataFrame, heads: DataFrame, lists: DataFrame, labels: DataFrame, holders: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Links (a, b) between different components among all members of lists that weren't the
    representative; of each pair of blocks those that span what it links. Fingerprints are compared
    first; whole sets travel for members of a pair of blocks that these don't rule out."""
    rest = lists.where("rank > 1").join(few(labels), F.col("cls") == F.col("node"), "left").select("token", "to", "cls", "n", F.coalesce("label", "cls").alias("label"))
    over = Window.partitionBy("token")
    mixed = rest.withColumns({"_low": F.min("label").over(over), "_high": F.max("label").over(over)}).where("_low <> _high")
    members = mixed.select("to", "cls", "n", "label").distinct()
    along = Window.partitionBy("to").orderBy(F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.25))), "label", "cls")
    before = F.coalesce(F.sum(F.greatest(F.col("n"), F.lit(LEAST_WEIGHT))).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    members = materialise(members.withColumn("block", F.floor(before / BLOCK).cast("int")))
    blocks = materialise(members.groupBy("to", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")))
    other = blocks.select(F.col("to").alias("_to"), F.col("block").alias("right"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("least").alias("_least"), F.col("most").alias("_most"))
    meet = (F.col("to") == F.col("_to")) & (F.col("block") <= F.col("right"))
    meet = meet & (5 * F.col("most") >= 4 * F.col("_least")) & (5 * F.col("_most") >= 4 * F.col("least"))
    pairs = blocks.join(other, meet).where((F.least("low", "_low") != F.greatest("high", "_high"))).select("to", F.col("block").alias("left"), "right")
    pairs = pairs.withColumn("_side", F.explode(F.array_distinct(F.array("left", "right"))))
    side = pairs.select(F.col("to").alias("_to"), "left", "right", "_side")
    roles = members.join(side, (F.col("to") == F.col("_to")) & (F.col("block") == F.col("_side")))

    def wanted(roles: DataFrame) -> DataFrame:
        roles = roles.groupBy("cls", "label").agg(F.collect_list(F.struct("to", "left", "right")).alias("roles"))
        return materialise(roles.join(holders, "cls"))

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition("to", "left", "right").sortWithinPartitions("to", "left", "right", "cls")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Sets (cls, label, n, data) of a pair of blocks, one pair after another."""
        key, held = None, []
        for batch in batches:
            for *where, c, label, n, data in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if where != key:
                    if held:
                        yield key, held
                    key, held = where, []
                if not held or held[-1][0] != c:
                    held.append((c, label, n, data))
        if held:
            yield key, held

    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in gathered(batches):
            codes = _codes([h[3] for h in held], [h[2] for h in held])
            left = np.unique(np.concatenate(_close(held, codes))).tolist()
            if left:
                yield _rows(pa.schema(list(_SHIPPED)[:5]), [(*key, *held[k][:2]) for k in left])

    place = ["role.to", "role.left", "role.right", "cls", "label"]
    asked = wanted(roles)
    close = met(_prints_of(heads, asked, "label").select(*place, "n", "prints"))
    left = materialise(close.mapInArrow(rule_out, "to long, left int, right int, cls long, label long"))
    discard(asked, members, blocks)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "_text", 1 << 20):
                for t, c, label, roles in zip(texts_of(rows.column(0)), *(rows.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    tokens = shingles(t)
                    if _class(tokens) == c:
                        data = tokens.tobytes()
                        yield _rows(_SHIPPED, [(r["to"], r["left"], r["right"], c, label, len(tokens), data) for r in roles])

    travelling = _rows_of(docs, wanted(left), doc_id, text, "size(roles)").select("_text", "cls", "label", "roles")
    travelling = travelling.mapInArrow(sets, "to long, left int, right int, cls long, label long, n long, data binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in gathered(batches):
            i, j = _forest(len(held), *_close(held, [np.frombuffer(h[3], np.int64) for h in held]))
            yield pa.RecordBatch.from_arrays([pa.array([held[k][0] for k in x.tolist()], pa.int64()) for x in (i, j)], names=["a", "b"])

    return met(travelling).mapInArrow(compare, "a long, b long")


def _close(held: list[tuple], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of held sets (cls, label, n, ...) of different labels that have enough in common.
    Intersections are counted by products of incidence matrices, a run of elements at a time."""
    none = np.zeros(0, np.int64)
    if len(held) < 2 or len({h[1] for h in held}) < 2:
        return none, none
    n = np.array([h[2] for h in held])
    column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(len(held)), [len(s) for s in sets])
    shared = counts[column] > 1
    row, column = row[shared], (np.cumsum(counts > 1) - 1)[column[shared]]
    both = np.zeros((len(held), len(held)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 1 << 13
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        matrix = np.zeros((len(held), min(width, int(column[-1]) + 1 - start)), np.float32)
        matrix[row[a:b], column[a:b] - start] = 1
        both += matrix @ matrix.T
    label = np.array([h[1] for h in held])
    return np.nonzero((9 * both >= 4 * (n[:, None] + n[None, :])) & (label[:, None] > label[None, :]))


def _forest(size: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links (i, j) between `size` sets that span their components: fewer than sets.
    In a round every root that has a link to a smaller one takes one such link."""
    root, taken = np.arange(size), []
    while True:
        one, two = root[i], root[j]
        high, at = np.unique(np.maximum(one, two)[one != two], return_index=True)
        if not len(high):
            at = np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
            return i[at], j[at]
        at = np.nonzero(one != two)[0][at]
        taken.append(at)
        root[high] = np.minimum(one, two)[at]
        while (root[root] != root).any():
            root = root[root]


_SHIPPED = pa.schema([("to", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("cls", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
_ROLES = pa.schema([("to", pa.int64()), ("salt", pa.int32()), ("kind", pa.int32()), ("cls", pa.int64()), ("data", pa.binary())])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after further links (a, b): components of the graph of labels."""
    ends = links.select("a").unionByName(links.select(F.col("b").alias("a"))).distinct()
    known = ends.join(labels, F.col("a") == F.col("node"), "left").select("a", F.coalesce("label", "a").alias("label"))
    one, two = known.select(F.col("a").alias("_x"), F.col("label").alias("_p")), known.select(F.col("a").alias("_y"), F.col("label").alias("_q"))
    between = links.join(one, F.col("a") == F.col("_x")).join(two, F.col("b") == F.col("_y")).select(F.col("_p").alias("a"), F.col("_q").alias("b"))
    merged = components(between).select(F.col("node").alias("_old"), F.col("label").alias("_new"))
    every = labels.unionByName(known.select(F.col("a").alias("node"), "label")).distinct()
    return materialise(every.join(merged, F.col("label") == F.col("_old"), "left").select("node", F.coalesce("_new", "label").alias("label")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles (long), component_id (long) and n_spanning_links (long) of every row.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a set holds the
    distinct 5-word shingles (with fewer words: the whole sequence, if any). Two documents are
    linked if 100 * intersection >= 80 * union; component_id is the smallest doc_id reachable by
    links. n_spanning_links counts the verified links of the document's class with other classes
    by which components were found: a class with a link has at least one, but not all are listed.
    Empty, blank and null texts have no set and no link. Rows that share an id are one document
    with each of their texts; a row with a null id is linked with nothing and has a null component.
    Extra columns are ignored; an empty table gives an empty result. Sets are compared by 64-bit
    hashes of shingles.
    """
    spark = docs.sparkSession
    heads = materialise(shingle_heads(docs, doc_id, text))
    valid = heads.where("_id is not null and n > 0")
    holds = F.min(F.when(F.size("head") > 0, F.col("_id")))  # a row that has the class's head
    holders = materialise(valid.groupBy("cls").agg(F.min("_id").alias("_id"), F.first("n").alias("_n"), holds.alias("_held")))
    counts = holders.where(F.col("_n") <= MAX_SMALL).groupBy("_n").count().collect()  # MAX_SMALL rows
    small = boundary({r["_n"]: r["count"] for r in counts})
    holders = holders.select("cls", "_id", "_held")
    usable = valid.where(F.size("head") > 0)
    light = usable.where(F.col("n") <= small).dropDuplicates(["cls"])
    large = usable.where((F.col("n") > small) | (F.floor(F.col("n") * 5 / 4) > small))
    lists = _lists(docs, large, holders, doc_id, text)
    release_shuffles(spark)
    # rows that share an id belong together
    shared = valid.select("_id", "cls").distinct().withColumn("b", F.min("cls").over(Window.partitionBy("_id")))
    same = shared.where("cls <> b").select(F.col("cls").alias("a"), "b")
    pairs = lists.where((F.col("rank") > 1) & _near(F.col("n"), F.col("to_n"))).select(F.col("cls").alias("a"), F.col("to").alias("b"))
    pairs = materialise(pairs.distinct())
    possible = _possible(heads, pairs, holders)
    links = materialise(_small_links(light, small).unionByName(same).unionByName(_verify(docs, possible, holders, doc_id, text)))
    discard(pairs, possible)
    labels = components(links)
    release_shuffles(spark)
    found = materialise(_block_links(docs, heads, lists, labels, holders, doc_id, text).distinct())
    discard(lists)
    if found.take(1):
        labels = _joined(labels, found)
        links = links.unionByName(found)
    release_shuffles(spark)
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_spanning_links"))
    groups = labels.join(holders, F.col("node") == F.col("cls")).select("node", "label", "_id")
    smallest = groups.groupBy("label").agg(F.min("_id").alias("component_id"))
    linked = groups.join(smallest, "label").join(ends, "node").select("node", "component_id", "n_spanning_links")
    every = heads.select("_id", "n", "cls")
    done = every.where("n > 0").join(linked, F.col("cls") == F.col("node"), "left")
    done = done.join(holders.select(F.col("cls").alias("_c"), F.col("_id").alias("_holder")), F.col("cls") == F.col("_c"), "left")
    found = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_holder", "_id"))
    done = done.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce("n_spanning_links", F.lit(0)).alias("n_spanning_links"))
    # texts without a set meet no join: they may be many and have one class
    bare = every.where("n = 0").select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("_id").alias("component_id"), F.lit(0).cast("long").alias("n_spanning_links"))
    done = materialise(done.unionByName(bare))
    discard(heads, holders, links, labels)
    return done


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs of which no linked document has a smaller id: one document stays of each
    component. Rows with a null id stay; exactly repeated rows of a kept id stay too."""
    found = near_duplicates(docs, doc_id, text).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    kept = docs.join(found, F.col(doc_id) == F.col("_kept"), "left_semi")
    return kept.unionByName(docs.where(F.col(doc_id).isNull()))
