"""Merkle manifest of a dataset, broadcast upper-tree variant.

Leaves are hashed by Spark's own functions and placed within their group by ranges. Blocks of
ARITY ** BLOCK_LEVELS consecutive leaves, aligned with the tree's runs, are reduced to their top
nodes by tasks, a block each. While the tops are more than MAX_TOP, they are reduced in the same
way again, by tasks; what is left is a small top tree, which the driver builds. It broadcasts
the path from each top to the root (the proofs' suffix); tasks walk their blocks once more and
finish every row's proof and fold. No proof is stored or shuffled.

A node of a run of several, or of one, is the hash of the run's digests as text, one after another,
while the level has more than one node; a single leaf is its own subroot.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, placed

ARITY = 3
#: Levels that a task reduces: blocks of 3 ** 7 = 2187 leaves.
BLOCK_LEVELS = 7
#: Nodes that the driver takes at most; with their paths these are about 30 MB.
MAX_TOP = 20_000
#: Fields of a row's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64


def leaf_hash(*columns: Column) -> Column:
    """sha256 of the values as text, each with its number of bytes before it; null is '-'."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text)), 256)


def node_hash(digests: str) -> str:
    return hashlib.sha256(digests.encode()).hexdigest()


def tree_levels(nodes: list[str], total: int, arity: int, most: int | None = None) -> list[list[str]]:
    """The levels above a run of consecutive nodes of a level that has `total` nodes, itself first:
    until the tree's level has one node, or `most` levels higher."""
    levels = [nodes]
    while total > 1 and (most is None or len(levels) <= most):
        below = levels[-1]
        levels.append([node_hash("".join(below[i : i + arity])) for i in range(0, len(below), arity)])
        total = -(-total // arity)
    return levels


def paths(levels: list[list[str]], arity: int, places: str = "", siblings: str = "") -> list[tuple[str, str]]:
    """Each lowest node's path to the only highest one, followed by a path from there on. `places`
    has two digits a level: the node's place in its run and the run's size; `siblings` are the
    others' digests, left to right."""
    higher = [(places, siblings)]
    for nodes in reversed(levels[:-1]):
        own = []
        for i in range(len(nodes)):
            run, k = nodes[i - i % arity : i - i % arity + arity], i % arity
            p, s = higher[i // arity]
            own.append((f"{k}{len(run)}{p}", "".join(run[:k]) + "".join(run[k + 1 :]) + s))
        higher = own
    return higher


def fold(node: str, places: str, siblings: str) -> str:
    """The root that a node and its path give."""
    at = 0
    for k in range(0, len(places), 2):
        left, right = at + _HEX * int(places[k]), at + _HEX * (int(places[k + 1]) - 1)
        node, at = node_hash(siblings[at:left] + node + siblings[left:right]), right
    return node


_NODES = "_group string, _pos long, _n long, _node string"
_PATHS = "_group string, _pos long, places string, siblings string, subroot string, root string"


def _blocked(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    return nodes.withColumn("_block", F.floor(F.col("_pos") / F.lit(arity**levels)).cast("long"))


def _blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """Top nodes of blocks, as the nodes of a level `levels` higher."""
    span = arity**levels

    def top(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        n = table.column("_n")[0].as_py()
        node = tree_levels(table.column("_node").to_pylist(), n, arity, levels)[-1][0]
        return pa.table({"_group": [key[0].as_py()], "_pos": [key[1].as_py()], "_n": [-(-n // span)], "_node": [node]})

    return _blocked(nodes.select("_group", "_pos", "_n", "_node"), arity, levels).groupBy("_group", "_block").applyInArrow(top, _NODES)


def _top_tree(tops: list, arity: int) -> dict[tuple[str, int], tuple[str, str, str, str]]:
    """(group, place) -> places, siblings, subroot, root of the rows (group, place, n, node)."""
    by: dict[str, list] = defaultdict(list)
    for group, pos, _, node in sorted(tops, key=lambda r: (r[0].encode(), r[1])):
        by[group].append(node)
    trees = {group: tree_levels(nodes, len(nodes), arity) for group, nodes in by.items()}
    subroots = [tree[-1][0] for tree in trees.values()]
    upper = tree_levels(subroots, len(subroots), arity)
    out = {}
    for (group, tree), suffix in zip(trees.items(), paths(upper, arity) if subroots else [], strict=True):
        for pos, path in enumerate(paths(tree, arity, *suffix)):
            out[group, pos] = (*path, tree[-1][0], upper[-1][0])
    return out


def _climb(nodes: DataFrame, arity: int, levels: int, most: int) -> Broadcast | DataFrame:
    """Paths of written nodes to the root: broadcast from the driver if the nodes are few, else as a
    table, made by tasks from the paths of their blocks."""
    count, largest = nodes.agg(F.count(F.lit(1)), F.max("_n")).first()
    if count <= most:
        return nodes.sparkSession.sparkContext.broadcast(_top_tree([tuple(r) for r in nodes.select("_group", "_pos", "_n", "_node").collect()], arity))
    if largest > 1:
        higher = materialise(_blocks(nodes, arity, levels))
        return materialise(_finish(nodes, _climb(higher, arity, levels, most), arity, levels))
    ranked = materialise(placed(nodes.select(F.col("_group").alias("_own"), "_node"), [F.col("_own")], "_pos", count="_n"))  # a node a group, many groups
    above = _climb(ranked.select(F.lit("").alias("_group"), "_pos", "_n", "_node"), arity, levels, most)
    found = ranked.select("_pos", "_own", "_node").join(above.drop("_group", "subroot"), "_pos")
    return materialise(found.select(F.col("_own").alias("_group"), F.lit(0).cast("long").alias("_pos"), "places", "siblings", F.col("_node").alias("subroot"), "root"))


def _finish(nodes: DataFrame, above: Broadcast | DataFrame, arity: int, levels: int, leaves: bool = False) -> DataFrame:
    """Nodes with their whole paths; for leaves also the fold of `_claim` (the leaf itself where that
    is null) and all columns of theirs, instead of the nodes' own."""
    kept = [f for f in nodes.schema.fields if f.name not in ("_n", "_claim")] if leaves else T._parse_datatype_string("_group string, _pos long").fields
    schema = T.StructType([*kept, *T._parse_datatype_string("places string, siblings string, subroot string, root string").fields])
    if leaves:
        schema = T.StructType([*schema.fields, T.StructField("folded_root", T.StringType())])
    names = [f.name for f in kept]

    def finished(table: pa.Table, suffix: tuple[str, str, str, str]) -> pa.Table:
        table = table.sort_by("_pos")
        hashes = table.column("_node").to_pylist()
        own = paths(tree_levels(hashes, table.column("_n")[0].as_py(), arity, levels), arity, suffix[0], suffix[1])
        out = {c: table.column(c) for c in names}
        out |= {"places": [p for p, _ in own], "siblings": [s for _, s in own], "subroot": [suffix[2]] * len(own), "root": [suffix[3]] * len(own)}
        if leaves:
            out["folded_root"] = [fold(c or h, *path) for h, c, path in zip(hashes, table.column("_claim").to_pylist(), own, strict=True)]
        return pa.table(out)

    groups = _blocked(nodes, arity, levels).groupBy("_group", "_block")
    if isinstance(above, Broadcast):
        return groups.applyInArrow(lambda key, table: finished(table, above.value[key[0].as_py(), key[1].as_py()]), schema)

    def met(key: tuple, table: pa.Table, path: pa.Table) -> pa.Table:
        return finished(table, tuple(path.column(c)[0].as_py() for c in ("places", "siblings", "subroot", "root")))

    return groups.cogroup(above.withColumnRenamed("_pos", "_block").groupBy("_group", "_block")).applyInArrow(met, schema)


def prove(
    docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, claimed: dict[str, Column] | None = None, *,
    arity: int = ARITY, levels: int = BLOCK_LEVELS, most: int = MAX_TOP,
) -> DataFrame:
    """A row per row of docs: key, group, position (in its group, by key), leaf, places, siblings (the
    proof, see paths), subroot, root, and folded_root: what the proof gives for the leaf whose
    fields `claimed` replaces. Groups are ordered by their UTF-8 bytes, null first.

    Nulls in any field are hashed as '-'; a null key comes first in its group. Rows with equal keys
    are ordered by their leaves; equal leaves have places of their own. Very long texts are hashed
    where they are read; only digests are dealt. Columns beside key, group and fields don't
    matter, whatever their names. An empty table has no rows and no root."""
    if not 2 <= arity <= 9 or levels < 1 or most < 1:
        raise ValueError("arity must be 2 to 9; levels and most at least 1")
    values = {f: F.col(f) for f in fields}
    leaf = leaf_hash(*values.values())
    claim = leaf_hash(*(values | (claimed or {})).values())
    name = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    rows = docs.select(name.alias("_group"), F.col(key).alias("_key"), leaf.alias("_node"), F.nullif(claim, leaf).alias("_claim"))
    leaves = materialise(placed(rows, [F.col("_key"), F.col("_node")], "_pos", "_group", "_n"))
    tops = materialise(_blocks(leaves, arity, levels))
    above = _climb(tops, arity, levels, most)
    out = _finish(leaves, above, arity, levels, leaves=True)
    back = F.when(F.col("_group") != "", F.substring(F.col("_group"), 2, 1 << 30))
    return out.select(F.col("_key").alias(key), back.alias(group), F.col("_pos").alias("position"), F.col("_node").alias("leaf"), "places", "siblings", "subroot", "root", "folded_root")


def manifest(docs: DataFrame, group: str = "source", **options) -> DataFrame:
    """A row per group, to be kept beside the data: group, n_rows, subroot, root."""
    proved = prove(docs, group=group, **options)
    return proved.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.first("subroot").alias("subroot"), F.first("root").alias("root"))


def digests(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proofs of all documents, and what the proofs say of texts whose line breaks
    were deleted where the crc32 of the decimal doc_id is even."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    text = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = prove(docs, claimed={"text": text})
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
