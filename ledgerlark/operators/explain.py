"""Per-row explanations of boosted trees: path-dependent Shapley values, exact.

A leaf's path asks of each feature on it whether the row's value lies in an interval (o = 1 or 0);
a feature that isn't known passes with the share z of the training weight that did. The leaf's
part in a feature's Shapley value is leaf * (o - z) * the mean, over all orders of the path's
features, of the others' product of o (known before) and z (not yet). That mean is the integral
over s from 0 to 1 of the product of o * s + z * (1 - s), a polynomial, which a Gauss-Legendre
rule of half as many points as the path has features gives exactly. Leaves, features and rows
are array axes, so a tree takes a few array operations for a block of rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_folder

#: Values of one array at most (rows x leaves x path), which bounds a task's memory.
_BLOCK = 1 << 20
CONTRIBUTIONS = "array<struct<feature: string, value: double, shap: double>>"


@dataclass
class TreePaths:
    """One tree's leaves: values (tree weight included) and, per place on their paths (padded), the
    feature, its interval (low, high] and the share of weight that passes."""

    values: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    @property
    def base(self) -> float:
        return float(self.values @ self.share.prod(1))


def tree_paths(nodes: dict[int, tuple], weight: float) -> TreePaths:
    """Paths of a tree given as node id -> (prediction, training weight, left, right, feature, threshold);
    left is -1 at a leaf. Splits of one feature on a path meet in one interval."""
    found = []
    stack = [(0, {})]
    while stack:
        number, path = stack.pop()
        prediction, mass, left, right, feature, threshold = nodes[number]
        if left < 0:
            found.append((prediction * weight, path))
            continue
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        stack.append((left, path | {feature: (low, min(high, threshold), share * nodes[left][1] / mass)}))
        stack.append((right, path | {feature: (max(low, threshold), high, share * nodes[right][1] / mass)}))
    longest = max(1, *(len(path) for _, path in found)) if found else 1
    shape = (len(found), longest)
    out = TreePaths(np.array([v for v, _ in found]), np.zeros(shape, np.int32), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape))
    for i, (_, path) in enumerate(found):
        for k, (feature, (low, high, share)) in enumerate(path.items()):
            out.feature[i, k], out.low[i, k], out.high[i, k], out.share[i, k] = feature, low, high, share
    return out


def shapley(trees: list[TreePaths], rows: np.ndarray) -> np.ndarray:
    """Shapley values (rows x features) of the trees' sum."""
    out = np.zeros(rows.shape)
    for tree in trees:
        leaves, longest = tree.feature.shape
        points, weights = np.polynomial.legendre.leggauss((longest + 1) // 2)
        points, weights = (points + 1) / 2, weights / 2
        order = np.argsort(tree.feature, axis=None, kind="stable")
        features, starts = np.unique(tree.feature.ravel()[order], return_index=True)
        step = max(1, _BLOCK // (leaves * longest))
        for at in range(0, len(rows), step):
            x = rows[at : at + step][:, tree.feature]
            passed = ((x > tree.low) & (x <= tree.high)).astype(float)
            mean = np.zeros(passed.shape)
            for s, w in zip(points, weights, strict=True):
                factor = passed * s + tree.share * (1 - s)
                mean += w * factor.prod(2)[:, :, None] / factor
            parts = (tree.values[:, None] * (passed - tree.share) * mean).reshape(len(x), -1)[:, order]
            out[at : at + step, features] += np.add.reduceat(parts, starts, axis=1)
    return out


def paths_of(model) -> list[TreePaths]:
    """Paths of a fitted boosted model (a pipeline's last stage or the model itself), from the node
    table that it is saved as. The driver holds the model anyway."""
    trees = model.stages[-1] if hasattr(model, "stages") else model
    session = SparkSession.getActiveSession()
    path = work_folder(session)
    trees.write().save(path)
    node = F.col("nodeData")
    table = session.read.parquet(f"{path}/data").select(
        "treeID", node["id"], node["prediction"], node["impurityStats"][0], node["leftChild"], node["rightChild"], node["split"]["featureIndex"],
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)), node["split"]["numCategories"],
    ).collect()
    by: dict[int, dict[int, tuple]] = {}
    for tree, number, *rest, categories in table:
        if categories > 0:
            raise ValueError("splits of categories aren't explained; encode them first")
        by.setdefault(tree, {})[number] = tuple(rest)
    return [tree_paths(by[k], w) for k, w in enumerate(trees.treeWeights)]


def tree_contributions(model, rows: DataFrame, features: list[str]) -> DataFrame:
    """Adds base_value and contributions to rows that a model's features are columns of: each feature
    with its value and its Shapley contribution to the margin (base_value + their sum = margin),
    largest size first, ties in the order of `features`. Columns of these names are replaced."""
    trees = paths_of(model)
    base = sum(t.base for t in trees)
    sent = rows.sparkSession.sparkContext.broadcast(trees)  # as large as the model
    added = ("base_value", "contributions")
    kept = rows.drop(*added)
    ready = kept.withColumn("_x", F.array(*(F.col(c).cast("double") for c in features)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", base_value double, contributions {CONTRIBUTIONS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(batch.num_columns - 1).flatten(), float).reshape(-1, len(features))
            shap = shapley(sent.value, x)
            order = np.argsort(-np.abs(shap), axis=1, kind="stable")
            names = pa.array(features).take(pa.array(order.ravel()))
            values = pa.StructArray.from_arrays([names, pa.array(np.take_along_axis(x, order, 1).ravel()), pa.array(np.take_along_axis(shap, order, 1).ravel())], names=["feature", "value", "shap"])
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(features))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.full(len(x), base)), pa.ListArray.from_arrays(offsets, values)], names=[*batch.schema.names[:-1], *added])

    return ready.mapInArrow(run, schema)
