"""Tree explanations against enumeration, the vector index, windows at day grain."""

import itertools
import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import explain, ml, temporal, training
from ledgerlark.operators.vector_index import VectorIndex


def random_tree(draw, depth, features):
    """node id -> (prediction, weight, left, right, feature, threshold)"""
    nodes = {}

    def grow(mass, left_depth):
        number = len(nodes)
        nodes[number] = None
        if left_depth == 0 or draw.random() < 0.15:
            nodes[number] = (draw.uniform(-1, 1), mass, -1, -1, -1, None)
            return number
        part = draw.uniform(0.1, 0.9)
        left, right = grow(mass * part, left_depth - 1), grow(mass * (1 - part), left_depth - 1)
        nodes[number] = (0.0, mass, left, right, draw.randrange(features), draw.uniform(0, 1))
        return number

    grow(100.0, depth)
    return nodes


def expected(nodes, x, known, number=0):
    """The tree's value where only the known features are; others pass by training weight."""
    value, mass, left, right, feature, threshold = nodes[number]
    if left < 0:
        return value
    if feature in known:
        return expected(nodes, x, known, left if x[feature] <= threshold else right)
    return sum(nodes[c][1] / mass * expected(nodes, x, known, c) for c in (left, right))


def test_shapley_values_equal_enumeration():
    draw = random.Random(11)
    for depth, features in ((1, 1), (2, 2), (4, 3), (6, 5)):
        forest = [random_tree(draw, depth, features) for _ in range(3)]
        trees = [explain.tree_paths(nodes, w) for nodes, w in zip(forest, (1.0, 0.1, 0.1), strict=True)]
        rows = np.array([[draw.random() for _ in range(features)] for _ in range(7)])
        got = explain.shapley(trees, rows)
        for r, x in enumerate(rows):
            value = lambda known: sum(w * expected(nodes, x, known) for nodes, w in zip(forest, (1.0, 0.1, 0.1), strict=True))  # noqa: B023, E731
            for f in range(features):
                others = [g for g in range(features) if g != f]
                want = sum(math.factorial(k) * math.factorial(features - 1 - k) / math.factorial(features) * (value({*s, f}) - value(set(s))) for k in range(features) for s in itertools.combinations(others, k))
                assert got[r, f] == pytest.approx(want, abs=1e-12)
            assert got[r].sum() + sum(t.base for t in trees) == pytest.approx(value(set(range(features))), abs=1e-12)


def test_contributions_sum_to_the_margin(spark):
    draw = random.Random(3)
    data = [(i, *(draw.random() for _ in range(4))) for i in range(600)]
    rows = spark.createDataFrame([(*r, int(r[1] + r[2] * r[3] > 0.8)) for r in data], "id int, a double, b double, c double, d double, y int").repartition(3)
    model = training.train(rows, ["a", "b", "c", "d"], "y", "gbt", trees=20, depth=5, rate=0.3)
    scored = ml.score(model, rows).withColumn("contributions", F.lit("own"))
    for r in explain.tree_contributions(model, scored, ["a", "b", "c", "d"]).collect():
        margin = math.log(r["y_pred_proba"] / (1 - r["y_pred_proba"])) / 2
        assert r["base_value"] + sum(c["shap"] for c in r["contributions"]) == pytest.approx(margin, abs=1e-9)
        assert {c["feature"]: c["value"] for c in r["contributions"]} == {f: r[f] for f in "abcd"}
        sizes = [abs(c["shap"]) for c in r["contributions"]]
        assert sizes == sorted(sizes, reverse=True)
    shares = explain.tree_contributions(model, scored, ["a", "b", "c", "d"]).select(F.inline("contributions")).groupBy("feature").agg(F.avg(F.abs("shap")).alias("s"))
    ranked = [r["feature"] for r in shares.orderBy(F.desc("s")).collect()]
    assert ranked[0] == "a" and ranked[-1] == "d"
    assert explain.tree_contributions(model, scored.limit(0), ["a", "b", "c", "d"]).count() == 0


def test_early_stop_is_for_folds_only(spark, monkeypatch):
    draw = random.Random(8)
    rows = spark.createDataFrame([(date(2023 + k // 12, k % 12 + 1, 1), draw.random(), draw.randrange(2)) for k in range(24) for _ in range(40)], "snapshot_date date, x double, is_insolvent int")
    remaining, test, folds = training.combined_split(rows, "snapshot_date", splits=2)
    make, counted, asked = training.Preprocessor((), ("x",), handle_missing=False), [], []
    fit = training.train
    monkeypatch.setattr(training, "train", lambda *a, validation=None, **p: asked.append(validation is not None) or counted.append(m := fit(*a, validation=validation, **p)) or m)
    training.cross_validate(remaining, folds, "snapshot_date", "is_insolvent", make, "gbt", trees=12, depth=4, rate=0.5, tolerance=0.01)
    training.final_fit(remaining, test, "is_insolvent", make, 0.5, "gbt", trees=12, depth=2, rate=0.5)
    assert asked == [True, True, False]
    assert counted[2].stages[-1].getNumTrees == 12 and max(m.stages[-1].getNumTrees for m in counted[:2]) < 12  # noise: no round helps for long


def test_folds_are_computed_once_for_a_search(spark, tmp_path):
    """The rows' own computation is counted: a search runs it once, however many fits follow."""
    count = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda x: count.add(1) or x, "double")
    rows = spark.range(480).select(F.add_months(F.lit("2023-01-01").cast("date"), (F.col("id") % 24).cast("int")).alias("snapshot_date"), mark((F.col("id") % 7).cast("double")).alias("x"), (F.col("id") % 7 > 3).cast("int").alias("is_insolvent"))
    held = spark.range(24).select(F.add_months(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).alias("snapshot_date"))
    folds = ml.folds(held, "snapshot_date", 2)
    make = training.Preprocessor((), ("x",), handle_missing=False)
    found = training.search(rows, folds, "snapshot_date", "is_insolvent", make, "logistic", training.grid(c=[0.01, 1.0, 100.0]))
    assert found.count() == 3 and count.value == 480
    alone, scores = training.cross_validate(rows, folds, "snapshot_date", "is_insolvent", make, c=1.0)
    one = training.aggregate_folds(alone).first()
    assert one["auc_roc"] == pytest.approx(found.where("parameters = '{\"c\": 1.0}'").first()["auc_roc"]) and scores.count() == one["size"]
    assert len(training.grid(**training.GRIDS["gbt"])) == 27 and len(training.grid(**training.GRIDS["gbt_fine"])) == 16 and len(training.grid(**training.GRIDS["logistic"])) == 5


def test_many_categories_are_refused(spark):
    rows = spark.range(1500).select(F.col("id").cast("string").alias("c"), F.col("id").cast("double").alias("x"))
    with pytest.raises(ValueError, match="closed vocabulary"):
        training.Preprocessor(("c",), ("x",), handle_missing=False).fit(rows)


def test_constant_columns(spark):
    rows = spark.range(1000).select((F.col("id") * 0 + 0.1).alias("fixed"), F.col("id").cast("double").alias("x"))
    own = training.Preprocessor((), ("fixed", "x"), handle_missing=False).fit(rows)
    assert own.deviations["fixed"] == 1.0 and own.means["fixed"] == 0.1
    assert ml.scale(rows, rows, ["fixed"]).agg(F.min("fixed"), F.max("fixed")).first() == (0.0, 0.0)


def test_a_request_needs_four_values_only(spark):
    rows = spark.createDataFrame([(date(2010, 1, 1), "tech", 0.5, 90.0), (date(2010, 1, 1), None, 0.5, 90.0)], "foundation_date date, industry_sector string, unpaid_ratio_trailing_90d double, total_outstanding_debt double")
    good, bad = training.validation.validated_requests(rows, "2024-01-01").orderBy(F.size("violations")).collect()
    assert good["violations"] == [] and good["login_velocity"] is None and bad["violations"] == ["missing_industry_sector"]


# --- vector index ---------------------------------------------------------------------------

VECTORS = "id string, text string, metadata map<string, string>, vector array<double>"


def brute(rows, query, k):
    def distance(v):
        a, b = np.array(query), np.array(v)
        return round(1 - a @ b / np.sqrt((a @ a) * (b @ b)), 10) + 0.0

    good = [(distance(v), i) for i, v in rows.items() if v is not None and len(v) == len(query) and None not in v and any(v) and np.isfinite(v).all()]
    return [i for _, i in sorted(good)[:k]]


def test_index_lifecycle_and_search(spark, tmp_path, monkeypatch):
    draw = random.Random(6)
    new = lambda: [draw.randrange(-3, 4) / 2 for _ in range(4)]  # noqa: E731  (few values: many ties)
    rows = {f"c{i}": new() for i in range(300)} | {"null": None, "zero": [0.0] * 4, "nan": [1.0, float("nan"), 0.0, 0.0], "hole": [1.0, None, 0.0, 0.0], "long": [1.0] * 5, "empty": []}
    frame = lambda part: spark.createDataFrame([(i, f"text {i}", {"source": i[0]}, v) for i, v in part.items()], VECTORS).repartition(5)
    index = VectorIndex(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError, match="no index"):
        index.table()
    assert index.build(frame({"old": [1.0, 0.0, 0.0, 0.0]} | rows)) == len(rows) + 1
    assert index.build(frame(rows)) == len(rows) and index.table().where("id = 'old'").count() == 0
    changed = {"c7": new(), "c9": new(), "fresh": new()}
    assert index.upsert(frame(changed)) == len(rows) + 1
    rows |= changed
    assert index.versions() == [2, 3]
    asked = {f"q{i}": new() for i in range(40)} | {"qlong": [1.0, 2.0, 3.0, 4.0, 5.0], "qnull": None, "qzero": [0.0] * 4}
    queries = spark.createDataFrame([(q, v, "own") for q, v in asked.items()], "query_id string, vector array<double>, text string")

    def check():
        got = {}
        for r in index.nearest(queries).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
            assert r["text"] == f"text {r['id']}" and r["metadata"] == {"source": r["id"][0]}
        want = {q: brute(rows, v, 6) for q, v in asked.items() if v and any(v)}
        assert got == want and got["qlong"] == ["long"]

    check()
    monkeypatch.setattr("ledgerlark.operators.vector_index.MAX_QUERY_VALUES", 50)  # many passes
    check()
    with pytest.raises(ValueError, match="several rows"):
        index.upsert(frame({"a": new()}).unionByName(frame({"a": new()})))
    broken = frame({"z": new()}).withColumn("text", F.raise_error(F.lit("midway")).cast("string"))
    with pytest.raises(Exception, match="midway"):
        index.upsert(broken)
    assert index.versions() == [2, 3] and index.table().count() == len(rows)  # the failed write left nothing
    assert index.build(frame(rows).limit(0)) == 0 and index.nearest(queries).count() == 0


# --- day grain ------------------------------------------------------------------------------


def test_binned_windows_equal_a_range_join(spark):
    draw = random.Random(1)
    at = lambda n: date(1969, 12, 20) + timedelta(days=n)  # noqa: E731  (bins on both sides of day 0)
    spine = [(k, at(n)) for k in (1, 2) for n in range(0, 60)]
    events = [(draw.choice([1, 1, 2, 3, None]), at(draw.randrange(-20, 70)), i) for i in range(80)]
    for days in (1, 7, 30):
        got = temporal.trailing_pairs(spark.createDataFrame(spine, "k int, snapshot_date date"), spark.createDataFrame(events, "k int, day date, i int"), "k", "day", days).collect()
        want = sorted((k, s, i) for k, s in spine for e, d, i in events if e == k and s - timedelta(days=days) < d <= s)
        assert sorted((r.k, r.snapshot_date, r.i) for r in got) == want
