"""The perceptron against finite differences, sessions against batches."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import ml, perceptron, training
from ledgerlark.streaming import sessions


def test_gradient_equals_finite_differences():
    draw = np.random.default_rng(1)
    shape = perceptron.sizes(3, (5, 4))
    flat = draw.normal(size=sum(a * b + b for a, b in shape))
    x, y = draw.normal(size=(20, 3)), draw.integers(0, 2, 20).astype(float)
    for dropout in (0.0, 0.4):
        at = lambda w: perceptron.loss_and_gradient(w, shape, x, y, 3.5, dropout, np.random.default_rng(9))  # noqa: B023, E731  (the same units drop)
        _, gradient = at(flat)
        for i in range(len(flat)):
            step = np.zeros(len(flat))
            step[i] = 1e-6
            assert gradient[i] == pytest.approx((at(flat + step)[0] - at(flat - step)[0]) / 2e-6, rel=1e-4, abs=1e-5)


@pytest.fixture(scope="module")
def rare(spark):
    draw = random.Random(2)
    rows = [(draw.gauss(0, 1), draw.gauss(0, 1)) for _ in range(1500)]
    return spark.createDataFrame([(a, b, int(a + b + draw.gauss(0, 1) > 2.4)) for a, b in rows], "a double, b double, y int").cache()


def test_class_weight_raises_recall_of_the_rare_class(spark, rare):
    options = {"hidden": (8,), "dropout": 0.1, "epochs": 12, "steps": 4, "rate": 0.03}
    plain = perceptron.fit(rare, ["a", "b"], "y", **options)
    weighted = training.train(rare, ["a", "b"], "y", "mlp", **options)
    recall = [training.evaluate(ml.score(m, rare), "y").first()["recall"] for m in (plain, weighted)]
    assert recall[1] > recall[0] + 0.2 and recall[1] > 0.7
    assert plain.history[-1][0] < plain.history[0][0]


def test_partitions_do_not_change_the_model(spark, rare):
    options = {"hidden": (4,), "dropout": 0.0, "epochs": 2, "steps": 3}
    one, many = (perceptron.fit(rare.repartition(n), ["a", "b"], "y", **options) for n in (1, 7))
    assert one.weights == pytest.approx(many.weights, abs=1e-9)
    twice = [perceptron.fit(rare.coalesce(1), ["a", "b"], "y", **{**options, "dropout": 0.5}).weights for _ in range(2)]
    assert twice[0] == twice[1]


def test_early_stop_keeps_the_best_weights(spark, rare):
    flipped = rare.withColumn("y", 1 - F.col("y"))  # every epoch makes it worse
    m = perceptron.fit(rare, ["a", "b"], "y", flipped, hidden=(4,), dropout=0.0, epochs=20, steps=2, rate=0.05, patience=2)
    assert len(m.history) < 20 and m.history[-1][1] > min(v for _, v in m.history)
    loss, n, _ = perceptron._sums(flipped.select(F.array("a", "b").alias("x"), F.col("y").cast("double").alias("y")), np.array(m.weights), perceptron.sizes(2, (4,)), 1.0, 0.0, [1], gradient=False)
    assert loss / n == pytest.approx(min(v for _, v in m.history))


def test_saved_perceptron(spark, rare, tmp_path):
    own = training.Preprocessor((), ("a", "b"), handle_missing=False).fit(rare)
    scorer = training.Scorer(training.train(own.apply(rare), own.columns, "y", "mlp", hidden=(4,), epochs=1, steps=2), own, 0.3)
    scorer.save(str(tmp_path / "m"), spark)
    again = training.Scorer.load(str(tmp_path / "m"), spark)
    a, b = (sorted(r["y_pred_proba"] for r in s.score(rare).collect()) for s in (scorer, again))
    assert a == b


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ts timestamp_ntz")


def test_histories_do_not_depend_on_batches(spark, tmp_path):
    draw = random.Random(3)
    rows = [(draw.choice([1, 2, 3, None]), draw.randrange(12), draw.choice(["user", "assistant", None]), draw.choice(["a", 'q"é\n', None]), datetime(2024, 1, 1)) for _ in range(90)]
    frame = turns(spark, rows).drop("ts")
    want = {}
    for c in (1, 2, 3):
        own = sorted(((t, r, x or "") for k, t, r, x, _ in rows if k == c), key=lambda x: (x[0], (x[1] is not None, x[1] or ""), x[2]))
        want[c] = (len(own), [list(x) for x in own[-4:]])
    for n in (1, 5):
        folder = str(tmp_path / f"in{n}")
        frame.repartition(n).write.parquet(folder)
        found = sessions.run_to_table(spark, folder, frame.schema, str(tmp_path / f"out{n}"), last=4)
        assert found.select("batch").distinct().count() == n
        assert {r.conv_id: (r.n_turns, json.loads(r.history)) for r in sessions.latest(found).collect()} == want


def test_idle_sessions_expire(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    batches = [[(1, 0, "user", "a", at(0)), (2, 0, "user", "b", at(0))], [(2, 1, "user", "c", at(50))], [(2, 2, "user", "d", at(150))], [(1, 9, "user", "z", at(160)), (2, 3, "user", "e", at(160))]]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = turns(spark, batches[0]).schema
    got = []
    for rows in batches:
        turns(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        found = sessions.run_to_table(spark, folder, schema, out, idle="60 minutes")
        got = [(r.conv_id, r.n_turns, r.expired) for r in found.orderBy("batch", "conv_id", "expired").collect()]
    assert (1, 1, True) in got and sum(x == (1, 1, False) for x in got) == 2  # ended, and begun anew
    assert got[-1][0] == 2 and not any(c == 2 and n == 4 and e for c, n, e in got) or (2, 4, False) in got
