"""What lets the queries grow no faster than their input: merges by months, runs in arrays, grouped
training rows, rules counted by typed keys, and a bounded search."""

import random
from collections import Counter
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlark import quality_queries, queries
from ledgerlark.operators import leakage, quality, rules, temporal, training
from ledgerlark.operators.rules import Rule
from ledgerlark.operators.vector_index import _Best
from ledgerlark.plans import models, warehouse

MONTHS = [date(2020 + n // 12, n % 12 + 1, 1) for n in range(30)]


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


def test_merge_by_months_equals_merge_along_the_spine(spark):
    draw = random.Random(3)
    spans = spark.createDataFrame([(1, MONTHS[2], MONTHS[9], "a"), (1, MONTHS[6], MONTHS[20], "b"), (2, MONTHS[0], MONTHS[0], "c"), (3, MONTHS[5], MONTHS[29], "d")], "k int, _first date, _last date, v string")
    at = spark.createDataFrame([(k, m, draw.random()) for k in (1, 2, 3, 4) for m in MONTHS if draw.random() < 0.3], "k int, snapshot_date date, x double")
    since = spark.createDataFrame([(draw.choice([1, 2, 4]), draw.choice(MONTHS).replace(day=draw.choice([1, 1, 30 - 3])), draw.randrange(9)) for _ in range(40)], "k int, snapshot_date date, n int")
    changes = {"c": (since, {"total": F.sum("c.n"), "top": F.max("c.n")})}
    spine = spans.select("k", F.explode(temporal.months_of()).alias("snapshot_date"), "v")
    along = temporal.carried(spine, "k", "snapshot_date", {"w": at}, changes).withColumn("w", F.col("w.x"))
    merged = temporal.carried_months(spans, "k", {"w": at}, changes)
    same(merged.withColumn("w", F.col("w.x")), along)
    same(temporal.carried_months(spans, "k", {"w": at}, only="w").select("k", "snapshot_date", F.col("w.x").alias("w")), along.where("w is not null").select("k", "snapshot_date", "w"))
    tree = merged._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("explode(sequence") < tree.index("Window")  # months are generated above the merge


def test_runs_of_arrays(spark):
    draw = random.Random(8)
    arrays = [(k, [m for m in MONTHS[low:high] if draw.random() < 0.7]) for k in (1, 2) for low, high in ((0, 10), (10, 11), (15, 30))] + [(3, []), (4, MONTHS[:1])]
    frame = spark.createDataFrame(arrays, "k int, months array<date>")
    rows = frame.select("k", F.explode("months").alias("d"))
    for grain in ("month", "day"):
        same(quality.islands_of(frame, "k", "months", grain), quality.islands(rows, "k", "d", grain))
        same(quality.gaps_of(frame, "k", "months", grain), quality.gaps(rows, "k", "d", grain))


def test_rules_of_spans_equal_rules_of_rows(spark):
    spans = spark.createDataFrame([(1, MONTHS[0], MONTHS[9]), (1, MONTHS[10], MONTHS[14]), (2, MONTHS[3], MONTHS[5]), (2, MONTHS[8], MONTHS[8]), (3, MONTHS[29], MONTHS[29]), (None, MONTHS[1], MONTHS[2]), (4, MONTHS[0], MONTHS[1])], "k int, _first date, _last date")
    held = spark.createDataFrame([(1, MONTHS[2], MONTHS[6]), (1, MONTHS[5], MONTHS[12]), (2, MONTHS[0], MONTHS[29]), (None, MONTHS[1], MONTHS[2]), (4, MONTHS[5], MONTHS[6])], "k int, _first date, _last date")
    rows = lambda df: df.select("k", F.explode(temporal.months_of()).alias("d"))
    same(quality.no_month_gaps_of(spans, "k", "d"), quality.no_month_gaps(rows(spans), "k", "d"))
    same(quality.dropped_months(spans, held, "k"), quality.dropped_rows(rows(spans), rows(held), "k", "d"))
    assert [quality.dropped_months(spans, held, "k").first()[1], quality.dropped_months(spans.limit(0), held, "k").first()[1]] == [4 + 1 + 2 + 2, 0]


def test_spine_rules_neither_sort_nor_deal_months(spark):
    plan = queries.quality_spine(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for at, line in enumerate(plan):
        if "Generate explode(sequence(_first" in line or "array_except" in line or "array_distinct" in line:
            above = [x for n, x in enumerate(plan[:at]) if depth(x) < depth(line) and all(depth(y) > depth(x) for y in plan[n + 1 : at + 1])]
            assert not any("Sort " in x or "hashpartitioning" in x for x in above), line
    assert sum("array_except" in x or "array_distinct" in x for x in plan) >= 2


class Few(models.Staged):
    """Staged tables of a few rows, dealt by company."""

    def __init__(self, spark, bills=None, logins=None):
        super().__init__(spark, "")
        for name, rows in (("billing", bills), ("logins", logins)):
            if rows is not None:
                self.__dict__[name] = rows.repartition(4, "company_id")


def test_daily_bills_equal_pairs_and_are_dealt_once(spark):
    draw = random.Random(5)
    due = lambda: draw.choice([None, *(date(2023, 6, 1) + timedelta(days=draw.choice([0, 1, 119, 120, 121, draw.randrange(400)])) for _ in range(9))])
    bills = []
    for _ in range(600):
        at = due()
        paid = draw.choice([None, None, (at or date(2023, 9, 9)) + timedelta(days=draw.choice([-9, 0, 1, 30, 119, 120, 121, 200]))])
        bills.append((draw.choice([1, 1, 2, 3, None]), at, paid, "unpaid", draw.choice([None, Decimal("10.25"), Decimal("-3.10"), Decimal("9999999999999.99")])))
    frame = spark.createDataFrame(bills, "company_id int, due_date date, payment_date date, invoice_status string, total_amount decimal(15,2)")
    got = models.billing_daily(spark, "", as_of="2024-03-01", source=Few(spark, bills=frame))
    plan = got._jdf.queryExecution().executedPlan().toString()
    end, want = date(2024, 3, 1), {}
    for k, day in {(k, x) for k, a, b, _, _ in bills for x in (a, b) if k and x and x <= end}:
        inside = [(a, b, v) for c, a, b, _, v in bills if c == k and a and day - timedelta(days=120) < a <= day]
        if inside:
            late = max(max(0, (min(b or day, day) - a).days) for a, b, _ in inside)
            want[k, day] = (late, len(inside), sum((v or 0 for a, b, v in inside if b is None or b > day), Decimal("0.00")))
    assert {(r.company_id, r.snapshot_date): tuple(r)[2:] for r in got.collect()} == want and got.count() == len(want) > 100
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_daily_logins_equal_pairs_and_are_dealt_once(spark):
    draw = random.Random(7)
    events = [(draw.choice([1, 1, 1, 2, 3, None]), draw.choice([None, date(2023, 1, 1) + timedelta(days=draw.choice([0, 29, 30, 89, 90, draw.randrange(500)]))])) for _ in range(90)] + [(4, date(2024, 5, 5)), (5, None)]
    got = models.logins_daily(spark, "", as_of="2024-03-01", source=Few(spark, logins=spark.createDataFrame(events, "company_id int, login_date date")))
    plan = got._jdf.queryExecution().executedPlan().toString()
    end, want = date(2024, 3, 1), {}
    for k in {k for k, _ in events}:
        days = [x for c, x in events if c == k and x and x <= end]
        for n in range((end - min(days)).days + 1 if days else 0):
            day = min(days) + timedelta(days=n)
            seen = [x for x in days if k and day - timedelta(days=90) < x <= day]
            recent = sum(x > day - timedelta(days=30) for x in seen)
            want[k, day] = ((day - max(seen)).days, len(seen), round(recent / (len(seen) / 3), 4)) if seen else (None, None, None)
    assert {(r.company_id, r.snapshot_date): (*tuple(r)[2:4], None if r[4] is None else float(r[4])) for r in got.collect()} == want and got.count() == len(want) > 1000
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_invoice_keys_are_dealt_once(spark):
    lines = models.billing_facts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [x for x in lines if "Join" in x]
    assert "contract_id" in joins[0] and "invoice_id" in joins[1]


def test_scaling_makes_the_windows_once_and_sorts_none(spark):
    data = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    debts = queries.billing_trailing(spark, data).select("company_id", "snapshot_date", "debt")
    assert "Sort [company_id" not in plan(debts).split("ShuffledHashJoin")[1].split("Window")[0] and plan(debts).count("Window [") == 1
    got = queries.ml_scaled(spark, data)
    assert "lineitem" not in plan(got) and "Scan parquet" in plan(got) and got.count() == debts.count()
    mean, deviation = debts.agg(F.avg("debt"), F.stddev_pop("debt")).first()
    both = got.join(debts.withColumnRenamed("debt", "plain"), ["company_id", "snapshot_date"])
    assert both.where(F.abs(F.col("debt") - (F.col("plain") - mean) / deviation) < 1e-4).count() == debts.count()
    few = models.billing_trailing(spark, data, columns=("total_outstanding_debt",))
    assert few.columns == ["company_id", "snapshot_date", "total_outstanding_debt"] and "max(dpd" not in plan(few)


def test_boosting_on_grouped_rows(spark, monkeypatch):
    rows = spark.range(4000).select((F.col("id") % 997 / 10).alias("x"), (F.col("id") % 3).cast("double").alias("z"), F.lit(1.5).alias("flat")).withColumn("y", ((F.col("x") > 60) & (F.col("z") > 0)).cast("int"))
    few = training.grouped(rows.withColumn("w", F.lit(2.0)), ["x", "z", "flat"], ["y"], "w").collect()
    assert len(few) <= training.BINS * 3 * 2 and sum(r["w"] for r in few) == 8000 and {r["flat"] for r in few} == {1.5} and {r["z"] for r in few} == {0.0, 1.0, 2.0}
    monkeypatch.setattr(training, "GROUP_FROM", 1)
    model = training.train(rows, ["x", "z", "flat"], "y", "gbt", trees=3, depth=3, rate=0.3)
    assert training.ml.score(model, rows).where("(y_pred_proba >= 0.5) = (y = 1)").count() > 3800


def test_rules_of_one_key_make_no_text_and_no_shuffle_of_rows(spark):
    draw = random.Random(6)
    data = [(draw.choice([1, 2, 3, None]), draw.choice([*MONTHS[:5], None]), draw.choice([-1, 1, None])) for _ in range(60)]
    table = spark.createDataFrame(data, "k int, d date, n int").repartition(4, "k")
    declared = [Rule("t", "combination", ("k", "d")), Rule("t", "not_null", ("k",)), Rule("t", "expression", ("n",), expression="n >= 0"), Rule("t", "not_null", ("n",), where="k = 1")]
    found = rules.check({"t": table}, declared)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [r.violations for r in sorted(found.collect(), key=lambda r: [x.name for x in declared].index(r.rule))] == [sum(n > 1 for n in Counter(r[:2] for r in data).values()), sum(r[0] is None for r in data), sum(r[2] == -1 for r in data), sum(r[2] is None and r[0] == 1 for r in data)]
    assert "to_json" not in plan and plan.count("Exchange hashpartitioning(k") == 1


def test_model_rules_write_no_fact(spark, monkeypatch):
    written = []
    monkeypatch.setattr(warehouse.Warehouse, "_write", lambda self, df, name, *rest, **more: written.append(name))
    monkeypatch.setattr(warehouse.Warehouse, "table", lambda self, name: (_ for _ in ()).throw(LookupError(name)))
    try:
        quality_queries.model_rules(spark, "/root/testdata/sf0.001", broken=False)
    except LookupError:
        pass
    assert "fct_company_credit_profile" not in written


def test_best_rows_of_blocks():
    draw = np.random.default_rng(4)
    distance, ids = draw.integers(0, 6, (50, 300)) / 10, [f"i{n}" for n in draw.permutation(300)]
    best = _Best(50, 6)
    for at in range(0, 300, 70):
        for low in range(0, 50, 20):
            best.meet(low, distance[low : low + 20, at : at + 70], ids[at : at + 70])
    place, names, far = best.rows(0, 50)
    want = [(q, i, d) for q in range(50) for d, i in sorted(zip(distance[q].tolist(), ids, strict=True))[:6]]
    assert list(zip(place.tolist(), names, far.tolist(), strict=True)) == want
    few = _Best(2, 6)
    few.meet(0, distance[:2, :4], ids[:4])
    assert len(few.rows(0, 2)[1]) == 8


def test_rules_between_models_meet_by_company(spark):
    draw = random.Random(9)
    keys = [(k, m) for k in (1, 2, 3) for m in MONTHS]
    dealt = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(4, "company_id")
    counted, known = [x for x in keys if draw.random() < 0.6] + [(1, MONTHS[0]), (1, MONTHS[0]), (None, MONTHS[1])], [x for x in keys if draw.random() < 0.6] + [(None, MONTHS[1])]
    chosen = [(*x, draw.randrange(2019, 2023)) for x in keys if draw.random() < 0.8]
    latest = {x: draw.choice([2020, 2021, None]) for x in keys if draw.random() < 0.8}
    dim = [(k, f"key{k}", MONTHS[k], draw.choice([None, MONTHS[9]])) for k in (1, 2, 2, 3)]
    fact = [(k, m, draw.choice(["key1", "key2", None])) for k, m in keys]
    year = "company_id int, snapshot_date date, fiscal_year int"
    found = [
        leakage.without_source("alone", dealt(counted, "company_id int, snapshot_date date"), dealt(known, "company_id int, snapshot_date date")),
        leakage.financial_rules(dealt(chosen, year), dealt([(*x, y) for x, y in latest.items()], year)),
        leakage.key_out_of_time(dealt(fact, "company_id int, snapshot_date date, company_key string"), dealt(dim, "company_id int, company_key string, foundation_date date, valid_to date")),
    ]
    for df in found:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "Broadcast" not in plan and "SortMerge" not in plan
    got = {r.rule: r.violations for df in found for r in df.collect()}
    assert got == {
        "alone": sum(x not in known or x[0] is None for x in counted), "used_before_publication": sum(m < date(y + 1, 6, 30) for _, m, y in chosen), "newer_year_available": sum((latest.get((k, m)) or 0) > y for k, m, y in chosen),
        "key_out_of_time": sum(c == x[1] and k == x[0] and (m < x[2] or (x[3] is not None and m >= x[3])) for k, m, c in fact for x in dim),
    }


def test_months_by_turns(spark):
    draw = random.Random(12)
    spans = [(k, *sorted((draw.choice(MONTHS), draw.choice(MONTHS)))) for k in (1, 2, 3, None) for _ in range(3)] + [(4, MONTHS[0], MONTHS[3]), (4, MONTHS[4], MONTHS[9])]
    frame = spark.createDataFrame(spans, "k int, _first date, _last date")
    turns = temporal.month_turns(frame, "k")
    rows = frame.select("k", F.explode(temporal.months_of()).alias("d"))
    held = Counter(map(tuple, rows.collect()))
    back = temporal.spans_of(turns, "k").select("k", F.explode(temporal.months_of()).alias("d"), "_times")
    assert {(r.k, r.d): r._times for r in back.collect()} == held and turns.where("k = 4").count() == 2
    undated = spark.createDataFrame([(1, None, 3), (2, None, 1), (None, None, 2)], "k int, snapshot_date date, _change long")
    by_month = lambda df: df.withColumnRenamed("snapshot_date", "d")
    found = rules.check({"t": rows}, [Rule("t", "combination", ("k", "d")), Rule("t", "not_null", ("k",))], turns={"t": by_month(turns.unionByName(undated))})
    assert {r.rule: r.violations for r in found.collect()} == {"t.combination.k+d": sum(n > 1 for n in held.values()) + 2, "t.not_null.k": sum(n for (k, _), n in held.items() if k is None)}


def test_keys_of_months_are_neither_text_nor_dealt_with_their_rows(spark):
    draw = random.Random(13)
    key = lambda n: f"{n:032x}"
    values = [draw.choice([key(draw.randrange(9)), key(draw.randrange(9)).upper(), "zz", "zz ", "", None, "abc"]) for _ in range(60)]
    keys = spark.createDataFrame([(v, n % 3) for n, v in enumerate(values)], "v string, _times int")
    other = spark.createDataFrame([("zz",), ("zz",), (None,), (key(3),)], "o string")
    declared = [Rule("t", "unique", ("v",)), Rule("t", "relationship", ("v",), other="u", key="o"), Rule("t", "not_null", ("w",)), Rule("u", "unique", ("o",))]
    found = rules.check({"t": spark.createDataFrame([(1, 1), (1, None)], "v int, w int"), "u": other}, declared, turns={"t": spark.createDataFrame([], "v int, w date, _change int")}, keys={"t": keys})
    held = Counter()
    for n, v in enumerate(values):
        held[v] += n % 3
    assert {r.rule: r.violations for r in found.collect()} == {"t.unique.v": sum(n > 1 for v, n in held.items() if v is not None), "t.relationship.v": sum(n for v, n in held.items() if v not in ("zz", key(3), None)), "t.not_null.w": 1, "u.unique.o": 1}


def test_declared_rules_sum_up_monthly_rows(spark, monkeypatch):
    seen, check = {}, rules.check
    monkeypatch.setattr(rules, "check", lambda tables, declared, *more: seen.update(plain=tables, more=more, found=check(tables, declared, *more)))
    quality_queries.declared_rules(spark, "/root/testdata/sf0.001", broken=True)
    assert "unhex(" in seen["found"]._jdf.queryExecution().executedPlan().toString()
    for name, turns in seen["more"][0].items():
        rows = seen["plain"][name].groupBy("company_id", "snapshot_date").agg(F.count("*").alias("n"))
        dated = temporal.spans_of(turns.groupBy("company_id", "snapshot_date").agg(F.sum("_change").alias("_change")).where("snapshot_date is not null"), "company_id")
        months = dated.select("company_id", F.explode(temporal.months_of()).alias("snapshot_date"), F.col("_times").alias("n"))
        lost = turns.where("snapshot_date is null").groupBy("company_id", "snapshot_date").agg(F.sum("_change").alias("n"))
        both = rows.select(F.struct("*").alias("r"), F.lit(1).alias("s")).unionByName(months.unionByName(lost).select(F.struct("company_id", "snapshot_date", F.col("n").cast("long").alias("n")).alias("r"), F.lit(-1).alias("s")))
        assert both.groupBy("r").agg(F.sum("s").alias("s")).where("s <> 0").count() == 0, name
    assert len(seen["more"][0]) == 7


def test_linear_scores_and_contributions_are_columns(spark):
    draw = random.Random(15)
    rows = spark.createDataFrame([(float(draw.randrange(9)), float(draw.randrange(3)), draw.randrange(2)) for _ in range(200)], "x double, z double, y int")
    model = training.train(rows, ["x", "z"], "y")
    scored = training.ml.score(model, rows)
    assert not any(w in scored._jdf.queryExecution().optimizedPlan().toString() for w in ("UDF", "probability"))
    both = model.transform(scored).withColumn("own", vector_to_array("probability")[1])
    assert both.count() == 200 and both.where(F.abs(F.col("own") - F.col("y_pred_proba")) > 1e-12).count() == 0
    with pytest.raises(Exception, match="feature is null"):
        training.ml.score(model, rows.withColumn("z", F.when(F.col("x") < 4, F.col("z")))).collect()
    weights, means = model.stages[-1].coefficients.toArray().tolist(), rows.agg(F.avg("x"), F.avg("z")).first()
    found = training.ml.linear_contributions(model, rows.withColumn("x2", F.col("x")), ["x", "z"])
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString() and found.columns == ["x", "z", "y", "x2", "contributions"]
    for r in found.collect():
        parts = [("x", weights[0] * (r.x - means[0])), ("z", weights[1] * (r.z - means[1]))]
        want = sorted(parts, key=lambda p: -abs(p[1]))
        assert [c.feature for c in r.contributions] == [c for c, _ in want] and all(abs(c.value - v) < 1e-12 for c, (_, v) in zip(r.contributions, want, strict=True))


def test_stored_training_rows_are_not_written_again(spark, monkeypatch):
    count, written = [], training.written
    monkeypatch.setattr(training, "written", lambda df: (count.append(df.columns), written(df))[1])
    rows = spark.range(300).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 5).cast("int").alias("y"))
    for stored in (True, False):
        scorer, metrics = training.final_fit(rows, rows, "y", training.Preprocessor((), ("x",), handle_missing=False), 0.5, stored=stored)
        assert metrics.first()["recall"] > 0.9 and len(count) == (0 if stored else 1)


def test_profile_from_the_warehouse_writes_no_spine(spark, monkeypatch):
    written, write = [], warehouse.Warehouse._write
    monkeypatch.setattr(warehouse.Warehouse, "_write", lambda self, df, name, *rest, **more: (written.append(name), write(self, df, name, *rest, **more)))
    got = queries.warehouse_profile(spark, "/root/testdata/sf0.001")
    assert sorted(written) == sorted(warehouse.STAGED) and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
