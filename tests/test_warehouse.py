"""The merge along dates, the warehouse's tables, and extracts."""

import random
import shutil
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import temporal, training
from ledgerlark.plans import models as m
from ledgerlark.plans.warehouse import MARTS, STAGED, Warehouse
from ledgerlark.session import work_folder
from ledgerlark.sources import tables

DATA = "/root/testdata/sf0.001"
D = date(2024, 1, 1)


def days(n):
    return D + timedelta(days=n)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


def test_merge_equals_joins(spark):
    draw = random.Random(2)
    rows = [(draw.choice([1, 1, 1, 2, None]), days(draw.randrange(40)), i) for i in range(120)]
    at = list({(k, d): (k, d, draw.random()) for k, d in ((draw.choice([1, 2, 3, None]), days(draw.randrange(40))) for _ in range(40))}.values())
    since = [(draw.choice([1, 2, 3]), days(draw.randrange(-5, 40)), draw.choice([draw.randrange(9), None])) for _ in range(50)]
    left = spark.createDataFrame(rows, "k int, d date, n int")
    right, changes = spark.createDataFrame(at, "k int, d date, x double"), spark.createDataFrame(since, "k int, d date, v int")
    got = temporal.carried(left, "k", "d", {"w": right}, {"c": (changes, {"total": F.sum("c.v"), "top": F.max("c.v"), "seen": F.count("c._is")})}).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["w"]["x"] if r["w"] else None) == {(k, d): x for k, d, x in at}.get((r["k"], r["d"]))
        before = [v for k, d, v in since if k == r["k"] and d <= r["d"]]
        known = [v for v in before if v is not None]
        assert (r["total"], r["top"], r["seen"]) == (sum(known) if known else None, max(known, default=None), len(before))
    assert temporal.carried(left.limit(0), "k", "d", {"w": right}).count() == 0 and temporal.carried(left, "k", "d").count() == len(rows)


def test_spine_of_versions_has_each_month_once(spark):
    rows = [(1, date(2023, 5, 9), date(2023, 8, 1)), (1, date(2023, 5, 9), None), (2, date(2023, 1, 31), date(2023, 3, 2)), (2, date(2023, 2, 1), date(2023, 2, 20)), (2, date(2023, 9, 1), date(2023, 11, 1)), (3, date(2025, 1, 1), None), (4, date(2023, 5, 1), date(2023, 5, 1))]
    got = temporal.monthly_spine(spark.createDataFrame(rows, "k int, s date, e date"), "k", "s", "2023-12-15", "e").collect()
    months = lambda a, b: [date(2023, x, 1) for x in range(a, b + 1)]
    assert sorted((r.k, r.snapshot_date) for r in got) == [(1, x) for x in months(5, 12)] + [(2, x) for x in months(1, 3) + months(9, 10)]


def test_held_version(spark):
    versions = spark.createDataFrame([(1, days(0), days(10), "a"), (1, days(10), days(20), "b"), (1, days(30), None, "c")], "k int, start date, valid_to date, v string")
    spine = spark.createDataFrame([(1, days(n)) for n in (-1, 0, 9, 10, 20, 29, 30, 99)], "k int, snapshot_date date")
    assert [(r.snapshot_date, r.v) for r in temporal.held_at(spine, versions, "k", "start").orderBy("snapshot_date").collect()] == [(days(0), "a"), (days(9), "a"), (days(10), "b"), (days(30), "c"), (days(99), "c")]


def test_models_read_the_warehouse_without_a_shuffle(spark):
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    folder = work_folder(spark)
    house = Warehouse.build(spark, DATA, "house", folder)
    for model in (m.fct_company_credit_profile, m.latest_profiles, m.insolvency_label, m.financial_asof, m.contracts_asof, m.billing_trailing, m.logins_trailing, m.tickets_trailing, m.companies_resolved):
        stored = model(spark, DATA, source=house)
        assert "Exchange" not in plan(stored), model.__name__
        same(stored, model(spark, DATA))
    star = m.star_features(spark, DATA, source=house)
    assert "Exchange hashpartitioning" not in plan(star) and plan(star).count(".companies[") + plan(star).count("house.spine") <= 2
    same(star, m.star_features(spark, DATA))
    same(house.table("fct_company_credit_profile"), m.fct_company_credit_profile(spark, DATA))
    assert {r.tableName for r in spark.sql("SHOW TABLES IN house").collect()} == {*STAGED, *MARTS, "spine"}
    n = house.table("spine").count()
    again = Warehouse.build(spark, DATA, "house", folder, as_of="2000-01-01", marts=False)
    assert 0 < again.table("spine").count() < n  # replaced, no old row left
    spark.sql("DROP DATABASE house CASCADE")
    shutil.rmtree(folder)


def test_a_failed_extract_leaves_the_earlier_one(spark, tmp_path):
    rows = spark.range(10)
    assert tables.extract_table(rows, str(tmp_path), "companies")
    broken = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") < 900, F.col("id")).otherwise(F.raise_error(F.lit("midway")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="midway"):
        tables.extract_table(broken, str(tmp_path), "companies")
    assert tables.read_table(spark, str(tmp_path), "companies").count() == 10 and [p.name for p in tmp_path.iterdir()] == ["companies.parquet"]
    assert not tables.extract_table(rows.limit(0), str(tmp_path), "companies") and not list(tmp_path.iterdir())


def test_extract_from_a_database(spark, tmp_path):
    """Derby, which comes with Spark, in this process's memory."""
    url = "jdbc:derby:memory:credit;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(1000).select((F.col("id") * 7 + 3).alias("ID"), F.when(F.col("id") % 9 > 0, F.col("id") / 4).alias("AMOUNT"))
    rows.write.jdbc(url, "payments", "overwrite", options)
    rows.limit(0).write.jdbc(url, "invoices", "overwrite", options)
    rows.limit(1).write.jdbc(url, "companies", "overwrite", options)
    read = tables.read_jdbc(spark, url, "payments", "ID", 100, **options)
    sizes = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 101 and sum(sizes) == 1000
    done = tables.extract_database(spark, url, str(tmp_path), {"payments": "ID", "invoices": "ID", "companies": "ID"}, 100, **options)
    assert done == ["companies", "payments"] and not (tmp_path / "invoices.parquet").exists()
    same(tables.read_table(spark, str(tmp_path), "payments"), rows)
    assert len(list((tmp_path / "payments.parquet").glob("part-*"))) == 10
    with pytest.raises(Exception, match="(?i)does not exist"):
        tables.extract_database(spark, url, str(tmp_path), {"companies": "ID", "nothing": "ID"}, 100, **options)
    assert tables.read_table(spark, str(tmp_path), "payments").count() == 1000


def test_models_score_after_an_extract(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 5).cast("int").alias("y"))
    tables.extract_table(rows, str(tmp_path), "companies")
    model = training.train(rows, ["x"], "y")
    assert training.ml.score(model, rows).where("(y_pred_proba >= 0.5) = (y = 1)").count() > 150
