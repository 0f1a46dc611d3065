"""Operators against hand-made rows, and registered queries against DuckDB."""

from datetime import date, timedelta
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.operators import ml, quality, temporal
from ledgerlark.queries import ORACLE_SQL, QUERIES
from ledgerlark.sources import tables

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = duck.sql(ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    want = [tuple(r) for r in expected.select(", ".join(f'"{c}"' for c in columns)).fetchall()]
    got = [tuple(r) for r in df.select(columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@settings(max_examples=1, deadline=None)
@given(st.integers(0, 27))
def test_expansion_equals_range_join(spark, shift):
    days = [date(2023, 1, 1) + timedelta(days=i + shift) for i in range(0, 400)]
    events = spark.createDataFrame([(d,) for d in days], "day date")
    for n in (30, 90, 120):
        got = {(r.day, r.snapshot_date) for r in temporal.expand_trailing(events, F.col("day"), n).collect()}
        starts = [date(y, mth, 1) for y in range(2022, 2026) for mth in range(1, 13)]
        assert got == {(d, s) for d in days for s in starts if s - timedelta(days=n) < d <= s}


def test_valid_to_is_excluded_and_latest_wins(spark):
    spine = spark.createDataFrame([(1, date(2024, 1, 1)), (1, date(2024, 2, 1))], "k int, snapshot_date date")
    versions = spark.createDataFrame([(1, date(2023, 1, 1), date(2024, 2, 1), "old")], "k int, start date, valid_to date, v string")
    assert [r.snapshot_date for r in temporal.valid_at(spine, versions, "k", "start").collect()] == [date(2024, 1, 1)]
    facts = spark.createDataFrame([(1, 2022, date(2023, 6, 30)), (1, 2023, date(2024, 2, 1))], "k int, year int, available date")
    got = {r.snapshot_date: r.year for r in temporal.latest_at(spine, facts, "k", "available", "year").collect()}
    assert got == {date(2024, 1, 1): 2022, date(2024, 2, 1): 2023}


def test_facts_and_versions_without_order_of_dates(spark):
    """A fact of a larger order that is available earlier, a late one, versions that end as they begin."""
    spine = spark.createDataFrame([(k, date(2024, m, 1)) for k in (1, 2) for m in range(1, 7)], "k int, snapshot_date date")
    facts = spark.createDataFrame([(1, 2021, date(2024, 4, 1)), (1, 2022, date(2024, 2, 15)), (1, 2023, date(2030, 1, 1))], "k int, year int, available date")
    got = {(r.k, r.snapshot_date.month): r.year for r in temporal.latest_at(spine, facts, "k", "available", "year").collect()}
    assert got == {(k, m): 2022 if k == 1 and m > 2 else None for k in (1, 2) for m in range(1, 7)}
    versions = spark.createDataFrame([(1, date(2023, 5, 9), date(2024, 3, 1)), (1, date(2024, 2, 1), None), (1, date(2024, 4, 2), date(2024, 4, 2)), (2, date(2024, 5, 20), None)], "k int, start date, valid_to date")
    got = {(r.k, r.snapshot_date.month): r.n for r in temporal.running_counts(spine, versions, "k", "start", {"n": F.lit(True)}).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (1, 3): 1, (1, 4): 1, (1, 5): 1, (1, 6): 1, (2, 6): 1}


def test_broken_models_break_every_rule(spark):
    rows = {r.rule: r.violations for r in QUERIES["quality_models_broken"](spark, DATA).collect()}
    assert len(rows) == 18 and sum(n > 0 for n in rows.values()) >= 14, rows


def test_curve_over_partitions(spark):
    import random

    draw = random.Random(5)
    pairs = [(int(draw.random() < 0.3), round(draw.random(), 3)) for _ in range(3000)]
    got = {r.score: (r.tp, r.fp, r.tp_before, r.fp_before) for r in ml.curve(spark.createDataFrame(pairs, "y int, p double"), "y", "p").collect()}
    for score in list(got)[::97]:
        assert got[score] == (sum(y for y, p in pairs if p >= score), sum(1 - y for y, p in pairs if p >= score), sum(y for y, p in pairs if p > score), sum(1 - y for y, p in pairs if p > score))


def test_metric_fixture(spark):
    rows = spark.createDataFrame(list(zip([0, 0, 0, 0, 0, 0, 1, 1], [0.05, 0.10, 0.20, 0.55, 0.15, 0.30, 0.90, 0.40], strict=True)), "y int, p double")
    r = ml.confusion(rows, "y", "p").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 5)
    flat = spark.createDataFrame([(0, 0.1)] * 5, "y int, p double")
    r = ml.confusion(flat, "y", "p").first()
    assert (r.tn, r.precision, r.recall, r.f1) == (5, 0.0, 0.0, 0.0)
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, p double")
    assert ml.ranking_metrics(tied, "y", "p").first().auc_roc == 0.5
    parts = spark.createDataFrame([(0.6, 1000), (0.9, 3000)], "auc double, n int")
    assert ml.weighted_folds(parts, "auc", "n").first().auc == pytest.approx(0.825)


def test_rules_find_violations(spark):
    rows = spark.createDataFrame([(1, date(2024, 1, 1), date(2024, 3, 1)), (1, date(2024, 2, 1), None)], "k int, valid_from date, valid_to date")
    assert quality.no_overlap(rows, "k").first().violations == 1
    assert quality.unique(rows, "k").first().violations == 1
    got = {r.rule: r.violations for r in quality.row_rules(rows, quality.not_null("valid_to") | quality.accepted_values("k", [2])).collect()}
    assert got == {"not_null_valid_to": 1, "accepted_values_k": 2}


def test_extract_and_restore(spark, tmp_path):
    rows = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "id long, x double")
    assert tables.extract_table(rows, str(tmp_path), "companies")
    assert not tables.extract_table(rows.limit(0), str(tmp_path), "payments")
    assert tables.read_table(spark, str(tmp_path), "payments", rows.schema).count() == 0
    assert not (tmp_path / "payments.parquet").exists()
    done = tables.restore_tables(spark, str(tmp_path), "restored", {"payments": rows.schema, "companies": rows.schema})
    assert done == ["companies", "payments"] and spark.table("restored.payments").count() == 0
    assert {r.x for r in spark.table("restored.companies").collect()} == {None, 3.0}  # NaN becomes null
    spark.sql("DROP DATABASE restored CASCADE")


def test_entry_points():
    import __spark_entry__ as entry

    assert set(ORACLE_SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
