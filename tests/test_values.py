"""Scalar functions, row rules, and files that operators write and read."""

import json
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions.keys import as_utc, half_up, sigmoid
from ledgerlark.operators import retrieval, validation
from ledgerlark.sources import tables


def test_moments_in_utc(spark):
    rows = spark.createDataFrame([("2024-07-01 10:00:00.25",), ("2024-07-01T10:00:00+02:00",), ("2024-07-01T10:00:00Z",), ("2024-07-01T10:00:00-0330",), (None,), ("1969-12-31 23:59:59.999999",)], "t string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [r[0] for r in rows.select(F.unix_micros(as_utc(F.col("t")))).collect()]
            at = lambda *x: int(datetime(*x, tzinfo=timezone.utc).timestamp() * 1e6)
            assert got == [at(2024, 7, 1, 10, 0, 0, 250000), at(2024, 7, 1, 8), at(2024, 7, 1, 10), at(2024, 7, 1, 13, 30), None, -1]
            rome = rows.limit(2).select(F.unix_micros(as_utc(F.col("t"), "Europe/Rome"))).collect()
            assert [r[0] for r in rome] == [at(2024, 7, 1, 8, 0, 0, 250000), at(2024, 7, 1, 8)]
            naive = spark.createDataFrame([(datetime(2024, 1, 1, 12),)], "t timestamp_ntz").select(F.unix_micros(as_utc(F.col("t"), "Asia/Tokyo"))).first()[0]
            assert naive == at(2024, 1, 1, 3)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_rounding_and_sigmoid(spark):
    row = spark.range(1).select(half_up(F.lit("2.125").cast("decimal(10,3)")), half_up(F.lit("-2.125").cast("decimal(10,3)")), sigmoid(F.lit(0.0)), sigmoid(F.lit(-800.0)), sigmoid(F.lit(800.0))).first()
    assert [str(x) for x in row[:2]] == ["2.13", "-2.13"] and list(row[2:]) == [0.5, 0.0, 1.0]


def broken(df, rules):
    return [r["violations"] for r in validation.violations(df, rules).collect()]


def test_rows_of_payments_logins_and_others(spark):
    payments = spark.createDataFrame([(1.0, date(2024, 1, 1), "T1"), (0.0, date(2025, 1, 1), " "), (None, None, None)], "amount_paid double, payment_date date, transaction_reference string")
    assert broken(payments, validation.payment_rules("2024-06-01")) == [[], ["amount_not_positive", "paid_in_the_future", "missing_reference"], ["missing_reference"]]
    logins = [("10.0.255.1", "mobile"), ("256.0.0.1", "fridge"), ("2001:db8::1", "api"), ("1.2.3", None)]
    frame = spark.createDataFrame([(datetime(2024, 1, 1), *x) for x in logins], "login_timestamp timestamp_ntz, ip_address string, device_type string")
    assert broken(frame, validation.login_rules("2024-01-01")) == [[], ["address_format", "unknown_device"], [], ["address_format"]]
    bills = spark.createDataFrame([(date(2024, 2, 1), date(2024, 1, 1), 10.0, 2.0, 13.0), (date(2024, 1, 1), date(2024, 2, 1), -1.0, 1.0, 0.0)], "issue_date date, due_date date, amount_ex_tax double, tax_amount double, total_amount double")
    assert broken(bills, validation.invoice_rules()) == [["due_before_issue", "total_not_sum"], ["negative_amount"]]
    company = spark.createDataFrame([("12345678901", "tech", date(2020, 1, 1)), ("1234", "mining", date(2030, 1, 1))], "vat_number string, industry_sector string, foundation_date date")
    assert broken(company, validation.company_rules("2024-01-01")) == [[], ["vat_number_format", "unknown_industry_sector", "future_foundation_date"]]
    tickets = spark.createDataFrame([(datetime(2024, 1, 2), datetime(2024, 1, 1), 6), (datetime(2024, 1, 1), None, 3)], "created_at timestamp_ntz, resolved_at timestamp_ntz, satisfaction_score int")
    assert broken(tickets, validation.ticket_rules()) == [["resolved_before_created", "score_out_of_range"], ["score_without_resolution"]]
    statements = spark.createDataFrame([(1999, -1.0, 0.0, 0.0, -2.0)], "fiscal_year int, total_revenue double, total_debt double, liquidity_cash double, share_capital double")
    assert broken(statements, validation.statement_rules()) == [["year_before_2000", "negative_total_revenue", "negative_share_capital"]]


def test_predictions_and_documents(spark, tmp_path):
    scored = spark.createDataFrame([(1, 0.25, "x"), (0, 1e-9, "y"), (1, 0.1 + 0.2, "z")], "y_true int, y_pred_proba double, more string")
    tables.write_predictions(scored, str(tmp_path / "p"))
    assert sorted(map(tuple, tables.read_predictions(spark, str(tmp_path / "p")).collect())) == sorted((r[0], r[1]) for r in scored.collect())
    documents = [{"source": "readme", "kind": "section", "name": "A", "file": "f", "text": "## One\nfirst\n## Two\nsecond"}, {"source": "code", "kind": "function", "name": "B", "text": None}]
    (tmp_path / "docs.json").write_text(json.dumps(documents, indent=1))
    read = tables.read_json_documents(spark, str(tmp_path / "docs.json"))
    assert read.count() == 2 and [r.name for r in retrieval.chunk_markdown(read.drop("name"), "source", "text").orderBy("index").collect()] == ["One", "Two"]


def test_paths(tmp_path):
    assert tables.table_path("/data/raw/", "companies") == "/data/raw/companies.parquet" == tables.table_path("/data/raw", "companies.parquet")
    with pytest.raises(ValueError, match="name"):
        tables.table_path("/data", "../x")
