"""The warehouse: staging, intermediate models and marts as DataFrame functions.

`as_of` is a date literal and takes the place of the wall clock. mode='compat' follows the
published definitions; 'strict' uses only what was known at the snapshot date.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import cleaned, month_start_from, ratio, surrogate_key
from ..operators.temporal import FAR, capture_changes, carried_months, days_before, expand_trailing, month_turns, monthly_spans, monthly_spine, months_of, spans_of, version_changes
from ..sources import tables as src

AS_OF = "2024-04-01"
BILLING_DAYS = 120
TRAILING_DAYS = 90


def stg_companies(spark: SparkSession, d: str) -> DataFrame:
    return src.companies(spark, d).select(
        "company_id", F.trim("vat_number").alias("vat_number"), F.upper(F.trim("legal_name")).alias("legal_name"), cleaned(F.col("legal_form")).alias("legal_form"),
        cleaned(F.col("industry_sector")).alias("industry_sector"), F.coalesce(cleaned(F.col("registered_office_region")), F.lit("unknown")).alias("registered_office_region"),
        "foundation_date", F.coalesce("is_active", F.lit(True)).alias("is_active"), "valid_from", "valid_to",
    )


def stg_financial_statements(spark: SparkSession, d: str) -> DataFrame:
    f = src.financial_statements(spark, d)
    return f.withColumns({
        "leverage_ratio": ratio(F.col("total_debt"), F.col("share_capital")),
        "cash_to_debt_ratio": ratio(F.col("cash_and_equivalents"), F.col("total_debt")),
        "net_profit_margin": ratio(F.col("net_income"), F.col("revenue")),
        "available_from": F.make_date(F.col("fiscal_year") + 1, F.lit(6), F.lit(30)),
    })


def stg_invoices(spark: SparkSession, d: str) -> DataFrame:
    return src.invoices(spark, d).withColumn("payment_term_days", F.datediff("due_date", "issue_date"))


def stg_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Tickets with the time to resolution in hours and days (null while open)."""
    seconds = (F.unix_micros("resolved_at") - F.unix_micros("created_at")) / 1e6
    tickets = src.crm_support_tickets(spark, d).withColumn("ticket_category", cleaned(F.col("ticket_category")))
    return tickets.withColumns({"resolution_time_hours": (seconds / 3600).cast("decimal(10,2)"), "resolution_time_days": (seconds / 86400).cast("decimal(10,2)")})


def stg_energy_contracts(spark: SparkSession, d: str) -> DataFrame:
    """Contracts with vocabularies in lower case, the meter class in upper case."""
    low = ("commodity_type", "market_type", "contract_status", "voltage_level", "pressure_level")
    c = src.energy_contracts(spark, d).withColumns({n: cleaned(F.col(n)) for n in low})
    return c.withColumns({"gas_meter_class": F.upper(F.trim("gas_meter_class")), "power_committed_kw": F.col("power_committed_kw").cast("decimal(10,2)")})


def stg_payments(spark: SparkSession, d: str) -> DataFrame:
    p = src.payments(spark, d).withColumn("transaction_reference", F.trim("transaction_reference"))
    return p.withColumns({"payment_method": cleaned(F.col("payment_method")), "payment_status": cleaned(F.col("payment_status")), "amount_paid": F.col("amount_paid").cast("decimal(15,2)")})


def stg_user_web_logins(spark: SparkSession, d: str) -> DataFrame:
    logins = src.user_web_logins(spark, d)
    return logins.withColumns({"ip_address": F.substring("ip_address", 1, 45), "device_type": cleaned(F.col("device_type"))})


#: Columns whose change opens a new version, and the key, of the tables with versions.
SNAPSHOTS = {
    "companies": ("company_id", ["legal_name", "legal_form", "industry_sector", "registered_office_region", "is_active"]),
    "energy_contracts": ("contract_id", ["contract_status", "voltage_level", "power_committed_kw", "gas_meter_class", "termination_date"]),
}


def snapshot(name: str, history: DataFrame, current: DataFrame, run_at: str) -> DataFrame:
    """History of a table with versions after a run over its current rows."""
    key, watched = SNAPSHOTS[name]
    return capture_changes(history, current, key, watched, run_at)


class Staged:
    """Staged tables with what the models need of them."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df

    @cached_property
    def companies(self) -> DataFrame:
        return self._dealt(stg_companies(self.spark, self.d))

    @cached_property
    def contracts(self) -> DataFrame:
        return self._dealt(stg_energy_contracts(self.spark, self.d).select("company_id", "contract_id", "activation_date", "valid_to", "contract_status", "commodity_type"))

    @cached_property
    def statements(self) -> DataFrame:
        return self._dealt(financial_facts(self.spark, self.d))

    @cached_property
    def billing(self) -> DataFrame:
        return self._dealt(billing_facts(self.spark, self.d).select("company_id", "due_date", "payment_date", "invoice_status", "total_amount"))

    @cached_property
    def logins(self) -> DataFrame:
        return self._dealt(stg_user_web_logins(self.spark, self.d).select("company_id", F.col("login_timestamp").cast("date").alias("login_date")))

    @cached_property
    def tickets(self) -> DataFrame:
        return self._dealt(stg_tickets(self.spark, self.d).select("company_id", F.col("created_at").cast("date").alias("created_date"), "ticket_category", "resolved_at", "satisfaction_score"))

    def spine(self, as_of: str) -> DataFrame:
        return monthly_spine(self.companies, "company_id", "foundation_date", as_of, "valid_to")

    def spans(self, as_of: str) -> DataFrame:
        """The spine as one row per span of months."""
        return monthly_spans(self.companies, "company_id", "foundation_date", as_of, "valid_to")


class Dealt(Staged):
    """Staged tables, each dealt by company once. Models on them expand, aggregate, cumulate and merge
    within a company's partition, so that their rows (months, windows) never travel."""

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "company_id")


def company_date_spine(spark: SparkSession, d: str, as_of: str = AS_OF, source: Staged | None = None) -> DataFrame:
    return (source or Dealt(spark, d)).spine(as_of)


def resolved_spans(source: Staged, as_of: str = AS_OF) -> DataFrame:
    """Each company version with the months that it holds in, _first to _last (foundation_date <= s < valid_to)."""
    last = F.trunc(F.lit(as_of).cast("date"), "MM")
    until = F.least(last, F.add_months(month_start_from(F.coalesce("valid_to", F.lit(FAR).cast("date"))), -1))
    return source.companies.withColumns({"_first": month_start_from(F.col("foundation_date")), "_last": until}).where("_first <= _last")


def companies_resolved(spark: SparkSession, d: str, as_of: str = AS_OF, source: Staged | None = None) -> DataFrame:
    """Spine rows with each company version that holds, and the company's age. All of a version's
    months are in the spine, so they are generated from it."""
    spans = resolved_spans(source or Dealt(spark, d), as_of)
    rows = spans.select("company_id", F.explode(months_of()).alias("snapshot_date"), *(x for x in spans.columns if x not in ("company_id", "_first", "_last")))
    return rows.withColumn("company_age_days", F.datediff("snapshot_date", "foundation_date"))


def contract_counts() -> dict[str, Column]:
    active = F.col("contract_status") == "active"
    return {"active_contracts_count": active, "_power": active & (F.col("commodity_type") == "electricity"), "_gas": active & (F.col("commodity_type") == "gas")}


def contracts_asof(spark: SparkSession, d: str, as_of: str = AS_OF, source: Staged | None = None) -> DataFrame:
    source = source or Dealt(spark, d)
    counts = {"_any": F.lit(True)} | contract_counts()
    changes = version_changes(source.contracts, "company_id", "activation_date", counts)
    rows = carried_months(source.spans(as_of), "company_id", since={"_change": (changes, {n: F.sum(f"_change.{n}") for n in counts})}).where("_any > 0")
    return rows.select("company_id", "snapshot_date", "active_contracts_count", (F.col("_power") > 0).alias("has_active_electricity_contract"), (F.col("_gas") > 0).alias("has_active_gas_contract"))


def billing_facts(spark: SparkSession, d: str) -> DataFrame:
    """Invoices with company and first completed payment: a second payment can't duplicate one. Payments
    come first: the invoice's key, a text, is dealt once and needn't travel on."""
    paid = stg_payments(spark, d).where("payment_status = 'completed'").groupBy("invoice_id").agg(F.min("payment_date").alias("payment_date"))
    contracts = src.energy_contracts(spark, d).select("contract_id", "company_id")
    return stg_invoices(spark, d).join(paid, "invoice_id", "left").join(contracts, "contract_id")


def billing_windows(spark: SparkSession, d: str, mode: str = "compat", source: Staged | None = None) -> DataFrame:
    """Days past due, unpaid ratio and outstanding debt of the invoices due in the window."""
    rows = expand_trailing((source or Dealt(spark, d)).billing, F.col("due_date"), BILLING_DAYS)
    if mode == "strict":
        rows = rows.withColumn("payment_date", F.when(F.col("payment_date") <= F.col("snapshot_date"), F.col("payment_date")))
        rows = rows.withColumn("invoice_status", F.when(F.col("payment_date").isNotNull(), "paid").otherwise("overdue"))
    rows = rows.withColumn("dpd", F.greatest(F.lit(0), F.datediff(F.coalesce("payment_date", "snapshot_date"), "due_date")))
    unpaid = F.col("invoice_status").isin("unpaid", "overdue")
    return rows.groupBy("company_id", "snapshot_date").agg(
        F.max("dpd").alias("max_dpd_trailing_90d"),
        F.avg(F.col("dpd").cast("decimal(10,0)")).cast("decimal(10,2)").alias("avg_dpd_trailing_90d"),
        (F.count_if(unpaid) / F.count("*")).cast("decimal(5,4)").alias("unpaid_ratio_trailing_90d"),
        F.coalesce(F.sum(F.when(F.col("payment_date").isNull(), F.col("total_amount"))), F.lit(0)).cast("decimal(15,2)").alias("total_outstanding_debt"),
    )


def _with(source: Staged, as_of: str, windows: DataFrame, how: str) -> DataFrame:
    """Spine rows with the columns of monthly windows; how='inner': only those that have one, which are
    the windows whose month lies in a span of the company: spans, a few rows a company, are looked up in
    a partition's hash table, so that windows aren't sorted."""
    spans = source.spans(as_of)
    if how == "inner":
        return windows.join(spans.hint("shuffle_hash"), "company_id").where("snapshot_date between _first and _last").select(windows.columns)
    rows = carried_months(spans, "company_id", {"_w": windows})
    return rows.select("company_id", "snapshot_date", *(F.col(f"_w.{c}").alias(c) for c in windows.columns if c not in ("company_id", "snapshot_date")))


def billing_trailing(spark: SparkSession, d: str, as_of: str = AS_OF, mode: str = "compat", source: Staged | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """columns: those of the windows that are wanted (none named: all); others aren't computed."""
    source = source or Dealt(spark, d)
    windows = billing_windows(spark, d, mode, source)
    return _with(source, as_of, windows.select("company_id", "snapshot_date", *columns) if columns else windows, "inner")


def insolvency_label(spark: SparkSession, d: str, as_of: str = AS_OF, source: Staged | None = None, detail: bool = False) -> DataFrame:
    """The label of every spine row; detail: with the days past due that it rests on, 0 without a bill."""
    source = source or Dealt(spark, d)
    rows = _with(source, as_of, billing_windows(spark, d, source=source), "left")
    dpd = F.coalesce("max_dpd_trailing_90d", F.lit(0))
    return rows.select("company_id", "snapshot_date", *([dpd.alias("max_dpd_trailing_90d")] if detail else []), F.when(dpd >= 90, 1).otherwise(0).alias("is_insolvent"))


def financial_facts(spark: SparkSession, d: str) -> DataFrame:
    return stg_financial_statements(spark, d).select("company_id", "fiscal_year", "available_from", "leverage_ratio", "cash_to_debt_ratio", "net_profit_margin", "ebitda")


def financial_asof(spark: SparkSession, d: str, as_of: str = AS_OF, source: Staged | None = None, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """`shown` is what ratios are given as (null: decimals): computed per statement, not per snapshot."""
    source = source or Dealt(spark, d)
    values = [c for c in source.statements.columns if c not in ("company_id", "fiscal_year")]
    rows = carried_months(source.spans(as_of), "company_id", since=_latest_statement(source, ["fiscal_year", *values], shown))
    return rows.select("company_id", "snapshot_date", *(F.col(f"_best.{c}").alias(c) for c in source.statements.columns if c != "company_id"))


RATIOS = ("leverage_ratio", "cash_to_debt_ratio", "net_profit_margin")


def _latest_statement(source: Staged, columns: list[str], shown: Callable[[Column], Column] | None = None) -> dict[str, tuple[DataFrame, dict[str, Column]]]:
    """The statement of the latest year (first of `columns`) that is available, as the struct _best."""
    facts = source.statements.select("company_id", F.col("available_from").alias("snapshot_date"), *(shown(F.col(c)).alias(c) if shown and c in RATIOS else F.col(c) for c in columns))
    best = F.max(F.when(F.col("_statement").isNotNull(), F.struct(*(F.col(f"_statement.{c}").alias(c) for c in columns))))
    return {"_statement": (facts, {"_best": best})}


def login_windows(spark: SparkSession, d: str, source: Staged | None = None) -> DataFrame:
    """Last login and velocity (logins of 30 days against a third of 90 days')."""
    rows = expand_trailing((source or Dealt(spark, d)).logins, F.col("login_date"), TRAILING_DAYS)
    recent = F.col("login_date") > F.date_sub("snapshot_date", 30)
    found = rows.groupBy("company_id", "snapshot_date").agg(
        F.max("login_date").alias("_last"), (F.count_if(recent) / (F.count("*") / 3.0)).cast("decimal(5,4)").alias("login_velocity")
    )
    return found.select("company_id", "snapshot_date", F.datediff("snapshot_date", "_last").alias("days_since_last_login"), "login_velocity")


def logins_trailing(spark: SparkSession, d: str, as_of: str = AS_OF, source: Staged | None = None) -> DataFrame:
    source = source or Dealt(spark, d)
    return _with(source, as_of, login_windows(spark, d, source), "left")


def ticket_windows(spark: SparkSession, d: str, source: Staged | None = None) -> DataFrame:
    rows = expand_trailing((source or Dealt(spark, d)).tickets, F.col("created_date"), TRAILING_DAYS)
    return rows.groupBy("company_id", "snapshot_date").agg(
        F.count_if(F.col("ticket_category") == "billing").alias("billing_disputes_count"),
        F.avg(F.when(F.col("resolved_at").isNotNull(), F.col("satisfaction_score").cast("decimal(3,0)"))).cast("decimal(3,2)").alias("average_satisfaction_score"),
    )


def logins_daily(spark: SparkSession, d: str, as_of: str = AS_OF, source: Staged | None = None) -> DataFrame:
    """Login features at day grain: every day of a company from its first login on. The logins of
    a day are one event with a count; the days up to the next event see no other events than its window
    has, so they are generated from it, last."""
    end = F.lit(as_of).cast("date")
    logins = (source or Dealt(spark, d)).logins.where(F.col("login_date") <= end).groupBy("company_id", "login_date").agg(F.count("*").alias("_n"))
    along = Window.partitionBy("company_id").orderBy("login_date")
    seen = F.when(F.col("company_id").isNotNull(), days_before("company_id", "login_date", TRAILING_DAYS, F.struct("login_date", "_n")))  # a null key has no logins
    turns = logins.select("company_id", "login_date", seen.alias("_seen"), F.coalesce(F.date_sub(F.lead("login_date").over(along), 1), end).alias("_until"))
    rows = turns.select("company_id", F.explode(F.sequence("login_date", "_until", F.expr("interval 1 day"))).alias("snapshot_date"), "_seen")
    within = lambda days: F.filter("_seen", lambda x: x["login_date"] > F.date_sub("snapshot_date", days))
    total = lambda events: F.aggregate(events, F.lit(0).cast("long"), lambda s, x: s + x["_n"])
    counted = rows.select("company_id", "snapshot_date", F.array_max(F.transform(within(TRAILING_DAYS), lambda x: x["login_date"])).alias("_last"), F.nullif(total(within(TRAILING_DAYS)), F.lit(0)).alias("logins"), total(within(30)).alias("_recent"))
    return counted.select("company_id", "snapshot_date", F.datediff("snapshot_date", "_last").alias("days_since_last_login"), "logins", (F.col("_recent") / (F.col("logins") / 3.0)).cast("decimal(5,4)").alias("login_velocity"))


def billing_daily(spark: SparkSession, d: str, as_of: str = AS_OF, source: Staged | None = None) -> DataFrame:
    """Billing features at day grain, for days on which invoices of the window fall due or are paid:
    the days at which a company's position changes. The bills of a due day are one event with their
    number and longest delay; an amount is opened on its due day and closed when it is paid or leaves
    the window. Days are ordered once within a company; no pair of a day and a bill is made."""
    bills = (source or Dealt(spark, d)).billing.where(F.col("company_id").isNotNull())
    due, paid, gone = F.col("due_date"), F.col("payment_date"), F.date_add("due_date", BILLING_DAYS)
    amount = F.when(paid.isNull() | (paid > due), F.col("total_amount"))  # else: open on no day
    event = lambda day, turn, n, delay, change: F.struct(day.alias("snapshot_date"), F.lit(turn).alias("_turn"), n.alias("_n"), delay.alias("_delay"), change.cast("decimal(16,2)").alias("_change"))
    none = F.lit(None)
    events = F.array(
        event(due, True, F.lit(1), F.coalesce(F.datediff(paid, due), F.lit(BILLING_DAYS)), amount),
        event(paid, True, none.cast("int"), none.cast("int"), F.when(paid < gone, -amount)),
        event(F.when(amount.isNotNull() & (paid.isNull() | (paid >= gone)), gone), False, none.cast("int"), none.cast("int"), -amount),
    )
    days = bills.select("company_id", F.inline(events)).where(F.col("snapshot_date") <= F.lit(as_of).cast("date")).groupBy("company_id", "snapshot_date").agg(
        F.max("_turn").alias("_turn"), F.sum("_n").alias("_n"), F.max("_delay").alias("_delay"), F.sum("_change").alias("_change"))
    along = Window.partitionBy("company_id").orderBy(F.unix_date("snapshot_date"))
    seen = days_before("company_id", "snapshot_date", BILLING_DAYS, F.when(F.col("_n") > 0, F.struct("snapshot_date", "_n", "_delay")))
    rows = days.select("company_id", "snapshot_date", "_turn", seen.alias("_seen"), F.sum("_change").over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("_open"))
    late = F.array_max(F.transform("_seen", lambda x: F.greatest(F.lit(0), F.least(F.datediff("snapshot_date", x["snapshot_date"]), x["_delay"]))))
    rows = rows.where("_turn and size(_seen) > 0")
    return rows.select("company_id", "snapshot_date", late.alias("max_dpd"), F.aggregate("_seen", F.lit(0).cast("long"), lambda s, x: s + x["_n"]).alias("invoices"), F.coalesce("_open", F.lit(0)).cast("decimal(18,2)").alias("open_amount"))


def tickets_trailing(spark: SparkSession, d: str, as_of: str = AS_OF, source: Staged | None = None) -> DataFrame:
    source = source or Dealt(spark, d)
    return _with(source, as_of, ticket_windows(spark, d, source), "inner")


def dim_companies(spark: SparkSession, d: str, source: Staged | None = None) -> DataFrame:
    c = (source or Staged(spark, d)).companies
    return c.select(surrogate_key(F.col("company_id"), F.col("valid_from")).alias("company_key"), *c.columns, F.col("valid_to").isNull().alias("is_current"))


def dim_date(spark: SparkSession, d: str, as_of: str = AS_OF, source: Staged | None = None) -> DataFrame:
    bounds = (source or Staged(spark, d)).companies.agg(F.min("foundation_date").alias("low"))
    days = bounds.select(F.explode(F.sequence(F.col("low"), F.lit(as_of).cast("date"), F.expr("interval 1 day"))).alias("date"))
    dow = F.dayofweek("date") - 1
    return days.select(
        "date", F.month("date").alias("month"), F.quarter("date").alias("quarter"), F.year("date").alias("year"), dow.alias("day_of_week"),
        F.date_format("date", "EEEE").alias("day_name"), dow.isin(0, 6).alias("is_weekend"),
    )


def fct_company_credit_profile(spark: SparkSession, d: str, as_of: str = AS_OF, source: Staged | None = None, company: tuple[str, ...] = (), latest: bool = False, shown: Callable[[Column], Column] | None = None, months: bool = True) -> DataFrame:
    """All features and the label per (company, snapshot). Counts, flags and billing default to 0
    or false; ratios, logins and satisfaction stay null. Windows, contract changes and statements
    are merged by the months at which they change; the months of each version are generated last.
    `company`: attributes of the version that company_key names, which its rows bring along.
    latest: only each company's last snapshot. shown: what ratios are given as, see financial_asof.
    months=False: only the spans of months that the rows have, with company and company_key."""
    source = source or Dealt(spark, d)
    spans = resolved_spans(source, as_of)
    if latest:
        newest = Window.partitionBy("company_id").orderBy(F.desc("_last"), F.desc("valid_from"))
        spans = spans.withColumn("_place", F.row_number().over(newest)).where("_place = 1").withColumn("_first", F.col("_last"))
    spans = spans.select("company_id", "_first", "_last", "foundation_date", surrogate_key(F.col("company_id"), F.col("valid_from")).alias("company_key"), *company)
    windows = {"_billing": billing_windows(spark, d, source=source), "_logins": login_windows(spark, d, source), "_tickets": ticket_windows(spark, d, source)}
    counts = contract_counts()
    changes = version_changes(source.contracts, "company_id", "activation_date", counts)
    statement = _latest_statement(source, ["fiscal_year", "leverage_ratio", "cash_to_debt_ratio", "net_profit_margin", "ebitda"], shown)
    merged = carried_months(spans, "company_id", windows, {"_change": (changes, {n: F.sum(f"_change.{n}") for n in counts})} | statement, months=months)
    if not months:
        return merged.select("company_id", "company_key", "_first", "_last")
    of = lambda part, *names: [F.col(f"{part}.{c}").alias(c) for c in names]
    known = lambda part, *names: [F.coalesce(F.col(f"{part}.{c}"), F.lit(0)).alias(c) for c in names]
    late = F.coalesce(F.col("_billing.max_dpd_trailing_90d"), F.lit(0)) >= 90
    return merged.select(
        "company_id", "snapshot_date", F.datediff("snapshot_date", "foundation_date").alias("company_age_days"), *of("_best", "leverage_ratio", "cash_to_debt_ratio", "net_profit_margin", "ebitda"),
        F.coalesce("active_contracts_count", F.lit(0)).alias("active_contracts_count"), (F.coalesce("_power", F.lit(0)) > 0).alias("has_active_electricity_contract"), (F.coalesce("_gas", F.lit(0)) > 0).alias("has_active_gas_contract"),
        *known("_billing", "max_dpd_trailing_90d", "avg_dpd_trailing_90d", "unpaid_ratio_trailing_90d", "total_outstanding_debt"), *of("_logins", "days_since_last_login", "login_velocity"),
        *known("_tickets", "billing_disputes_count"), *of("_tickets", "average_satisfaction_score"), F.when(late, 1).otherwise(0).alias("is_insolvent"),
        "company_key", profile_key(), *company,
    )


def profile_key() -> Column:
    return surrogate_key(F.col("company_id"), F.col("snapshot_date")).alias("profile_key")


def profile_keys(turns: DataFrame) -> DataFrame:
    """The keys of the fact's rows (each _times) from its monthly_turns(): few rows that many months are made
    of, so they are dealt to a given number of tasks, however small they are."""
    keys = ("company_id", "company_key")
    spans = spans_of(turns.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys), *keys)
    return spans.select("company_id", "company_key", F.explode(months_of()).alias("snapshot_date"), "_times").withColumn("profile_key", profile_key())


def monthly_turns(spark: SparkSession, d: str, as_of: str = AS_OF, source: Staged | None = None) -> dict[str, DataFrame]:
    """The months of each model with a row per company and month, as month_turns(): from the merges
    that the models are made by, before months are generated. The fact's also by company_key."""
    source = source or Dealt(spark, d)
    spans = source.spans(as_of)
    merged = lambda at=None, since=None: carried_months(spans, "company_id", at, since, months=False)
    changes = version_changes(source.contracts, "company_id", "activation_date", {"_any": F.lit(True)})
    months = {
        "spine": spans, "resolved": resolved_spans(source, as_of), "contracts_asof": merged(since={"_change": (changes, {"_any": F.sum("_change._any")})}).where("_any > 0"),
        "label": merged({"_w": billing_windows(spark, d, source=source)}), "logins_trailing": merged({"_w": login_windows(spark, d, source)}),
        "financial_asof": merged(since=_latest_statement(source, ["fiscal_year"])).where("_best.fiscal_year is not null"),
    }
    fact = month_turns(fct_company_credit_profile(spark, d, as_of, source, months=False), "company_id", "company_key")
    return {name: month_turns(df, "company_id") for name, df in months.items()} | {"fact": fact}


def star_features(spark: SparkSession, d: str, as_of: str = AS_OF, source: Staged | None = None, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """The training query: the fact without its two days-past-due columns, attributes of the company's
    version and of the calendar. The version's attributes come with the resolved spine, which is
    what a join of the fact with dim_companies on company_key gives, without dealing the fact by
    that key."""
    fact = fct_company_credit_profile(spark, d, as_of, source, ("legal_name", "industry_sector", "registered_office_region"), shown=shown)
    dates = dim_date(spark, d, as_of, source).select(F.col("date").alias("snapshot_date"), "year", "quarter", "month")
    return fact.drop("max_dpd_trailing_90d", "avg_dpd_trailing_90d", "profile_key", "company_key").join(F.broadcast(dates), "snapshot_date")  # a row per day


def latest_profiles(spark: SparkSession, d: str, as_of: str = AS_OF, source: Staged | None = None, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each company's latest snapshot: its last month is known from its versions, so no other is generated."""
    return fct_company_credit_profile(spark, d, as_of, source, latest=True, shown=shown)
