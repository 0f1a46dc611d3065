"""The rules that the warehouse declares for its tables, over the models of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import surrogate_key
from ..operators.rules import Rule
from ..sources import tables as src
from . import models as m

_KEYS = ("company_id", "snapshot_date")
#: Vocabularies of the test tables.
VALUES = {
    "industry_sector": ("automobile", "building", "furniture", "household", "machinery"), "commodity_type": ("electricity", "gas"), "market_type": ("regulated", "free"),
    "contract_status": ("active", "suspended", "terminated"), "voltage_level": ("low", "medium", "high"), "pressure_level": ("low", "medium", "high"),
    "invoice_status": ("unpaid", "paid", "overdue", "cancelled"), "payment_method": ("bank transfer", "card"), "payment_status": ("pending", "completed", "failed", "refunded"),
    "ticket_category": ("billing", "technical", "onboarding", "commercial"), "satisfaction_score": (1, 2, 3, 4, 5), "device_type": ("desktop", "mobile", "tablet", "api"), "is_insolvent": (0, 1),
}


def _of(table: str, *rules: Rule, not_null: str = "", values: str = "", unique: str = "", at_least_0: str = "", combination: tuple[str, ...] = (), where: str = "", known_in: dict[str, tuple[str, str]] | None = None) -> list[Rule]:
    out = [Rule(table, "combination", combination, where=where)] if combination else []
    out += [Rule(table, "not_null", (c,)) for c in not_null.split()] + [Rule(table, "unique", (c,)) for c in unique.split()]
    out += [Rule(table, "accepted_values", (c,), values=VALUES[c]) for c in values.split()]
    out += [Rule(table, "expression", (c,), expression=f"{c} >= 0") for c in at_least_0.split()]
    out += [Rule(table, "relationship", (c,), other=other, key=key) for c, (other, key) in (known_in or {}).items()]
    return [*out, *rules]


_COMPANY = {"company_id": ("companies", "company_id")}
RULES = [
    *_of("spine", combination=_KEYS, not_null="company_id snapshot_date"),
    *_of("billing", Rule("billing", "accepted_range", ("unpaid_ratio_trailing_90d",), low=0, high=1), combination=_KEYS, not_null="company_id snapshot_date max_dpd_trailing_90d avg_dpd_trailing_90d unpaid_ratio_trailing_90d total_outstanding_debt", at_least_0="max_dpd_trailing_90d avg_dpd_trailing_90d total_outstanding_debt"),
    *_of("resolved", combination=_KEYS, not_null="company_key company_id snapshot_date vat_number legal_name legal_form foundation_date is_active industry_sector company_age_days", at_least_0="company_age_days"),
    *_of("contracts_asof", combination=_KEYS, not_null="company_id snapshot_date active_contracts_count has_active_electricity_contract has_active_gas_contract", at_least_0="active_contracts_count"),
    *_of("label", combination=_KEYS, not_null="company_id snapshot_date max_dpd_trailing_90d is_insolvent", values="is_insolvent"),
    *_of("logins_trailing", *(Rule("logins_trailing", "expression", (c,), expression=f"{c} >= 0 or {c} is null") for c in ("days_since_last_login", "login_velocity")), combination=_KEYS, not_null="company_id snapshot_date"),
    *_of("tickets_trailing", Rule("tickets_trailing", "expression", ("average_satisfaction_score",), expression="average_satisfaction_score is null or average_satisfaction_score between 1.0 and 5.0"), combination=_KEYS, not_null="company_id snapshot_date billing_disputes_count", at_least_0="billing_disputes_count"),
    *_of("financial_asof", combination=_KEYS, not_null="company_id snapshot_date fiscal_year"),
    *_of("dim_date", *(Rule("dim_date", "expression", (c,), expression=f"{c} between {low} and {high}") for c, low, high in (("month", 1, 12), ("quarter", 1, 4), ("day_of_week", 0, 6))), combination=("date",), not_null="date month quarter day_of_week day_name is_weekend", unique="date"),
    *_of("dim_companies", combination=("company_id", "valid_from"), not_null="company_key company_id vat_number legal_form industry_sector valid_from", unique="company_key"),
    *_of(
        "fact", Rule("fact", "expression", ("unpaid_ratio_trailing_90d",), expression="unpaid_ratio_trailing_90d between 0 and 1"), combination=_KEYS, unique="profile_key", values="is_insolvent",
        not_null="profile_key company_id company_key snapshot_date company_age_days is_insolvent active_contracts_count has_active_electricity_contract has_active_gas_contract max_dpd_trailing_90d avg_dpd_trailing_90d unpaid_ratio_trailing_90d total_outstanding_debt billing_disputes_count",
        known_in={"company_key": ("dim_companies", "company_key"), "snapshot_date": ("dim_date", "date")},
    ),
    *_of("companies", combination=("company_id",), where="valid_to is null", not_null="company_id vat_number valid_from legal_name legal_form industry_sector foundation_date is_active", values="industry_sector"),
    *_of("contracts", combination=("contract_id",), where="valid_to is null", not_null="contract_id company_id valid_from commodity_type market_type contract_status activation_date", values="commodity_type market_type contract_status voltage_level pressure_level", known_in=_COMPANY),
    *_of("statements", combination=("company_id", "fiscal_year"), not_null="company_id fiscal_year revenue net_income total_debt cash_and_equivalents share_capital ebitda", known_in=_COMPANY),
    *_of(
        "invoices", Rule("invoices", "relationship", ("contract_id",), other="contracts", key="contract_id", where="commodity_type = commodity_type", label="where"), unique="invoice_id invoice_number", values="commodity_type invoice_status",
        not_null="invoice_id contract_id invoice_number commodity_type invoice_status amount_excluding_tax tax_amount total_amount issue_date due_date payment_term_days", known_in={"contract_id": ("contracts", "contract_id")},
    ),
    *_of("payments", unique="payment_id transaction_reference", not_null="payment_id invoice_id payment_method payment_status amount_paid payment_date", values="payment_method payment_status", known_in={"invoice_id": ("invoices", "invoice_id")}),
    *_of("tickets", unique="ticket_id", not_null="ticket_id company_id ticket_category created_at", values="ticket_category satisfaction_score", known_in=_COMPANY),
    *_of("logins", unique="login_id", not_null="login_id company_id user_id login_timestamp ip_address device_type", values="device_type", known_in=_COMPANY),
]


def tables(spark: SparkSession, d: str, as_of: str = m.AS_OF, source: m.Staged | None = None) -> dict[str, DataFrame]:
    """Every table that RULES name, each built from tables that are dealt by company once."""
    source = source or m.Dealt(spark, d)
    resolved = m.companies_resolved(spark, d, as_of, source)
    return {
        "spine": m.company_date_spine(spark, d, as_of, source), "billing": m.billing_trailing(spark, d, as_of, source=source),
        "resolved": resolved.withColumn("company_key", surrogate_key(F.col("company_id"), F.col("valid_from"))), "contracts_asof": m.contracts_asof(spark, d, as_of, source),
        "label": m.insolvency_label(spark, d, as_of, source, detail=True), "logins_trailing": m.logins_trailing(spark, d, as_of, source), "tickets_trailing": m.tickets_trailing(spark, d, as_of, source),
        "financial_asof": m.financial_asof(spark, d, as_of, source).where("fiscal_year is not null"), "dim_date": m.dim_date(spark, d, as_of, source), "dim_companies": m.dim_companies(spark, d, source),
        "fact": m.fct_company_credit_profile(spark, d, as_of, source), "companies": m.stg_companies(spark, d), "contracts": m.stg_energy_contracts(spark, d), "statements": m.stg_financial_statements(spark, d),
        "invoices": m.stg_invoices(spark, d), "payments": m.stg_payments(spark, d), "tickets": m.stg_tickets(spark, d), "logins": src.user_web_logins(spark, d).withColumn("device_type", F.lower(F.trim("device_type"))),
    }
