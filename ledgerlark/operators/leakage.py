"""Rules that hold models against their inputs: leakage from the future, expired versions, keys out
of time, labels against their rule. Each gives (rule, violations); see quality.py for rules of one
table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import named, row_rules

KEYS = ["company_id", "snapshot_date"]


def billing_rules(max_dpd: str, avg_dpd: str, ratio: str, debt: str) -> dict[str, Column]:
    return {
        "avg_above_max": F.col(avg_dpd) > F.col(max_dpd), "zero_max_nonzero_avg": (F.col(max_dpd) == 0) & (F.col(avg_dpd) != 0),
        "debt_without_ratio": (F.col(debt) > 0) & (F.col(ratio) == 0),
    }


def resolved_rules(foundation: str = "foundation_date", age: str = "company_age_days", valid_to: str = "valid_to") -> dict[str, Column]:
    s = F.col("snapshot_date")
    return {"before_foundation": s < F.col(foundation), "negative_age": F.col(age) < 0, "expired_version": F.col(valid_to) <= s}


def after_last_version(spine: DataFrame, versions: DataFrame, key: str = "company_id", valid_to: str = "valid_to") -> DataFrame:
    """Spine rows at or after the latest end of the key's closed versions."""
    last = versions.groupBy(F.col(key).alias("_key")).agg(F.max(valid_to).alias("_last"))
    return named("spine_after_valid_to", spine.join(last.hint("shuffle_hash"), F.col(key) == F.col("_key")).where(F.col("snapshot_date") >= F.col("_last")))


def without_source(rule: str, rows: DataFrame, source: DataFrame) -> DataFrame:
    """Rows whose (company, snapshot) no source row supports, counted as in matched()."""
    each = lambda df, n, m: df.select(*KEYS, F.lit(n).alias("_rows"), F.lit(m).alias("_there"))
    keys = each(rows, 1, 0).unionByName(each(source, 0, 1)).groupBy(*KEYS).agg(F.sum("_rows").alias("_rows"), F.max("_there").alias("_there"))
    alone = (F.col("_there") == 0) | F.col(KEYS[0]).isNull() | F.col(KEYS[1]).isNull()
    return keys.agg(F.coalesce(F.sum(F.when(alone, F.col("_rows"))), F.lit(0)).cast("long").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def matched(rows: DataFrame, own: str, other: DataFrame, value: str) -> DataFrame:
    """(company, snapshot, own, value): rows with `value` of the other table's row of the same company and
    snapshot, null where it has none; both have one row a key at most. They are put one under another and
    grouped, so that tables dealt by company meet where they are: a join would deal both again by the
    whole key, or take a spine's table for a small one and gather it in the driver."""
    kinds = {own: rows.schema[own].dataType, value: other.schema[value].dataType}
    one = rows.select(*KEYS, own, F.lit(None).cast(kinds[value]).alias(value), F.lit(True).alias("_is"))
    two = other.where(F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull()).select(*KEYS, F.lit(None).cast(kinds[own]).alias(own), value, F.lit(False).alias("_is"))
    return one.unionByName(two).groupBy(*KEYS).agg(*(F.max(c).alias(c) for c in (own, value, "_is"))).where("_is").drop("_is")


def financial_rules(chosen: DataFrame, latest: DataFrame) -> DataFrame:
    """Statements used before their publication, and older ones than the latest one available."""
    rows = matched(chosen, "fiscal_year", latest.select(*KEYS, F.col("fiscal_year").alias("_latest")), "_latest")
    published = F.make_date(F.col("fiscal_year") + 1, F.lit(6), F.lit(30))
    return row_rules(rows, {"used_before_publication": F.col("snapshot_date") < published, "newer_year_available": F.col("_latest") > F.col("fiscal_year")})


def label_rules(max_dpd: str = "max_dpd", label: str = "is_insolvent", days: int = 90) -> dict[str, Column]:
    late = F.coalesce(F.col(max_dpd), F.lit(0)) >= days
    return {"label_false_negative": late & (F.col(label) == 0), "label_false_positive": ~late & (F.col(label) == 1)}


def several_current(versions: DataFrame, key: str = "company_id", valid_to: str = "valid_to") -> DataFrame:
    return named("several_current_versions", versions.where(F.col(valid_to).isNull()).groupBy(key).count().where("count > 1"))


def key_out_of_time(fact: DataFrame, dim: DataFrame, key: str = "company_key", by: str = "company_id") -> DataFrame:
    """Fact rows whose dimension version doesn't hold at their snapshot. The key names a version of one
    company, so the fact meets the versions by company, looked up by hash; the key is compared where rows
    are counted, and isn't dealt."""
    versions = dim.select(F.col(by).alias("_by"), F.col(key).alias("_k"), F.col("foundation_date").alias("_f"), F.col("valid_to").alias("_t"))
    s = F.col("snapshot_date")
    pairs = fact.join(versions.hint("shuffle_hash"), F.col(by) == F.col("_by"))
    return row_rules(pairs, {"key_out_of_time": (F.col(key) == F.col("_k")) & ((s < F.col("_f")) | (s >= F.col("_t")))})
