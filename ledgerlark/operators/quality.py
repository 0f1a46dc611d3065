"""Data-quality rules: each gives a count of violating rows; a rule passes iff it is zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) for predicates that mark violating rows; all in one pass."""
    row = df.agg(*(F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("violations")) for n in rules))
    return row.select(F.inline(pairs))


def not_null(*columns: str) -> dict[str, Column]:
    return {f"not_null_{c}": F.col(c).isNull() for c in columns}


def accepted_values(column: str, values: list) -> dict[str, Column]:
    return {f"accepted_values_{column}": F.col(column).isNotNull() & ~F.col(column).isin(values)}


def accepted_range(column: str, low=None, high=None) -> dict[str, Column]:
    bad = [F.col(column) < low] if low is not None else []
    bad += [F.col(column) > high] if high is not None else []
    return {f"accepted_range_{column}": reduce(lambda a, b: a | b, bad)}


def named(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").cast("long").alias("violations")).select(F.lit(name).alias("rule"), "violations")


def unique(df: DataFrame, *columns: str, where: str | None = None) -> DataFrame:
    rows = df.where(where) if where else df
    return named(f"unique_{'_'.join(columns)}", rows.groupBy(*columns).count().where("count > 1"))


def relationship(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    keys = other.select(F.col(key).alias("_key")).distinct()
    return named(f"relationship_{column}", df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti"))


def no_overlap(df: DataFrame, key: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Versions of a key whose intervals overlap an earlier one (a running maximum, no self join)."""
    stop = F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))
    before = Window.partitionBy(key).orderBy(start, stop).rowsBetween(Window.unboundedPreceding, -1)
    return named(f"no_overlap_{key}", df.withColumn("_before", F.max(stop).over(before)).where(F.col(start) < F.col("_before")))


def _steps(date: str, grain: str) -> Column:
    """A date's number in months or days."""
    return F.year(date) * 12 + F.month(date) if grain == "month" else F.unix_date(date)


def islands(df: DataFrame, key: str, date: str, grain: str = "month") -> DataFrame:
    """(key, start, end, n): the runs of consecutive dates of each key; repeated dates count once. A
    date's number less its place among the key's dates is the same along a run. Nulls are in none."""
    dates = df.select(key, date).where(F.col(date).isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy(date))
    runs = dates.withColumn("_run", _steps(date, grain) - place)
    return runs.groupBy(key, "_run").agg(F.min(date).alias("start"), F.max(date).alias("end"), F.count("*").alias("n")).drop("_run")


def gaps(df: DataFrame, key: str, date: str, grain: str = "month") -> DataFrame:
    """(key, start, end, n): the runs of missing dates between a key's first and last one."""
    dates = df.select(key, date).where(F.col(date).isNotNull()).distinct()
    following = F.lead(date).over(Window.partitionBy(key).orderBy(date))
    step = (lambda c, n: F.add_months(c, n)) if grain == "month" else (lambda c, n: F.date_add(c, n))
    found = dates.withColumn("_next", following).withColumn("n", (_steps("_next", grain) - _steps(date, grain) - 1).cast("long")).where("n > 0")
    return found.select(key, step(F.col(date), 1).alias("start"), step(F.col("_next"), -1).alias("end"), "n")


def islands_of(df: DataFrame, key: str, dates: str, grain: str = "month") -> DataFrame:
    """islands() of dates that come as arrays without nulls, each ascending, a key's arrays apart from each
    other (spans of a spine): runs are found within an array, and only first and last dates of runs are
    ordered to meet those of the key's other arrays, so that no date travels or is sorted."""
    numbers = df.select(key, F.col(dates).alias("_dates"), F.transform(dates, lambda d: _steps(d, grain)).alias("_steps")).where(F.size("_dates") > 0)
    n = F.size("_dates")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get("_steps", i) > F.get("_steps", i - 1) + 1))
    places = numbers.withColumn("_ends", ends)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_ends", i - 1))
    runs = F.transform("_ends", lambda e, i: F.struct(F.get("_dates", before(i)).alias("start"), F.get("_dates", e - 1).alias("end")))
    found = places.select(key, F.inline(runs)).withColumns({"_first": _steps("start", grain), "_last": _steps("end", grain)})
    along = Window.partitionBy(key).orderBy("_first")
    joined = found.withColumn("_new", F.coalesce((F.col("_first") > F.lag("_last").over(along) + 1).cast("int"), F.lit(1)))
    joined = joined.withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return joined.groupBy(key, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("_last") - F.col("_first") + 1).cast("long").alias("n")).drop("_run")


def gaps_of(df: DataFrame, key: str, dates: str, grain: str = "month") -> DataFrame:
    """gaps() of dates that come as arrays, as for islands_of: what lies between a key's islands."""
    step = (lambda c, n: F.add_months(c, n)) if grain == "month" else (lambda c, n: F.date_add(c, n))
    runs = islands_of(df, key, dates, grain)
    found = runs.withColumn("_next", F.lead("start").over(Window.partitionBy(key).orderBy("start"))).where(F.col("_next").isNotNull())
    return found.select(key, step(F.col("end"), 1).alias("start"), step(F.col("_next"), -1).alias("end2"), (_steps("_next", grain) - _steps("end", grain) - 1).cast("long").alias("n")).withColumnRenamed("end2", "end")


def overlaps(df: DataFrame, key: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """(key, start, end): the parts of each version's interval [start, end) that earlier versions of
    its key cover up to (null: open), one row a version that overlaps any."""
    far = F.lit("9999-12-31").cast("date")
    rows = df.select(key, F.col(start).alias("_s"), F.coalesce(F.col(end), far).alias("_e"))
    before = Window.partitionBy(key).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_reach", F.max("_e").over(before)).where(F.col("_reach").isNotNull() & (F.col("_s") < F.least("_reach", "_e")))
    return found.select(key, F.col("_s").alias("start"), F.nullif(F.least("_reach", "_e"), far).alias("end"))


def no_month_gaps(df: DataFrame, key: str, month: str) -> DataFrame:
    """Keys whose months aren't consecutive."""
    index = F.year(month) * 12 + F.month(month)
    spans = df.groupBy(key).agg(F.countDistinct(month).alias("n"), (F.max(index) - F.min(index) + 1).alias("span"))
    return named(f"no_month_gaps_{month}", spans.where("n <> span"))


def _months_in(spans: str) -> Column:
    """The month starts of an array of spans (_first, _last), span by span."""
    return F.flatten(F.transform(spans, lambda s: F.sequence(s["_first"], s["_last"], F.expr("interval 1 month"))))


def no_month_gaps_of(spans: DataFrame, key: str, name: str) -> DataFrame:
    """no_month_gaps() of months `name` that come as spans (key, _first, _last): a key's spans are put
    together and its months are generated and counted last, so that no month travels or is sorted."""
    index = lambda d: F.year(d) * 12 + F.month(d)
    months = spans.groupBy(key).agg(F.collect_list(F.struct("_first", "_last")).alias("_spans")).select(key, _months_in("_spans").alias("_months"))
    return named(f"no_month_gaps_{name}", months.where(F.size(F.array_distinct("_months")) != index(F.array_max("_months")) - index(F.array_min("_months")) + 1))


def no_day_gaps(df: DataFrame, day: str) -> DataFrame:
    span = df.agg(F.countDistinct(day).alias("n"), (F.datediff(F.max(day), F.min(day)) + 1).alias("span"))
    return named(f"no_day_gaps_{day}", span.where("n <> span"))


def dropped_rows(spine: DataFrame, fact: DataFrame, *keys: str) -> DataFrame:
    return named("no_dropped_spine_rows", spine.join(fact.select(*keys), list(keys), "left_anti"))


def dropped_months(spans: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """dropped_rows() of a spine and a fact that come as spans (key, _first, _last), those of a key in the
    spine apart from each other: spans are joined by key, and months are generated and compared last."""
    there = held.groupBy(key).agg(F.collect_list(F.struct("_first", "_last")).alias("_held"))
    rows = spans.join(there, key, "left").select(F.array(F.struct("_first", "_last")).alias("_spans"), "_held")
    missing = F.size(F.when(F.col("_held").isNull(), _months_in("_spans")).otherwise(F.array_except(_months_in("_spans"), _months_in("_held"))))
    return rows.agg(F.coalesce(F.sum(missing), F.lit(0)).cast("long").alias("violations")).select(F.lit("no_dropped_spine_rows").alias("rule"), "violations")
