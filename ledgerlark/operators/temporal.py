"""Point-in-time operators: spines, trailing windows, validity intervals, as-of facts, and
capture of slowly changing dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import month_start_from

FAR = "9999-12-31"


def monthly_spans(entities: DataFrame, key: str, start: str, as_of: str, end: str | None = None) -> DataFrame:
    """(key, _first, _last): month starts from the month of `start` to the month of `as_of`, those
    before `end` (null: open), as one row per row of `entities`; a row of a key spans only the
    months that its earlier ones don't, so a key's spans don't overlap."""
    last = F.trunc(F.lit(as_of).cast("date"), "MM")
    until = F.least(last, F.add_months(month_start_from(F.coalesce(F.col(end), F.lit(FAR).cast("date"))), -1)) if end else last
    spans = entities.select(key, F.trunc(F.col(start), "MM").alias("_first"), until.alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_first", "_last").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_first", F.greatest("_first", F.add_months(F.max("_last").over(earlier), 1))).where("_first <= _last")


def months_of(first: str = "_first", last: str = "_last") -> Column:
    """The month starts from `first` to `last`, both included, as an array."""
    return F.sequence(first, last, F.expr("interval 1 month"))


def monthly_spine(entities: DataFrame, key: str, start: str, as_of: str, end: str | None = None) -> DataFrame:
    """(key, snapshot_date): the months of monthly_spans, each once. Generated per row, without a join."""
    return monthly_spans(entities, key, start, as_of, end).select(key, F.explode(months_of()).alias("snapshot_date"))


def carried(rows: DataFrame, key: str, date: str, at: dict[str, DataFrame] | None = None, since: dict[str, tuple[DataFrame, dict[str, Column]]] | None = None) -> DataFrame:
    """Merge as-of: rows with values of other tables, all of which have key and date.

    at[name]: a table with one row per key and date at most; rows of the same key and date get the
    rest of its columns as the struct `name` (null: none). since[name]: a table of changes and
    aggregates of them (columns of struct `name`); a row gets each aggregate over the changes of its
    key up to its own date, that day included. All tables are put one under another and ordered by
    key and date once, so rows travel at most once, by key, and not at all if all tables are dealt
    by key already. No pair of a row and a version is made."""
    at, since = at or {}, since or {}
    parts = {"_row": rows, **at, **{n: changes for n, (changes, _) in since.items()}}
    packed = {n: df.select(key, date, F.struct(*(c for c in df.columns if c not in (key, date)), F.lit(True).alias("_is")).alias(n)) for n, df in parts.items()}
    kinds = {n: df.schema[n].dataType for n, df in packed.items()}
    every = [df.select(key, date, *(F.col(m) if m == n else F.lit(None).cast(kinds[m]).alias(m) for m in packed)) for n, df in packed.items()]
    here, sofar = Window.partitionBy(key, date), Window.partitionBy(key).orderBy(date).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    merged = reduce(DataFrame.unionByName, every)
    if since:
        merged = merged.select(key, date, "_row", *at, *(value.over(sofar).alias(c) for _, values in since.values() for c, value in values.items()))
    if at:
        merged = merged.withColumns({n: F.first(n, ignorenulls=True).over(here) for n in at})
    own = [F.col(f"_row.{c}").alias(c) for c in rows.columns if c not in (key, date)]
    added = [c for _, values in since.values() for c in values]
    return merged.where(F.col("_row").isNotNull()).select(key, date, *own, *at, *added)


def carried_months(spans: DataFrame, key: str, at: dict[str, DataFrame] | None = None, since: dict[str, tuple[DataFrame, dict[str, Column]]] | None = None, only: str | None = None, months: bool = True) -> DataFrame:
    """What carried() gives for a monthly spine, without a row of the spine in the merge: `spans` (key,
    _first, _last, more) stand for the months from _first to _last. Of the other tables (with key and
    snapshot_date) only the months at which something begins are ordered and cumulated; each of them
    holds to the month before the next, and its months are generated last, within each span of the
    key. Spans of a key may overlap. A table of `at` has one row per key and month at most, its dates
    are month starts; a change of `since` counts from the first month start at or after its day.
    only: a table of `at`; months without a row of it are left out (and never generated). months=False:
    the spans (_first, _last) whose months the rows have, without the columns of `at`."""
    at, since = at or {}, since or {}
    month = "snapshot_date"
    parts = {"_span": spans.withColumn(month, F.col("_first")), **at, **{n: changes.withColumn(month, month_start_from(F.col(month))) for n, (changes, _) in since.items()}}
    packed = {n: df.select(key, month, F.struct(*(c for c in df.columns if c not in (key, month)), F.lit(True).alias("_is")).alias(n)) for n, df in parts.items()}
    kinds = {n: df.schema[n].dataType for n, df in packed.items()}
    every = [df.select(key, month, *(F.col(m) if m == n else F.lit(None).cast(kinds[m]).alias(m) for m in packed)) for n, df in packed.items()]
    whole, along = Window.partitionBy(key), Window.partitionBy(key).orderBy(month)
    sofar = along.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    merged = reduce(DataFrame.unionByName, every).select(
        key, month, *at, F.collect_list("_span").over(whole).alias("_spans"), F.lead(month).over(along).alias("_next"), *(value.over(sofar).alias(c) for _, values in since.values() for c, value in values.items())
    )
    if at:
        merged = merged.withColumns({n: F.first(n, ignorenulls=True).over(Window.partitionBy(key, month)) for n in at})
    added = [c for _, values in since.values() for c in values]
    turns = merged.where((F.col("_next").isNull() | (F.col("_next") > F.col(month))) & (F.size("_spans") > 0))  # the last row of a month
    if only:
        turns = turns.where(F.col(only).isNotNull())
    held = turns.select(key, F.col(month).alias("_from"), (F.col(month) if only else F.coalesce(F.add_months("_next", -1), F.lit(FAR).cast("date"))).alias("_until"), F.explode("_spans").alias("_span"), *at, *added)
    inside = held.withColumns({"_begin": F.greatest("_from", "_span._first"), "_end": F.least("_until", "_span._last")}).where("_begin <= _end")
    own = [F.col(f"_span.{c}").alias(c) for c in spans.columns if c not in (key, "_first", "_last")]
    if not months:
        return inside.select(key, F.col("_begin").alias("_first"), F.col("_end").alias("_last"), *own, *added)
    rows = inside.withColumn(month, F.explode(months_of("_begin", "_end")))
    return rows.select(key, month, *own, *(F.when(F.col(month) == F.col("_from"), F.col(n)).alias(n) for n in at), *added)


def month_turns(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, snapshot_date, _change): by how much the number of rows a month grows or shrinks at a month,
    of rows that come as spans of months (_first, _last). Spans that follow one another leave none."""
    ends = F.array(F.struct(F.col("_first").alias("snapshot_date"), F.lit(1).alias("_change")), F.struct(F.add_months("_last", 1).alias("snapshot_date"), F.lit(-1).alias("_change")))
    return spans.select(*keys, F.inline(ends)).groupBy(*keys, "snapshot_date").agg(F.sum("_change").alias("_change")).where("_change <> 0")


def spans_of(turns: DataFrame, *keys: str) -> DataFrame:
    """month_turns() the other way: (keys, _first, _last, _times), each month _times rows."""
    along = Window.partitionBy(*keys).orderBy("snapshot_date")
    times = F.sum("_change").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = turns.select(*keys, F.col("snapshot_date").alias("_first"), F.add_months(F.lead("snapshot_date").over(along), -1).alias("_last"), times.alias("_times"))
    return spans.where("_times > 0")


def expand_trailing(events: DataFrame, day: Column, days: int) -> DataFrame:
    """Each event once per month start s with s - days < day <= s: the trailing-window join with
    a monthly spine without a range join. An event has at most days/28 + 1 of them."""
    first, last = month_start_from(day), F.date_add(day, days - 1)
    rows = events.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    steps = (F.year("_last") - F.year("_first")) * 12 + F.month("_last") - F.month("_first")  # a few: cheaper than a sequence of dates
    return rows.withColumn("_step", F.explode(F.sequence(F.lit(0), steps))).withColumn("snapshot_date", F.add_months("_first", F.col("_step"))).drop("_first", "_last", "_step")


def days_before(key: str, day: str, days: int, value: Column) -> Column:
    """The values (no nulls) of a key's rows in the window of `days` days that ends with the row's day, as
    an array: a trailing window without a join. A key should have a row per day, not per event."""
    return F.collect_list(value).over(Window.partitionBy(key).orderBy(F.unix_date(day)).rangeBetween(1 - days, Window.currentRow))


def valid_at(spine: DataFrame, versions: DataFrame, key: str, start: str, valid_to: str = "valid_to", how: str = "inner") -> DataFrame:
    """Spine rows with the versions that hold at snapshot_date: start <= s < valid_to (null: open)."""
    v = versions.withColumnRenamed(key, "_key").withColumn("_end", F.coalesce(F.col(valid_to), F.lit(FAR).cast("date")))
    on = (F.col(key) == F.col("_key")) & (F.col("snapshot_date") >= F.col(start)) & (F.col("snapshot_date") < F.col("_end"))
    return spine.join(v, on, how).drop("_key", "_end")


def daily_spine(entities: DataFrame, key: str, start: str, as_of: str) -> DataFrame:
    """(key, snapshot_date): every day from the key's first `start` to `as_of`."""
    first = entities.groupBy(key).agg(F.min(start).alias("_first")).where(F.col("_first") <= F.lit(as_of).cast("date"))
    return first.select(key, F.explode(F.sequence("_first", F.lit(as_of).cast("date"), F.expr("interval 1 day"))).alias("snapshot_date"))


def trailing_pairs(spine: DataFrame, events: DataFrame, key: str, day: str, days: int) -> DataFrame:
    """Rows (spine row, event) with snapshot_date - days < day <= snapshot_date, for spines of any
    grain. Days are cut into bins as long as the window: a spine row looks into its own bin and the
    one before, so an event stays one row and a spine row becomes two, joined on key and bin; an event
    isn't copied to every snapshot of its window."""
    bin_of = lambda c: F.floor(F.unix_date(c) / F.lit(days)).cast("long")
    looks = spine.withColumn("_bin", F.explode(F.array(bin_of(F.col("snapshot_date")), bin_of(F.col("snapshot_date")) - 1)))
    kept = events.withColumnRenamed(key, "_key").withColumn("_at", bin_of(F.col(day)))
    on = (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_at")) & (F.col(day) <= F.col("snapshot_date")) & (F.col(day) > F.date_sub("snapshot_date", days))
    return looks.join(kept, on).drop("_key", "_bin", "_at")


def latest_at(spine: DataFrame, facts: DataFrame, key: str, available: str, order: str) -> DataFrame:
    """Spine rows with the latest fact (largest `order`) available by snapshot_date, nulls if there
    is none: the largest so far is carried along a key's dates. Facts of the same key and order must
    agree."""
    values = [c for c in facts.columns if c != key]
    first = [order, *(c for c in values if c != order)]
    changes = facts.withColumn("snapshot_date", F.col(available))
    rows = carried(spine.select(key, "snapshot_date"), key, "snapshot_date", since={"_fact": (changes, {"_best": F.max(F.when(F.col("_fact").isNotNull(), F.struct(*(F.col(f"_fact.{c}").alias(c) for c in first))))})})
    return rows.select(key, "snapshot_date", *(F.col(f"_best.{c}").alias(c) for c in values))


def held_at(spine: DataFrame, versions: DataFrame, key: str, start: str, valid_to: str = "valid_to") -> DataFrame:
    """Spine rows with the version that holds at snapshot_date (start <= s < valid_to, null: open), for
    versions of a key that don't overlap: the latest begun is carried. Rows without one go."""
    values = [c for c in versions.columns if c != key]
    first = [start, *(c for c in values if c != start)]
    changes = versions.withColumn("snapshot_date", F.col(start))
    rows = carried(spine.select(key, "snapshot_date"), key, "snapshot_date", since={"_version": (changes, {"_held": F.max(F.when(F.col("_version").isNotNull(), F.struct(*(F.col(f"_version.{c}").alias(c) for c in first))))})})
    rows = rows.where(F.col("_held").isNotNull() & (F.col(f"_held.{valid_to}").isNull() | (F.col("snapshot_date") < F.col(f"_held.{valid_to}"))))
    return rows.select(key, "snapshot_date", *(F.col(f"_held.{c}").alias(c) for c in values))


def version_changes(versions: DataFrame, key: str, start: str, counts: dict[str, Column], valid_to: str = "valid_to") -> DataFrame:
    """(key, snapshot_date, counts): +1 for each true predicate in the first month that a version holds
    in and -1 in the month that it no longer holds in. Their running sums count the versions."""
    sized = versions.select(F.col(key), month_start_from(F.col(start)).alias("_from"), month_start_from(F.col(valid_to)).alias("_until"), *(F.coalesce(p, F.lit(False)).cast("long").alias(n) for n, p in counts.items()))
    turns = F.array(F.struct(F.col("_from").alias("snapshot_date"), F.lit(1).alias("_sign")), F.struct(F.col("_until").alias("snapshot_date"), F.lit(-1).alias("_sign")))
    changes = sized.where("_until is null or _from < _until").select(key, *counts, F.inline(turns)).where("snapshot_date is not null")
    return changes.select(key, "snapshot_date", *((F.col(n) * F.col("_sign")).alias(n) for n in counts))


def running_counts(spine: DataFrame, versions: DataFrame, key: str, start: str, counts: dict[str, Column], valid_to: str = "valid_to") -> DataFrame:
    """Spine rows at which any version of the key holds (start <= s < valid_to, null: open), with
    the number of those for which each predicate of `counts` is true: running sums of changes, so
    rows are spine and changes, not their product."""
    marks = {"_any": F.lit(True)} | counts
    changes = version_changes(versions, key, start, marks, valid_to)
    rows = carried(spine.select(key, "snapshot_date"), key, "snapshot_date", since={"_change": (changes, {n: F.sum(f"_change.{n}") for n in marks})})
    return rows.where("_any > 0").drop("_any")


def capture_changes(history: DataFrame, current: DataFrame, key: str, watched: list[str], run_at: str) -> DataFrame:
    """History with valid_from / valid_to after a run: a change of a watched column closes the open
    version and opens another; a new key opens one. Keys that are gone keep their open version."""
    at = F.lit(run_at).cast("date")
    values = [c for c in current.columns if c != key]
    closed, open_ = history.where("valid_to is not null"), history.where("valid_to is null")
    now = current.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in values))
    pair = open_.join(now, F.col(key) == F.col("_key"), "full_outer")
    same = F.lit(True)
    for c in watched:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    pair = pair.withColumn("_changed", F.col(key).isNotNull() & F.col("_key").isNotNull() & ~same)
    kept = pair.where(F.col(key).isNotNull()).withColumn("valid_to", F.when(F.col("_changed"), at).otherwise(F.col("valid_to"))).select(history.columns)
    new = pair.where(F.col("_changed") | F.col(key).isNull()).select(F.col("_key").alias(key), *(F.col(f"_{c}").alias(c) for c in values), at.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return closed.unionByName(kept).unionByName(new.select(history.columns))
