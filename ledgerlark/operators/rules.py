"""Declared rules of tables, compiled to one pass.

Every rule turns into marks: a row of its table that breaks it, a key that must be unique, a key
that refers to another table, a key that can be referred to. Each table is scanned once and gives
the marks of all its rules; all tables' marks are put one under another and counted by rule and
key, then by rule. Rows that break a row rule are summed up before the shuffle; keys are counted
on both sides of it, so a key that many rows hold is no hot spot."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@dataclass(frozen=True)
class Rule:
    """kind: not_null, accepted_values, accepted_range, expression (true for a sound row), unique (null
    keys don't count), combination (unique, null is a value like any other), or relationship (a
    value that isn't null must be in `other`'s column `key`). `where` limits the rows, in SQL."""

    table: str
    kind: str
    columns: tuple[str, ...]
    values: tuple = ()
    low: float | None = None
    high: float | None = None
    expression: str = ""
    other: str = ""
    key: str = ""
    where: str = ""
    label: str = ""

    @property
    def name(self) -> str:
        return f"{self.table}.{self.kind}.{'+'.join(self.columns)}" + (f".{self.label}" if self.label else "")

    def broken(self) -> Column:
        """For rules of a row: whether it breaks the rule."""
        c = F.col(self.columns[0])
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "accepted_values":
            return c.isNotNull() & ~c.isin(*self.values)
        if self.kind == "accepted_range":
            low = (c < self.low) if self.low is not None else F.lit(False)
            return low | (c > self.high) if self.high is not None else low
        if self.kind == "expression":
            return ~F.expr(self.expression)
        raise ValueError(f"{self.kind} isn't a rule of a row")

    def sql(self, relation: dict[str, str]) -> str:
        """The number of violations in SQL; relation: table -> what stands after FROM."""
        c, rows = self.columns[0], f"(SELECT * FROM {relation[self.table]}" + (f" WHERE {self.where}" if self.where else "") + ")"
        if self.kind == "not_null":
            return f"SELECT count(*) FROM {rows} WHERE {c} IS NULL"
        if self.kind == "accepted_values":
            return f"SELECT count(*) FROM {rows} WHERE {c} NOT IN ({', '.join(map(repr, self.values))})"
        if self.kind == "accepted_range":
            bad = [f"{c} < {self.low}"] * (self.low is not None) + [f"{c} > {self.high}"] * (self.high is not None)
            return f"SELECT count(*) FROM {rows} WHERE {' OR '.join(bad)}"
        if self.kind == "expression":
            return f"SELECT count(*) FROM {rows} WHERE NOT ({self.expression})"
        if self.kind == "relationship":
            return f"SELECT count(*) FROM {rows} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {self.key} FROM {relation[self.other]} WHERE {self.key} IS NOT NULL)"
        known = f" WHERE {c} IS NOT NULL" if self.kind == "unique" else ""
        return f"SELECT count(*) FROM (SELECT 1 FROM {rows}{known} GROUP BY {', '.join(self.columns)} HAVING count(*) > 1)"


def _by_key(df: DataFrame, numbered: list[tuple[int, Rule]]) -> DataFrame:
    """(rule, violations) of a table with one rule of a key that no other table refers to: rows are counted
    by the key's own columns, so that a table dealt by one of them isn't shuffled and no key turns to text."""
    (number, one), = [(i, r) for i, r in numbered if r.kind in ("unique", "combination")]
    others = [(i, r) for i, r in numbered if i != number]
    where = lambda r: F.coalesce(F.expr(r.where), F.lit(False)) if r.where else F.lit(True)
    inside = where(one) & F.col(one.columns[0]).isNotNull() if one.kind == "unique" else where(one)
    marked = df.select(*dict.fromkeys(one.columns), inside.alias("_in"), *((where(r) & F.coalesce(r.broken(), F.lit(False))).cast("long").alias(f"_r{i}") for i, r in others))
    keys = marked.groupBy(*dict.fromkeys(one.columns), "_in").agg(F.count("*").alias("_held"), *(F.sum(f"_r{i}").alias(f"_r{i}") for i, _ in others))
    sums = keys.agg(F.count_if(F.col("_in") & (F.col("_held") > 1)).alias(f"_r{number}"), *(F.coalesce(F.sum(f"_r{i}"), F.lit(0)).alias(f"_r{i}") for i, _ in others))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(i).alias("rule"), F.col(f"_r{i}").cast("long").alias("violations")) for i, _ in numbered))))


def _by_rows(df: DataFrame, numbered: list[tuple[int, Rule]]) -> DataFrame:
    """(rule, violations) of rules of a row."""
    where = lambda r: F.coalesce(F.expr(r.where), F.lit(False)) if r.where else F.lit(True)
    sums = df.agg(*(F.count_if(where(r) & F.coalesce(r.broken(), F.lit(False))).alias(f"_r{i}") for i, r in numbered))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(i).alias("rule"), F.col(f"_r{i}").alias("violations")) for i, _ in numbered))))


def _by_turns(turns: DataFrame, number: int, rule: Rule) -> DataFrame:
    """(rule, violations) of a combination whose last column is a month, from the months at which the
    number of rows with the other columns changes (see check()): the months between two of them hold
    as many rows, so that no month is generated."""
    *others, month = rule.columns
    summed = turns.groupBy(*rule.columns).agg(F.sum("_change").alias("_change"))
    along = Window.partitionBy(*others).orderBy(month)
    index = lambda c: F.year(c) * 12 + F.month(c)
    times = F.sum(F.when(F.col(month).isNotNull(), F.col("_change"))).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = summed.select(month, "_change", times.alias("_times"), F.lead(month).over(along).alias("_next"))
    several = F.when(F.col(month).isNull(), (F.col("_change") > 1).cast("long")).when(F.col("_times") > 1, index("_next") - index(month))
    return held.agg(F.coalesce(F.sum(several), F.lit(0)).cast("long").alias("violations")).select(F.lit(number).alias("rule"), "violations")


def _by_value(keys: DataFrame, number: int, rule: Rule, other: DataFrame | None) -> DataFrame:
    """(rule, violations) of a unique column, or of a reference to `other`, whose rows stand _times each. A
    digest in hexadecimal digits is dealt as the bytes that it stands for, half as many, other text as it is."""
    c = F.col(rule.columns[0])
    values = keys.where(c.isNotNull()).select(c.alias("_value"), F.col("_times").cast("long").alias("_held"), F.lit(False).alias("_known"))
    if other is not None:
        known = other.where(F.col(rule.key).isNotNull()).select(F.col(rule.key).alias("_value"), F.lit(0).cast("long").alias("_held"), F.lit(True).alias("_known"))
        values = values.groupBy("_value", "_known").agg(F.sum("_held").alias("_held")).unionByName(known)
    by = [F.col("_value")]
    if other is None and keys.schema[rule.columns[0]].dataType == StringType():
        digest = F.lower(F.hex(F.unhex("_value"))).eqNullSafe(F.col("_value"))
        by = [F.when(digest, F.unhex("_value")).alias("_bytes"), F.when(~digest, F.col("_value")).alias("_text")]
    summed = values.groupBy(*by).agg(F.sum("_held").alias("_held"), F.bool_or("_known").alias("_known"))
    count = F.count_if(F.col("_held") > 1) if other is None else F.sum(F.when(~F.col("_known"), F.col("_held")))
    return summed.agg(F.coalesce(count, F.lit(0)).cast("long").alias("violations")).select(F.lit(number).alias("rule"), "violations")


_MARK = "struct<rule: int, key: string, held: bigint, known: boolean>"


def _marks(number: int, rule: Rule) -> Column:
    """The rule's mark of a row of its table, null where the row has none."""
    inside = F.coalesce(F.expr(rule.where), F.lit(False)) if rule.where else F.lit(True)
    if rule.kind in ("unique", "combination", "relationship"):
        if rule.kind != "combination":
            inside = inside & F.col(rule.columns[0]).isNotNull()
        key = F.to_json(F.struct(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(rule.columns))), {"ignoreNullFields": "false"})
    else:
        inside = inside & F.coalesce(rule.broken(), F.lit(False))
        key = F.lit(None).cast("string")
    return F.when(inside, F.struct(F.lit(number).alias("rule"), key.alias("key"), F.lit(1).cast("long").alias("held"), F.lit(False).alias("known")))


def _referred(number: int, rule: Rule) -> Column:
    """The mark of a row of the table that a relationship refers to."""
    c = F.col(rule.key)
    key = F.to_json(F.struct(c.cast("string").alias("k0")), {"ignoreNullFields": "false"})
    return F.when(c.isNotNull(), F.struct(F.lit(number).alias("rule"), key.alias("key"), F.lit(0).cast("long").alias("held"), F.lit(True).alias("known")))


def check(tables: dict[str, DataFrame], rules: Iterable[Rule], turns: dict[str, DataFrame] | None = None, keys: dict[str, DataFrame] | None = None) -> DataFrame:
    """(rule, violations) of every rule: rows that break a rule of a row, keys that stand in several
    rows, rows whose reference isn't there. Rules without a violation, or of an empty table, have 0.

    turns[table]: for tables with a row per month, the columns of the table's combination, the last of
    them the month, and _change: by how much the number of rows a month changes there (null month:
    that many rows without one). keys[table]: the columns of such a table's other rules of a key, by
    rows that stand _times each. Their rows are only summed up, and no month's key is text."""
    rules, turns, keys = list(rules), turns or {}, keys or {}
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise ValueError(f"rules need labels to be told apart: {sorted({n for n in names if names.count(n) > 1})}")
    parts, counted = [], []
    for name, df in tables.items():
        own = [(i, r) for i, r in enumerate(rules) if r.table == name]
        if name in turns:
            counted += [_by_turns(turns[name], i, r) for i, r in own if r.kind == "combination"]
            counted += [_by_value(keys[name], i, r, tables[r.other] if r.other else None) for i, r in own if r.kind in ("unique", "relationship")]
            counted.append(_by_rows(df, [(i, r) for i, r in own if r.kind not in ("combination", "unique", "relationship")]))
            continue
        if sum(r.kind in ("unique", "combination") for _, r in own) == 1 and not any(r.kind == "relationship" and name in (r.table, r.other) and r.table not in turns for r in rules):
            counted.append(_by_key(df, own))
            continue
        marks = [_marks(i, r) for i, r in enumerate(rules) if r.table == name]
        marks += [_referred(i, r) for i, r in enumerate(rules) if r.kind == "relationship" and r.other == name and r.table not in turns]
        if marks:
            parts.append(df.select(F.inline(F.array_compact(F.array(*(m.cast(_MARK) for m in marks))))))
    spark = next(iter(tables.values())).sparkSession
    listed = spark.createDataFrame(list(enumerate(names)), "rule int, name string")
    found = reduce(DataFrame.unionByName, [*counted, *([_by_marks(parts, rules)] if parts else [])])
    return listed.join(found, "rule", "left").select(F.col("name").alias("rule"), F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))


def _by_marks(parts: list[DataFrame], rules: list[Rule]) -> DataFrame:
    """(rule, violations) of tables' marks."""
    keys = reduce(DataFrame.unionByName, parts).groupBy("rule", "key").agg(F.sum("held").alias("held"), F.bool_or("known").alias("known"))
    unique = [i for i, r in enumerate(rules) if r.kind in ("unique", "combination")]
    count = F.when(F.col("rule").isin(*unique), (F.col("held") > 1).cast("long")).when(F.col("known"), F.lit(0)).otherwise(F.col("held")) if unique else F.when(F.col("known"), F.lit(0)).otherwise(F.col("held"))
    return keys.groupBy("rule").agg(F.sum(count).alias("violations"))
