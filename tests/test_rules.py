"""The rule compiler and intervals against plain counts."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest

from ledgerlark.operators import quality, rules
from ledgerlark.operators.rules import Rule
from ledgerlark.plans.declared import RULES


def test_rules_equal_plain_counts(spark):
    draw = random.Random(4)
    pick = lambda *v: draw.choice(v)
    a = [(pick(1, 2, 3, None, i), pick("x", "y", None, 'q"{'), pick(-1.0, 0.0, 5.0, None), pick(date(2024, 1, 1), None)) for i in range(200)]
    b = [(pick(1, 2, 5, 9, None), pick("x", "z")) for _ in range(30)]
    tables = {"a": spark.createDataFrame(a, "k int, t string, n double, d date"), "b": spark.createDataFrame(b, "k int, t string"), "none": spark.createDataFrame([], "k int, t string")}
    declared = [
        Rule("a", "not_null", ("k",)), Rule("a", "not_null", ("n",), where="t = 'x'"), Rule("a", "accepted_values", ("t",), values=("x", "y")), Rule("a", "accepted_range", ("n",), low=0, high=4),
        Rule("a", "accepted_range", ("n",), low=0, label="low"), Rule("a", "expression", ("n",), expression="n >= 0 or t = 'x'"), Rule("a", "unique", ("k",)), Rule("a", "unique", ("k",), where="d is not null", label="dated"),
        Rule("a", "combination", ("k", "t")), Rule("a", "relationship", ("k",), other="b", key="k"), Rule("a", "relationship", ("t",), other="b", key="t", where="n > 0"),
        Rule("b", "relationship", ("k",), other="none", key="k"), Rule("none", "not_null", ("k",)), Rule("none", "unique", ("k",)), Rule("b", "relationship", ("t",), other="b", key="t"),
    ]
    got = {r.rule: r.violations for r in rules.check(tables, declared).collect()}
    ks, ts = {k for k, _ in b}, {t for _, t in b}
    several = lambda values: sum(n > 1 for n in Counter(values).values())
    want = [
        sum(r[0] is None for r in a), sum(r[2] is None and r[1] == "x" for r in a), sum(r[1] is not None and r[1] not in ("x", "y") for r in a), sum(r[2] is not None and not 0 <= r[2] <= 4 for r in a),
        sum(r[2] is not None and r[2] < 0 for r in a), sum(r[2] == -1.0 and r[1] is not None and r[1] != "x" for r in a), several(r[0] for r in a if r[0] is not None), several(r[0] for r in a if r[0] is not None and r[3]),
        several(r[:2] for r in a), sum(r[0] is not None and r[0] not in ks for r in a), sum(r[1] is not None and r[1] not in ts and (r[2] or 0) > 0 for r in a), sum(k is not None for k, _ in b), 0, 0, 0,
    ]
    assert [got[r.name] for r in declared] == want
    with pytest.raises(ValueError, match="labels"):
        rules.check(tables, [declared[0], declared[0]])


def test_one_scan_a_table_and_every_rule_declared(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(20).selectExpr("id", "id % 3 as k").write.parquet(str(tmp_path / name))
    tables = {name: spark.read.parquet(str(tmp_path / name)) for name in ("a", "b")}
    declared = [Rule(t, kind, ("id",)) for t in tables for kind in ("not_null", "unique", "combination")] + [Rule("a", "relationship", ("k",), other="b", key="id"), Rule("b", "relationship", ("k",), other="a", key="k")]
    plan = rules.check(tables, declared)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2
    assert len(RULES) == 172 and len({r.name for r in RULES}) == 172


def test_intervals(spark):
    draw = random.Random(7)
    months = [(k, date(2023 + n // 12, n % 12 + 1, 1)) for k in (1, 2, 3) for n in range(36) if draw.random() < 0.7]
    frame = spark.createDataFrame(months + months[:5] + [(1, None)], "k int, d date")
    for grain in ("month", "day"):
        index = (lambda d: d.year * 12 + d.month) if grain == "month" else date.toordinal
        runs, holes = [], []
        for k in (1, 2, 3):
            own = sorted(d for key, d in months if key == k)
            start = own[0]
            for x, y in zip(own, own[1:] + [None], strict=True):
                if y is None or index(y) > index(x) + 1:
                    runs.append((k, start, x))
                    if y:
                        step = (lambda d, n: date((d.year * 12 + d.month - 1 + n) // 12, (d.month - 1 + n) % 12 + 1, 1)) if grain == "month" else (lambda d, n: d + timedelta(days=n))
                        holes.append((k, step(x, 1), step(y, -1), index(y) - index(x) - 1))
                    start = y
        assert sorted((r.k, r.start, r.end) for r in quality.islands(frame, "k", "d", grain).collect()) == sorted(runs)
        assert sorted((r.k, r.start, r.end, r.n) for r in quality.gaps(frame, "k", "d", grain).collect()) == sorted(holes)
    spans = [(1, date(2024, 1, 1), date(2024, 3, 1)), (1, date(2024, 2, 1), date(2024, 2, 10)), (1, date(2024, 3, 1), None), (1, date(2024, 5, 1), date(2024, 6, 1)), (2, date(2024, 1, 1), None), (2, date(2024, 1, 1), date(2024, 1, 1))]
    got = quality.overlaps(spark.createDataFrame(spans, "k int, valid_from date, valid_to date"), "k").collect()
    assert sorted((r.k, r.start, r.end) for r in got) == [(1, date(2024, 2, 1), date(2024, 2, 10)), (1, date(2024, 5, 1), date(2024, 6, 1))]
