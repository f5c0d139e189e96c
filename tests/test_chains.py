"""Kept chains, split running sums and ranks, with a key that holds much of a table."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import labels as lb
from tapeloom.operators import rules as ru
from tapeloom.operators import trades as tr
from tapeloom.operators.chains import keep_clear


def loop(rows):
    """(key, pos) kept when every key is read upwards."""
    out, end = set(), {}
    for k, p, r in sorted(rows, key=lambda x: (x[0] is None, x[0] or "", x[1])):
        if k not in end or p > end[k]:
            out.add((k, p))
            end[k] = r
    return out


@pytest.mark.parametrize("spread", [0, 1, 9, 60])
def test_chains_equal_a_loop_with_a_hot_key(spark, spread):
    rng = random.Random(spread)
    rows = [("hot", p, p + rng.randint(0, spread)) for p in range(400)]
    for k in [None, *"abcdefgh"]:
        rows += [(k, p, p + rng.randint(0, spread)) for p in rng.sample(range(-300, 300), 60)]
    d = spark.createDataFrame(rows, "k string, p long, r long")
    got = keep_clear(d, ["k"], "p", "r")
    assert {(r["k"], r["p"]) for r in got.collect()} == loop(rows)
    assert got.count() == len(loop(rows))


def test_chains_are_one_sort_without_joins(spark, capsys):
    d = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("a", 3, 3)], "k string, p long, r long")
    got = keep_clear(d, ["k"], "p", "r")
    got.explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert sorted(r["p"] for r in got.collect()) == [1, 3]


def test_no_rows_no_chains(spark):
    assert keep_clear(spark.createDataFrame([], "k string, p long, r long"), ["k"], "p", "r").count() == 0


def test_cooldown_of_a_hot_key_equals_a_loop(spark):
    rng = random.Random(2)
    day = lambda n: date(2020, 1, 1) + timedelta(days=n)
    rows = [("H", "r", n) for n in range(900)] + [(rng.choice("XYZ"), rng.choice("rq"), rng.randint(0, 900)) for _ in range(600)]
    rows += rows[:50]
    d = spark.createDataFrame([(s, r, day(n)) for s, r, n in rows] + [("X", "r", None)], "symbol string, rule_key string, date date")
    got = ru.cooldown(d, 30).collect()
    want = {(*k.split("/"), day(p)) for k, p in loop({(f"{s}/{r}", n, n + 30) for s, r, n in rows})}
    assert {(r["symbol"], r["rule_key"], r["date"]) for r in got} == want and len(got) == len(want)


def test_curve_of_one_day_is_split(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["s", None]), i, date(2024, 1, 1 + (i % 50 == 0)), rng.gauss(0, 20)) for i in range(3000)]
    d = spark.createDataFrame(rows, "strategy string, n long, exit_date date, pnl double").repartition(7)
    got = {r["n"]: r for r in tr.equity_curve(d, ["strategy"], "exit_date", ["n"], "pnl", 500.0).collect()}
    assert len(got) == len(rows)
    for who in ("s", None):
        eq = peak = 500.0
        for _, n, _, pnl in sorted((r for r in rows if r[0] == who), key=lambda r: (r[2], r[1])):
            eq += pnl
            peak = max(peak, eq)
            assert got[n]["equity"] == pytest.approx(eq, abs=1e-6)
            assert got[n]["drawdown"] == pytest.approx((eq - peak) / peak, abs=1e-6)


def test_exits_are_found_once_for_rules_of_one_label(path_bars):
    bars = path_bars({"A": [100, 100, 130, 130], "B": [50] * 5})
    e = bars.where(F.dayofmonth("date") == 1).select("symbol", "date")
    e = e.crossJoin(bars.sparkSession.createDataFrame([("r", "L1"), ("q", "L1"), ("z", "L3")], "rule_key string, label string"))
    got = {(r["symbol"], r["rule_key"]): r for r in tr.barrier_exits(bars, e, slippage=0.0).collect()}
    assert len(got) == 6
    assert got["A", "r"]["exit_reason"] == got["A", "q"]["exit_reason"] == "target"
    assert got["A", "r"]["exit_price"] == pytest.approx(115.0) and got["A", "z"]["exit_price"] == pytest.approx(130.0)


def test_sector_rank_of_a_hot_sector(spark, path_bars):
    paths = {f"S{i:03}": [100.0, 100.0 + i] for i in range(60)} | {"other": [1.0, 2.0], "none": [1.0, 9.0]}
    bars = path_bars(paths)
    sectors = spark.createDataFrame([(s, "hot") for s in paths if s[0] == "S"] + [("other", "small")], "symbol string, sector string")
    got = lb.sector_rank(bars, sectors, horizon=1, top=0.9)
    first = {r["symbol"]: r["sector_rank"] for r in got.where(F.dayofmonth("date") == 1).collect()}
    assert [s for s in first if first[s] == 1.0 and s[0] == "S"] and sum(first[s] == 1.0 for s in first) == 6
    assert first["S059"] == 1.0 and first["S000"] == 0.0 and first["none"] is None
    assert got.columns == [*bars.columns, "sector_rank"] and got.count() == 2 * len(paths)
