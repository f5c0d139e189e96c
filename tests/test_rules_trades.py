import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import joins as jn
from tapeloom.operators import rules as ru
from tapeloom.operators import signals as sg
from tapeloom.operators import trades as tr
from tapeloom.operators.predicates import condition
from tapeloom.operators.rules import Rule
from tapeloom.plans.q_trades import best_signals
from tapeloom.sources.tables import Tables

D0 = date(2024, 1, 1)


def day(n):
    return D0 + timedelta(days=n)


def test_rule_evaluation_by_hand(spark):
    d = spark.createDataFrame(
        [("S", day(i), float(i + 1), i < 2) for i in range(5)], "symbol string, date date, f1 double, is_winner boolean"
    )
    r = ru.evaluate(d, [Rule("r", (("f1", "<", 3.0),)), Rule("x", (("absent", "<", 3.0),))]).collect()
    assert len(r) == 1
    assert (r[0]["coverage_n"], r[0]["precision"], r[0]["lift"]) == (2, 1.0, 2.5)


def test_null_and_nan_fail_both_branches(spark):
    d = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (3.0,)], "f1 double")
    got = d.select(condition("f1", "<", 2).alias("a"), condition("f1", ">=", 2).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(True, False), (False, False), (False, False), (False, False), (False, True)]
    with pytest.raises(ValueError):
        condition("f1", "~", 1)


def test_canonical_rules(spark):
    rows = [("p", "f1", ">=", 0.5), ("p", "f1", ">=", 0.8), ("p", "f2", "<", 3.0), ("q", "f2", "<", 3.0), ("q", "f1", ">=", 0.8)]
    got = ru.canonical_rules(spark.createDataFrame(rows, "path string, feature string, op string, threshold double")).collect()
    assert len(got) == 1 and got[0]["n_paths"] == 2
    assert [tuple(c) for c in got[0]["conditions"]] == [("f1", ">=", 0.8), ("f2", "<", 3.0)]


def test_walk_forward_keeps_rules_that_never_fire(spark):
    d = spark.createDataFrame([("S", day(i), float(i), i % 2 == 0) for i in range(10)], "symbol string, date date, f double, is_winner boolean")
    wf = ru.walk_forward(d, [Rule("never", (("f", ">", 99.0),)), Rule("all", (("f", ">=", 0.0),))], [(str(day(0)), str(day(9)))])
    got = {r["rule_key"]: r for r in wf.collect()}
    assert got["never"]["val_lift"] == 0.0 and got["never"]["val_n_samples"] == 10
    assert got["all"]["val_lift"] == 1.0 and got["all"]["val_n_winners"] == 5


def test_cooldown_at_30_and_31_days(spark):
    rows = [("S", date(2024, 5, 1), "r"), ("S", date(2024, 5, 31), "r"), ("S", date(2024, 6, 1), "r"), ("S", date(2024, 5, 2), "q")]
    got = ru.cooldown(spark.createDataFrame(rows, "symbol string, date date, rule_key string"), 30).collect()
    assert {(r["rule_key"], r["date"]) for r in got} == {("r", date(2024, 5, 1)), ("r", date(2024, 6, 1)), ("q", date(2024, 5, 2))}


@pytest.mark.parametrize(
    "change, reason",
    [
        ({}, None),
        ({"signal_strength": 1.2}, "strength"),
        ({"signal_type": "HOLD"}, "type"),
        ({"signal_id": ""}, "id"),
        ({"signal_date": "2024-13-01"}, "date"),
        ({"symbol": ""}, "symbol"),
    ],
)
def test_signal_validation(spark, change, reason):
    row = {"signal_id": "a", "symbol": "S", "signal_date": "2024-05-01", "signal_type": "ENTRY", "signal_strength": 0.5} | change
    assert sg.validate(spark.createDataFrame([row])).first()["invalid_reason"] == reason


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(1)
    spans = [(rng.choice("AB"), day(lo), day(lo + rng.randint(-1, 90)), i) for i, lo in enumerate(rng.choices(range(300), k=60))]
    points = [(s, day(i)) for s in "AB" for i in range(0, 400, 3)]
    a = spark.createDataFrame(spans, "symbol string, lo date, hi date, id int")
    b = spark.createDataFrame(points, "symbol string, date date")
    got = {(r["id"], r["date"]) for r in jn.interval_join(a, b, "symbol", "lo", "hi", "date", 32).collect()}
    assert got == {(i, p) for s, lo, hi, i in spans for t, p in points if s == t and lo <= p <= hi}


def test_next_row_after_is_strict(spark):
    left = spark.createDataFrame([("A", day(0), 1), ("A", day(5), 2), ("A", day(9), 3)], "symbol string, d date, id int")
    bars = spark.createDataFrame([("A", day(0), 1.0), ("A", day(5), 2.0), ("A", day(8), 3.0)], "symbol string, date date, open double")
    got = {r["id"]: (r["next_date"], r["open"]) for r in jn.next_row_after(left, bars, ["symbol"], "d", "date", ["open"]).collect()}
    assert got == {1: (day(5), 2.0), 2: (day(8), 3.0), 3: (None, None)}


def test_equity_curve_equals_a_loop(spark):
    rng = random.Random(7)
    rows = [("s", rng.choice("ABC") + str(i), day(rng.randint(0, 9)), rng.gauss(0, 50)) for i in range(200)]
    d = spark.createDataFrame(rows, "strategy string, symbol string, exit_date date, pnl double")
    got = tr.equity_curve(d, ["strategy"], "exit_date", ["symbol"], "pnl", 1000.0)
    got = {r["symbol"]: r for r in got.collect()}
    eq = peak = 1000.0
    for _, sym, _, pnl in sorted(rows, key=lambda r: (r[2], r[1])):
        prev, eq = eq, eq + pnl
        peak = max(peak, eq)
        assert math.isclose(got[sym]["equity"], eq, abs_tol=1e-8)
        assert math.isclose(got[sym]["event_return"], pnl / prev, abs_tol=1e-8)
        assert math.isclose(got[sym]["drawdown"], (eq - peak) / peak, abs_tol=1e-8)


def test_stop_wins_over_target_on_the_same_bar(path_bars):
    bars = path_bars({"A": [100.0, 100.0, 100.0, 100.0]})
    bars = bars.withColumn("high", F.when(F.dayofmonth("date") == 3, 150.0).otherwise(F.col("high")))
    bars = bars.withColumn("low", F.when(F.dayofmonth("date") == 3, 50.0).otherwise(F.col("low")))
    e = bars.limit(1).select("symbol", "date", F.lit("r").alias("rule_key"), F.lit("L2").alias("label"))
    got = tr.barrier_exits(bars, e, slippage=0.0).first()
    assert (got["exit_reason"], got["exit_price"], got["entry_date"]) == ("stop", 92.0, day(1))


def test_non_overlapping_equals_a_loop(path_bars):
    rng = random.Random(11)
    path = [100.0]
    for _ in range(250):
        path.append(path[-1] * math.exp(rng.gauss(0.002, 0.05)))
    got = tr.non_overlapping(path_bars({"A": path}), 10, 15, 0.2).orderBy("entry_date").collect()
    want, i, n = [], 0, len(path)
    while i < n:
        if i < 10 or path[i] <= max(path[i - 10 : i]):
            i += 1
            continue
        hit = next((j for j in range(i + 1, min(i + 16, n)) if path[j] >= path[i] * 1.2), None)
        x = hit if hit is not None else min(i + 15, n - 1)
        want.append((day(i), day(x), "tp" if hit is not None else "horizon" if i + 15 < n else "data_end"))
        i = x + 1
    assert [(r["entry_date"], r["exit_date"], r["exit_reason"]) for r in got] == want


def test_peak_capital(spark):
    d = spark.createDataFrame([(day(0), day(3), 10.0), (day(3), day(5), 5.0), (day(4), day(6), 1.0)], "o date, c date, cost double")
    assert tr.peak_capital(d, "o", "c", "cost").first()["peak_capital"] == 15.0


def test_many_rules_cost_no_more_plan_than_few(spark):
    rng = random.Random(2)
    d = spark.createDataFrame([(i, *[rng.choice([None, float("nan"), rng.random()]) for _ in range(3)], i % 3 == 0) for i in range(500)],
                              "id long, a double, b double, c double, is_winner boolean")
    rules = [Rule(f"r{i}", tuple((rng.choice("abc"), rng.choice(["<", "<=", ">", ">=", "==", "!="]), rng.random()) for _ in range(rng.randint(1, 4)))) for i in range(3000)]
    plan = lambda n: len(ru.evaluate(d, rules[:n])._jdf.queryExecution().optimizedPlan().toString())
    assert plan(3000) < 1.2 * plan(10)
    got = {r["rule_key"]: (r["coverage_n"], r["n_hit"]) for r in ru.evaluate(d, rules).collect()}
    import operator as o

    ops = {"<": o.lt, "<=": o.le, ">": o.gt, ">=": o.ge, "==": o.eq, "!=": o.ne}
    rows = d.collect()
    for rule in rules[::37]:
        hit = [r["is_winner"] for r in rows if all(r[f] is not None and not math.isnan(r[f]) and ops[op](r[f], t) for f, op, t in rule.conditions)]
        assert got.get(rule.key, (0, 0)) == (len(hit), sum(hit))


def test_rule_counts_by_group_with_null_group(spark):
    d = spark.createDataFrame([(g, float(i), i % 2 == 0) for i, g in enumerate(["x", None, "x", "y", None])], "g string, f double, is_winner boolean")
    got = {(r["g"], r["rule_key"]): (r["coverage_n"], r["n_hit"], r["n_rows"]) for r in ru.rule_counts(d, [Rule("r", (("f", ">=", 1.0),))], by=["g"]).collect()}
    assert got == {("x", "r"): (1, 1, 2), ("x", "*"): (2, 2, 2), (None, "r"): (2, 1, 2), (None, "*"): (2, 1, 2), ("y", "r"): (1, 0, 1), ("y", "*"): (1, 0, 1)}


def test_no_rows_and_no_rules(spark):
    d = spark.createDataFrame([], "symbol string, date date, f double, is_winner boolean")
    assert ru.evaluate(d, [Rule("r", (("f", ">", 0.0),))]).count() == 0
    assert ru.auc(d.withColumn("score", F.col("f")), "score", "is_winner").count() == 0
    full = spark.createDataFrame([("S", day(1), 1.0, True)], d.schema)
    assert ru.firings(full, [Rule("x", (("absent", ">", 0.0),))]).count() == 0


def test_two_stage_exit_by_hand(spark):
    bars = [("A", day(i), 10.0 + i, 10.5 + i, i in (4, 9)) for i in range(12)] + [("B", day(i), 5.0, 5.0, False) for i in range(4)] + [("C", day(i), 0.0, 1.0, False) for i in range(4)]
    df = spark.createDataFrame(bars, "symbol string, date date, open double, close_adj double, would_exit boolean")
    entries = spark.createDataFrame(
        [("A", day(0), 0.1), ("A", day(0), 0.9), ("A", day(4), 0.5), ("A", day(11), 0.5), ("B", day(0), 0.5), ("C", day(0), 0.5), ("Z", day(0), 0.5)],
        "symbol string, date date, signal_strength double",
    )
    got = {(r["symbol"], r["entry_date"]): r for r in tr.two_stage_exits(df, entries, 3, 6).collect()}
    assert set(got) == {("A", day(0)), ("A", day(4)), ("B", day(0))}
    a, b, c = got[("A", day(0))], got[("A", day(4))], got[("B", day(0))]
    assert (a["exit_reason"], a["exit_date"], a["days_held"], a["signal_strength"]) == ("exit_signal", day(4), 3, 0.9)
    assert (b["exit_reason"], b["exit_date"], b["days_held"]) == ("eligibility_cap", day(9), 4)
    assert (c["exit_reason"], c["days_held"], c["realized_gain_pct"]) == ("end_of_data", 2, 0.0)
    capped = {(r["symbol"], r["entry_date"]): r for r in tr.two_stage_exits(df, entries, 2, 2).collect()}
    assert (capped[("A", day(0))]["exit_reason"], capped[("A", day(0))]["days_held"]) == ("hard_cap", 2)


def test_spoiled_signals_are_named(spark):
    good = ("i1", "A", "2024-01-01", "ENTRY", 0.5)
    rows = [good, ("i2", "A", "2024-01-01", "HOLD", 0.5), ("i3", "A", "01/02/2024", "EXIT", 0.5), ("i4", "A", "2024-01-01", "EXIT", 1.5), good]
    s = spark.createDataFrame(rows, "signal_id string, symbol string, signal_date string, signal_type string, signal_strength double")
    assert sorted(r["invalid_reason"] or "" for r in sg.validate(s).collect()) == ["", "", "date", "strength", "type"]
    assert [r["signal_id"] for r in sg.duplicate_ids(s).collect()] == ["i1"]


def plain_exit(bars, i, label, slippage):
    """The exit of an entry on row ``i`` of one symbol's bars (date, open, low, high, close_adj), read forwards."""
    target, stop, days = tr.LABEL_EXITS.get(label, (None, None, None))
    fill = bars[i + 1][1]
    if fill is None or not fill > 0:
        return None
    price = fill * (1 + slippage)
    found = (bars[-1][0], bars[-1][4], "end_of_period")
    ahead = bars[i + 2 :]
    if days is not None:
        for d, _, low, high, _ in ahead[:days]:
            if low is not None and low <= price * (1 - stop):
                found = (d, price * (1 - stop), "stop")
                break
            if high is not None and high >= price * (1 + target):
                found = (d, price * (1 + target), "target")
                break
        else:
            if len(ahead) >= days:
                found = (ahead[days - 1][0], ahead[days - 1][4], "time")
    return bars[i + 1][0], price, found[0], None if found[1] is None else found[1] * (1 - slippage), found[2], i


def test_exits_of_a_stream_equal_a_loop_over_each_symbol(spark):
    rng = random.Random(4)
    rows, asked, want = [], [], {}
    for symbol, n in (("A", 150), ("B", 1), ("C", 2), ("D", 90)):
        bars = []
        for i in range(n):
            p = 100 + rng.gauss(0, 1 if i < 80 else 9)
            bar = [p, p - rng.random(), p + rng.random(), p]
            bars.append((date(2024, 1, 1) + timedelta(days=2 * i), *[None if rng.random() < 0.03 else x for x in bar]))
        rows += [(symbol, *b, i) for i, b in enumerate(bars)]
        for i, b in enumerate(bars):
            for label in rng.sample([*tr.LABEL_EXITS, "other"], rng.randint(0, 3)):
                for rule in ("r1", "r2"):
                    asked.append((symbol, b[0], rule, label))
                    if i + 1 < n and (out := plain_exit(bars, i, label, 0.001)):
                        want[symbol, b[0], rule, label] = out
        asked.append((symbol, date(2024, 1, 2), "r1", "L1"))  # a day without a bar
    asked += [("A", None, "r1", "L1"), (None, rows[0][1], "r1", "L1"), ("A", rows[0][1], "r1", None), ("E", rows[0][1], "r1", "L1")]
    rng.shuffle(rows)
    rows.append((None, *rows[0][1:]))
    kind = "symbol string, date date, open double, low double, high double, close_adj double, i int"
    entries = spark.createDataFrame([(s, d, f"{r} {label}", label) for s, d, r, label in asked], "symbol string, date date, rule_key string, label string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        d = tr.barrier_exits(spark.createDataFrame(rows, kind), entries, keep=["i"])
        got = {(r["symbol"], r["signal_date"], *r["rule_key"].split(" ")): tuple(r[3:]) for r in d.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == want and {w[4] for w in want.values()} == {"stop", "target", "time", "end_of_period"}
    plan = d._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Join" not in plan  # no symbol is one list, no entry is joined


def test_best_signals_sort_no_firings(spark):
    d = best_signals(Tables(spark, "/root/testdata/sf0.001"))
    assert "rule_key" in d.columns and "row_number" not in d._jdf.queryExecution().toString()
    per_day = d.groupBy("symbol", "date").count()
    assert per_day.where("count > 1").count() == 0
