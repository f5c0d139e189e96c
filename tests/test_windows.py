import math
import random

import numpy as np
import pytest
from rows import column
from pyspark.sql import functions as F

from tapeloom.functions.quantiles import exact_quantiles, running_before
from tapeloom.functions.windows import DAILY, emas, safe_corr, with_extremes, with_means
from tapeloom.operators.rules import auc
from tapeloom.operators.stats import pair_cells, positions, top_share
from tapeloom.session import staged, staging


def loop_ema(xs, span, warm):
    a, y, out, n = 2 / (span + 1), None, [], 0
    for x in xs:
        if x is not None:
            y = x if y is None else y + a * (x - y)
            n += 1
        out.append(y if n >= (span if warm else 1) else None)
    return out


@pytest.mark.parametrize("warm", [False, True])
def test_ema_equals_loop_over_many_blocks(path_bars, warm):
    rng = random.Random(3)
    xs = [100 + rng.gauss(0, 20) for _ in range(900)]
    d = emas(path_bars({"A": xs, "B": xs[::-1]}), {"e2": ("close", 2), "e9": ("close", 9)}, warmup=warm)
    for span in (2, 9):
        got, want = column(d, f"e{span}"), loop_ema(xs, span, warm)
        assert [g is None for g in got] == [w is None for w in want]
        assert np.allclose([g for g in got if g is not None], [w for w in want if w is not None], rtol=1e-12)


def test_ema_skips_leading_nulls(path_bars):
    d = path_bars({"A": list(range(1, 61))}).withColumn("x", F.when(F.col("close") > 20, F.col("close")))
    got = column(emas(d, {"e": ("x", 5)}, warmup=True), "e")
    want = loop_ema([None] * 20 + [float(x) for x in range(21, 61)], 5, True)
    assert [g is None for g in got] == [w is None for w in want]
    assert np.allclose(got[24:], want[24:])


def test_rolling_means_and_extremes_equal_direct_frames(path_bars):
    rng = random.Random(5)
    d = path_bars({"A": [rng.uniform(1, 9) for _ in range(300)], "B": [5.0] * 30})
    d = d.withColumn("x", F.when(F.dayofmonth("date") != 13, F.col("close")))
    d = with_means(d, {"m": ("x", 7), "z": ("close", 40)})
    d = with_extremes(d, {"hi": (F.max, "close", 60), "lo": (F.min, "x", 17), "one": (F.max, "close", 1)})
    d = d.withColumns(
        {
            "m0": DAILY.roll(F.avg, "x", 7),
            "z0": DAILY.roll(F.avg, "close", 40),
            "hi0": DAILY.roll(F.max, "close", 60),
            "lo0": DAILY.roll(F.min, "x", 17),
        }
    )
    for r in d.collect():
        for a, b in (("m", "m0"), ("z", "z0"), ("hi", "hi0"), ("lo", "lo0")):
            assert (r[a] is None) == (r[b] is None), (a, r)
            assert r[a] is None or math.isclose(r[a], r[b], rel_tol=1e-12)
        assert r["one"] == r["close"]


def test_correlation_of_a_constant_is_null(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "a double, b double")
    assert d.agg(safe_corr("a", "b").alias("c")).first()["c"] is None


def test_exact_quantiles_with_hot_ties_and_small_groups(spark):
    rng = np.random.default_rng(1)
    rows = [("big", float(x)) for x in rng.normal(size=6000)] + [("big", 0.25)] * 3000
    rows += [("small", float(x)) for x in rng.normal(size=47)] + [("one", 4.0)]
    d = spark.createDataFrame(rows, "g string, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["g"]: r for r in exact_quantiles(d, ["g"], "v", probs).collect()}
    for g in ("big", "small", "one"):
        vals = [v for k, v in rows if k == g]
        for name, p in probs.items():
            assert math.isclose(got[g][name], float(np.quantile(vals, p)), abs_tol=1e-12), (g, name)


def test_exact_quantiles_of_many_rows_use_the_bracket(spark):
    d = spark.range(60_000).select(((F.col("id") * 7919) % 60_013).cast("double").alias("v"))
    vals = [float((i * 7919) % 60_013) for i in range(60_000)]
    got = exact_quantiles(d, [], "v", {"p": 0.3333, "q": 0.95}).first()
    assert math.isclose(got["p"], float(np.quantile(vals, 0.3333))) and math.isclose(got["q"], float(np.quantile(vals, 0.95)))


def test_running_before_and_auc(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), rng.randint(0, 9) / 10, rng.randint(0, 1)) for _ in range(2000)]
    rows += [("x", 0.5, 1)] * 1000
    d = spark.createDataFrame(rows, "g string, s double, y int")
    for r in running_before(d.withColumn("o", F.lit(1)), ["g"], "s", ["o"], 8).collect():
        assert r["o_before"] == sum(1 for g, s, _ in rows if g == r["g"] and s < r["s"])
    for r in auc(d, "s", "y", ["g"]).collect():
        pos = [s for g, s, y in rows if g == r["g"] and y]
        neg = [s for g, s, y in rows if g == r["g"] and not y]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert math.isclose(r["auc"], want)


@pytest.mark.parametrize("hot", [0, 700])
def test_top_share_counts_ties_by_key(spark, hot):
    rng = random.Random(9)
    rows = [(f"s{rng.randint(0, 30):02d}", i, rng.randint(0, 20) / 10) for i in range(1000)]
    rows += [("s07", 5000 + i, 1.9) for i in range(hot)]
    d = spark.createDataFrame(rows, "symbol string, day int, score double")
    got = {(r["symbol"], r["day"]) for r in top_share(d, "score", ["symbol", "day"], 10).collect()}
    want = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[: max(1, len(rows) // 10)]
    assert got == {(s, i) for s, i, _ in want}


@pytest.mark.parametrize("n", [2, 5, 7])
def test_pair_cells_equal_plain_counts(spark, n):
    rng = random.Random(n)
    names = [f"f{i}" for i in range(n)]
    rows = [(rng.randint(0, 1), *[rng.choice([0, 1, 2, 3, None]) for _ in names]) for _ in range(400)]
    d = spark.createDataFrame(rows, "y int, " + ", ".join(f"q_{f} int" for f in names))
    got = {(r["x"], r["y"], r["qx"], r["qy"]): (r["w"], r["n"]) for r in pair_cells(d, names, "y").collect()}
    want = {}
    for row in rows:
        for i, x in enumerate(names):
            for j in range(i, n):
                if row[1 + i] is not None and row[1 + j] is not None:
                    k = (x, names[j], row[1 + i], row[1 + j])
                    w, c = want.get(k, (0, 0))
                    want[k] = (w + row[0], c + 1)
    assert got == want


def test_ema_of_spans_far_apart(path_bars):
    rng = random.Random(4)
    xs = [100 + rng.gauss(0, 20) for _ in range(3000)]
    d = emas(path_bars({"A": xs}), {"e3": ("close", 3), "e60": ("close", 60), "e500": ("close", 500)})
    for span in (3, 60, 500):
        assert np.allclose(column(d, f"e{span}"), loop_ema(xs, span, False), rtol=1e-10)


def test_one_bad_value_leaves_later_windows_alone(path_bars):
    xs = [float(i % 17 + 1) for i in range(300)]
    d = path_bars({"A": xs}).withColumn("x", F.when(F.col("close") == 5, F.lit(float("nan"))).when(F.col("close") == 9, float("inf")).otherwise(F.col("close")))
    d = d.withColumn("x", F.when(F.datediff("date", F.lit("2024-01-01")) > 40, F.col("close")).otherwise(F.col("x")))
    got = column(emas(with_means(d, {"m": ("x", 10)}), {"e": ("x", 5)}), "m")
    assert got[55:] == pytest.approx([sum(xs[i - 9 : i + 1]) / 10 for i in range(55, 300)])
    clean = [None if i <= 40 and x in (5.0, 9.0) else x for i, x in enumerate(xs)]
    assert column(emas(d, {"e": ("x", 5)}), "e") == pytest.approx(loop_ema(clean, 5, False))


def test_order_statistics_of_an_empty_frame(spark):
    d = spark.createDataFrame([], "g string, v double, n long")
    assert running_before(d, ["g"], "v", ["n"]).count() == 0
    assert exact_quantiles(d, ["g"], "v", {"q": 0.5}).count() == 0


def test_positions_in_groups_of_any_size(spark):
    rng = random.Random(7)
    rows = [(g, rng.randint(0, 50), i) for i, g in enumerate(["hot"] * 300 + ["a", "b", "b", None])]
    d = spark.createDataFrame(rows, "g string, v int, id int")
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((v, i) for x, v, i in rows if x == g)
        want |= {i: (k + 1, len(own)) for k, (_, i) in enumerate(own)}
    got = {r["id"]: (r["position"], r["n_group"]) for r in positions(d.where("g IS NOT NULL"), ["g"], ["v", "id"]).collect()}
    assert got == {i: p for i, p in want.items() if rows[i][0] is not None}
    whole = {r["id"]: r["position"] for r in positions(d, [], ["v", "id"]).collect()}
    assert whole == {i: k + 1 for k, (_, i) in enumerate(sorted((v, i) for _, v, i in rows))}


def test_staged_tables_go_with_their_owner(spark):
    import os

    with staging():
        a = staged(spark.range(5))
        path = a.staged_path.removeprefix("file:")
        assert os.path.isdir(path) and a.count() == 5
    assert not os.path.exists(path)
