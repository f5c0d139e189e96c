import math

import pytest
from rows import column
from pyspark.sql import functions as F

from tapeloom.operators import features as fx
from tapeloom.operators import labels as lb
from tapeloom.operators import predicates as pr
from tapeloom.operators import timebars as tb


def test_flat_series(path_bars):
    d = path_bars({"A": [50.0] * 30})
    assert column(fx.sma_distance(d, (10,)), "close_over_sma_10")[9:] == [1.0] * 21
    assert column(fx.sma_distance(d, (10,)), "close_over_sma_10")[:9] == [None] * 9
    assert column(fx.band_position(d), "bb_position_20")[-1] is None
    assert column(fx.rsi(d, (2,)), "rsi_2")[0] is None
    assert column(fx.rsi(d, (2,)), "rsi_2")[1:] == [100.0] * 29


def test_symbols_do_not_mix(path_bars):
    d = fx.roc(path_bars({"A": [10.0] * 10, "B": [20.0] * 10}), (5,))
    assert column(d, "roc_5", "B")[:5] == [None] * 5
    assert column(d, "roc_5", "B")[5:] == [0.0] * 5


def test_zero_volume_gives_null_not_infinity(path_bars):
    assert set(column(fx.vol_mult(path_bars({"A": [1.0] * 12}, 0), (5,)), "vol_mult_5")) == {None}


def test_runs(path_bars):
    d = fx.consecutive_run(path_bars({"A": [1, 2, 3, 3, 2, 1, 2]}))
    assert column(d, "consec_up") == [0, 1, 2, 0, 0, 0, 1]
    assert column(d, "consec_down") == [0, 0, 0, 0, 1, 2, 0]


def test_inside_bar_and_range_expansion(spark, path_bars):
    d = path_bars({"A": [10, 10, 10]}).withColumn("high", F.when(F.dayofmonth("date") == 3, 10.05).otherwise(F.col("high")))
    d = d.withColumn("low", F.when(F.dayofmonth("date") == 3, 9.95).otherwise(F.col("low")))
    assert column(fx.inside_bar(d), "is_inside_bar") == [None, False, True]


def test_event_recency_counts_from_the_first_day_of_a_run(path_bars):
    d = fx.days_since_last_20pct(path_bars({"A": [100.0] * 30 + [130.0, 131.0, 132.0]}))
    assert column(d, "days_since_last_20pct")[29:] == [None, 0, 1, 2]


def test_matrix_equals_single_functions(spark, path_bars):
    import random

    rng = random.Random(4)
    bars = path_bars({s: [100 * math.exp(rng.gauss(0, 0.1)) for _ in range(280)] for s in "ABC"})
    groups = spark.createDataFrame([("A", "g"), ("B", "g"), ("C", "h")], "symbol string, peer_group string")
    market = bars.groupBy("date").agg(F.avg("close").alias("close"))
    wide = fx.build_features(bars, market, groups)
    one = bars
    for step in (fx.sma_distance, fx.sma_slope, fx.band_position, fx.n_day_high_low, fx.vol_mult, fx.obv_slope, fx.atr_pct,
                 fx.bb_squeeze, fx.nr4_nr7, fx.hv_ratio, fx.rsi, fx.macd, fx.consecutive_run, fx.range_expansion,
                 fx.accumulation_distribution, fx.days_since_last_20pct):
        one = step(one)
    one = fx.peer_zscore(one, groups, "close_over_sma_20")
    names = [c for c in one.columns if c not in bars.columns]
    a = {(r["symbol"], r["date"]): r for r in wide.collect()}
    for r in one.collect():
        for c in names:
            x, y = a[(r["symbol"], r["date"])][c], r[c]
            assert (x is None) == (y is None), c
            assert x is None or math.isclose(float(x), float(y), rel_tol=1e-9, abs_tol=1e-9), c


SPEC = lb.SustainedSpec("standard", 20.0, 10.0)


@pytest.mark.parametrize(
    "path, want",
    [
        ([100, 105, 110, 115, 120, 125] + [115] * 14 + [112], True),
        ([100, 110, 120, 125, 128, 130] + [109] * 14 + [108], False),
        ([0.5] + [0.7] * 19 + [0.6], None),
    ],
)
def test_sustained_winner_first_row(path_bars, path, want):
    assert column(lb.sustained_winner(path_bars({"A": path}), SPEC), SPEC.label_column())[0] is want


def test_sustained_winner_needs_a_whole_window(path_bars):
    assert set(column(lb.sustained_winner(path_bars({"A": [100] * 15}), SPEC), SPEC.label_column())) == {None}


def test_forward_label_is_null_on_the_last_rows(path_bars):
    got = column(lb.forward_winner(path_bars({"A": [100] * 5 + [125] + [100] * 4}), 3, 0.2), "is_winner")
    assert got == [False, False, True, True, True, False, False, None, None, None]
    with pytest.raises(ValueError):
        lb.forward_winner(path_bars({"A": [1]}), 0)


def test_first_touch_counts_even_when_the_window_is_incomplete(path_bars):
    d = lb.first_touch_return(path_bars({"A": [100, 100, 130, 100]}), 60, 20.0)
    assert column(d, "bsq_hold_trading_days") == [2, 1, None, None]
    assert column(d, "bsq_exit_reason") == ["target_hit", "target_hit", "day60_cap", "day60_cap"]


def test_sweep_names_fall():
    assert [s.name for s in lb.sweep_specs()][:2] == ["g20", "g19"] and len(lb.sweep_specs()) == 20


def test_exit_label_scales_with_the_gain(path_bars):
    d = lb.exit_labels(path_bars({"A": [100] * 20 + [130] * 20 + [100] * 5}), 15.0, 20, 20, 66.0)
    assert {r["exit_label"] for r in d.collect()} <= {0, 1}
    assert d.where("exit_label = 1").count() > 0


def test_split_is_disjoint_and_complete(path_bars):
    from datetime import date

    d = pr.split_by_date(path_bars({"A": range(1, 31)}), date(2024, 1, 10), date(2024, 1, 20))
    assert {r["split"]: r["count"] for r in d.groupBy("split").count().collect()} == {"train": 10, "val": 10, "holdout": 10}
    with pytest.raises(ValueError):
        pr.split_by_date(d, date(2024, 1, 2), date(2024, 1, 2))


def test_sliding_windows_drop_short_symbols(path_bars):
    d = path_bars({"A": [1.0] * 70, "B": [1.0] * 20}).withColumn("y", F.when(F.dayofmonth("date") != 10, F.lit(True)))
    got = tb.sliding_windows(d, "y").groupBy("symbol").count().collect()
    assert [(r["symbol"], r["count"]) for r in got] == [("A", 10)]


def test_interval_choice():
    assert tb.choose_interval({60, 5}, 240) == 60 and tb.choose_interval({60, 5}, 5) == 5
    with pytest.raises(FileNotFoundError):
        tb.choose_interval({60}, 15)
