"""What keeps time, disk and shuffles in proportion: timers of streams, plans without copies of the rows."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.windows import DAILY
from tapeloom.operators import features as fx
from tapeloom.operators import stats as st
from tapeloom.plans.common import rounded
from tapeloom.sources.tables import Tables
from tapeloom.streaming import stateful as sx


class _Cell:
    def __init__(self):
        self.held = {}

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held.get(0)

    def update(self, value):
        self.held[0] = value

    def clear(self):
        self.held.clear()

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]

    def iterator(self):
        return iter(list(self.held.items()))


class _Handle:
    def __init__(self):
        self.timers, self.calls = set(), 0

    def getValueState(self, *_):
        return _Cell()

    getMapState = getListState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class _At:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


def _expire(p, handle, key, mark):
    out = []
    while due := [t for t in handle.timers if t < mark]:
        handle.timers.remove(min(due))
        out += list(p.handleExpiredTimer(key, _At(mark), None))
    return out


def test_cooldown_has_one_timer_a_key():
    handle, p = _Handle(), sx._Cooldown(30)
    p.init(handle)
    list(p.handleInputRows(("s", "r"), iter([pd.DataFrame({"day": np.arange(100, 300)})]), None))
    assert len(handle.timers) == handle.calls == 1
    kept = pd.concat(_expire(p, handle, ("s", "r"), 250 * sx.DAY_MS))["day"].tolist()
    list(p.handleInputRows(("s", "r"), iter([pd.DataFrame({"day": [270]})]), None))
    assert len(handle.timers) == 1
    kept += pd.concat(_expire(p, handle, ("s", "r"), 400 * sx.DAY_MS))["day"].tolist()
    assert kept == [100, 131, 162, 193, 224, 255, 286] and not handle.timers and handle.calls < 5


def test_rolling_notional_has_one_timer_an_account():
    handle, p = _Handle(), sx._Rolling(3)
    p.init(handle)
    at = np.arange(0, 500) * sx.SLOT_US
    list(p.handleInputRows((1,), iter([pd.DataFrame({"at": at, "fill_id": np.arange(500), "x": 1.0})]), None))
    assert len(handle.timers) == handle.calls == 1
    got = pd.concat(_expire(p, handle, (1,), 10**10))
    assert got["volume_30d"].tolist() == [float(min(i, 72)) for i in range(500)]
    assert not handle.timers and handle.calls < 4


def test_hurst_repeats_no_row_for_the_lags(path_bars, capsys):
    rng = np.random.default_rng(1)
    bars = path_bars({"a": (100 + rng.normal(size=300).cumsum()).tolist(), "flat": [5.0] * 80, "short": [1.0, 2.0, 3.0]})
    got = {r["symbol"]: r["hurst"] for r in st.hurst(bars, DAILY).collect()}
    assert set(got) == {"a"} and 0.3 < got["a"] < 1.2
    st.hurst(bars, DAILY).explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and "Generate" not in plan


def test_a_missing_close_adds_nothing_to_its_segment():
    x = np.array([1.0, np.nan, 3.0, 2.0, np.nan, 4.0, 5.0, 9.0])
    assert st._exponent(x, [2, 3, 4]) is not None and st._exponent(x, [4]) == 0.5
    assert st._exponent(np.ones(20), [2, 3]) is None


@pytest.fixture
def no_small_tables(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_wide_rows_are_not_dealt_by_date(spark, path_bars, no_small_tables, capsys):
    bars = path_bars({"a": [1, 2, 3], "b": [2, 3, 4]})
    groups = spark.createDataFrame([("a", "g"), ("b", "g")], "symbol string, peer_group string")
    market = bars.groupBy("date").agg({"close": "avg"}).withColumnRenamed("avg(close)", "close")
    fx.build_features(bars, market, groups).explain()
    assert capsys.readouterr().out.count("BroadcastHashJoin") == 2


def test_generated_code_stays_small_enough_to_be_compiled(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        Tables(spark, "/nowhere")
        assert spark.conf.get(key) == "8000"
        spark.conf.set(key, "5000")
        Tables(spark, "/nowhere")
        assert spark.conf.get(key) == "5000"  # the session's own limit stays
    finally:
        spark.conf.set(key, before)


def test_rounded_equals_round_bit_for_bit(spark, capsys):
    rng = random.Random(7)
    odd = [None, 0.0, -0.0, 0.5e-6, -0.5e-6, 1.5e-6, 2.675, 1.005, -1e-9, 1e-320, 1e300, 2.0**52 + 0.5, 2.0**34, float("nan"), float("inf"), -float("inf")]
    odd += [k + 0.5 for k in range(-5, 5)] + [(k + 0.5) / 1e6 for k in range(-200, 200)] + [(k + 0.5) / 100 for k in range(-200, 200)]
    odd += [math.nextafter((k + 0.5) / 1e6, side) for k in range(200) for side in (-1, 1)]
    odd += [rng.choice((-1, 1)) * rng.random() * 10.0 ** rng.randint(-8, 12) for _ in range(5000)]
    df = spark.createDataFrame([(x,) for x in odd], "x double")
    for places in (2, 6):
        got = df.select(rounded(F.col("x"), places).alias("a"), F.round("x", places).alias("b"))
        apart = got.where(~F.col("a").eqNullSafe(F.col("b")) | (F.col("a").cast("string") != F.col("b").cast("string")))
        assert apart.count() == 0
    # a plain value never comes to the decimal
    df.select(rounded(F.col("x"), 6)).explain()
    assert "CASE WHEN" in capsys.readouterr().out
