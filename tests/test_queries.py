"""Registered queries against their SQL on the smallest tables; TAPELOOM_ALL=1 runs every one."""

import os

import duckdb
import pytest

import tapeloom.plans as plans

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUICK = (
    "f1_sma_distance f9_atr_pct f14_macd f23_peer_zscore l5_sustained_winner l8_first_touch_return l12_sector_rank u4_rule_evaluation "
    "u11_cooldown_dedup x4_non_overlapping_trades x17_daily_portfolio_curve k2_top_per_day q4_hurst b1_bars_from_ticks b2_asof_align "
    "i3_supertrend i8_rolling_volume_fees g3_crypto_block p9_discrete_regime_score v5_nearest_losers_euclidean s10_groups_hash"
).split()
NAMES = sorted(plans.ORACLES) if os.environ.get("TAPELOOM_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    return "~" if v is None else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    rel = con.sql(plans.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    pos = [rel.columns.index(c) for c in cols]
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    want = sorted(tuple(norm(r[i]) for i in pos) for r in rel.fetchall())
    assert got == want


def test_registry_is_whole():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
    assert len(plans.QUERIES) > 200


def test_flagship(spark):
    assert plans.flagship(spark, SF).count() > 0
