"""Trailing features."""

from pyspark.sql import functions as F

from ..operators import features as fx
from .common import E, Tables, emit
from .registry import add_cte, div, lag, prior, query, roll, win

TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
add_cte("bars_tr", f"SELECT *, {TR} AS tr, {lag('close')} AS pc FROM bars")


# in units of price, where two places already are nine digits
MACD_COLS = ("macd_line", "macd_signal", "macd_hist")


def _simple(name, step, spec, body):
    @query(name, E("symbol d:date " + spec, body))
    def run(spark, sf):
        cols = [x.rpartition(":")[2] for x in spec.split()]
        return emit(step(Tables(spark, sf).series()), "symbol", "date", *cols, coarse=MACD_COLS)

    return run


_simple(
    "f1_sma_distance",
    fx.sma_distance,
    " ".join(f"f:close_over_sma_{n}" for n in (10, 20, 50, 200)),
    "SELECT symbol, date, "
    + ", ".join(f"{div('close', roll('avg', 'close', n))} AS close_over_sma_{n}" for n in (10, 20, 50, 200))
    + " FROM bars",
)
_simple(
    "f2_sma_slope",
    lambda d: fx.sma_slope(d, 50, 5),
    "f:sma50_slope_5d",
    f"SELECT *, {div('sma - ' + lag('sma', 5), lag('sma', 5))} AS sma50_slope_5d FROM "
    f"(SELECT *, {roll('avg', 'close', 50)} AS sma FROM bars)",
)
_simple(
    "f3_band_position",
    fx.band_position,
    "f:bb_position_20",
    "SELECT *, CASE WHEN sd > 0 THEN (close - m) / (2 * sd) END AS bb_position_20 FROM "
    f"(SELECT *, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS sd FROM bars)",
)
_simple(
    "f4_n_day_high_low",
    fx.n_day_high_low,
    " ".join(f"f:pct_of_{n}d_high f:pct_of_{n}d_low" for n in (20, 60, 252)),
    "SELECT symbol, date, "
    + ", ".join(
        f"{div('close', roll('max', 'high', n))} AS pct_of_{n}d_high, "
        f"{div('close', roll('min', 'low', n))} AS pct_of_{n}d_low"
        for n in (20, 60, 252)
    )
    + " FROM bars",
)
_simple(
    "f5_vol_mult",
    fx.vol_mult,
    " ".join(f"f:vol_mult_{n}" for n in (5, 10, 30, 60)),
    "SELECT symbol, date, "
    + ", ".join(f"{div('CAST(volume AS DOUBLE)', roll('avg', 'volume', n))} AS vol_mult_{n}" for n in (5, 10, 30, 60))
    + " FROM bars",
)
_simple(
    "f6_obv_slope",
    fx.obv_slope,
    "f:obv_slope_20d",
    f"SELECT *, {div('obv - ' + lag('obv', 20), roll('avg', 'volume', 20) + ' * 20')} AS obv_slope_20d FROM "
    f"(SELECT *, sum(sv) OVER {win('UNBOUNDED PRECEDING')} AS obv FROM "
    f"(SELECT *, coalesce(sign(close - {lag('close')}), 0) * CAST(volume AS DOUBLE) AS sv FROM bars))",
)
_simple(
    "f7_accumulation_distribution",
    fx.accumulation_distribution,
    "f:ad_line",
    "SELECT *, sum(CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume) "
    f"OVER {win('UNBOUNDED PRECEDING')} AS ad_line FROM bars",
)


@query("f8_true_range", E("symbol d:date f:tr", "SELECT * FROM bars_tr"))
def f8(spark, sf):
    return emit(Tables(spark, sf).bars().withColumn("tr", fx.true_range()), "symbol", "date", "tr")


_simple(
    "f9_atr_pct",
    fx.atr_pct,
    "f:atr_pct_14",
    f"SELECT *, {div(roll('avg', 'tr', 14), 'close')} AS atr_pct_14 FROM bars_tr",
)
_simple(
    "f10_bb_squeeze",
    fx.bb_squeeze,
    "f:bb_squeeze_20",
    f"SELECT *, {div('4.0 * ' + roll('stddev_samp', 'close', 20), roll('avg', 'close', 20))} AS bb_squeeze_20 FROM bars",
)
_simple(
    "f11_nr4_nr7",
    fx.nr4_nr7,
    "b:is_nr4 b:is_nr7",
    f"SELECT *, tr = {roll('min', 'tr', 4)} AS is_nr4, tr = {roll('min', 'tr', 7)} AS is_nr7 FROM bars_tr",
)
_simple(
    "f12_hv_ratio",
    fx.hv_ratio,
    "f:hv_ratio_10_60",
    f"SELECT *, {div(roll('stddev_samp', 'lr', 10), roll('stddev_samp', 'lr', 60))} AS hv_ratio_10_60 "
    "FROM (SELECT *, ln(close / nullif(pc, 0)) AS lr FROM bars_tr)",
)
add_cte(
    "gains",
    "SELECT *, greatest(coalesce(close - pc, 0), 0) AS g, greatest(-coalesce(close - pc, 0), 0) AS l FROM bars_tr",
)


def rsi_sql(n):
    g, lo = roll("avg", "g", n), roll("avg", "l", n)
    return f"CASE WHEN {lo} = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + {div(g, lo)}) END AS rsi_{n}"


_simple(
    "f13_rsi",
    fx.rsi,
    "f:rsi_2 f:rsi_5 f:rsi_14",
    f"SELECT *, {rsi_sql(2)}, {rsi_sql(5)}, {rsi_sql(14)} FROM gains",
)

# exponential means as a recursion over the row number
add_cte("bars_n", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars")
MACD_WITH = """WITH RECURSIVE e AS (
    SELECT symbol, date, i, close, close AS f, close AS s,
           CAST(NULL AS DOUBLE) AS sg FROM bars_n WHERE i = 1
    UNION ALL
    SELECT b.symbol, b.date, b.i, b.close,
           e.f + (2.0 / 13) * (b.close - e.f), e.s + (2.0 / 27) * (b.close - e.s),
           CASE WHEN b.i < 26 THEN NULL
                WHEN b.i = 26 THEN (e.f + (2.0 / 13) * (b.close - e.f)) - (e.s + (2.0 / 27) * (b.close - e.s))
                ELSE e.sg + 0.2 * ((e.f + (2.0 / 13) * (b.close - e.f)) - (e.s + (2.0 / 27) * (b.close - e.s)) - e.sg) END
    FROM e JOIN bars_n b ON b.symbol = e.symbol AND b.i = e.i + 1)
"""
_simple(
    "f14_macd",
    fx.macd,
    "g:macd_line g:macd_signal g:macd_hist",
    MACD_WITH + "SELECT symbol, date, CASE WHEN i >= 26 THEN f - s END AS macd_line, "
    "CASE WHEN i >= 34 THEN sg END AS macd_signal, CASE WHEN i >= 34 THEN f - s - sg END AS macd_hist FROM e",
)
_simple(
    "f15_roc",
    fx.roc,
    "f:roc_5 f:roc_10 f:roc_20 f:roc_60",
    "SELECT symbol, date, " + ", ".join(f"{div('close', lag('close', n))} - 1 AS roc_{n}" for n in (5, 10, 20, 60)) + " FROM bars",
)
_simple(
    "f16_consecutive_run",
    fx.consecutive_run,
    "i:consec_up i:consec_down",
    "SELECT *, sum(u) OVER (PARTITION BY symbol, ub ORDER BY date) AS consec_up, "
    "sum(d) OVER (PARTITION BY symbol, db ORDER BY date) AS consec_down FROM "
    f"(SELECT *, sum(1 - u) OVER {win('UNBOUNDED PRECEDING')} AS ub, sum(1 - d) OVER {win('UNBOUNDED PRECEDING')} AS db FROM "
    "(SELECT *, CAST(coalesce(close - pc, 0) > 0 AS INT) AS u, CAST(coalesce(close - pc, 0) < 0 AS INT) AS d FROM bars_tr))",
)
_simple("f17_gap_pct", fx.gap_pct, "f:gap_pct", f"SELECT *, {div('open - pc', 'pc')} AS gap_pct FROM bars_tr")
_simple(
    "f18_range_expansion",
    fx.range_expansion,
    "f:range_expansion_5d",
    f"SELECT *, {div('tr', prior('avg', 'tr', 5))} AS range_expansion_5d FROM bars_tr",
)
_simple(
    "f19_body_range_ratio",
    fx.body_range_ratio,
    "f:body_range_ratio",
    "SELECT *, CASE WHEN high > low THEN abs(close - open) / (high - low) END AS body_range_ratio FROM bars",
)
_simple(
    "f20_inside_bar",
    fx.inside_bar,
    "b:is_inside_bar",
    f"SELECT *, high < {lag('high')} AND low > {lag('low')} AS is_inside_bar FROM bars",
)

add_cte("market_ret", f"SELECT date, {div('close', 'lag(close, 20) OVER (ORDER BY date)')} - 1 AS b FROM market")
add_cte("sym_ret", f"SELECT *, {div('close', lag('close', 20))} - 1 AS s FROM bars")


@query(
    "f21_rel_strength_benchmark",
    E("symbol d:date g:rs_spy_20d", f"SELECT *, {div('s', 'b')} AS rs_spy_20d FROM sym_ret LEFT JOIN market_ret USING (date)"),
)
def f21(spark, sf):
    t = Tables(spark, sf)
    return emit(fx.rel_strength_spy(t.bars(), t.market()), "symbol", "date", "rs_spy_20d", coarse=("rs_spy_20d",))


@query(
    "f22_rel_strength_sector",
    E(
        "symbol d:date g:rs_sector_20d",
        f"SELECT symbol, date, {div('s', 'avg(s) OVER (PARTITION BY date, peer_group)')} AS rs_sector_20d "
        "FROM sym_ret JOIN peers USING (symbol)",
    ),
)
def f22(spark, sf):
    t = Tables(spark, sf)
    return emit(fx.rel_strength_sector(t.bars(), t.peers()), "symbol", "date", "rs_sector_20d", coarse=("rs_sector_20d",))


@query(
    "f23_peer_zscore",
    E(
        "symbol d:date f:close_over_sma_20_peer_z",
        "SELECT *, CASE WHEN sd > 0 AND n >= 2 THEN (x - m) / sd END AS close_over_sma_20_peer_z FROM "
        "(SELECT *, avg(x) OVER g AS m, stddev_samp(x) OVER g AS sd, count(*) OVER g AS n FROM "
        f"(SELECT *, {div('close', roll('avg', 'close', 20))} AS x FROM bars) JOIN peers USING (symbol) "
        "WINDOW g AS (PARTITION BY date, peer_group))",
    ),
)
def f23(spark, sf):
    t = Tables(spark, sf)
    d = fx.sma_distance(t.bars(), (20,))
    return emit(fx.peer_zscore(d, t.peers(), "close_over_sma_20"), "symbol", "date", "close_over_sma_20_peer_z")


_simple(
    "f24_days_since_event",
    fx.days_since_last_20pct,
    "i:days_since_last_20pct",
    f"SELECT *, i - last_value(ev IGNORE NULLS) OVER {win('UNBOUNDED PRECEDING')} AS days_since_last_20pct FROM "
    f"(SELECT *, CASE WHEN hit AND NOT coalesce({lag('hit')}, false) THEN i END AS ev FROM "
    f"(SELECT *, coalesce({div('close', prior('min', 'close', 30))} >= 1.2, false) AS hit FROM bars_n))",
)
add_cte(
    "regimes",
    "SELECT date, CASE WHEN close > a AND a > b THEN 'uptrend' WHEN close < a AND a < b THEN 'downtrend' "
    f"ELSE 'chop' END AS regime_label FROM (SELECT *, {roll('avg', 'close', 50, part='')} AS a, "
    f"{roll('avg', 'close', 200, part='')} AS b FROM market)",
)


@query("f25_market_regime", E("d:date market_regime", "SELECT date, regime_label AS market_regime FROM regimes"))
def f25(spark, sf):
    return emit(fx.market_regime(Tables(spark, sf).market()), "date", "market_regime")


FEATURE_MATRIX = f"""
  SELECT *, {div('s', 'sec')} AS rs_sector_20d, {div('s', 'b')} AS rs_spy_20d,
         CASE WHEN zsd > 0 AND zn >= 2 THEN (close_over_sma_20 - zm) / zsd END AS close_over_sma_20_peer_z,
         regime_label AS market_regime
  FROM (SELECT *, avg(s) OVER g AS sec, avg(close_over_sma_20) OVER g AS zm,
               stddev_samp(close_over_sma_20) OVER g AS zsd, count(*) OVER g AS zn FROM (
    SELECT *, {div('close', lag('close', 20))} - 1 AS s,
      {", ".join(f"{div('close', roll('avg', 'close', n))} AS close_over_sma_{n}" for n in (10, 20, 50, 200))},
      {div('sma20 - ' + lag('sma20', 5), lag('sma20', 5))} AS sma20_slope_5d,
      {div('sma50 - ' + lag('sma50', 5), lag('sma50', 5))} AS sma50_slope_5d,
      CASE WHEN sd20 > 0 THEN (close - sma20) / (2 * sd20) END AS bb_position_20,
      {", ".join(f"{div('close', roll('max', 'high', n))} AS pct_of_{n}d_high, {div('close', roll('min', 'low', n))} AS pct_of_{n}d_low" for n in (20, 60, 252))},
      {", ".join(f"{div('CAST(volume AS DOUBLE)', roll('avg', 'volume', n))} AS vol_mult_{n}" for n in (5, 10, 30, 60))},
      {div('obv - ' + lag('obv', 20), roll('avg', 'volume', 20) + ' * 20')} AS obv_slope_20d,
      {div(roll('avg', 'tr', 14), 'close')} AS atr_pct_14, {div('4.0 * sd20', 'sma20')} AS bb_squeeze_20,
      tr = {roll('min', 'tr', 4)} AS is_nr4, tr = {roll('min', 'tr', 7)} AS is_nr7,
      {div(roll('stddev_samp', 'lr', 10), roll('stddev_samp', 'lr', 60))} AS hv_ratio_10_60,
      {rsi_sql(2)}, {rsi_sql(5)}, {rsi_sql(14)},
      {", ".join(f"{div('close', lag('close', n))} - 1 AS roc_{n}" for n in (5, 10, 20, 60))},
      {div('open - pc', 'pc')} AS gap_pct, {div('tr', prior('avg', 'tr', 5))} AS range_expansion_5d,
      CASE WHEN high > low THEN abs(close - open) / (high - low) END AS body_range_ratio,
      high < {lag('high')} AND low > {lag('low')} AS is_inside_bar,
      i - last_value(ev IGNORE NULLS) OVER {win('UNBOUNDED PRECEDING')} AS days_since_last_20pct
    FROM (SELECT *, CASE WHEN hit AND NOT coalesce({lag('hit')}, false) THEN i END AS ev FROM (SELECT *, {roll('avg', 'close', 20)} AS sma20, {roll('avg', 'close', 50)} AS sma50,
                 {roll('stddev_samp', 'close', 20)} AS sd20, ln(close / nullif(pc, 0)) AS lr,
                 sum(coalesce(sign(close - pc), 0) * volume) OVER {win('UNBOUNDED PRECEDING')} AS obv,
                 sum(CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume)
                   OVER {win('UNBOUNDED PRECEDING')} AS ad_line,
                 row_number() OVER (PARTITION BY symbol ORDER BY date) AS i,
                 coalesce({div('close', prior('min', 'close', 30))} >= 1.2, false) AS hit
          FROM gains)))
    JOIN peers USING (symbol)
    WINDOW g AS (PARTITION BY date, peer_group))
  LEFT JOIN market_ret USING (date) LEFT JOIN regimes USING (date)"""
add_cte("features", FEATURE_MATRIX)

MATRIX_SPEC = (
    " ".join(f"f:close_over_sma_{n}" for n in (10, 20, 50, 200))
    + " f:sma20_slope_5d f:sma50_slope_5d f:bb_position_20 "
    + " ".join(f"f:pct_of_{n}d_high f:pct_of_{n}d_low" for n in (20, 60, 252))
    + " " + " ".join(f"f:vol_mult_{n}" for n in (5, 10, 30, 60))
    + " f:obv_slope_20d f:ad_line f:atr_pct_14 f:bb_squeeze_20 b:is_nr4 b:is_nr7 f:hv_ratio_10_60 f:rsi_2 f:rsi_5 f:rsi_14 "
    + " ".join(f"f:roc_{n}" for n in (5, 10, 20, 60))
    + " f:gap_pct f:range_expansion_5d f:body_range_ratio b:is_inside_bar i:days_since_last_20pct"
    + " g:rs_sector_20d f:close_over_sma_20_peer_z g:rs_spy_20d market_regime"
)


def feature_matrix(t: Tables):
    return fx.build_features(t.series(), t.market(), t.peers())


add_cte(
    "macd",
    MACD_WITH + "SELECT symbol, date, CASE WHEN i >= 34 THEN f - s - sg END AS macd_hist FROM e",
)
MATRIX_MACD = " g:macd_line g:macd_signal g:macd_hist i:consec_up i:consec_down"


@query(
    "f26_feature_matrix",
    E(
        "symbol d:date " + MATRIX_SPEC + MATRIX_MACD,
        MACD_WITH
        + ", m AS (SELECT symbol, date, CASE WHEN i >= 26 THEN f - s END AS macd_line, CASE WHEN i >= 34 THEN sg END AS macd_signal, "
        "CASE WHEN i >= 34 THEN f - s - sg END AS macd_hist FROM e), "
        "r AS (SELECT symbol, date, sum(u) OVER (PARTITION BY symbol, ub ORDER BY date) AS consec_up, "
        "sum(d) OVER (PARTITION BY symbol, db ORDER BY date) AS consec_down FROM "
        f"(SELECT *, sum(1 - u) OVER {win('UNBOUNDED PRECEDING')} AS ub, sum(1 - d) OVER {win('UNBOUNDED PRECEDING')} AS db FROM "
        "(SELECT *, CAST(coalesce(close - pc, 0) > 0 AS INT) AS u, CAST(coalesce(close - pc, 0) < 0 AS INT) AS d FROM bars_tr))) "
        "SELECT * FROM features JOIN m USING (symbol, date) JOIN r USING (symbol, date)",
    ),
)
def f26(spark, sf):
    cols = [x.rpartition(":")[2] for x in (MATRIX_SPEC + MATRIX_MACD).split()]
    return emit(feature_matrix(Tables(spark, sf, share=True)), "symbol", "date", *cols, coarse=("rs_sector_20d", "rs_spy_20d", *MACD_COLS))


_P = "close_adj"


def _scan_cte(threshold):
    w30 = win("1 FOLLOWING", "30 FOLLOWING")
    return f"""
  SELECT symbol, date, hl_pct, {roll('avg', 'hl_pct', 14)} AS atr_pct_14,
    {div(_P, roll('max', _P, 252))} AS pct_of_252d_high, {div(_P, roll('min', _P, 252))} AS pct_of_252d_low,
    {div(_P, roll('avg', _P, 20))} AS close_over_sma_20, {div(_P, roll('avg', _P, 50))} AS close_over_sma_50,
    {div(_P, roll('avg', _P, 200))} AS close_over_sma_200,
    {div('CAST(volume AS DOUBLE)', roll('avg', 'volume', 20))} AS vol_ratio_20, {roll('stddev_samp', 'r1', 20)} AS rvol_20,
    {div(_P, lag(_P, 5))} - 1 AS ret_5d, {div(_P, lag(_P, 20))} - 1 AS ret_20d, {div(_P, lag(_P, 60))} - 1 AS ret_60d,
    {div(_P, roll('max', _P, 30))} AS distance_from_max_30, {div(_P, roll('min', _P, 30))} AS distance_from_min_30,
    CAST(CASE WHEN i >= 30 AND count({_P}) OVER {w30} = 30 THEN max({_P}) OVER {w30} END / nullif({_P}, 0) >= {1 + threshold} AS INT) AS winner
  FROM (SELECT *, {div('high - low', 'close')} AS hl_pct, {div(_P, lag(_P))} - 1 AS r1 FROM bars_n)"""


add_cte("scan", _scan_cte(2.0))


@query("f27_scan_features", E("symbol d:date winner " + " ".join("f:" + c for c in fx.SCAN_FEATURES), "SELECT * FROM scan"))
def f27(spark, sf):
    return emit(fx.scan_features(Tables(spark, sf).series(), 2.0), "symbol", "date", "winner", *fx.SCAN_FEATURES)


def _m(agg, x, n):
    return roll(agg, x, n, part="")


add_cte(
    "panel",
    f"""SELECT date, close, {div('close', 'lag(close, 30) OVER (ORDER BY date)')} - 1 AS r_30d,
   {div('close', 'lag(close, 60) OVER (ORDER BY date)')} - 1 AS r_60d,
   (close - {_m('max', 'close', 60)}) / nullif({_m('max', 'close', 60)}, 0) AS drawdown_60d,
   {div(_m('avg', 'close', 50), _m('avg', 'close', 200))} AS sma_ratio,
   {div(_m('stddev_samp', 'r', 30), _m('stddev_samp', 'r', 60))} AS vol_ratio
   FROM (SELECT *, {div('close', 'lag(close) OVER (ORDER BY date)')} - 1 AS r FROM market)""",
)


@query("f28_panel_features", E("d:date f:r_30d f:r_60d f:drawdown_60d f:sma_ratio f:vol_ratio", "SELECT * FROM panel"))
def f28(spark, sf):
    d = fx.panel_features(Tables(spark, sf).market())
    return emit(d, "date", "r_30d", "r_60d", "drawdown_60d", "sma_ratio", "vol_ratio")


_T = win("251 PRECEDING", "1 PRECEDING", part="")
add_cte(
    "terciles",
    f"""SELECT date, vol_30d, CASE WHEN n >= 60 AND vol_30d <= lo THEN 'low' WHEN n >= 60 AND vol_30d >= hi THEN 'high'
       ELSE 'mid' END AS vol_tercile FROM (
     SELECT *, count(vol_30d) OVER {_T} AS n, quantile_cont(vol_30d, 0.3333) OVER {_T} AS lo,
            quantile_cont(vol_30d, 0.6667) OVER {_T} AS hi FROM (
       SELECT date, {_m('stddev_samp', 'lr', 30)} AS vol_30d FROM (
         SELECT date, ln(close) - ln(lag(close) OVER (ORDER BY date)) AS lr FROM market)))""",
)


@query("f29_vol_tercile", E("d:date f:vol_30d vol_tercile", "SELECT * FROM terciles"))
def f29(spark, sf):
    return emit(fx.vol_terciles(Tables(spark, sf).market()), "date", "vol_30d", "vol_tercile")
