"""Regime panel, labels, folds, predicates."""

from functools import reduce

from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..operators import features as fx
from ..operators import labels as lb
from ..operators import models as md
from ..operators import predicates as pr
from ..operators import regime as rg
from ..operators import stats as st
from ..session import staged
from .common import E, Tables, emit
from .q_features import feature_matrix
from .q_rules import rule_frame
from .q_stats import sym_metrics
from .registry import add_cte, query, roll, win


def R0(agg, x, n):
    return roll(agg, x, n, part="")


def lag0(x, n=1):
    return f"lag({x}, {n}) OVER (ORDER BY date)"


_KN = "drawdown_60d IS NULL OR r_30d IS NULL OR r_60d IS NULL OR sma_ratio IS NULL OR vol_ratio IS NULL"


def _pick(scores):
    best = "greatest(b, c, s, q)"
    return (
        f"SELECT date, CASE WHEN {_KN} THEN 'sideways_range' WHEN b = {best} THEN 'bear_trend' WHEN c = {best} THEN 'choppy_recovery' WHEN s = {best} THEN 'steady_bull' ELSE 'sideways_range' END AS regime_label, "
        f"CASE WHEN {_KN} THEN 0.5 ELSE {best} END AS regime_confidence FROM ({scores})"
    )


def _disc(t):
    b, c, s, q = t["bear"], t["chop"], t["steady"], t["sideways"]
    st_ = [f"sma_ratio >= {s['sma']}", f"r_60d >= {s['r60']}", f"vol_ratio < {s['vol']}", f"drawdown_60d > {s['dd60']}"]
    if "r30" in s:
        st_.append(f"r_30d >= {s['r30']}")

    def mean(xs):
        return "(" + " + ".join(f"CAST({x} AS INT)" for x in xs) + f") / {float(len(xs))}"

    return (
        f"SELECT *, {mean([f'drawdown_60d <= {b['dd60']}', f'r_30d <= {b['r30']}', f'sma_ratio < {b['sma']}'])} AS b, {mean([f'drawdown_60d <= {c['dd60']}', f'r_30d >= {c['r30']}', f'vol_ratio > {c['vol']}'])} AS c, "
        f"{mean(st_)} AS s, {mean([f'abs(r_30d) < {q['r30']}', f'(sma_ratio > {q['sma'][0]} AND sma_ratio < {q['sma'][1]})', f'drawdown_60d > {q['dd60']}'])} AS q FROM panel"
    )


def _cont(t):
    b, c, s = t["bear"], t["chop"], t["steady"]

    def sig(x, k):
        return f"1 / (1 + exp(-({x}) * {k}.0))"

    def mean(xs):
        return "(" + " + ".join(xs) + f") / {float(len(xs))}"

    st_ = [sig(f"sma_ratio - {s['sma']}", 20), sig(f"r_60d - {s['r60']}", 10), sig(f"{s['vol']} - vol_ratio", 10), sig(f"drawdown_60d - ({s['dd60']})", 20)]
    if "r30" in s:
        st_.append(sig(f"r_30d - {s['r30']}", 20))
    return (
        f"SELECT *, greatest(0.0, 1 - greatest(b, c, s)) AS q FROM (SELECT *, {mean([sig(f'{b['dd60']} - drawdown_60d', 10), sig(f'{b['r30']} - r_30d', 20), sig(f'{b['sma']} - sma_ratio', 20)])} AS b, "
        f"{mean([sig(f'{c['dd60']} - drawdown_60d', 10), sig(f'r_30d - {c['r30']}', 20), sig(f'vol_ratio - {c['vol']}', 10)])} AS c, {mean(st_)} AS s FROM panel)"
    )


add_cte("heur", _pick(_disc(pr.LOOSE)))

# Roles of the panel: the market stands for the coin, listed symbols for the indices.
for _name, _sym in (("spy", "1"), ("vix", "2"), ("hyg", "3"), ("lqd", "4"), ("dxy", "5"), ("gold", "6")):
    add_cte(_name, f"SELECT date, close FROM bars WHERE symbol = '{_sym}'")
add_cte("alts", "SELECT symbol, date, close FROM bars WHERE symbol IN ('7', '8', '9', '10')")
_SP = f"({R0('avg', 'close', 20)} - {R0('avg', 'close', 50)}) / nullif({R0('avg', 'close', 50)}, 0)"
_POS = f"({R0('avg', 'close', 50)} - {R0('avg', 'close', 200)}) / nullif({R0('avg', 'close', 200)}, 0)"
add_cte(
    "crypto",
    f"SELECT date, {R0('avg', 'tr', 14)} / nullif(close, 0) * 100 AS btc_atr_pct_daily, (sp - {lag0('sp', 20)}) / 20 AS btc_sma20_50_slope, {_POS} AS btc_sma50_200_position, "
    f"ln(close / {lag0('close', 30)}) AS btc_30d_return, (volume - {R0('avg', 'volume', 30)}) / nullif({R0('stddev_samp', 'volume', 30)}, 0) AS btc_volume_z30, "
    f"close / {R0('max', 'close', 200)} - 1 AS btc_drawdown_from_200d_high FROM (SELECT *, greatest(high - low, abs(high - {lag0('close')}), abs(low - {lag0('close')})) AS tr, {_SP} AS sp FROM market_ohlcv)",
)
add_cte(
    "equity",
    f"SELECT s.date, spx_sma50_200_position, spx_6mo_return, spx_vix_level, spx_vix_pct_30d_rank, -ln(h.close / l.close) AS spx_credit_spread_proxy FROM (SELECT date, {_POS} AS spx_sma50_200_position, ln(close / {lag0('close', 126)}) AS spx_6mo_return FROM spy) s "
    f"LEFT JOIN (SELECT date, close AS spx_vix_level, (close - {R0('min', 'close', 30)}) / nullif({R0('max', 'close', 30)} - {R0('min', 'close', 30)}, 0) AS spx_vix_pct_30d_rank FROM vix) v USING (date) "
    "LEFT JOIN hyg h ON h.date = s.date LEFT JOIN lqd l ON l.date = h.date",
)


def rcorr(a, b):
    w = win("29 PRECEDING", part="")
    return f"CASE WHEN count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) OVER {w} = 30 THEN corr({a}, {b}) OVER {w} END"


add_cte(
    "cross_asset",
    f"SELECT date, {rcorr('b', 's')} AS crypto_equity_30d_corr, {rcorr('alt', 'b')} AS crypto_alt_to_btc_corr, dxy_30d_slope, {rcorr('g', 's')} AS gold_proxy_corr_to_spx FROM "
    f"(SELECT date, close / {lag0('close')} - 1 AS b FROM market) JOIN (SELECT date, close / {lag0('close')} - 1 AS s FROM spy) USING (date) "
    "LEFT JOIN (SELECT date, avg(r) AS alt FROM (SELECT date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM alts) GROUP BY date) USING (date) "
    f"LEFT JOIN (SELECT date, {R0('avg', 'l', 30)} AS dxy_30d_slope FROM (SELECT date, ln(close) - ln({lag0('close')}) AS l FROM dxy)) USING (date) "
    f"LEFT JOIN (SELECT date, close / {lag0('close')} - 1 AS g FROM gold) USING (date)",
)
add_cte("rpanel", "SELECT * FROM crypto FULL JOIN equity USING (date) FULL JOIN cross_asset USING (date)")
C_COLS = "btc_atr_pct_daily btc_sma20_50_slope btc_sma50_200_position btc_30d_return btc_volume_z30 btc_drawdown_from_200d_high".split()
E_COLS = "spx_sma50_200_position spx_6mo_return spx_vix_level spx_vix_pct_30d_rank spx_credit_spread_proxy".split()
X_COLS = "crypto_equity_30d_corr crypto_alt_to_btc_corr dxy_30d_slope gold_proxy_corr_to_spx".split()


def fs(cols):
    return " ".join("f:" + c for c in cols)


class Feeds:
    """The panel's input series, each one row per day."""

    def __init__(self, t):
        self.t = t
        self.bars = t.bars()

    def one(self, symbol):
        return self.bars.where(F.col("symbol") == symbol).select("date", "close")

    def market(self):
        return self.t.market_ohlcv()

    def alts(self):
        return self.bars.where(F.col("symbol").isin("7", "8", "9", "10")).select("symbol", "date", "close")


def panel_of(t):
    f = Feeds(t)
    return rg.regime_panel(
        f.market(), f.one("1"), f.one("2"), f.one("3"), f.one("4"), f.one("5"), f.one("6"), f.alts()
    )


@query(
    "g1_regime_primitives",
    E(
        "d:date f:slope f:position f:ret f:vz f:dd f:pos",
        "SELECT date, btc_sma20_50_slope AS slope, btc_sma50_200_position AS position, btc_30d_return AS ret, btc_volume_z30 AS vz, btc_drawdown_from_200d_high AS dd, "
        f"pos FROM crypto JOIN (SELECT date, (close - {R0('min', 'close', 30)}) / nullif({R0('max', 'close', 30)} - {R0('min', 'close', 30)}, 0) AS pos FROM market) USING (date)",
    ),
)
def g1(spark, sf):
    d = rg.sma_spread_slope(Tables(spark, sf, share=True).market_ohlcv(), "slope")
    return emit(
        d.select(
            "date",
            "slope",
            rg.sma_position().alias("position"),
            rg.log_return(30).alias("ret"),
            rg.volume_z(30).alias("vz"),
            rg.drawdown_from_high(200).alias("dd"),
            rg.range_position("close", 30).alias("pos"),
        )
    )


@query("g2_rolling_correlation", E("d:date f:crypto_equity_30d_corr", "SELECT * FROM cross_asset"))
def g2(spark, sf):
    f = Feeds(Tables(spark, sf, share=True))
    return emit(rg.cross_asset_block(f.market(), f.one("1")), "date", "crypto_equity_30d_corr")


@query("g3_crypto_block", E("d:date " + fs(C_COLS), "SELECT * FROM crypto"))
def g3(spark, sf):
    return emit(rg.crypto_block(Tables(spark, sf, share=True).market_ohlcv()), "date", *C_COLS)


@query("g4_equity_block", E("d:date " + fs(E_COLS), "SELECT * FROM equity"))
def g4(spark, sf):
    f = Feeds(Tables(spark, sf, share=True))
    return emit(rg.equity_block(f.one("1"), f.one("2"), f.one("3"), f.one("4")), "date", *E_COLS)


@query(
    "g4_equity_block_missing_feeds",
    E("d:date " + fs(E_COLS), "SELECT date, spx_sma50_200_position, spx_6mo_return, NULL AS spx_vix_level, NULL AS spx_vix_pct_30d_rank, NULL AS spx_credit_spread_proxy FROM equity"),
)
def g4b(spark, sf):
    return emit(rg.equity_block(Feeds(Tables(spark, sf, share=True)).one("1")), "date", *E_COLS)


@query("g5_cross_asset_block", E("d:date " + fs(X_COLS), "SELECT * FROM cross_asset"))
def g5(spark, sf):
    f = Feeds(Tables(spark, sf, share=True))
    return emit(rg.cross_asset_block(f.market(), f.one("1"), f.alts(), f.one("5"), f.one("6")), "date", *X_COLS)


@query("g6_regime_panel", E("d:date " + fs(C_COLS + E_COLS + X_COLS), "SELECT * FROM rpanel"))
def g6(spark, sf):
    return emit(panel_of(Tables(spark, sf, share=True)), "date", *C_COLS, *E_COLS, *X_COLS)


@query("j5_full_outer_on_date", E("d:date f:a f:b", "SELECT date, a.close AS a, b.close AS b FROM spy a FULL JOIN vix b USING (date)"))
def j5(spark, sf):
    f = Feeds(Tables(spark, sf, share=True))
    d = f.one("1").withColumnRenamed("close", "a").join(f.one("2").withColumnRenamed("close", "b"), "date", "full_outer")
    return emit(d, "date", "a", "b")


# thresholds on the scale of the given prices
TH = {
    "crash_vix_floor": 40000.0,
    "crash_credit_spread_sigma": 1.0,
    "risk_off_corr_floor": 0.05,
    "bear_spx_6mo_return_ceiling": -0.10,
    "bear_vix_floor": 22000.0,
    "decoupled_btc_30d_return_floor": 0.30,
    "decoupled_btc_equity_corr_ceiling": 0.40,
    "choppy_drawdown_threshold": -0.30,
    "choppy_btc_atr_floor": 12.0,
    "steady_vix_ceiling": 30000.0,
    "steady_btc_atr_ceiling": 60.0,
    "lowvol_btc_atr_ceiling": 50.0,
    "lowvol_vix_ceiling": 30000.0,
    "lowvol_abs_btc_return_ceiling": 0.10,
    "sideways_slope_ceiling": 0.01,
    "sideways_vix_floor": 15000.0,
    "sideways_vix_ceiling": 60000.0,
}
add_cte(
    "rlabels",
    f"""SELECT *, CASE WHEN spx_vix_level > 40000 AND z > 1.0 THEN 'crash_shock'
      WHEN crypto_equity_30d_corr > 0.05 AND btc_30d_return < 0 AND spx_6mo_return < 0 THEN 'high_correlation_risk_off'
      WHEN NOT (spx_sma50_200_position > 0) AND spx_6mo_return < -0.1 AND spx_vix_level > 22000 THEN 'bear_trend'
      WHEN btc_30d_return > 0.3 AND crypto_equity_30d_corr < 0.4 THEN 'crypto_decoupled_bull'
      WHEN btc_sma50_200_position > 0 AND btc_drawdown_from_200d_high < -0.3 AND btc_atr_pct_daily > 12 THEN 'choppy_recovery'
      WHEN btc_sma50_200_position > 0 AND spx_sma50_200_position > 0 AND spx_vix_level < 30000 AND btc_atr_pct_daily < 60 THEN 'steady_bull'
      WHEN btc_atr_pct_daily < 50 AND spx_vix_level < 30000 AND abs(btc_30d_return) < 0.1 THEN 'low_vol_grind'
      WHEN abs(btc_sma20_50_slope) < 0.01 AND spx_vix_level > 15000 AND spx_vix_level < 60000 THEN 'sideways_range'
      ELSE 'unlabeled' END AS regime_label_rule
    FROM (SELECT *, (spx_credit_spread_proxy - {R0('avg', 'spx_credit_spread_proxy', 90)}) / nullif({R0('stddev_samp', 'spx_credit_spread_proxy', 90)}, 0) AS z FROM rpanel)""",
)


def labels_of(t):
    return rg.assign_labels(panel_of(t), TH)


@query(
    "g7_regime_labels",
    E("d:date regime_label_rule b:was_unlabeled", "SELECT *, regime_label_rule = 'unlabeled' AS was_unlabeled FROM rlabels"),
)
def g7(spark, sf):
    return emit(labels_of(Tables(spark, sf, share=True)), "date", "regime_label_rule", "was_unlabeled")


@query(
    "g8_label_coverage",
    E(
        "n_total_days n_labeled_days f:coverage_rate d:first_date d:last_date",
        "SELECT count(*) AS n_total_days, count(*) FILTER (regime_label_rule <> 'unlabeled') AS n_labeled_days, 1 - avg(CAST(regime_label_rule = 'unlabeled' AS INT)) AS coverage_rate, min(date) AS first_date, max(date) AS last_date FROM rlabels",
    ),
)
def g8(spark, sf):
    return emit(rg.coverage(labels_of(Tables(spark, sf, share=True))))


@query("g8_year_by_regime", "SELECT year(date) AS year, regime_label_rule, count(*) AS n FROM rlabels GROUP BY 1, 2")
def g8b(spark, sf):
    d = labels_of(Tables(spark, sf, share=True))
    return d.groupBy(F.year("date").cast("long").alias("year"), "regime_label_rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g8_regime_by_tercile",
    "SELECT regime_label_rule, count(*) FILTER (vol_tercile = 'low') AS low, count(*) FILTER (vol_tercile = 'mid') AS mid, count(*) FILTER (vol_tercile = 'high') AS high FROM rlabels JOIN terciles USING (date) GROUP BY 1",
)
def g8c(spark, sf):
    t = Tables(spark, sf, share=True)
    j = labels_of(t).join(fx.vol_terciles(t.market()).select("date", "vol_tercile"), "date")
    cells = j.groupBy("regime_label_rule").pivot("vol_tercile", ["low", "mid", "high"]).agg(F.count(F.lit(1)))
    return cells.na.fill(0)


add_cte("labelled", "SELECT * FROM rlabels WHERE regime_label_rule <> 'unlabeled'")
add_cte(
    "folds",
    "SELECT CAST(k AS BIGINT) AS fold, f AS train_start, f + 366 + CAST(k * 90 AS INT) - 1 AS train_end, f + 366 + CAST(k * 90 AS INT) AS val_start, f + 366 + CAST(k * 90 AS INT) + 180 AS val_end "
    "FROM (SELECT min(date) AS f, max(date) AS l FROM labelled), (SELECT unnest(range(100)) AS k) WHERE f + 366 + CAST(k * 90 AS INT) + 180 <= l",
)


def labelled_of(t):
    return labels_of(t).where("regime_label_rule <> 'unlabeled'")


@query("g9_walk_forward_folds", E("i:fold d:train_start d:train_end d:val_start d:val_end", "SELECT * FROM folds"))
def g9(spark, sf):
    d = rg.folds(labelled_of(Tables(spark, sf, share=True)))
    return emit(d.withColumn("fold", F.col("fold").cast("long")))


@query(
    "g10_class_weights",
    E("regime_label_rule n_class f:class_weight", "SELECT regime_label_rule, count(*) AS n_class, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS class_weight FROM labelled GROUP BY 1"),
)
def g10(spark, sf):
    return emit(rg.class_weights(labelled_of(Tables(spark, sf, share=True)), "regime_label_rule"), "regime_label_rule", "n_class", "class_weight")


# a prediction to score: yesterday's label
add_cte("pred", "SELECT date, regime_label_rule AS y, lag(regime_label_rule) OVER (ORDER BY date) AS p FROM labelled")


def pred_of(t):
    from pyspark.sql import Window

    d = labelled_of(t)
    return d.select("date", F.col("regime_label_rule").alias("y"), F.lag("regime_label_rule").over(Window.orderBy("date")).alias("p")).where(
        "p IS NOT NULL"
    )


def metrics_sql(src, by=""):
    b = f"{by}, " if by else ""
    using = f"{by}, class" if by else "class"
    return (
        f"SELECT {b}class, prec AS precision, rec AS recall, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) AS f1, support FROM (SELECT {b}class, coalesce(coalesce(tp, 0) / nullif(np, 0), 0) AS prec, "
        f"coalesce(coalesce(tp, 0) / nullif(ns, 0), 0) AS rec, coalesce(ns, 0) AS support FROM (SELECT {b}y AS class, count(*) AS ns, count(*) FILTER (y = p) AS tp FROM {src} GROUP BY ALL) FULL JOIN "
        f"(SELECT {b}p AS class, count(*) AS np FROM {src} GROUP BY ALL) USING ({using}))"
    )


add_cte("pred_ok", "SELECT * FROM pred WHERE p IS NOT NULL")
add_cte("pred_fold", "SELECT f.fold, q.* FROM pred_ok q JOIN folds f ON q.date BETWEEN f.val_start AND f.val_end")
add_cte("mets", metrics_sql("pred_ok"))
add_cte("fmets", metrics_sql("pred_fold", "fold"))


@query("g11_class_metrics", E("class f:precision f:recall f:f1 i:support", "SELECT * FROM mets"))
def g11(spark, sf):
    return emit(rg.class_metrics(pred_of(Tables(spark, sf, share=True)), "y", "p"))


@query("g11_f1_summary", E("f:macro_f1 f:weighted_f1 i:n_val", "SELECT avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, sum(support) AS n_val FROM mets"))
def g11b(spark, sf):
    return emit(rg.f1_summary(rg.class_metrics(pred_of(Tables(spark, sf, share=True)), "y", "p")))


@query(
    "g12_label_agreement",
    "SELECT a.regime_label_rule AS label_a, b.regime_label AS label_b, count(*) AS n, CAST(a.regime_label_rule = b.regime_label AS INTEGER) AS agrees FROM rlabels a JOIN heur b USING (date) GROUP BY ALL",
)
def g12(spark, sf):
    t = Tables(spark, sf, share=True)
    a = labels_of(t).select("date", F.col("regime_label_rule").alias("label_a"))
    b = pr.heuristic_regime(fx.panel_features(t.market())).select("date", F.col("regime_label").alias("label_b"))
    return rg.agreement(a, b)


REG_FEATS = [*C_COLS, *E_COLS, *X_COLS]  # every column of the panel
LABELLED = "regime_label_rule <> 'unlabeled'"


@query("g13_classifier_scores")
def g13(spark, sf):
    d = staged(labels_of(Tables(spark, sf, share=True)).select("date", "regime_label_rule", *REG_FEATS))
    return emit(rg.refit_by_fold(d, rg.folds(d.where(LABELLED)), REG_FEATS)[1])


@query(
    "g13_scored_days",
    E(
        "i:fold d:date n_scores b:is_share",
        "SELECT f.fold, r.date, 1 AS n_scores, true AS is_share FROM folds f JOIN rlabels r ON r.date BETWEEN f.val_start AND f.val_end",
    ),
)
def g13k(spark, sf):
    """Every day of a fold's validation range has one score of that fold's model."""
    d = staged(labels_of(Tables(spark, sf, share=True)).select("date", "regime_label_rule", *REG_FEATS))
    got = rg.refit_by_fold(d, rg.folds(d.where(LABELLED)), REG_FEATS)[1]
    n = F.count(F.lit(1)).alias("n_scores")
    share = F.bool_and(F.col("regime_confidence").between(0, 1)).alias("is_share")
    return emit(got.groupBy(F.col("fold").cast("long").alias("fold"), "date").agg(n, share))


@query(
    "g14_point_in_time_sets",
    E(
        "d:date train_set_size d:train_end_date b:is_refit",
        "SELECT *, coalesce(train_set_size <> lag(train_set_size) OVER (ORDER BY date), true) AS is_refit FROM (SELECT r.date, count(l.date) AS train_set_size, max(l.date) AS train_end_date FROM rpanel r LEFT JOIN labelled l ON l.date <= r.date - 30 GROUP BY r.date) WHERE train_set_size >= 30",
    ),
)
def g14(spark, sf):
    d = labels_of(Tables(spark, sf, share=True)).select("date", "regime_label_rule")
    lab = d.where("regime_label_rule <> 'unlabeled'")
    return emit(rg.point_in_time_sets(d.select("date"), lab.select("date"), 30), "date", "train_set_size", "train_end_date", "is_refit")


_SETS = (
    "SELECT r.date, count(l.date) AS n, max(l.date) AS last FROM rpanel r LEFT JOIN labelled l ON l.date <= r.date - 30 GROUP BY r.date HAVING count(l.date) >= 30"
)
_MODELS = f"SELECT model_id, min(date) AS first_day, arg_min(n, date) AS n, arg_min(last, date) AS last FROM (SELECT *, CAST(floor(ln(n / 30.0) / ln(1.25)) AS BIGINT) AS model_id FROM ({_SETS})) GROUP BY model_id"


@query(
    "g14_refit_schedule",
    E("i:model_id d:first_day train_set_size d:train_end_date", f"SELECT model_id, first_day, n AS train_set_size, last AS train_end_date FROM ({_MODELS})"),
)
def g14r(spark, sf):
    """When a model is fitted anew: the training set has grown by a quarter."""
    d = labels_of(Tables(spark, sf, share=True)).select("date", "regime_label_rule")
    return emit(rg.refit_schedule(rg.point_in_time_sets(d.select("date"), d.where(LABELLED).select("date"), 30)))


@query("g14_walk_forward_scores")
def g14s(spark, sf):
    d = labels_of(Tables(spark, sf, share=True))
    return emit(rg.walk_forward_scores(d, REG_FEATS)[1])


@query(
    "g14_models_of_days",
    E(
        "d:date i:model_id train_set_size d:train_end_date n_scores b:is_share",
        f"SELECT s.date, m.model_id, m.n AS train_set_size, m.last AS train_end_date, 1 AS n_scores, true AS is_share FROM ({_SETS}) s "
        f"ASOF JOIN ({_MODELS}) m ON s.date >= m.first_day",
    ),
)
def g14m(spark, sf):
    """Every day has one score, by the newest model that saw no label of the 30 days before it."""
    got = rg.walk_forward_scores(labels_of(Tables(spark, sf, share=True)), REG_FEATS)[1]
    n = F.count(F.lit(1)).alias("n_scores")
    share = F.bool_and(F.col("regime_confidence").between(0, 1)).alias("is_share")
    return emit(got.groupBy("date", "model_id", "train_set_size", "train_end_date").agg(n, share))


@query(
    "g15_fold_acceptance",
    E(
        "f:mean_macro_f1 f:f1_range n_failing_classes b:passes_macro_f1 b:passes_stability b:passes_all",
        "SELECT *, mean_macro_f1 >= 0.5 AS passes_macro_f1, f1_range <= 0.5 AS passes_stability, mean_macro_f1 >= 0.5 AND f1_range <= 0.5 AND n_failing_classes = 0 AS passes_all FROM "
        "(SELECT avg(m) AS mean_macro_f1, max(m) - min(m) AS f1_range, (SELECT count(*) FROM (SELECT class FROM fmets WHERE support > 0 GROUP BY class HAVING avg(precision) < 0.4)) AS n_failing_classes FROM (SELECT fold, avg(f1) AS m FROM fmets GROUP BY fold))",
    ),
)
def g15(spark, sf):
    t = Tables(spark, sf, share=True)
    lab = staged(labelled_of(t).select("date", "regime_label_rule"))
    from pyspark.sql import Window

    p = F.lag("regime_label_rule").over(Window.orderBy("date"))
    d = lab.select("date", F.col("regime_label_rule").alias("y"), p.alias("p")).where("p IS NOT NULL")
    m = rg.fold_members(d, rg.folds(lab)).where("role = 'val'")
    return emit(rg.acceptance(rg.class_metrics(m, "y", "p", ["fold"])))


@query("g16_feature_importance")
def g16(spark, sf):
    """Mean importance over the models of all folds, each fitted on its own training days."""
    d = staged(labelled_of(Tables(spark, sf, share=True)).select("date", "regime_label_rule", *REG_FEATS))
    models, _ = rg.refit_by_fold(d, rg.folds(d), REG_FEATS)
    each = reduce(lambda a, b: a.unionByName(b), [md.importances(spark, m, REG_FEATS, len(REG_FEATS)) for m in models])
    mean = each.groupBy("feature").agg(F.avg("importance").alias("importance"))
    return mean.orderBy(F.desc("importance"), "feature").limit(5)


# --- predicates --------------------------------------------------------------------------


@query(
    "p1_temporal_split",
    "SELECT CASE WHEN date <= DATE '1998-12-31' THEN 'train' WHEN date <= DATE '1999-12-31' THEN 'val' ELSE 'holdout' END AS split, count(*) AS n, CAST(min(date) AS VARCHAR) AS lo, CAST(max(date) AS VARCHAR) AS hi FROM bars GROUP BY 1",
)
def p1(spark, sf):
    from datetime import date

    d = pr.split_by_date(Tables(spark, sf, share=True).bars(), date(1998, 12, 31), date(1999, 12, 31))
    return emit(d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")))


@query(
    "p2_multi_range_filter",
    "SELECT symbol, CAST(date AS VARCHAR) AS date FROM bars WHERE date BETWEEN DATE '1998-07-01' AND DATE '1998-12-31' OR date BETWEEN DATE '2000-01-01' AND DATE '2000-08-31'",
)
def p2(spark, sf):
    d = Tables(spark, sf, share=True).bars().where(pr.in_ranges([("1998-07-01", "1998-12-31"), ("2000-01-01", "2000-08-31")]))
    return emit(d, "symbol", "date")


@query(
    "p4_non_finite_to_null",
    "SELECT symbol, count(x) AS n_finite, count(*) - count(x) AS n_missing FROM (SELECT symbol, CASE WHEN high > low THEN (close - low) / (high - low) END AS x FROM bars) GROUP BY symbol",
)
def p4(spark, sf):
    # a bare division of doubles outside strict mode would give infinities; make them here
    span = F.col("high") - F.col("low")
    raw = F.when(span == 0, F.when(F.col("volume") > 25, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise((F.col("close") - F.col("low")) / span)
    d = Tables(spark, sf, share=True).bars().select("symbol", pr.finite(raw).alias("x"))
    return d.groupBy("symbol").agg(F.count("x").alias("n_finite"), F.sum(F.col("x").isNull().cast("long")).alias("n_missing"))


_LV = ("chop", "downtrend", "uptrend", "sideways")


@query("p5_one_hot", "SELECT CAST(date AS VARCHAR) AS date, " + ", ".join(f"CAST(regime_label = '{v}' AS INTEGER) AS market_regime_{v}" for v in _LV) + " FROM regimes")
def p5(spark, sf):
    # a level that never occurs gives a column of zeros
    return emit(pr.one_hot(fx.market_regime(Tables(spark, sf, share=True).market()), "market_regime", _LV))


@query("p6_complete_cases", "SELECT symbol, CAST(date AS VARCHAR) AS date FROM rf WHERE atr_pct_14 IS NOT NULL AND pct_of_60d_high IS NOT NULL AND is_winner IS NOT NULL")
def p6(spark, sf):
    d = rule_frame(Tables(spark, sf, share=True)).na.drop(subset=["atr_pct_14", "pct_of_60d_high", "is_winner"])
    return emit(d, "symbol", "date")


_SQL_REGIME = {f"market_regime_{v}": f"CAST(market_regime = '{v}' AS INTEGER)" for v in _LV[:3]}
_CONCEPTS = list(pr.CONCEPTS)


def _concept_sql(f, op, thr):
    x = _SQL_REGIME.get(f, f)
    x = f"CAST({x} AS INTEGER)" if f.startswith("is_") else x
    return f"CAST(coalesce({x} {'=' if op == '==' else op} {thr}, false) AS INTEGER)"


add_cte("concepts", "SELECT symbol, date, " + ", ".join(f"{_concept_sql(f, o, t)} AS {n}" for n, f, o, t in _CONCEPTS) + " FROM features JOIN macd USING (symbol, date)")


def concepts_of(t):
    d = pr.one_hot(feature_matrix(t), "market_regime", ("chop", "downtrend", "uptrend"))
    return pr.concept_labels(pr.flags_to_int(d))


@query("p7_concepts", "SELECT symbol, CAST(date AS VARCHAR) AS date, " + ", ".join(n for n, *_ in _CONCEPTS) + " FROM concepts")
def p7(spark, sf):
    return emit(concepts_of(Tables(spark, sf, share=True)), "symbol", "date", *[n for n, *_ in _CONCEPTS])


@query(
    "p8_first_match_ladder",
    "SELECT band, count(*) AS n FROM (SELECT CASE WHEN rsi_14 < 30.3 THEN 'oversold' WHEN rsi_14 > 70.3 THEN 'overbought' WHEN vol_mult_30 > 1.503 THEN 'active' ELSE 'none' END AS band FROM rf) GROUP BY 1",
)
def p8(spark, sf):
    c = F.col
    ladder = [("oversold", c("rsi_14") < 30.3), ("overbought", c("rsi_14") > 70.3), ("active", c("vol_mult_30") > 1.503)]
    d = rule_frame(Tables(spark, sf, share=True)).select(pr.first_match(ladder, "none").alias("band"))
    return d.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


H_SPEC = "d:date regime_label f:regime_confidence"


@query("p9_discrete_regime_score", E(H_SPEC, "SELECT * FROM heur"))
def p9(spark, sf):
    return emit(pr.heuristic_regime(fx.panel_features(Tables(spark, sf, share=True).market())), "date", "regime_label", "regime_confidence")


@query("p9_discrete_regime_score_strict", E(H_SPEC, _pick(_disc(pr.STRICT))))
def p9b(spark, sf):
    return emit(pr.heuristic_regime(fx.panel_features(Tables(spark, sf, share=True).market()), True), "date", "regime_label", "regime_confidence")


@query("p10_continuous_regime_score", E(H_SPEC, _pick(_cont(pr.LOOSE))))
def p10(spark, sf):
    return emit(pr.heuristic_regime(fx.panel_features(Tables(spark, sf, share=True).market()), False, True), "date", "regime_label", "regime_confidence")


@query("p10_continuous_regime_score_strict", E(H_SPEC, _pick(_cont(pr.STRICT))))
def p10b(spark, sf):
    return emit(pr.heuristic_regime(fx.panel_features(Tables(spark, sf, share=True).market()), True, True), "date", "regime_label", "regime_confidence")


_MX = " ".join(
    f"WHEN regime_label = '{r}' AND vol_tercile = '{t}' THEN {v}" for r, w in pr.DIRECTION.items() for t, v in pr.SIZE_MATRIX[w].items()
)


@query("p13_size_multiplier", E("d:date f:m", f"SELECT date, CASE {_MX} ELSE 1.0 END AS m FROM (SELECT date, regime_label, vol_tercile FROM heur JOIN terciles USING (date))"))
def p13(spark, sf):
    m = Tables(spark, sf, share=True).market()
    d = pr.heuristic_regime(fx.panel_features(m)).join(fx.vol_terciles(m).select("date", "vol_tercile"), "date")
    return emit(d.select("date", pr.size_multiplier("regime_label", "vol_tercile").alias("m")))


@query(
    "p14_regime_multiplier",
    E("symbol d:date f:size_multiplier", "SELECT symbol, b.date, CASE regime_label WHEN 'uptrend' THEN 1.5 WHEN 'downtrend' THEN 0.5 ELSE 1.0 END AS size_multiplier FROM bars b LEFT JOIN regimes r ON r.date = b.date"),
)
def p14(spark, sf):
    t = Tables(spark, sf, share=True)
    r = fx.market_regime(t.market()).withColumnRenamed("market_regime", "regime_label")
    return emit(pr.regime_multiplier(t.bars(), r, {"uptrend": 1.5, "downtrend": 0.5}), "symbol", "date", "size_multiplier")


ZF = ("close_over_sma_20", "rsi_14", "roc_20")


@query(
    "p16_impute_standardise",
    E(
        "symbol d:date " + " ".join(f"f:{f}_z" for f in ZF),
        "SELECT symbol, date, " + ", ".join(f"({f} - avg({f}) OVER ()) / nullif(stddev_pop({f}) OVER (), 0) AS {f}_z" for f in ZF) + " FROM (SELECT symbol, date, "
        + ", ".join(f"coalesce({f}, (SELECT median({f}) FROM rf)) AS {f}" for f in ZF) + " FROM rf)",
    ),
)
def p16(spark, sf):
    d = staged(rule_frame(Tables(spark, sf, share=True)).select("symbol", "date", *ZF))
    long = st.unpivot(d, [], ZF)
    q = exact_quantiles(long, ["feature"], "value", {"m": 0.5})
    med = staged(q.agg(*[F.max(F.when(F.col("feature") == f, F.col("m"))).alias(f) for f in ZF]))
    mom = pr.impute_moments(d, ZF, med)
    return emit(pr.standardise(d, ZF, med, mom), "symbol", "date", *[f"{f}_z" for f in ZF])


_HL = "greatest(0.1, 1 + greatest(-0.5, least(0.5, vol_slope_yr)))"


@query(
    "p17_liquidity_scores",
    E(
        "symbol f:base f:linear f:hard f:sigmoid",
        f"SELECT symbol, base, base * {_HL} AS linear, base * CASE WHEN vol_slope_yr < -0.1 THEN 0 ELSE 1 END AS hard, base / (1 + exp(-vol_slope_yr * 4)) AS sigmoid FROM (SELECT symbol, pow(atr, 5) * least(mean_dv / 800000.0, 1.0) / 1.6 AS base, vol_slope_yr FROM sym_metrics JOIN (SELECT symbol, avg(atr) AS atr FROM atr14 GROUP BY 1) USING (symbol))",
    ),
)
def p17(spark, sf):
    t = Tables(spark, sf, share=True)
    atr = fx.atr_pct(t.bars()).groupBy("symbol").agg(F.avg("atr_pct_14").alias("atr"))
    d = sym_metrics(t).join(atr, "symbol").withColumn("base", pr.liquidity_score("atr", "mean_dv", 1.6, 800_000.0))
    d = d.withColumns({k: F.col("base") * pr.volume_health("vol_slope_yr", k) for k in ("linear", "hard", "sigmoid")})
    return emit(d, "symbol", "base", "linear", "hard", "sigmoid")


@query(
    "p18_cap_bucket",
    E(
        "symbol d:date g:market_cap cap_bucket",
        "SELECT *, CASE WHEN market_cap < 1e9 THEN 'micro' WHEN market_cap < 3e9 THEN 'small' WHEN market_cap < 6e9 THEN 'mid' WHEN market_cap < 1.2e10 THEN 'large' WHEN market_cap IS NOT NULL THEN 'mega' END AS cap_bucket FROM "
        "(SELECT b.symbol, date, close * shares AS market_cap FROM bars b LEFT JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, floor(abs(s_acctbal)) * 30 AS shares FROM supplier WHERE s_acctbal > 0) USING (symbol))",
    ),
)
def p18(spark, sf):
    t = Tables(spark, sf, share=True)
    s = t.read("supplier").where("s_acctbal > 0").select(
        F.col("s_suppkey").cast("string").alias("symbol"), (F.floor(F.abs("s_acctbal")) * 30).alias("shares_outstanding")
    )
    return emit(pr.cap_bucket(t.bars(), s), "symbol", "date", "market_cap", "cap_bucket", coarse=("market_cap",))


