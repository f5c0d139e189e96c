"""Aggregations, ranking, set operations, series statistics (A, K, O, Q, X20-X22, J1-J5)."""

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.windows import DAILY, ratio, row_of
from ..operators import features as fx
from ..operators import joins as jn
from ..operators import labels as lb
from ..operators import rules as ru
from ..operators import stats as st
from ..session import staged
from .common import E, Tables, emit
from .q_rules import TAUS, WINDOWS, rule_frame, scored
from .q_trades import best_signals, bull_trades, trades_of
from .registry import add_cte, lag, lead, query, roll, win


@query(
    "a1_group_statistics",
    E(
        "symbol n f:mean f:sd f:lo f:hi f:median f:q25 f:q75 f:first_close",
        "SELECT symbol, count(*) AS n, avg(close) AS mean, stddev_samp(close) AS sd, min(close) AS lo, max(close) AS hi, median(close) AS median, "
        "quantile_cont(close, 0.25) AS q25, quantile_cont(close, 0.75) AS q75, arg_min(close, date) AS first_close FROM bars GROUP BY symbol",
    ),
)
def a1(spark, sf):
    p = F.percentile("close", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)))
    d = Tables(spark, sf).bars().groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean"), F.stddev_samp("close").alias("sd"),
        F.min("close").alias("lo"), F.max("close").alias("hi"), p.alias("p"), F.min_by("close", "date").alias("first_close"),
    )
    d = d.withColumns({"median": F.col("p")[0], "q25": F.col("p")[1], "q75": F.col("p")[2]})
    return emit(d, "symbol", "n", "mean", "sd", "lo", "hi", "median", "q25", "q75", "first_close")


@query(
    "a2_conditional_counts",
    "SELECT rule_key, count(*) FILTER (val_lift >= 1.02) AS n_windows_ge, count(*) AS n_windows FROM wf GROUP BY rule_key",
)
def a2(spark, sf):
    from .q_rules import RULES

    d = ru.walk_forward(rule_frame(Tables(spark, sf)), RULES, WINDOWS)
    return d.groupBy("rule_key").agg(F.count_if(F.col("val_lift") >= 1.02).alias("n_windows_ge"), F.count(F.lit(1)).alias("n_windows"))


@query("a3_distinct_counts", "SELECT rule_key, count(DISTINCT symbol) AS n_symbols, count(DISTINCT date) AS n_dates FROM fired GROUP BY rule_key")
def a3(spark, sf):
    from .q_rules import LIVE

    f = ru.firings(rule_frame(Tables(spark, sf)), LIVE)
    return f.groupBy("rule_key").agg(F.count_distinct("symbol").alias("n_symbols"), F.count_distinct("date").alias("n_dates"))


@query(
    "a5_signals_by_day",
    "SELECT CAST(date AS VARCHAR) AS date, row_number() OVER (PARTITION BY date ORDER BY symbol) AS position, count(*) OVER (PARTITION BY date) AS n_day, symbol, rule_key FROM best_signal",
)
def a5(spark, sf):
    d = st.positions(best_signals(Tables(spark, sf)), ["date"], ["symbol"]).withColumnRenamed("n_group", "n_day")
    return emit(d, "date", "position", "n_day", "symbol", "rule_key")


FEATS = fx.SCAN_FEATURES


def scan_frame(t):
    return fx.scan_features(t.series(), 2.0).where(F.col("winner").isNotNull())


add_cte("scan_ok", "SELECT * FROM scan WHERE winner IS NOT NULL")
add_cte(
    "scan_long",
    " UNION ALL ".join(f"SELECT symbol, date, winner, '{f}' AS feature, {f} AS v FROM scan_ok WHERE {f} IS NOT NULL" for f in FEATS),
)


@query(
    "a6_cohens_d",
    E(
        "feature n_winners n_losers f:mean_winner f:mean_loser f:cohens_d",
        "SELECT feature, nw AS n_winners, nl AS n_losers, CASE WHEN nw >= 100 AND nl >= 100 THEN mw END AS mean_winner, CASE WHEN nw >= 100 AND nl >= 100 THEN ml END AS mean_loser, "
        "CASE WHEN nw >= 100 AND nl >= 100 THEN (mw - ml) / nullif(sqrt(((nw - 1) * vw + (nl - 1) * vl) / (nw + nl - 2)), 0) END AS cohens_d FROM "
        "(SELECT feature, count(*) FILTER (winner = 1) AS nw, count(*) FILTER (winner = 0) AS nl, avg(v) FILTER (winner = 1) AS mw, avg(v) FILTER (winner = 0) AS ml, "
        "var_samp(v) FILTER (winner = 1) AS vw, var_samp(v) FILTER (winner = 0) AS vl FROM scan_long GROUP BY feature)",
    ),
)
def a6(spark, sf):
    return emit(st.cohens_d(scan_frame(Tables(spark, sf)), FEATS, "winner"))


add_cte("cuts", "SELECT feature, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM scan_long GROUP BY feature")
add_cte("binned", "SELECT symbol, date, feature, winner, CASE WHEN v < q25 THEN 0 WHEN v < q50 THEN 1 WHEN v < q75 THEN 2 ELSE 3 END AS q FROM scan_long JOIN cuts USING (feature)")


@query(
    "a7_quartile_bins",
    E("feature i:q n f:q25 f:q50 f:q75", "SELECT feature, q, count(*) AS n, min(q25) AS q25, min(q50) AS q50, min(q75) AS q75 FROM binned JOIN cuts USING (feature) GROUP BY feature, q"),
)
def a7(spark, sf):
    b, cuts = st.quartile_bins(scan_frame(Tables(spark, sf)), FEATS, ["winner"])
    d = b.groupBy("feature", F.col("q").cast("long").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    return emit(d.join(F.broadcast(cuts), "feature"), "feature", "q", "n", "q25", "q50", "q75")


add_cte("single", "SELECT feature, q, avg(winner) AS rate, count(*) AS n, avg(winner) / (SELECT avg(winner) FROM scan_ok) AS lift FROM binned GROUP BY feature, q")


@query(
    "a8_best_quartile",
    E(
        "feature i:q f:rate f:lift n",
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(rate, 9) DESC, q) AS r FROM single) WHERE r = 1",
    ),
)
def a8(spark, sf):
    s = scan_frame(Tables(spark, sf))
    b, _ = st.quartile_bins(s, FEATS, ["winner"])
    base = s.agg(F.avg("winner").alias("b")).scalar()
    d = st.best_quartile(b, "winner").withColumn("lift", F.col("rate") / base).withColumn("q", F.col("q").cast("long"))
    return emit(d, "feature", "q", "rate", "lift", "n")


add_cte(
    "bin_wide",
    "SELECT symbol, date, winner, " + ", ".join(f"max(q) FILTER (feature = '{f}') AS q_{f}" for f in FEATS) + " FROM binned GROUP BY symbol, date, winner",
)
add_cte(
    "pair_cells",
    " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, q_{x} AS qx, q_{y} AS qy, avg(winner) AS rate, count(*) AS n FROM bin_wide WHERE q_{x} IS NOT NULL AND q_{y} IS NOT NULL GROUP BY 3, 4"
        for x, y in combinations(FEATS, 2)
    ),
)


@query(
    "a9_pairwise_scan",
    E(
        "x y i:qx i:qy n f:rate f:lift f:coverage_pct f:interaction_strength",
        "SELECT c.*, 100.0 * n / tot AS coverage_pct, lift - greatest(mx, my) AS interaction_strength FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY round(lift, 9) DESC, qx, qy) AS r FROM "
        "(SELECT *, rate / base AS lift FROM pair_cells, (SELECT avg(winner) AS base, count(*) AS tot FROM scan_ok) WHERE n >= 0.005 * tot)) c "
        "JOIN (SELECT feature AS x, max(lift) AS mx FROM single GROUP BY 1) USING (x) JOIN (SELECT feature AS y, max(lift) AS my FROM single GROUP BY 1) USING (y) WHERE r = 1",
    ),
)
def a9(spark, sf):
    d = st.pairwise_scan(scan_frame(Tables(spark, sf)), FEATS, "winner")
    d = d.withColumns({"qx": F.col("qx").cast("long"), "qy": F.col("qy").cast("long")})
    return emit(d, "x", "y", "qx", "qy", "n", "rate", "lift", "coverage_pct", "interaction_strength")


# one row per symbol: the metrics that are correlated
add_cte("sym_day", "SELECT symbol, date AS day, close * volume AS dv FROM bars")
add_cte(
    "sym_metrics",
    "SELECT symbol, avg(dv) AS mean_dv, avg(ln(dv)) AS mean_log_dv, CAST(count(*) AS DOUBLE) AS n_days, "
    "(avg(dv) FILTER (b <= 60) - avg(dv)) / stddev_samp(dv) AS vol_z_late, regr_slope(ln(dv), x) AS vol_slope_yr FROM "
    "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS b, (row_number() OVER (PARTITION BY symbol ORDER BY day) - 1) / 365.0 AS x FROM sym_day) GROUP BY symbol",
)
METRICS = ("mean_log_dv", "n_days", "vol_z_late", "vol_slope_yr")


def sym_metrics(t):
    day = t.bars().select("symbol", F.col("date").alias("day"), (F.col("close") * F.col("volume")).alias("dv"))
    trend = st.volume_trend(day, "symbol", "dv")
    extra = day.groupBy("symbol").agg(F.avg(F.ln("dv")).alias("mean_log_dv"), F.count(F.lit(1)).cast("double").alias("n_days"))
    return trend.join(extra, "symbol")


@query(
    "a10_pearson_matrix",
    E("metric f:rho", " UNION ALL ".join(f"SELECT '{m}' AS metric, corr(mean_dv, {m}) AS rho FROM sym_metrics" for m in METRICS)),
)
def a10(spark, sf):
    return emit(st.pearson(sym_metrics(Tables(spark, sf)), "mean_dv", METRICS))


def arank(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(
    "a10_spearman_matrix",
    E(
        "metric f:rho",
        " UNION ALL ".join(f"SELECT '{m}' AS metric, corr(a, b) AS rho FROM (SELECT {arank('mean_dv')} AS a, {arank(m)} AS b FROM sym_metrics)" for m in METRICS),
    ),
)
def a10b(spark, sf):
    return emit(st.spearman(sym_metrics(Tables(spark, sf)), "mean_dv", METRICS))


@query(
    "a11_half_means",
    E(
        "half " + " ".join(f"f:{m}" for m in METRICS),
        "SELECT half, " + ", ".join(f"avg({m}) AS {m}" for m in METRICS) + " FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY mean_dv DESC, symbol) <= (SELECT count(*) // 2 FROM sym_metrics) THEN 'high' ELSE 'low' END AS half FROM sym_metrics) GROUP BY half",
    ),
)
def a11(spark, sf):
    return emit(st.halves(sym_metrics(Tables(spark, sf)), "mean_dv", METRICS, "symbol"))


@query("a12_value_counts", "SELECT bsq_exit_reason, count(*) AS n FROM realized60 GROUP BY 1")
def a12(spark, sf):
    d = lb.first_touch_return(Tables(spark, sf).bars(), 60, 200.0)
    return d.groupBy("bsq_exit_reason").agg(F.count(F.lit(1)).alias("n"))


add_cte(
    "cells",
    " UNION ALL ".join(
        f"SELECT window_id, {t} AS threshold, coalesce(avg(CAST(is_winner AS INT)) FILTER (score >= {t}), 0) AS metric FROM scored_w GROUP BY window_id" for t in TAUS
    ),
)


def window_cells(t):
    d = scored(t).where(F.col("window_id").isNotNull())
    return ru.threshold_sweep(d, "score", "is_winner", TAUS, ["window_id"]).select("window_id", "threshold", F.col("precision").alias("metric"))


@query(
    "a13_profile_comparison",
    E(
        "i:window_id f:peak_threshold f:peak f:vs_baseline",
        "SELECT window_id, arg_max(threshold, metric) AS peak_threshold, max(metric) AS peak, max(metric) - (SELECT max(metric) FROM cells WHERE window_id = 0) AS vs_baseline FROM cells GROUP BY window_id",
    ),
)
def a13(spark, sf):
    c = window_cells(Tables(spark, sf))
    base = c.where("window_id = 0").agg(F.max("metric").alias("b")).scalar()
    d = c.groupBy("window_id").agg(F.max_by("threshold", "metric").alias("peak_threshold"), F.max("metric").alias("peak"))
    return emit(d.withColumn("vs_baseline", F.col("peak") - base))


# --- ranking ---------------------------------------------------------------------------


@query(
    "k1_top_decile",
    E(
        "n_top f:precision f:recall f:lift",
        "SELECT count(*) AS n_top, avg(CAST(is_winner AS INT)) AS precision, count(*) FILTER (is_winner) / (SELECT count(*) FROM scored WHERE is_winner) AS recall, "
        "avg(CAST(is_winner AS INT)) / (SELECT avg(CAST(is_winner AS INT)) FROM scored) AS lift FROM (SELECT *, row_number() OVER (ORDER BY score DESC, symbol, date) AS r FROM scored) WHERE r <= greatest(1, (SELECT count(*) // 10 FROM scored))",
    ),
)
def k1(spark, sf):
    d = staged(scored(Tables(spark, sf)).select("symbol", "date", "score", F.col("is_winner").cast("int").alias("y")))
    top = st.top_share(d, "score", ["symbol", "date"], 10)
    a = d.agg(F.sum("y").alias("p"), F.avg("y").alias("b"))
    a = row_of(a)
    p, b = a["p"], a["b"]
    out = top.agg(F.count(F.lit(1)).alias("n_top"), F.avg("y").alias("precision"), F.sum("y").alias("hit"))
    return emit(
        out.withColumns({"recall": F.col("hit") / p, "lift": F.col("precision") / b}), "n_top", "precision", "recall", "lift"
    )


@query(
    "k2_top_per_day",
    E("d:date i:rank symbol f:score", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rank FROM scored) WHERE rank <= 5"),
)
def k2(spark, sf):
    d = st.top_per_group(scored(Tables(spark, sf)), ["date"], [F.col("score").desc(), "symbol"], 5)
    return emit(d.withColumn("rank", F.col("rank").cast("long")), "date", "rank", "symbol", "score")


@query("k3_best_signal", E("symbol d:date rule_key", "SELECT * FROM best_signal"))
def k3(spark, sf):
    return emit(best_signals(Tables(spark, sf)), "symbol", "date", "rule_key")


@query(
    "k4_percentile_cut",
    E("symbol d:date f:roc_20", "SELECT symbol, date, roc_20 FROM rf WHERE roc_20 >= (SELECT quantile_cont(roc_20, 0.95) FROM rf)"),
)
def k4(spark, sf):
    d = fx.roc(Tables(spark, sf).bars(), (20,))
    cut = exact_quantiles(d, [], "roc_20", {"q": 0.95}).scalar()
    return emit(d.where(F.col("roc_20") >= cut), "symbol", "date", "roc_20")


@query(
    "k5_highest_passing_cell",
    E(
        "i:window_id f:max_metric_threshold f:highest_passing",
        "SELECT window_id, arg_max(threshold, metric) AS max_metric_threshold, max(CASE WHEN metric > 0.3 THEN threshold END) AS highest_passing FROM cells GROUP BY window_id",
    ),
)
def k5(spark, sf):
    c = window_cells(Tables(spark, sf))
    d = c.groupBy("window_id").agg(
        F.max_by("threshold", "metric").alias("max_metric_threshold"),
        F.max(F.when(F.col("metric") > 0.3, F.col("threshold"))).alias("highest_passing"),
    )
    return emit(d)


@query("k6_last_dates", "SELECT CAST(date AS VARCHAR) AS date FROM (SELECT DISTINCT date FROM bars) ORDER BY date DESC LIMIT 20")
def k6(spark, sf):
    from ..operators.signals import last_dates

    return emit(last_dates(Tables(spark, sf).bars(), 20))


@query(
    "k7_stratified_sample",
    "SELECT symbol, CAST(date AS VARCHAR) AS date, CAST(is_winner AS INTEGER) AS is_winner FROM (SELECT *, row_number() OVER (PARTITION BY is_winner ORDER BY md5(symbol || '|' || CAST(date AS VARCHAR)), symbol, date) AS r FROM winners WHERE is_winner IS NOT NULL) WHERE r <= 300",
)
def k7(spark, sf):
    d = lb.forward_winner(Tables(spark, sf).bars(), 30, 2.0, "close_adj").where(F.col("is_winner").isNotNull())
    return emit(st.hash_sample(d, ["is_winner"], ["symbol", "date"], 300), "symbol", "date", "is_winner")


@query("k8_sorted_head", E("symbol d:date f:close", "SELECT symbol, date, close FROM bars ORDER BY close DESC, symbol, date LIMIT 50"))
def k8(spark, sf):
    return emit(Tables(spark, sf).bars().orderBy(F.desc("close"), "symbol", "date").limit(50), "symbol", "date", "close")


# --- unions and sets -------------------------------------------------------------------

_POS = "SELECT symbol, date FROM bars WHERE close >= 60000"
_THIN = "SELECT symbol, date FROM bars WHERE volume < 20"


def sets(t):
    b = t.bars()
    return b.where("close >= 60000").select("symbol", "date"), b.where("volume < 20").select("symbol", "date")


@query("o1_union_all", f"SELECT symbol, count(*) AS n FROM ({_POS} UNION ALL {_THIN}) GROUP BY symbol")
def o1(spark, sf):
    a, b = sets(Tables(spark, sf))
    return a.unionByName(b).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(
    "o2_set_overlap",
    E(
        "n_a n_b n_both f:share_of_a f:share_of_b f:jaccard",
        "SELECT *, n_both / n_a AS share_of_a, n_both / n_b AS share_of_b, n_both / (n_a + n_b - n_both) AS jaccard FROM "
        f"(SELECT (SELECT count(*) FROM ({_POS})) AS n_a, (SELECT count(*) FROM ({_THIN})) AS n_b, (SELECT count(*) FROM ({_POS} INTERSECT {_THIN})) AS n_both)",
    ),
)
def o2(spark, sf):
    a, b = sets(Tables(spark, sf))
    return emit(jn.overlap(a, b, ["symbol", "date"]))


@query("o3_distinct", f"SELECT DISTINCT symbol, CAST(date AS VARCHAR) AS date FROM ({_POS} UNION ALL {_THIN})")
def o3(spark, sf):
    a, b = sets(Tables(spark, sf))
    return emit(a.unionByName(b).distinct())


@query(
    "o4_hybrid_labels",
    "SELECT CAST(date AS VARCHAR) AS date, CASE WHEN a.regime_label = 'uptrend' THEN 'uptrend' WHEN b.vol_tercile = 'high' THEN 'stress' ELSE 'neutral' END AS regime_label FROM regimes a FULL JOIN terciles b USING (date)",
)
def o4(spark, sf):
    m = Tables(spark, sf).market()
    j = fx.market_regime(m).join(fx.vol_terciles(m).select("date", "vol_tercile"), "date", "full_outer")
    lab = F.when(F.col("market_regime") == "uptrend", "uptrend").when(F.col("vol_tercile") == "high", "stress").otherwise("neutral")
    return emit(j.select("date", lab.alias("regime_label")))


# --- joins on keys ---------------------------------------------------------------------


@query("j1_left_join_dimension", E("symbol d:date peer_group sector f:close", "SELECT * FROM bars LEFT JOIN peers USING (symbol)"))
def j1(spark, sf):
    t = Tables(spark, sf)
    return emit(t.bars().join(t.peers(), "symbol", "left"), "symbol", "date", "peer_group", "sector", "close")


@query("j2_inner_join_keys", "SELECT t.symbol, CAST(t.entry_date AS VARCHAR) AS entry_date, b.exit_reason FROM trades t JOIN bull b USING (symbol, entry_date)")
def j2(spark, sf):
    t = Tables(spark, sf)
    d = trades_of(t).join(bull_trades(t).select("symbol", "entry_date", "exit_reason"), ["symbol", "entry_date"])
    return emit(d, "symbol", "entry_date", "exit_reason")


@query("j3_semi_join", "SELECT symbol, CAST(entry_date AS VARCHAR) AS entry_date FROM trades WHERE symbol IN (SELECT symbol FROM sym_metrics WHERE vol_z_late > 0)")
def j3(spark, sf):
    t = Tables(spark, sf)
    keep = sym_metrics(t).where("vol_z_late > 0")
    return emit(trades_of(t).join(keep, "symbol", "left_semi"), "symbol", "entry_date")


@query(
    "j4_presence_flags",
    "SELECT symbol, CAST(date AS VARCHAR) AS date, CAST(coalesce(a, false) AS INTEGER) AS in_a, CAST(coalesce(b, false) AS INTEGER) AS in_b FROM "
    f"(SELECT symbol, date, true AS a FROM ({_POS})) x FULL JOIN (SELECT symbol, date, true AS b FROM ({_THIN})) y USING (symbol, date)",
)
def j4(spark, sf):
    a, b = sets(Tables(spark, sf))
    return emit(jn.presence(a, b, ["symbol", "date"], "in_a", "in_b"))


# --- series statistics -----------------------------------------------------------------

add_cte("lr", f"SELECT symbol, date, close, ln(close / nullif({lag('close')}, 0)) AS r FROM bars")
add_cte("lr_ok", "SELECT * FROM lr WHERE r IS NOT NULL")


@query(
    "q1_autocorrelation",
    E(
        "symbol f:autocorr_1 f:autocorr_5 f:autocorr_60",
        "SELECT symbol, corr(r, l1) AS autocorr_1, corr(r, l5) AS autocorr_5, corr(r, l60) AS autocorr_60 FROM "
        f"(SELECT *, {lag('r', 1)} AS l1, {lag('r', 5)} AS l5, {lag('r', 60)} AS l60 FROM lr_ok) GROUP BY symbol",
    ),
)
def q1(spark, sf):
    return emit(st.autocorrelation(st.log_returns(Tables(spark, sf).bars(), DAILY), DAILY))


@query("q2_skewness", E("symbol f:returns_skew", "SELECT symbol, skewness(r) AS returns_skew FROM lr_ok GROUP BY symbol"))
def q2(spark, sf):
    return emit(st.skew(st.log_returns(Tables(spark, sf).bars(), DAILY), ["symbol"]))


@query(
    "q3_variance_ratio",
    E("symbol f:vr_5", f"SELECT symbol, var_samp(k) / (5 * var_samp(r)) AS vr_5 FROM (SELECT *, {roll('sum', 'r', 5)} AS k FROM lr_ok) GROUP BY symbol"),
)
def q3(spark, sf):
    return emit(st.variance_ratio(st.log_returns(Tables(spark, sf).bars(), DAILY), DAILY, 5))


@query(
    "q4_hurst",
    E(
        "symbol f:hurst",
        "SELECT symbol, regr_slope(ln(rs), ln(lag)) AS hurst FROM (SELECT symbol, lag, avg(rs) AS rs FROM (SELECT symbol, lag, seg, (max(cum) - min(cum)) / nullif(stddev_pop(close), 0) AS rs FROM "
        "(SELECT *, sum(dev) OVER (PARTITION BY symbol, lag, seg ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum FROM (SELECT *, close - avg(close) OVER (PARTITION BY symbol, lag, seg) AS dev FROM "
        f"(SELECT symbol, close, i, lag, (i - 1) // lag AS seg FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars_n), (SELECT unnest([{', '.join(map(str, st.hurst_lags()))}]) AS lag) WHERE n >= 2 * lag AND i <= (n // lag) * lag))) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY symbol",
    ),
)
def q4(spark, sf):
    return emit(st.hurst(Tables(spark, sf).bars(), DAILY))


@query(
    "q5_half_life",
    E("symbol f:ou_half_life", f"SELECT symbol, CASE WHEN t > 0 THEN ln(2) / t END AS ou_half_life FROM (SELECT symbol, -regr_slope(lp - lg, lg) AS t FROM (SELECT symbol, ln(close) AS lp, {lag('ln(close)')} AS lg FROM bars) GROUP BY symbol)"),
)
def q5(spark, sf):
    return emit(st.half_life(Tables(spark, sf).bars(), DAILY))


@query(
    "q6_conditional_recovery",
    E(
        "symbol f:p_recovery n_attempts",
        "SELECT symbol, avg(CAST(list_max(list_slice(f, pos, pos + 19)) >= close AS INT)) AS p_recovery, count(*) AS n_attempts FROM (SELECT *, list_position(list_transform(f[1:100], lambda x: x <= close * 0.95), true) AS pos FROM "
        f"(SELECT *, list(close) OVER {win('1 FOLLOWING', '120 FOLLOWING')} AS f, count(*) OVER {win('1 FOLLOWING', 'UNBOUNDED FOLLOWING')} AS lft FROM bars) WHERE lft >= 100) WHERE pos IS NOT NULL GROUP BY symbol",
    ),
)
def q6(spark, sf):
    return emit(st.conditional_recovery(Tables(spark, sf).bars(), DAILY))


add_cte("dd", f"SELECT *, close / max(close) OVER {win('199 PRECEDING')} - 1 AS dd FROM bars")


@query(
    "q7_continuation",
    E(
        "symbol f:p_catastrophic n_bars",
        f"SELECT symbol, avg(CAST(m <= -0.3 AS INT)) AS p_catastrophic, count(*) AS n_bars FROM (SELECT *, min(dd) OVER {win('CURRENT ROW', '199 FOLLOWING')} AS m FROM dd) WHERE dd <= -0.1 AND dd > -0.3 GROUP BY symbol",
    ),
)
def q7(spark, sf):
    return emit(st.continuation(Tables(spark, sf).bars(), DAILY))


@query("q8_volume_trend", E("symbol f:mean_dv f:vol_slope_yr f:vol_z_late", "SELECT * FROM sym_metrics"))
def q8(spark, sf):
    return emit(sym_metrics(Tables(spark, sf)), "symbol", "mean_dv", "vol_slope_yr", "vol_z_late")


@query(
    "q9_trailing_sharpe",
    E(
        "symbol f:sharpe_terminal",
        "SELECT symbol, CASE WHEN count(*) >= 60 AND stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(365.0) ELSE 0 END AS sharpe_terminal FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS b FROM lr_ok) WHERE b <= 60 GROUP BY symbol",
    ),
)
def q9(spark, sf):
    d = st.log_returns(Tables(spark, sf).bars(), DAILY).where("r IS NOT NULL")
    day = d.groupBy("symbol", F.col("date").alias("day")).agg(F.sum("r").alias("r"))
    return emit(st.trailing_sharpe(day, "symbol", "r"))


add_cte(
    "ranged",
    "SELECT symbol, close, row_number() OVER w AS i, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars "
    "WINDOW w AS (PARTITION BY symbol ORDER BY date)",
)


@query(
    "q10_mean_atr_pct",
    E(
        "symbol f:mean_atr_pct",
        "SELECT symbol, avg(y / nullif(close, 0) * 100) AS mean_atr_pct FROM (WITH RECURSIVE e AS (SELECT symbol, i, close, tr AS y FROM ranged WHERE i = 1 UNION ALL "
        "SELECT b.symbol, b.i, b.close, e.y + (2.0 / 15) * (b.tr - e.y) FROM e JOIN ranged b ON b.symbol = e.symbol AND b.i = e.i + 1) SELECT * FROM e) q GROUP BY symbol",
    ),
)
def q10(spark, sf):
    return emit(st.mean_atr_pct(Tables(spark, sf).bars()))


_ZX = {"a": "n_days", "b": "vol_z_late", "c": "vol_slope_yr"}
add_cte(
    "ols_z",
    "SELECT mean_log_dv AS y, " + ", ".join(f"coalesce(({x} - avg({x}) OVER ()) / nullif(stddev_pop({x}) OVER (), 0), 0) AS {n}" for n, x in _ZX.items())
    + " FROM sym_metrics WHERE mean_log_dv IS NOT NULL",
)
# normal equations of three centred regressors: the inverse of their covariances, written out
add_cte(
    "ols_fit",
    "SELECT *, (g11 * ya + g12 * yb + g13 * yc) AS ba, (g12 * ya + g22 * yb + g23 * yc) AS bb, (g13 * ya + g23 * yb + g33 * yc) AS bc FROM ("
    "SELECT *, (bb2 * cc - bc2 * bc2) / d AS g11, (ac * bc2 - ab * cc) / d AS g12, (ab * bc2 - ac * bb2) / d AS g13, "
    "(aa * cc - ac * ac) / d AS g22, (ab * ac - aa * bc2) / d AS g23, (aa * bb2 - ab * ab) / d AS g33 FROM ("
    "SELECT *, aa * (bb2 * cc - bc2 * bc2) - ab * (ab * cc - ac * bc2) + ac * (ab * bc2 - ac * bb2) AS d FROM ("
    "SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, var_pop(y) AS yy, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb2, covar_pop(c, c) AS cc, "
    "covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc2, covar_pop(a, y) AS ya, covar_pop(b, y) AS yb, covar_pop(c, y) AS yc FROM ols_z) s) t) u",
)
_TERMS = {"n_days": ("ba", "g11"), "vol_z_late": ("bb", "g22"), "vol_slope_yr": ("bc", "g33")}


@query(
    "q11_ols",
    E(
        "term f:coefficient f:std_error f:t_value f:r2 f:adj_r2",
        "SELECT *, coefficient / std_error AS t_value, 1 - (1 - r2) * (n - 1) / (n - 4) AS adj_r2 FROM ("
        + " UNION ALL ".join(f"SELECT '{x}' AS term, {b} AS coefficient, sqrt((yy - ba * ya - bb * yb - bc * yc) * {g} / (n - 4)) AS std_error, (ba * ya + bb * yb + bc * yc) / yy AS r2, n FROM ols_fit" for x, (b, g) in _TERMS.items())
        + " UNION ALL SELECT 'intercept', my - ba * ma - bb * mb - bc * mc, "
        "sqrt((yy - ba * ya - bb * yb - bc * yc) / (n - 4) * (1 + g11 * ma * ma + g22 * mb * mb + g33 * mc * mc + 2 * (g12 * ma * mb + g13 * ma * mc + g23 * mb * mc))), "
        "(ba * ya + bb * yb + bc * yc) / yy, n FROM ols_fit)",
    ),
)
def q11(spark, sf):
    return emit(st.ols(sym_metrics(Tables(spark, sf)), "mean_log_dv", ["n_days", "vol_z_late", "vol_slope_yr"]))


@query(
    "q12_regressions",
    E(
        "f:slope f:intercept f:r2 f:cv",
        "SELECT regr_slope(ln(mean_dv), ln(n_days)) AS slope, regr_intercept(ln(mean_dv), ln(n_days)) AS intercept, regr_r2(ln(mean_dv), ln(n_days)) AS r2, stddev_pop(mean_dv) / avg(mean_dv) * 100 AS cv FROM sym_metrics",
    ),
)
def q12(spark, sf):
    y, x = F.ln("mean_dv"), F.ln("n_days")
    d = sym_metrics(Tables(spark, sf)).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        (F.stddev_pop("mean_dv") / F.avg("mean_dv") * 100).alias("cv"),
    )
    return emit(d)


@query(
    "q12_two_regressor_fit",
    E(
        "f:alpha f:beta f:gamma",
        "SELECT my - b1 * m1 - b2 * m2 AS alpha, b1 AS beta, b2 AS gamma FROM (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM "
        "(SELECT var_samp(a) AS s11, var_samp(b) AS s22, covar_samp(a, b) AS s12, covar_samp(a, y) AS s1y, covar_samp(b, y) AS s2y, avg(y) AS my, avg(a) AS m1, avg(b) AS m2 FROM (SELECT ln(mean_dv) AS y, ln(n_days) AS a, vol_slope_yr AS b FROM sym_metrics)))",
    ),
)
def q12b(spark, sf):
    d = sym_metrics(Tables(spark, sf)).select(F.ln("mean_dv").alias("y"), F.ln("n_days").alias("a"), F.col("vol_slope_yr").alias("b"))
    return emit(st.two_regressors(d, "y", "a", "b"))


@query(
    "q13_cluster_persistence",
    E(
        "f:same_1 f:same_5 f:same_30",
        "SELECT " + ", ".join(f"avg(CAST(c = l{k} AS INT)) AS same_{k}" for k in (1, 5, 30)) + " FROM (SELECT *, "
        + ", ".join(f"{lead('c', k)} AS l{k}" for k in (1, 5, 30)) + " FROM (SELECT symbol, date, CAST(floor(rsi_14 / 10.003) AS INT) AS c FROM rf WHERE rsi_14 IS NOT NULL))",
    ),
)
def q13(spark, sf):
    d = fx.rsi(Tables(spark, sf).bars(), (14,)).where("rsi_14 IS NOT NULL")
    d = d.withColumn("c", F.floor(F.col("rsi_14") / 10.003))
    d = d.withColumns({f"l{k}": DAILY.lead("c", k) for k in (1, 5, 30)})
    return emit(d.agg(*[F.avg((F.col("c") == F.col(f"l{k}")).cast("double")).alias(f"same_{k}") for k in (1, 5, 30)]))


# --- rolling profit, drawdown, flags -----------------------------------------------------

add_cte("pnl_days", "SELECT exit_date AS day, sum(net_pnl_pct / 100 * 1000) AS pnl FROM bull GROUP BY 1")
add_cte(
    "dense",
    "SELECT d.day, coalesce(pnl, 0) AS pnl FROM (SELECT CAST(unnest(generate_series((SELECT min(day) FROM pnl_days), (SELECT max(day) FROM pnl_days), INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN pnl_days USING (day)",
)
add_cte("rolled", "SELECT *, sum(pnl) OVER (ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS roll30 FROM dense")


def rolled(t):
    day = bull_trades(t).groupBy(F.col("exit_date").alias("day")).agg(F.sum(F.col("net_pnl_pct") / 100 * 1000.0).alias("pnl"))
    return st.calendar_sum(st.dense_days(day, "day", "pnl"), "day", "pnl", 30, "roll30")


@query(
    "x20_rolling_pnl_distribution",
    E(
        "f:worst f:p10 f:p25 f:median f:mean f:p75 f:p90 f:p99 f:best d:best_day d:worst_day",
        "SELECT min(roll30) AS worst, quantile_cont(roll30, 0.1) AS p10, quantile_cont(roll30, 0.25) AS p25, median(roll30) AS median, avg(roll30) AS mean, quantile_cont(roll30, 0.75) AS p75, quantile_cont(roll30, 0.9) AS p90, "
        "quantile_cont(roll30, 0.99) AS p99, max(roll30) AS best, min(day) FILTER (round(roll30, 4) = (SELECT max(round(roll30, 4)) FROM rolled)) AS best_day, min(day) FILTER (round(roll30, 4) = (SELECT min(round(roll30, 4)) FROM rolled)) AS worst_day FROM rolled",
    ),
)
def x20(spark, sf):
    d = rolled(Tables(spark, sf)).withColumn("k", F.round("roll30", 4))
    probs = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
    # one row per calendar day, so the built-in percentile is bounded
    a = d.agg(
        F.min("roll30").alias("worst"),
        F.percentile("roll30", F.array(*[F.lit(p) for p in probs])).alias("q"),
        F.avg("roll30").alias("mean"),
        F.max("roll30").alias("best"),
        F.max(F.struct(F.col("k"), -F.unix_date("day"))).alias("hi"),
        F.min(F.struct(F.col("k"), F.unix_date("day"))).alias("lo"),
    )
    names = ("p10", "p25", "median", "p75", "p90", "p99")
    cols = {n: F.col("q")[i] for i, n in enumerate(names)}
    cols["best_day"] = F.date_from_unix_date(-F.col("hi")["col2"])
    cols["worst_day"] = F.date_from_unix_date(F.col("lo")["col2"])
    return emit(a.withColumns(cols), "worst", *names, "mean", "best", "best_day", "worst_day")


@query(
    "x21_drawdown_profile",
    E(
        "symbol f:max_drawdown f:p_drawdown_30pct f:mean_recovery_bars",
        "SELECT symbol, min(dd) AS max_drawdown, avg(CAST(dd < -0.3 AS INT)) AS p_drawdown_30pct, coalesce(sum(u) / nullif(sum(st), 0), 0) AS mean_recovery_bars FROM "
        f"(SELECT *, CASE WHEN u = 1 AND coalesce({lag('u')}, 0) = 0 THEN 1 ELSE 0 END AS st FROM (SELECT *, CAST(dd < -0.1 AS INT) AS u FROM dd)) GROUP BY symbol",
    ),
)
def x21(spark, sf):
    return emit(st.underwater(Tables(spark, sf).bars(), DAILY))


@query(
    "x22_flag_baseline",
    E(
        "n_flags n_fired n_both n_winners_flagged n_winners_missed f:recall",
        "SELECT (SELECT count(*) FROM fl) AS n_flags, (SELECT count(*) FROM fi) AS n_fired, (SELECT count(*) FROM fl SEMI JOIN fi USING (symbol, date)) AS n_both, "
        "(SELECT count(*) FROM w SEMI JOIN fl USING (symbol, date)) AS n_winners_flagged, (SELECT count(*) FROM w ANTI JOIN fl USING (symbol, date)) AS n_winners_missed, "
        "(SELECT count(*) FROM w SEMI JOIN fl USING (symbol, date)) / (SELECT count(*) FROM w) AS recall FROM (SELECT 1)",
    ).replace("SELECT n_flags", "WITH fl AS (SELECT symbol, date FROM rf WHERE vol_mult_30 >= 1.503 AND roc_20 > 0), fi AS (SELECT DISTINCT symbol, date FROM fired), w AS (SELECT symbol, date FROM rf WHERE is_winner) SELECT n_flags", 1),
)
def x22(spark, sf):
    from .q_rules import LIVE

    d = rule_frame(Tables(spark, sf))
    flag = F.coalesce((F.col("vol_mult_30") >= 1.503) & (F.col("roc_20") > 0), F.lit(False))
    fire = F.size(ru.fired_keys(LIVE, d.columns)) > 0
    won = F.coalesce("is_winner", F.lit(False))
    # flags, firings and winners share the row key, so the semi and anti joins are row tests
    a = d.agg(
        F.count_if(flag).alias("n_flags"),
        F.count_if(fire).alias("n_fired"),
        F.count_if(flag & fire).alias("n_both"),
        F.count_if(won & flag).alias("n_winners_flagged"),
        F.count_if(won & ~flag).alias("n_winners_missed"),
    )
    w = F.col("n_winners_flagged")
    return emit(a.withColumn("recall", ratio(w.cast("double"), (w + F.col("n_winners_missed")).cast("double"))))


