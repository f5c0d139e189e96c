"""Trades, friction, performance."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import DAILY, ratio
from ..operators import features as fx
from ..operators import joins as jn
from ..operators import labels as lb
from ..operators import rules as ru
from ..operators import trades as tr
from ..session import staged
from .common import E, Tables, emit
from .q_labels import MOM
from .q_rules import LIVE, WINDOWS, rule_frame
from .registry import add_cte, div, lag, query, roll, prior, win

POS = 1000.0
START = 1_000_000.0

add_cte(
    "trades",
    "SELECT symbol, date AS entry_date, close_adj AS entry_price, exit_date, exit_close_adj AS exit_price, (exit_close_adj / nullif(close_adj, 0) - 1) * 100 AS gross_pnl_pct, "
    "forward_max_pct, is_momentum_winner AS is_winner_label, avg_dollar_volume_30d, 60 AS realized_horizon_days FROM momentum "
    "WHERE entry AND is_momentum_winner IS NOT NULL AND exit_close_adj IS NOT NULL",
)


def trades_of(t):
    return tr.momentum_trades(lb.equity_momentum(t.bars(), MOM), MOM.horizon)


T_SPEC = "symbol d:entry_date f:entry_price d:exit_date f:exit_price f:gross_pnl_pct f:forward_max_pct b:is_winner_label f:avg_dollar_volume_30d i:realized_horizon_days"


@query("x1_momentum_trades", E(T_SPEC, "SELECT * FROM trades"))
def x1(spark, sf):
    return emit(trades_of(Tables(spark, sf)))


def curve_sql(src, by, day, pnl, order, start=START):
    p = f"PARTITION BY {by} " if by else ""
    return (
        f"SELECT *, pnl / (CASE WHEN eq - pnl = 0 THEN 1e-9 ELSE eq - pnl END) AS ev, (eq - pk) / pk AS dd FROM (SELECT *, greatest({start}, max(eq) OVER ({p}ORDER BY {day}, {order} ROWS UNBOUNDED PRECEDING)) AS pk FROM "
        f"(SELECT *, {start} + sum(pnl) OVER ({p}ORDER BY {day}, {order} ROWS UNBOUNDED PRECEDING) AS eq FROM (SELECT *, {pnl} AS pnl FROM {src})))"
    )


SHARPE = "CASE WHEN stddev_pop(ev) > 0 THEN avg(ev) / greatest(stddev_pop(ev), 1e-9) * sqrt(252.0) ELSE 0 END"
add_cte("trades_w", "SELECT * FROM trades JOIN wf_windows ON entry_date BETWEEN lo AND hi")


@query(
    "x2_window_stats",
    E(
        "i:window_id n_trades f:win_rate f:mean_gross_pnl_pct f:median_gross_pnl_pct f:total_gross_pnl_usd f:sharpe f:max_drawdown",
        "SELECT window_id, count(*) AS n_trades, avg(CASE WHEN gross_pnl_pct > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(gross_pnl_pct) AS mean_gross_pnl_pct, "
        f"median(gross_pnl_pct) AS median_gross_pnl_pct, sum(pnl) AS total_gross_pnl_usd, {SHARPE} AS sharpe, least(min(dd), 0) AS max_drawdown FROM "
        f"({curve_sql('trades_w', 'window_id', 'exit_date', 'gross_pnl_pct / 100 * 1000', 'symbol, entry_date')}) GROUP BY window_id",
    ),
)
def x2(spark, sf):
    t = trades_of(Tables(spark, sf)).withColumn("window_id", ru.window_id(WINDOWS, "entry_date").cast("long"))
    d = tr.window_stats(t.where("window_id IS NOT NULL"), "window_id", POS, START)
    return emit(d, "window_id", "n_trades", "win_rate", "mean_gross_pnl_pct", "median_gross_pnl_pct", "total_gross_pnl_usd", "sharpe", "max_drawdown")


# --- barrier exits ---------------------------------------------------------------------

_EX = ", ".join(f"('{k}', {t}, {s}, {d})" for k, (t, s, d) in tr.LABEL_EXITS.items())
_RL = ", ".join(f"('{r.key}', '{r.source}', {i})" for i, r in enumerate(LIVE))
add_cte(
    "best_signal",
    "SELECT symbol, date, rule_key, label FROM (SELECT symbol, date, rule_key, label, row_number() OVER (PARTITION BY symbol, date ORDER BY ord DESC, rule_key) AS r "
    f"FROM fired JOIN (VALUES {_RL}) v(rule_key, label, ord) USING (rule_key)) WHERE r = 1",
)
_A61 = win("2 FOLLOWING", "61 FOLLOWING")
add_cte(
    "barrier",
    f"""SELECT symbol, date AS signal_date, rule_key, entry_date, entry_price,
      CASE WHEN reason = 'end_of_period' THEN e_date WHEN reason = 'stop' THEN ds[si] WHEN reason = 'target' THEN ds[ti] ELSE ds[d] END AS exit_date,
      CASE WHEN reason = 'stop' THEN sl WHEN reason = 'target' THEN tp WHEN reason = 'time' THEN adj[d] ELSE e_close END * 0.999 AS exit_price, reason AS exit_reason
    FROM (SELECT *, CASE WHEN si IS NOT NULL AND (ti IS NULL OR si <= ti) THEN 'stop' WHEN ti IS NOT NULL THEN 'target' WHEN len(adj) >= d THEN 'time' ELSE 'end_of_period' END AS reason
      FROM (SELECT *, list_position(list_transform(lows[1:d], lambda x: x <= sl), true) AS si, list_position(list_transform(highs[1:d], lambda x: x >= tp), true) AS ti
        FROM (SELECT *, entry_price * (1 + tpc) AS tp, entry_price * (1 - spc) AS sl FROM (
          SELECT s.*, p.* EXCLUDE (symbol, date), fill * 1.001 AS entry_price, x.tpc, x.spc, x.d FROM best_signal s JOIN (
            SELECT symbol, date, lead(open) OVER w AS fill, lead(date) OVER w AS entry_date, list(low) OVER {_A61} AS lows, list(high) OVER {_A61} AS highs,
                   list(date) OVER {_A61} AS ds, list(close_adj) OVER {_A61} AS adj, last(date) OVER z AS e_date, last(close_adj) OVER z AS e_close
            FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date), z AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) p USING (symbol, date)
          JOIN (VALUES {_EX}) x(label, tpc, spc, d) USING (label) WHERE fill > 0))))""",
)


def best_signals(t):
    """Strongest rule per (symbol, date); here the rule order stands for its lift."""
    rank = F.create_map(*[x for i, r in enumerate(LIVE) for x in (F.lit(r.key), F.lit(i))])
    f = ru.firings(rule_frame(t), LIVE)
    # every rule has a rank of its own, and the frame is dealt by symbol already
    f = f.groupBy("symbol", "date").agg(F.max(rank[F.col("rule_key")]).alias("_r"))
    key, label = (F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("_r") + 1) for xs in zip(*[(r.key, r.source) for r in LIVE]))
    return f.select("symbol", "date", key.alias("rule_key"), label.alias("label"))


def barrier_trades(t, bars=None, keep=()):
    return tr.barrier_exits(t.bars() if bars is None else bars, best_signals(t), keep=keep)


B_SPEC = "symbol d:signal_date rule_key d:entry_date f:entry_price d:exit_date g:exit_price exit_reason"


@query("x3_barrier_exits", E(B_SPEC, "SELECT * FROM barrier"))
def x3(spark, sf):
    return emit(barrier_trades(Tables(spark, sf, share=True)), coarse=("exit_price",))


# --- two-stage exits -----------------------------------------------------------------------

EXIT_VARIANTS = {"e60_c60": (60, 60), "e30_c60": (30, 60), "e20_c40": (20, 40)}
add_cte(
    "exit_rows",
    "SELECT symbol, date, open, close_adj, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, "
    "coalesce(rsi_14 >= (SELECT quantile_cont(rsi_14, 0.98) FROM rf), false) AS would_exit FROM rf",
)
add_cte(
    "entry_rows",
    "SELECT symbol, date, max(strength) AS signal_strength FROM fired JOIN (VALUES "
    + ", ".join(f"('{r.key}', 1.0 / {i + 1})" for i, r in enumerate(LIVE))
    + ") v(rule_key, strength) USING (rule_key) GROUP BY 1, 2",
)
add_cte(
    "entry_fills",
    "SELECT e.symbol, e.date, e.signal_strength, b.i, b.open, (SELECT max(z.i) FROM exit_rows z WHERE z.symbol = e.symbol) AS last FROM entry_rows e "
    "JOIN exit_rows a USING (symbol, date) JOIN exit_rows b ON b.symbol = a.symbol AND b.i = a.i + 1 WHERE b.open > 0",
)


def _exit_sql(variant):
    far, cap = EXIT_VARIANTS[variant]
    late = f"i + {far + 1}" if far < cap else "last + 1"
    return (
        f"SELECT '{variant}' AS variant, o.symbol, o.date AS entry_date, x.date AS exit_date, o.at - o.i AS days_held, o.open AS entry_price, x.close_adj AS exit_price, "
        "(x.close_adj / o.open - 1) * 100 AS realized_gain_pct, exit_reason, signal_strength FROM ("
        f"SELECT *, CASE WHEN sig IS NOT NULL THEN sig WHEN {late} <= last THEN {late} ELSE least(i + {cap}, last) END AS at, "
        f"CASE WHEN sig IS NOT NULL THEN 'exit_signal' WHEN {late} <= last THEN 'eligibility_cap' WHEN i + {cap} <= last THEN 'hard_cap' ELSE 'end_of_data' END AS exit_reason FROM ("
        "SELECT f.symbol, f.date, f.i, f.open, f.last, f.signal_strength, min(q.i) AS sig FROM entry_fills f "
        f"LEFT JOIN exit_rows q ON q.symbol = f.symbol AND q.would_exit AND q.i > f.i AND q.i <= f.i + {min(far, cap)} GROUP BY ALL) u) o "
        "JOIN exit_rows x ON x.symbol = o.symbol AND x.i = o.at"
    ).replace(" at,", " pos,").replace("o.at", "o.pos").replace("AS at", "AS pos")


def exit_pairs(t, *variants):
    rank = F.create_map(*[x for i, r in enumerate(LIVE) for x in (F.lit(r.key), F.lit(1.0 / (i + 1)))])
    frame = staged(rule_frame(t).select("symbol", "date", "open", "close_adj", *sorted({c[0] for r in LIVE for c in r.conditions})))
    entries = ru.firings(frame, LIVE).select("symbol", "date", rank[F.col("rule_key")].alias("signal_strength"))
    bars = tr.exit_flags(frame, "rsi_14", 0.02)
    out = [tr.two_stage_exits(bars, entries, *EXIT_VARIANTS[v]).withColumn("variant", F.lit(v)) for v in variants]
    return reduce(lambda a, b: a.unionByName(b), out)


@query(
    "u18_two_stage_exits",
    E("symbol d:entry_date d:exit_date i:days_held f:entry_price f:exit_price f:realized_gain_pct exit_reason f:signal_strength", _exit_sql("e30_c60")),
)
def u18(spark, sf):
    d = exit_pairs(Tables(spark, sf, share=True), "e30_c60").drop("variant")
    return emit(d)


def _rank_sql(c, q):
    return f"list_sort(list({c}))[1 + CAST(floor((count(*) - 1) * {q} + 0.5) AS INTEGER)]"


@query(
    "u19_exit_variants",
    E(
        "variant n_entries n_with_exit n_hard_cap f:exit_coverage_pct f:mean_hold_days f:median_hold_days f:p25_hold_days f:p75_hold_days i:min_hold_days i:max_hold_days "
        "g:mean_gain_pct g:median_gain_pct g:p25_gain_pct g:p75_gain_pct f:win_rate g:worst_gain_pct b:passes_mean_hold_days b:passes_median_gain_pct b:passes_win_rate b:passes_all",
        "SELECT *, mean_hold_days >= 30 AS passes_mean_hold_days, median_gain_pct >= 20 AS passes_median_gain_pct, win_rate >= 0.5 AS passes_win_rate, "
        "mean_hold_days >= 30 AND median_gain_pct >= 20 AND win_rate >= 0.5 AS passes_all FROM (SELECT variant, count(*) AS n_entries, "
        "count(*) FILTER (exit_reason = 'exit_signal') AS n_with_exit, count(*) FILTER (exit_reason = 'hard_cap') AS n_hard_cap, "
        "100.0 * count(*) FILTER (exit_reason = 'exit_signal') / count(*) AS exit_coverage_pct, avg(days_held) AS mean_hold_days, median(days_held) AS median_hold_days, "
        f"{_rank_sql('days_held', 0.25)} AS p25_hold_days, {_rank_sql('days_held', 0.75)} AS p75_hold_days, min(days_held) AS min_hold_days, max(days_held) AS max_hold_days, "
        "avg(realized_gain_pct) AS mean_gain_pct, median(realized_gain_pct) AS median_gain_pct, "
        f"{_rank_sql('realized_gain_pct', 0.25)} AS p25_gain_pct, {_rank_sql('realized_gain_pct', 0.75)} AS p75_gain_pct, "
        "avg(CASE WHEN realized_gain_pct > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, min(realized_gain_pct) AS worst_gain_pct FROM ("
        + " UNION ALL ".join(_exit_sql(v) for v in EXIT_VARIANTS)
        + ") GROUP BY variant)",
    ),
)
def u19(spark, sf):
    d = tr.compare_exits(exit_pairs(Tables(spark, sf, share=True), *EXIT_VARIANTS))
    cols = "mean_gain_pct median_gain_pct p25_gain_pct p75_gain_pct worst_gain_pct".split()
    return emit(d, *[c for c in d.columns], coarse=tuple(cols))


# --- non-overlapping trades ------------------------------------------------------------

_F120 = win("1 FOLLOWING", "120 FOLLOWING")
add_cte(
    "cand",
    f"""SELECT symbol, date AS entry_date, i, close AS entry_price, coalesce(h, n) AS hold_days, i + coalesce(h, n) AS x,
       coalesce(ds[coalesce(h, n)], date) AS exit_date, coalesce(cs[coalesce(h, n)], close) AS exit_price,
       CASE WHEN h IS NOT NULL THEN 'tp' WHEN n >= 120 THEN 'horizon' ELSE 'data_end' END AS exit_reason
     FROM (SELECT *, list_position(list_transform(cs, lambda c: c >= close * 3.0), true) AS h, coalesce(len(cs), 0) AS n FROM (
       SELECT *, {prior('max', 'close', 60)} AS ph, list(close) OVER {_F120} AS cs, list(date) OVER {_F120} AS ds FROM bars_n) WHERE close > ph)""",
)
NON_OVER = """WITH RECURSIVE t AS (
   SELECT c.* FROM cand c JOIN (SELECT symbol, min(i) AS i FROM cand GROUP BY symbol) f ON c.symbol = f.symbol AND c.i = f.i
   UNION ALL
   SELECT c.* FROM cand c JOIN (SELECT t.symbol, min(n.i) AS i FROM t JOIN cand n ON n.symbol = t.symbol AND n.i > t.x GROUP BY 1) f ON c.symbol = f.symbol AND c.i = f.i)
 SELECT symbol, entry_date, exit_date, entry_price, exit_price, (exit_price / nullif(entry_price, 0) - 1) * 100 AS gross_pnl_pct,
        (exit_price / nullif(entry_price, 0) - 1) * 100 - 0.35 AS net_pnl_pct, hold_days, exit_reason FROM t"""
add_cte("bull", NON_OVER)


def bull_trades(t):
    return tr.non_overlapping(t.bars(), 60, 120, 2.0)


@query(
    "x4_non_overlapping_trades",
    E("symbol d:entry_date d:exit_date f:entry_price f:exit_price f:gross_pnl_pct f:net_pnl_pct i:hold_days exit_reason", "SELECT * FROM bull"),
)
def x4(spark, sf):
    return emit(bull_trades(Tables(spark, sf)))


add_cte("market_reg", "SELECT date, close, regime_label FROM market JOIN regimes USING (date)")
add_cte(
    "streaks",
    "SELECT id, min(date) AS entry_date, arg_min(close, date) AS entry_price, arg_max(coalesce(nx, close), date) AS exit_price, count(*) AS n_days FROM "
    "(SELECT *, sum(st) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS id FROM (SELECT *, lead(close) OVER (ORDER BY date) AS nx, "
    "CASE WHEN regime_label = 'uptrend' AND coalesce(lag(regime_label) OVER (ORDER BY date), '') <> 'uptrend' THEN 1 ELSE 0 END AS st FROM market_reg)) "
    "WHERE regime_label = 'uptrend' GROUP BY id",
)


@query(
    "x5_regime_streaks",
    E(
        "n_streaks i:total_days_in_regime f:mean_net_pnl_pct f:total_compound_pct f:annualized_cagr",
        "SELECT count(*) AS n_streaks, sum(n_days) AS total_days_in_regime, avg(exit_price / entry_price - 1) * 100 AS mean_net_pnl_pct, "
        "(exp(sum(ln(exit_price / entry_price))) - 1) * 100 AS total_compound_pct, pow(exp(sum(ln(exit_price / entry_price))), 252.0 / sum(n_days)) - 1 AS annualized_cagr FROM streaks",
    ),
)
def x5(spark, sf):
    m = Tables(spark, sf, share=True).market()
    d = m.join(fx.market_regime(m), "date").withColumnRenamed("market_regime", "regime_label")
    return emit(tr.streak_summary(tr.regime_streaks(d, "uptrend")))


add_cte(
    "liquid",
    "SELECT t.*, v.avg_volume_30d, entry_price < 20000 AS price_fail, avg_volume_30d < 30 AS volume_fail, "
    "coalesce(entry_price >= 20000 AND avg_volume_30d >= 30, false) AS is_kept FROM trades t LEFT JOIN "
    f"(SELECT symbol, date AS entry_date, {roll('avg', 'volume', 30)} AS avg_volume_30d FROM bars) v USING (symbol, entry_date)",
)


@query("x6_liquidity_filter", E("symbol d:entry_date f:entry_price f:avg_volume_30d b:price_fail b:volume_fail b:is_kept", "SELECT * FROM liquid"))
def x6(spark, sf):
    t = Tables(spark, sf, share=True)
    return emit(tr.liquidity_tags(trades_of(t), t.bars(), 20000.0, 30.0), "symbol", "entry_date", "entry_price", "avg_volume_30d", "price_fail", "volume_fail", "is_kept")


@query(
    "x6_liquidity_drop_counts",
    "SELECT count(*) AS n_trades, count(*) FILTER (is_kept) AS n_kept, count(*) FILTER (price_fail) AS n_price_fail, count(*) FILTER (volume_fail) AS n_volume_fail, count(avg_volume_30d) AS n_with_volume FROM liquid",
)
def x6b(spark, sf):
    t = Tables(spark, sf, share=True)
    d = tr.liquidity_tags(trades_of(t), t.bars(), 20000.0, 30.0)
    return d.agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if("is_kept").alias("n_kept"),
        F.count_if("price_fail").alias("n_price_fail"),
        F.count_if("volume_fail").alias("n_volume_fail"),
        F.count("avg_volume_30d").alias("n_with_volume"),
    )


def friction_sql(fee, spread, slip, src, extra=""):
    return (
        f"SELECT *, CASE WHEN abs(gross_pnl_pct) > 0.01 THEN tot / abs(gross_pnl_pct) * 100 END AS friction_pct_of_gross, gross_pnl_pct - tot AS net_pnl_pct, (gross_pnl_pct - tot) / 100 * 1000 AS net_pnl_usd, "
        f"tot / 100 * 1000 AS total_friction_usd FROM (SELECT *, {fee} + {spread} + {slip} AS tot FROM (SELECT * EXCLUDE (entry_price, exit_price), entry_price, exit_price, "
        f"((exit_price / 0.999) / nullif(entry_price / 1.001, 0) - 1) * 100 AS gross_pnl_pct FROM {src}))"
    )


add_cte("flat", friction_sql("0.32", "0.05", "0.2", "barrier"))
FR_SPEC = "symbol d:signal_date exit_reason f:gross_pnl_pct f:net_pnl_pct f:friction_pct_of_gross f:net_pnl_usd f:total_friction_usd"
FR_COLS = [x.rpartition(":")[2] for x in FR_SPEC.split()]


@query("x7_flat_friction", E(FR_SPEC, "SELECT * FROM flat"))
def x7(spark, sf):
    return emit(tr.flat_friction(barrier_trades(Tables(spark, sf, share=True))), *FR_COLS)


add_cte("atr14", f"SELECT symbol, date, {div(roll('avg', 'tr', 14), 'close')} AS atr FROM bars_tr")
add_cte(
    "atrfric",
    friction_sql(
        "0", "0.08", "atr * 100 * (0.08 + CASE WHEN exit_reason = 'stop' THEN 0.18 ELSE 0.08 END)",
        "(SELECT b.*, a.atr FROM barrier b JOIN atr14 a ON a.symbol = b.symbol AND a.date = b.signal_date)",
    ),
)


@query("x8_atr_friction", E(FR_SPEC, "SELECT * FROM atrfric"))
def x8(spark, sf):
    t = Tables(spark, sf, share=True)
    bars = fx.atr_pct(t.series()).withColumnRenamed("atr_pct_14", "entry_atr")
    return emit(tr.atr_friction(barrier_trades(t, bars, ["entry_atr"]), "entry_atr"), *FR_COLS)


@query(
    "x9_haircut",
    E(
        "symbol d:signal_date f:net_pnl_pct_after_haircut f:net_pnl_usd_after_haircut f:haircut_pct",
        "SELECT symbol, signal_date, net_pnl_pct * 0.75 AS net_pnl_pct_after_haircut, net_pnl_usd * 0.75 AS net_pnl_usd_after_haircut, 25.0 AS haircut_pct FROM flat",
    ),
)
def x9(spark, sf):
    d = tr.haircut(tr.flat_friction(barrier_trades(Tables(spark, sf, share=True))), 0.25)
    return emit(d, "symbol", "signal_date", "net_pnl_pct_after_haircut", "net_pnl_usd_after_haircut", "haircut_pct")


@query(
    "x10_equity_curve",
    E(
        "rule_key n_trades f:sharpe f:max_drawdown f:final_equity",
        f"SELECT rule_key, count(*) AS n_trades, {SHARPE} AS sharpe, least(min(dd), 0) AS max_drawdown, {START * 100} + sum(pnl) AS final_equity FROM "
        f"({curve_sql('flat', 'rule_key', 'exit_date', 'net_pnl_usd', 'symbol, signal_date', START * 100)}) GROUP BY rule_key",
    ),
)
def x10(spark, sf):
    d = tr.flat_friction(barrier_trades(Tables(spark, sf, share=True)))
    d = staged(d.select("rule_key", "symbol", "signal_date", "exit_date", "net_pnl_usd"))  # what the curve reads
    c = tr.equity_curve(d, ["rule_key"], "exit_date", ["symbol", "signal_date"], "net_pnl_usd", START * 100)
    end = F.lit(START * 100) + F.sum("net_pnl_usd")
    return emit(tr.curve_stats(c, ["rule_key"], final_equity=end), "rule_key", "n_trades", "sharpe", "max_drawdown", "final_equity")


add_cte(
    "norm_trades",
    "SELECT 'momentum_fast' AS strategy_id, entry_date, gross_pnl_pct AS net_pnl_pct, 60 AS hold_days FROM trades UNION ALL "
    "SELECT 'bull_trend', entry_date, net_pnl_pct, hold_days FROM bull UNION ALL "
    "SELECT 'dca_' || rule_key, entry_date, (exit_price / entry_price - 1) * 100, datediff('day', entry_date, exit_date) FROM barrier",
)


def norm_trades(t):
    b = barrier_trades(t)
    b = b.withColumns(
        {"net": (ratio("exit_price", "entry_price") - 1.0) * 100.0, "hold": F.datediff("exit_date", "entry_date")}
    )
    sleeve = tr.normalise(b, "x", "net", "hold").drop("strategy_id")
    sleeve = b.select(
        F.concat(F.lit("dca_"), "rule_key").alias("strategy_id"),
        "entry_date",
        F.col("net").alias("net_pnl_pct"),
        F.col("hold").cast("long").alias("hold_days"),
    )
    return (
        tr.normalise(trades_of(t), "momentum_fast", "gross_pnl_pct", "realized_horizon_days")
        .unionByName(tr.normalise(bull_trades(t), "bull_trend", "net_pnl_pct", "hold_days"))
        .unionByName(sleeve)
    )


@query("p15_normalised_trades", E("strategy_id d:entry_date f:net_pnl_pct i:hold_days", "SELECT * FROM norm_trades"))
def p15(spark, sf):
    return emit(norm_trades(Tables(spark, sf, share=True)))


PTS = "CASE WHEN count(net_pnl_pct) >= 2 AND stddev_pop(net_pnl_pct) > 0 THEN avg(net_pnl_pct) / stddev_pop(net_pnl_pct) * sqrt(252.0 / greatest(coalesce(avg(hold_days), 1), 1)) ELSE 0 END"


@query("x11_per_trade_sharpe", E("strategy_id f:per_trade_sharpe", f"SELECT strategy_id, {PTS} AS per_trade_sharpe FROM norm_trades GROUP BY 1"))
def x11(spark, sf):
    return emit(tr.per_trade_sharpe(norm_trades(Tables(spark, sf, share=True)), ["strategy_id"]))


add_cte("nt_reg", "SELECT t.*, coalesce(regime_label, 'unlabeled') AS regime_label FROM norm_trades t LEFT JOIN (SELECT date AS entry_date, regime_label FROM regimes) USING (entry_date)")
add_cte(
    "attr",
    f"SELECT strategy_id, regime_label, count(*) AS n_trades, count(DISTINCT entry_date) AS n_unique_entry_days, avg(net_pnl_pct) AS mean_pnl_pct, median(net_pnl_pct) AS median_pnl_pct, {PTS} AS per_trade_sharpe, "
    "avg(net_pnl_pct) * 252.0 / greatest(coalesce(avg(hold_days), 1), 1) AS comparable_yield_pct, avg(CASE WHEN net_pnl_pct > 0 THEN 1.0 ELSE 0 END) * 100 AS win_rate_pct, min(net_pnl_pct) AS max_trade_loss_pct, "
    "coalesce(avg(hold_days), 1) AS mean_hold_days, CASE WHEN count(*) >= 30 THEN 'high' WHEN count(*) >= 10 THEN 'medium' ELSE 'low' END AS confidence, "
    "CASE WHEN strategy_id LIKE 'stream_2c_grid%' OR strategy_id LIKE '%dca%' THEN 'tp_clustered' ELSE 'realistic' END AS sharpe_class FROM nt_reg GROUP BY strategy_id, regime_label",
)
AT_SPEC = "strategy_id regime_label n_trades n_unique_entry_days f:mean_pnl_pct f:median_pnl_pct f:per_trade_sharpe f:comparable_yield_pct f:win_rate_pct f:max_trade_loss_pct f:mean_hold_days confidence sharpe_class"
AT_COLS = [x.rpartition(":")[2] for x in AT_SPEC.split()]


def regime_days(t):
    r = fx.market_regime(t.market()).withColumnRenamed("market_regime", "regime_label")
    return r


def attr(t):
    return tr.attribution(norm_trades(t), regime_days(t))


@query("x12_attribution_matrix", E(AT_SPEC, "SELECT * FROM attr"))
def x12(spark, sf):
    return emit(attr(Tables(spark, sf, share=True)), *AT_COLS)


add_cte(
    "curve_all",
    "SELECT date, 'momentum_fast' AS strategy_id, sum(r) / count(*) AS daily_return_pct, least(count(*), 10) AS open_deal_count, least(count(*), 10) / 10.0 * 100 AS active_capital_pct FROM "
    f"(SELECT p.date, p.r FROM trades t JOIN (SELECT symbol, date, ({div('close_adj', lag('close_adj'))} - 1) * 100 AS r FROM bars) p ON p.symbol = t.symbol AND p.date >= t.entry_date + 1 AND p.date <= t.exit_date WHERE r IS NOT NULL) GROUP BY date",
)


def curve_of(t):
    return tr.daily_curve(trades_of(t), t.bars(), "momentum_fast", 10)


@query("x17_daily_portfolio_curve", E("d:date strategy_id f:daily_return_pct i:open_deal_count f:active_capital_pct", "SELECT * FROM curve_all"))
def x17(spark, sf):
    return emit(curve_of(Tables(spark, sf, share=True)))


@query(
    "j6_interval_join",
    "SELECT t.symbol, CAST(t.entry_date AS VARCHAR) AS entry_date, count(*) AS n_days, max(p.date)::VARCHAR AS last_day FROM trades t JOIN bars p "
    "ON p.symbol = t.symbol AND p.date >= t.entry_date + 1 AND p.date <= t.exit_date GROUP BY 1, 2",
)
def j6(spark, sf):
    t = Tables(spark, sf, share=True)
    s = trades_of(t).select("symbol", "entry_date", F.date_add("entry_date", 1).alias("lo"), F.col("exit_date").alias("hi"))
    j = jn.interval_join(s, t.bars().select("symbol", "date"), "symbol", "lo", "hi", "date")
    return emit(j.groupBy("symbol", "entry_date").agg(F.count(F.lit(1)).alias("n_days"), F.max("date").alias("last_day")))


PD_SPEC = "strategy_id regime_label n_active_days f:mean_daily_return_pct f:annualized_return_pct f:daily_volatility_pct f:daily_sharpe f:max_daily_loss_pct f:mean_active_capital_pct f:active_capital_weighted_return_pct"


@query(
    "x13_per_day_attribution",
    E(
        PD_SPEC,
        "SELECT strategy_id, coalesce(regime_label, 'unlabeled') AS regime_label, count(daily_return_pct) AS n_active_days, avg(daily_return_pct) AS mean_daily_return_pct, avg(daily_return_pct) * 252 AS annualized_return_pct, "
        "stddev_pop(daily_return_pct) AS daily_volatility_pct, avg(daily_return_pct) / nullif(stddev_pop(daily_return_pct), 0) * sqrt(252.0) AS daily_sharpe, min(daily_return_pct) AS max_daily_loss_pct, "
        "avg(active_capital_pct) AS mean_active_capital_pct, avg(daily_return_pct) * avg(active_capital_pct) AS active_capital_weighted_return_pct FROM curve_all LEFT JOIN regimes USING (date) GROUP BY 1, 2 HAVING count(daily_return_pct) >= 5",
    ),
)
def x13(spark, sf):
    t = Tables(spark, sf, share=True)
    return emit(tr.per_day_attribution(curve_of(t), regime_days(t)), *[x.rpartition(":")[2] for x in PD_SPEC.split()])


add_cte(
    "policies",
    "SELECT 'always' AS policy_id, date, daily_return_pct * 0.001 AS daily_return_pct, strategy_id AS active_strategy_id FROM curve_all UNION ALL "
    "SELECT 'gated', date, CASE WHEN regime_label = 'chop' THEN 0 ELSE daily_return_pct * 0.001 END, CASE WHEN regime_label = 'chop' THEN 'cash' ELSE strategy_id END FROM curve_all JOIN regimes USING (date)",
)


@query(
    "x14_policy_summary",
    E(
        "policy_id n_days f:calendar_years f:rows_per_year f:total_return_pct f:cagr_pct f:daily_sharpe f:max_drawdown_pct i:n_transitions f:annual_transitions",
        "SELECT policy_id, n_days, calendar_years, n_days / calendar_years AS rows_per_year, (cum - 1) * 100 AS total_return_pct, (pow(cum, 1 / calendar_years) - 1) * 100 AS cagr_pct, "
        "CASE WHEN s > 0 THEN m / s * sqrt(n_days / calendar_years) ELSE 0 END AS daily_sharpe, max_drawdown_pct, n_transitions, n_transitions / calendar_years AS annual_transitions FROM ("
        "SELECT policy_id, count(daily_return_pct) AS n_days, greatest(datediff('day', min(date), max(date)) / 365.25, 1e-6) AS calendar_years, exp(sum(l)) AS cum, avg(daily_return_pct) AS m, stddev_pop(daily_return_pct) AS s, "
        "min((exp(c - pk) - 1) * 100) AS max_drawdown_pct, coalesce(sum(sw), 0) AS n_transitions FROM (SELECT *, max(c) OVER (PARTITION BY policy_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS pk FROM ("
        "SELECT *, ln(1 + daily_return_pct / 100) AS l, sum(ln(1 + daily_return_pct / 100)) OVER (PARTITION BY policy_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS c, "
        "CAST(active_strategy_id <> lag(active_strategy_id) OVER (PARTITION BY policy_id ORDER BY date) AS INT) AS sw FROM policies)) GROUP BY policy_id)",
    ),
)
def x14(spark, sf):
    t = Tables(spark, sf, share=True)
    c = curve_of(t).join(regime_days(t), "date")
    r = F.col("daily_return_pct") * 0.001
    chop = F.col("regime_label") == "chop"
    # every curve day under both policies
    d = c.select(
        "date",
        F.inline(
            F.array(
                F.struct(F.lit("always").alias("policy_id"), r.alias("daily_return_pct"), F.col("strategy_id").alias("active_strategy_id")),
                F.struct(
                    F.lit("gated").alias("policy_id"),
                    F.when(chop, 0.0).otherwise(r).alias("daily_return_pct"),
                    F.when(chop, F.lit("cash")).otherwise(F.col("strategy_id")).alias("active_strategy_id"),
                ),
            )
        ),
    )
    return emit(tr.policy_summary(d))


@query(
    "x15_regime_cagr",
    E(
        "regime n_trades f:win_rate_pct f:mean_net_pnl_pct f:annualized_cagr f:mean_hold_days",
        "SELECT regime_label AS regime, count(*) AS n_trades, avg(CASE WHEN net_pnl_pct > 0 THEN 1.0 ELSE 0 END) * 100 AS win_rate_pct, avg(net_pnl_pct) AS mean_net_pnl_pct, "
        "pow(exp(avg(ln(1 + net_pnl_pct / 100))), 252.0 / greatest(avg(hold_days), 1)) - 1 AS annualized_cagr, avg(hold_days) AS mean_hold_days FROM bull JOIN (SELECT date AS entry_date, regime_label FROM regimes) USING (entry_date) GROUP BY 1",
    ),
)
def x15(spark, sf):
    t = Tables(spark, sf, share=True)
    return emit(tr.regime_cagr(bull_trades(t), regime_days(t)))


@query(
    "x16_best_per_regime",
    E(
        "regime_label strategy_id i:rank f:comparable_yield_pct",
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY regime_label ORDER BY comparable_yield_pct DESC, strategy_id) AS rank FROM attr WHERE confidence <> 'low') WHERE rank <= 3",
    ),
)
def x16(spark, sf):
    d = tr.best_per_regime(attr(Tables(spark, sf, share=True))).withColumn("rank", F.col("rank").cast("long"))
    return emit(d, "regime_label", "strategy_id", "rank", "comparable_yield_pct")


add_cte("deals", "SELECT symbol, entry_date, exit_date, net_pnl_pct / 100 * 1000 AS pnl_usd, exit_reason AS reason FROM bull")
add_cte("equity_days", f"SELECT exit_date AS date, {START} + sum(sum(pnl_usd)) OVER (ORDER BY exit_date ROWS UNBOUNDED PRECEDING) AS equity FROM deals GROUP BY exit_date")


def deals_of(t):
    return bull_trades(t).select(
        "symbol", "entry_date", "exit_date", (F.col("net_pnl_pct") / 100.0 * POS).alias("pnl_usd"), F.col("exit_reason").alias("reason")
    )


@query(
    "x18_deal_metrics",
    E(
        "n_deals n_wins f:win_rate f:mean_win_usd f:mean_loss_usd f:net_pnl_usd n_tp n_horizon n_data_end f:rr_realized f:sharpe f:max_dd_pct f:cagr_pct f:final_equity",
        "SELECT d.*, mean_loss_usd / nullif(mean_win_usd, 0) AS rr_realized, e.* FROM (SELECT count(*) AS n_deals, count(*) FILTER (pnl_usd > 0) AS n_wins, avg(CASE WHEN pnl_usd > 0 THEN 1.0 ELSE 0 END) AS win_rate, "
        "coalesce(avg(pnl_usd) FILTER (pnl_usd > 0), 0) AS mean_win_usd, coalesce(avg(-pnl_usd) FILTER (pnl_usd < 0), 0) AS mean_loss_usd, sum(pnl_usd) AS net_pnl_usd, count(*) FILTER (reason = 'tp') AS n_tp, "
        "count(*) FILTER (reason = 'horizon') AS n_horizon, count(*) FILTER (reason = 'data_end') AS n_data_end FROM deals) d, "
        f"(SELECT CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(365.0) ELSE 0 END AS sharpe, min((equity - pk) / pk) * 100 AS max_dd_pct, (pow(arg_max(equity, date) / {START}, 1 / greatest(datediff('day', min(date), max(date)) / 365.25, 0.001)) - 1) * 100 AS cagr_pct, arg_max(equity, date) AS final_equity "
        "FROM (SELECT *, equity / lag(equity) OVER (ORDER BY date) - 1 AS r, max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS pk FROM equity_days)) e",
    ),
)
def x18(spark, sf):
    d = deals_of(Tables(spark, sf, share=True))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    day = d.groupBy(F.col("exit_date").alias("date")).agg(F.sum("pnl_usd").alias("p"))
    eq = day.select("date", (F.lit(START) + F.sum("p").over(w)).alias("equity"))
    return emit(tr.deal_metrics(d, eq, START))


@query(
    "x19_peak_concurrent_capital",
    E(
        "f:peak_capital n_event_days",
        "SELECT greatest(max(c), 0) AS peak_capital, count(*) AS n_event_days FROM (SELECT sum(delta) OVER (ORDER BY ts, side ROWS UNBOUNDED PRECEDING) AS c FROM "
        "(SELECT ts, side, sum(delta) AS delta FROM (SELECT entry_date AS ts, 0 AS side, entry_price AS delta FROM bull UNION ALL SELECT exit_date, 1, -entry_price FROM bull) GROUP BY 1, 2))",
    ),
)
def x19(spark, sf):
    return emit(tr.peak_capital(bull_trades(Tables(spark, sf)), "entry_date", "exit_date", "entry_price"))
