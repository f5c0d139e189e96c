"""Forward labels."""

from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.windows import row_of
from ..operators import labels as lb
from ..session import staged
from .common import E, Tables, emit
from .registry import add_cte, div, fwd, lag, lead, query, roll, prior, win

C = "close_adj"


def fw_max(n, k):
    return f"{div(fwd('max', C, n), C)} >= {1 + k}"


def fw_min(n):
    return div(fwd("min", C, n), C)


@query("l1_forward_winner", E("symbol d:date b:is_winner", f"SELECT *, {fw_max(30, 2.0)} AS is_winner FROM bars"))
def l1(spark, sf):
    return emit(lb.forward_winner(Tables(spark, sf).bars(), 30, 2.0, C), "symbol", "date", "is_winner")


FAMILY = (
    f"SELECT symbol, date, {fw_max(30, 2.0)} AS lbl_L1, {fw_max(90, 3.0)} AS lbl_L2, {fw_max(10, 1.5)} AS lbl_L3, "
    f"{fw_max(30, 2.0)} AND {fw_min(30)} >= 0.9 AS lbl_L4, {fw_min(30)} <= 0.85 AS lbl_L5 FROM bars"
)


@query("l2_label_family", E("symbol d:date b:lbl_L1 b:lbl_L2 b:lbl_L3 b:lbl_L4 b:lbl_L5", FAMILY))
def l2(spark, sf):
    return emit(lb.label_family(Tables(spark, sf).bars(), 10.0), "symbol", "date", "lbl_L1", "lbl_L2", "lbl_L3", "lbl_L4", "lbl_L5")


@query(
    "l3_smooth_winner",
    E("symbol d:date b:label", f"SELECT *, {fw_max(30, 0.2)} AND {fw_min(30)} >= 0.1 AS label FROM bars"),
)
def l3(spark, sf):
    return emit(lb.smooth_winner(Tables(spark, sf).bars(), 30, 0.2, -0.9), "symbol", "date", "label")


@query("l4_loser", E("symbol d:date b:label", f"SELECT *, {fw_min(30)} <= 0.85 AS label FROM bars"))
def l4(spark, sf):
    return emit(lb.loser(Tables(spark, sf).bars()), "symbol", "date", "label")


_F20 = win("1 FOLLOWING", "20 FOLLOWING")
add_cte(
    "fwd20",
    f"SELECT *, ({div(f'max({C}) OVER {_F20}', C)} - 1) * 100 AS forward_max_pct, "
    f"({div(lead(C, 20), C)} - 1) * 100 AS forward_endpoint_pct FROM bars",
)


def sus(touch, end, floor=1.0):
    return (
        f"CASE WHEN close_adj >= {floor} AND forward_max_pct IS NOT NULL AND forward_endpoint_pct IS NOT NULL "
        f"THEN forward_max_pct >= {touch} AND forward_endpoint_pct >= {end} END"
    )


SPEC = lb.SustainedSpec("g200", 200.0, 100.0)


@query(
    "l5_sustained_winner",
    E(
        "symbol d:date f:forward_max_pct f:forward_endpoint_pct b:is_sustained_winner_g200",
        f"SELECT *, {sus(200.0, 100.0)} AS is_sustained_winner_g200 FROM fwd20",
    ),
)
def l5(spark, sf):
    d = lb.sustained_winner(Tables(spark, sf).bars(), SPEC)
    return emit(d, "symbol", "date", "forward_max_pct", "forward_endpoint_pct", SPEC.label_column())


SWEEP = lb.sweep_specs(400.0, 20.0, 20.0)


@query(
    "l6_spec_sweep",
    E(
        "spec f:touch_threshold_pct f:endpoint_threshold_pct n_labelable_rows n_winners f:winner_rate",
        "SELECT *, n_winners / n_labelable_rows AS winner_rate FROM ("
        + " UNION ALL ".join(
            f"SELECT '{s.name}' AS spec, {s.touch_pct} AS touch_threshold_pct, {s.endpoint_pct} AS endpoint_threshold_pct, "
            f"count(y) AS n_labelable_rows, count(*) FILTER (y) AS n_winners FROM (SELECT {sus(s.touch_pct, s.endpoint_pct)} AS y FROM fwd20)"
            for s in SWEEP
        )
        + ")",
    ),
)
def l6(spark, sf):
    return emit(lb.sweep_counts(Tables(spark, sf).bars(), SWEEP))


_F60 = win("1 FOLLOWING", "60 FOLLOWING")
add_cte(
    "fwd60",
    f"SELECT *, CASE WHEN {lead(C, 60)} IS NOT NULL THEN (max({C}) OVER {_F60} / nullif({C}, 0) - 1) * 100 END AS forward_max_pct_60td, "
    f"list({C}) OVER {_F60} AS fl FROM bars",
)


@query(
    "l7_breakout_label",
    E(
        "symbol d:date f:forward_max_pct_60td b:is_breakout_seq_v1_g200",
        "SELECT *, CASE WHEN close_adj >= 1 AND forward_max_pct_60td IS NOT NULL THEN forward_max_pct_60td >= 200 END "
        "AS is_breakout_seq_v1_g200 FROM fwd60",
    ),
)
def l7(spark, sf):
    d = lb.breakout_label(Tables(spark, sf).bars(), 60, 200.0, 1.0, "v1_g200")
    return emit(d, "symbol", "date", "forward_max_pct_60td", "is_breakout_seq_v1_g200")


add_cte(
    "realized60",
    "SELECT symbol, date, close_adj, gain AS bsq_realized_gain_pct, CASE WHEN gain IS NOT NULL THEN hold END AS bsq_hold_trading_days, "
    "reason AS bsq_exit_reason FROM (SELECT *, CASE WHEN close_adj >= 1 THEN (list_extract(fl, coalesce(h, 60)) / nullif(close_adj, 0) - 1) * 100 END AS gain, "
    "coalesce(h, 60) AS hold, CASE WHEN h IS NOT NULL THEN 'target_hit' ELSE 'day60_cap' END AS reason "
    "FROM (SELECT *, list_position(list_transform(fl, lambda x: x / nullif(close_adj, 0) >= 3.0), true) AS h FROM fwd60))",
)


@query(
    "l8_first_touch_return",
    E("symbol d:date f:bsq_realized_gain_pct i:bsq_hold_trading_days bsq_exit_reason", "SELECT * FROM realized60"),
)
def l8(spark, sf):
    d = lb.first_touch_return(Tables(spark, sf).bars(), 60, 200.0)
    return emit(d, "symbol", "date", "bsq_realized_gain_pct", "bsq_hold_trading_days", "bsq_exit_reason")


MOM = lb.MomentumSpec("fast", 20, 60, 2.0, 10.0, 500_000.0, 1.0)


def mom_sql(n, h):
    f = win("1 FOLLOWING", f"{h} FOLLOWING")
    return (
        f"SELECT *, {roll('avg', 'volume * close_adj', 30)} AS avg_dollar_volume_30d, {prior('max', C, n)} AS prior_n_day_high, "
        f"CASE WHEN {lead(C, h)} IS NOT NULL THEN (max({C}) OVER {f} / nullif({C}, 0) - 1) * 100 END AS forward_max_pct, "
        f"{lead(C, h)} AS exit_close_adj, {lead('date', h)} AS exit_date, {roll('avg', 'volume', 30)} AS avg_volume_30d_shares FROM bars"
    )


add_cte(
    "momentum",
    "SELECT *, CASE WHEN entry AND volume >= 1.0 * avg_volume_30d_shares AND forward_max_pct IS NOT NULL THEN forward_max_pct >= 200 END AS is_momentum_winner "
    "FROM (SELECT *, coalesce(close_adj >= 10 AND avg_dollar_volume_30d >= 500000 AND close_adj > prior_n_day_high, false) AS entry "
    f"FROM ({mom_sql(20, 60)}))",
)


@query(
    "l9_equity_momentum",
    E(
        "symbol d:date f:avg_dollar_volume_30d f:prior_n_day_high f:forward_max_pct f:exit_close_adj d:exit_date b:is_entry b:is_momentum_winner",
        "SELECT *, entry AS is_entry FROM momentum",
    ),
)
def l9(spark, sf):
    d = lb.equity_momentum(Tables(spark, sf).bars(), MOM)
    return emit(
        d, "symbol", "date", "avg_dollar_volume_30d", "prior_n_day_high", "forward_max_pct",
        "exit_close_adj", "exit_date", "is_entry", "is_momentum_winner",
    )


@query(
    "l10_crypto_momentum",
    E(
        "symbol d:date f:prior_n_day_high f:forward_max_pct f:exit_close d:exit_date b:is_crypto_momentum",
        "SELECT *, exit_close_adj AS exit_close, CASE WHEN close_adj > prior_n_day_high AND forward_max_pct IS NOT NULL THEN forward_max_pct >= 200 END AS is_crypto_momentum "
        f"FROM ({mom_sql(14, 60)})",
    ),
)
def l10(spark, sf):
    d = lb.crypto_momentum(Tables(spark, sf).bars(), 14, 60, 2.0)
    return emit(d, "symbol", "date", "prior_n_day_high", "forward_max_pct", "exit_close", "exit_date", "is_crypto_momentum")


add_cte(
    "exit_set",
    "SELECT *, CAST(forward_return_pct <= -0.66 * position_gain_pct AS INT) AS exit_label FROM "
    f"(SELECT *, ({div(C, lag(C, 20))} - 1) * 100 AS position_gain_pct, ({div(lead(C, 20), C)} - 1) * 100 AS forward_return_pct FROM bars) "
    "WHERE position_gain_pct >= 15 AND forward_return_pct IS NOT NULL",
)


@query(
    "l11_exit_label",
    E("symbol d:date f:position_gain_pct f:forward_return_pct exit_label", "SELECT * FROM exit_set"),
)
def l11(spark, sf):
    return emit(lb.exit_labels(Tables(spark, sf).bars()), "symbol", "date", "position_gain_pct", "forward_return_pct", "exit_label")


add_cte(
    "sector_ranked",
    "SELECT symbol, date, CASE WHEN f IS NOT NULL AND n > 1 THEN CAST((rk - 1) / (n - 1) >= 0.9 AS DOUBLE) END AS sector_rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY f ASC NULLS LAST, symbol) AS rk, "
    "count(*) OVER (PARTITION BY date, sector) AS n FROM "
    f"(SELECT symbol, date, {div(lead(C, 30), C)} - 1 AS f FROM bars) JOIN peers USING (symbol))",
)


@query("l12_sector_rank", E("symbol d:date f:sector_rank", "SELECT * FROM sector_ranked"))
def l12(spark, sf):
    t = Tables(spark, sf)
    return emit(lb.sector_rank(t.bars(), t.peers()), "symbol", "date", "sector_rank")


@query(
    "l13_label_statistics",
    E(
        "n_labelable_rows n_winners f:winner_rate f:mean_max_all f:median_max_all f:median_end_all f:mean_max_winners f:median_max_winners f:median_end_winners",
        "SELECT count(*) AS n_labelable_rows, count(*) FILTER (y) AS n_winners, count(*) FILTER (y) / count(*) AS winner_rate, "
        "avg(forward_max_pct) AS mean_max_all, median(forward_max_pct) AS median_max_all, median(forward_endpoint_pct) AS median_end_all, "
        "avg(forward_max_pct) FILTER (y) AS mean_max_winners, median(forward_max_pct) FILTER (y) AS median_max_winners, "
        "median(forward_endpoint_pct) FILTER (y) AS median_end_winners FROM "
        f"(SELECT *, {sus(200.0, 100.0)} AS y FROM fwd20) WHERE y IS NOT NULL",
    ),
)
def l13(spark, sf):
    y = F.col(SPEC.label_column())
    d = lb.sustained_winner(Tables(spark, sf).series(), SPEC).where(y.isNotNull())
    d = staged(d.select(SPEC.label_column(), "forward_max_pct", "forward_endpoint_pct"))
    one = d.agg(
        F.count(F.lit(1)).alias("n_labelable_rows"),
        F.count_if(y).alias("n_winners"),
        (F.count_if(y) / F.count(F.lit(1))).alias("winner_rate"),
        F.avg("forward_max_pct").alias("mean_max_all"),
        F.avg(F.when(y, F.col("forward_max_pct"))).alias("mean_max_winners"),
    )
    # four medians as groups of one quantile pass; every group may hold all rows
    pieces = [
        ("median_max_all", F.col("forward_max_pct")),
        ("median_end_all", F.col("forward_endpoint_pct")),
        ("median_max_winners", F.when(y, F.col("forward_max_pct"))),
        ("median_end_winners", F.when(y, F.col("forward_endpoint_pct"))),
    ]
    long = d.select(F.inline(F.array(*[F.struct(F.lit(n).alias("m"), x.alias("v")) for n, x in pieces])))
    med = exact_quantiles(long, ["m"], "v", {"q": 0.5}, stage=False)
    med = med.agg(*[F.max(F.when(F.col("m") == n, F.col("q"))).alias(n) for n, _ in pieces])
    row = row_of(med)
    return emit(one.withColumns({n: row[n] for n, _ in pieces}))


@query(
    "l13_winner_counts_by_symbol",
    "SELECT symbol, count(*) FILTER (is_momentum_winner) AS n_winners, count(is_momentum_winner) AS n_labelable FROM momentum GROUP BY symbol",
)
def l13b(spark, sf):
    y = F.col("is_momentum_winner")
    d = lb.equity_momentum(Tables(spark, sf).bars(), MOM)
    return d.groupBy("symbol").agg(F.count_if(y).alias("n_winners"), F.count(y).alias("n_labelable"))


@query(
    "l14_multi_label_frame",
    E(
        "symbol d:date b:lbl_L1 b:lbl_L2 b:lbl_L3 b:lbl_L4 b:lbl_L5 f:sector_rank",
        f"SELECT * FROM ({FAMILY}) JOIN sector_ranked USING (symbol, date)",
    ),
)
def l14(spark, sf):
    t = Tables(spark, sf)
    d = lb.sector_rank(lb.label_family(t.bars(), 10.0), t.peers())
    return emit(d, "symbol", "date", "lbl_L1", "lbl_L2", "lbl_L3", "lbl_L4", "lbl_L5", "sector_rank")
