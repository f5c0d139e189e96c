"""Forward-looking labels: strictly later rows, null where the window is incomplete."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..functions.windows import DAILY, ratio
from ..session import staged
from .stats import positions


def forward_winner(df, lookahead=30, threshold=0.20, price_col="close", out="is_winner"):
    if lookahead < 1:
        raise ValueError(f"a label needs at least one row ahead, not {lookahead}")
    if threshold <= 0:
        raise ValueError(f"a winner has to gain something: {threshold}")
    top = DAILY.roll_forward(F.max, price_col, lookahead)
    return df.withColumn(out, ratio(top, price_col) >= 1.0 + threshold)


def smooth_winner(df, lookahead=30, up=0.20, max_drawdown=-0.10, out="label"):
    """Forward maximum reaches the gain while the forward minimum keeps the floor."""
    top = DAILY.roll_forward(F.max, "close_adj", lookahead)
    low = DAILY.roll_forward(F.min, "close_adj", lookahead)
    return df.withColumn(
        out, (ratio(top, "close_adj") >= 1.0 + up) & (ratio(low, "close_adj") >= 1.0 + max_drawdown)
    )


def loser(df, lookahead=30, down=-0.15, out="label"):
    low = DAILY.roll_forward(F.min, "close_adj", lookahead)
    return df.withColumn(out, ratio(low, "close_adj") <= 1.0 + down)


def label_family(df, scale=1.0):
    """The five binary labels as columns of one frame: no join is needed."""
    df = forward_winner(df, 30, 0.20 * scale, "close_adj", "lbl_L1")
    df = forward_winner(df, 90, 0.30 * scale, "close_adj", "lbl_L2")
    df = forward_winner(df, 10, 0.15 * scale, "close_adj", "lbl_L3")
    df = smooth_winner(df, 30, 0.20 * scale, -0.10, "lbl_L4")
    return loser(df, 30, -0.15, "lbl_L5")


@dataclass(frozen=True)
class SustainedSpec:
    name: str
    touch_pct: float
    endpoint_pct: float
    horizon: int = 20
    min_price: float = 1.0

    def label_column(self):
        return f"is_sustained_winner_{self.name}"


def sweep_specs(g_max=20.0, g_min=1.0, step=1.0, endpoint_ratio=0.5, horizon=20, min_price=1.0):
    """Specs by falling gain, each with its endpoint at a share of the touch gain."""
    if not 0 <= endpoint_ratio <= 1:
        raise ValueError(f"the endpoint is a share of the touch gain, from 0 to 1: {endpoint_ratio}")
    n = int((g_max - g_min) / step + 1e-9) + 1
    gains = [g_max - i * step for i in range(n)]
    return [SustainedSpec(f"g{int(round(g)):02d}", g, g * endpoint_ratio, horizon, min_price) for g in gains]


def forward_returns(df, horizon=20):
    """Percent to the best close of the next rows and to the close ``horizon`` rows on.

    The best close skips missing rows, so it exists up to the last row but one.
    """
    px = F.col("close_adj")
    best = F.max(px).over(DAILY.forward(horizon))
    return df.withColumns(
        {
            "forward_max_pct": (ratio(best, px) - 1.0) * 100.0,
            "forward_endpoint_pct": (ratio(DAILY.lead("close_adj", horizon), px) - 1.0) * 100.0,
        }
    )


def sustained_label(spec: SustainedSpec):
    """Three-valued label over ``forward_returns``: touch and endpoint, above a price floor."""
    usable = (
        (F.col("close_adj") >= spec.min_price)
        & F.col("forward_max_pct").isNotNull()
        & F.col("forward_endpoint_pct").isNotNull()
    )
    hit = (F.col("forward_max_pct") >= spec.touch_pct) & (F.col("forward_endpoint_pct") >= spec.endpoint_pct)
    return F.when(usable, hit)


def sustained_winner(df, spec):
    return forward_returns(df, spec.horizon).withColumn(spec.label_column(), sustained_label(spec))


def sweep_counts(df, specs):
    """Labelable rows and winners of every spec from one scan of the forward returns."""
    aggs = []
    for i, s in enumerate(specs):
        y = sustained_label(s)
        aggs += [F.count(y).alias(f"n{i}"), F.count_if(y).alias(f"w{i}")]
    wide = forward_returns(df, specs[0].horizon).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(s.name).alias("spec"),
                F.lit(s.touch_pct).alias("touch_threshold_pct"),
                F.lit(s.endpoint_pct).alias("endpoint_threshold_pct"),
                F.col(f"n{i}").alias("n_labelable_rows"),
                F.col(f"w{i}").alias("n_winners"),
                ratio(F.col(f"w{i}").cast("double"), F.col(f"n{i}").cast("double")).alias("winner_rate"),
            )
            for i, s in enumerate(specs)
        ]
    )
    return wide.select(F.inline(rows))


def breakout_label(df, horizon=60, touch_pct=20.0, min_price=1.0, name="v1_g20"):
    px = F.col("close_adj")
    top = F.max(px).over(DAILY.forward(horizon))
    complete = DAILY.lead("close_adj", horizon).isNotNull()
    df = df.withColumn("forward_max_pct_60td", F.when(complete, (ratio(top, px) - 1.0) * 100.0))
    ok = (px >= min_price) & F.col("forward_max_pct_60td").isNotNull()
    return df.withColumn(f"is_breakout_seq_{name}", F.when(ok, F.col("forward_max_pct_60td") >= touch_pct))


def first_touch_return(df, horizon=60, touch_pct=20.0, min_price=1.0):
    """Exit at the first forward close at or above the target, else at row ``horizon``.

    A target hit before the data ends counts even where the window is incomplete; the
    reason column is never masked.
    """
    px = F.col("close_adj")
    mult = 1.0 + touch_pct / 100.0
    df = df.withColumn("_fwd", F.collect_list("close_adj").over(DAILY.forward(horizon)))
    df = df.withColumn("_hit", F.array_position(F.transform("_fwd", lambda x: F.try_divide(x, px) >= mult), F.lit(True)))
    hit = F.col("_hit") > 0
    exit_close = F.get("_fwd", F.when(hit, F.col("_hit") - 1).otherwise(horizon - 1).cast("int"))
    gain = F.when(px >= min_price, (ratio(exit_close, px) - 1.0) * 100.0)
    df = df.withColumn("bsq_realized_gain_pct", gain)
    hold = F.when(hit, F.col("_hit")).otherwise(F.lit(horizon)).cast("long")
    return df.withColumns(
        {
            "bsq_hold_trading_days": F.when(F.col("bsq_realized_gain_pct").isNotNull(), hold),
            "bsq_exit_reason": F.when(hit, "target_hit").otherwise("day60_cap"),
        }
    ).drop("_fwd", "_hit")


@dataclass(frozen=True)
class MomentumSpec:
    name: str
    breakout: int
    horizon: int
    target_pct: float
    min_price: float = 10.0
    min_dollar_volume: float = 10_000_000.0
    vol_confirm: float = 0.0


def equity_momentum(df, spec: MomentumSpec):
    """Close above the prior N-row high, liquid enough, and the forward gain reached."""
    px = F.col("close_adj")
    top = F.max(px).over(DAILY.forward(spec.horizon))
    end = DAILY.lead("close_adj", spec.horizon)
    df = df.withColumns(
        {
            "avg_dollar_volume_30d": DAILY.roll(F.avg, F.col("volume") * px, 30),
            "prior_n_day_high": DAILY.roll_prior(F.max, "close_adj", spec.breakout),
            "forward_max_pct": F.when(end.isNotNull(), (ratio(top, px) - 1.0) * 100.0),
            "exit_close_adj": end,
            "exit_date": DAILY.lead("date", spec.horizon),
            "avg_volume_30d_shares": DAILY.roll(F.avg, F.col("volume").cast("double"), 30),
        }
    )
    entry = (
        (px >= spec.min_price)
        & (F.col("avg_dollar_volume_30d") >= spec.min_dollar_volume)
        & (px > F.col("prior_n_day_high"))
    )
    confirmed = (
        F.col("volume") >= spec.vol_confirm * F.col("avg_volume_30d_shares") if spec.vol_confirm > 0 else F.lit(True)
    )
    return df.withColumns(
        {
            "is_entry": F.coalesce(entry, F.lit(False)),
            "is_momentum_winner": F.when(
                entry & confirmed & F.col("forward_max_pct").isNotNull(),
                F.col("forward_max_pct") >= spec.target_pct * 100.0,
            ),
        }
    )


def crypto_momentum(df, breakout=14, horizon=60, target_pct=0.30):
    """Breakout label on the adjusted close where any exists, else on the close.

    The choice is a scalar subquery, so nothing comes back to the driver.
    """
    has_adj = df.agg((F.count("close_adj") > 0).alias("x")).scalar()
    df = df.withColumn("_px", F.when(has_adj, F.col("close_adj")).otherwise(F.col("close")))
    top = F.max("_px").over(DAILY.forward(horizon))
    end = DAILY.lead("_px", horizon)
    df = df.withColumns(
        {
            "prior_n_day_high": DAILY.roll_prior(F.max, "_px", breakout),
            "forward_max_pct": F.when(end.isNotNull(), (ratio(top, "_px") - 1.0) * 100.0),
            "exit_close": end,
            "exit_date": DAILY.lead("date", horizon),
        }
    )
    ok = (F.col("_px") > F.col("prior_n_day_high")) & F.col("forward_max_pct").isNotNull()
    return df.withColumn(
        "is_crypto_momentum", F.when(ok, F.col("forward_max_pct") >= target_pct * 100.0)
    ).drop("_px")


def exit_labels(df, gain_pct=15.0, lookback=20, forward=20, giveback_pct=66.0):
    """Positions up enough over the lookback, labelled by how much of it is given back."""
    px = F.col("close_adj")
    df = df.withColumns(
        {
            "position_gain_pct": (ratio(px, DAILY.lag("close_adj", lookback)) - 1.0) * 100.0,
            "forward_return_pct": (ratio(DAILY.lead("close_adj", forward), px) - 1.0) * 100.0,
        }
    )
    kept = df.where((F.col("position_gain_pct") >= gain_pct) & F.col("forward_return_pct").isNotNull())
    return kept.withColumn(
        "exit_label",
        (F.col("forward_return_pct") <= -(giveback_pct / 100.0) * F.col("position_gain_pct")).cast("int"),
    )


def sector_rank(df, sectors, horizon=30, top=0.9):
    """1.0 for the top decile of forward return inside (date, sector); ties go by symbol.

    Places inside a group come from range-sorted parts, so a sector of any size is split.
    """
    df = df.join(sectors.select("symbol", F.col("sector").alias("_sec")), "symbol", "left")
    df = df.withColumn("_f", ratio(DAILY.lead("close_adj", horizon), "close_adj") - 1.0)
    # a symbol outside every sector, or without a day, has no rank
    known = F.col("_sec").isNotNull() & F.col("date").isNotNull()
    df = staged(df)
    placed = positions(df.where(known), ["date", "_sec"], [F.col("_f").asc_nulls_last(), "symbol"], "_rank")
    pos = F.when(F.col("n_group") > 1, (F.col("_rank") - 1) / (F.col("n_group") - 1))
    ranked = placed.withColumn("sector_rank", F.when(F.col("_f").isNotNull(), (pos >= top).cast("double")))
    rest = df.where(~known).withColumn("sector_rank", F.lit(None).cast("double"))
    return ranked.drop("_f", "_rank", "n_group", "_sec").unionByName(rest.drop("_f", "_sec"))
