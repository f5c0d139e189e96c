"""Intraday indicators, entry gate, order ladder and volume-tiered fees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import TICKBARS, ema, ratio, true_range
from .joins import asof_backward, tier_lookup
from .timebars import resample

KEY = {"keys": ("symbol",), "order": ("ts",)}


def ema_close(bars, span, out="ema"):
    return ema(bars, "close", span, out, **KEY)


def atr(bars, period, out="atr"):
    """Exponential mean of the true range."""
    d = bars.withColumn("_tr", true_range(TICKBARS))
    return ema(d, "_tr", period, out, **KEY).drop("_tr")


def atr_pct(bars, period=9, out="atr_pct"):
    return atr(bars, period, "_a").withColumn(out, ratio("_a", "close") * 100.0).drop("_a")


def _ratchet(batches):
    """Ratcheting bands and trend along each symbol, carried from batch to batch.

    Rows arrive sorted by (symbol, ts); only the previous row is remembered, so memory
    stays at one Arrow batch whatever a symbol's length.
    """
    key = up = dn = close = None
    trend = 1
    for pdf in batches:
        out_up, out_dn, out_trend = [], [], []
        rows = zip(pdf["symbol"].array, pdf["close"].array, pdf["up_raw"].array, pdf["dn_raw"].array)
        for symbol, c, u, d in rows:
            if symbol != key:
                key, trend = symbol, 1
            else:
                if trend == -1 and c > dn:
                    trend = 1
                elif trend == 1 and c < up:
                    trend = -1
                u = max(u, up) if close > up else u
                d = min(d, dn) if close < dn else d
            up, dn, close = u, d, c
            out_up.append(u)
            out_dn.append(d)
            out_trend.append(trend)
        yield pdf.assign(up=out_up, dn=out_dn, trend=out_trend).drop(columns=["up_raw", "dn_raw"])


def supertrend(bars, ema_len, atr_len, mult):
    """Trend +1 / -1 from bands that only tighten while the close stays on their side.

    The averages run as windows; the band recurrence is not associative and streams
    through each symbol in order.
    """
    d = atr(ema_close(bars.select("symbol", "ts", "high", "low", "close"), ema_len, "ma"), atr_len, "atr")
    d = d.select(
        "symbol",
        "ts",
        "close",
        "ma",
        "atr",
        (F.col("ma") - mult * F.col("atr")).alias("up_raw"),
        (F.col("ma") + mult * F.col("atr")).alias("dn_raw"),
    )
    d = d.repartition("symbol").sortWithinPartitions("symbol", "ts")
    kinds = dict(d.dtypes)
    schema = f"symbol string, ts {kinds['ts']}, close double, ma double, atr double, up double, dn double, trend int"
    return d.mapInPandas(_ratchet, schema)


def smi_cross(bars, k=14, d_len=3, smooth=2):
    """Momentum index crossing above its mean while the mean is below zero."""
    s = TICKBARS
    lo, hi = s.roll(F.min, "close", k), s.roll(F.max, "close", k)
    d = bars.withColumns({"_m": F.col("close") - (lo + hi) / 2, "_s": hi - lo})
    d = d.withColumn("smi", 100 * ratio(s.roll(F.avg, "_m", d_len), s.roll(F.avg, "_s", d_len)))
    d = d.withColumn("_f", F.coalesce("smi", F.lit(0.0)))
    d = ema(d, "_f", smooth, "smi_mean", **KEY)
    cross = (F.col("smi") > F.col("smi_mean")) & (s.lag("smi") <= s.lag("smi_mean"))
    return d.withColumn("smi_buy", F.coalesce(cross & (F.col("smi_mean") < 0), F.lit(False))).drop("_m", "_s", "_f")


# Version configurations.
VERSIONS = {
    0.5: dict(tp=0.005, sl=0.0025, tf=1, atr_min=0.5, atr_max=None, slow_mult=2, slow_ema=75, smi=False, fresh=True),
    1: dict(tp=0.01, sl=0.005, tf=5, atr_min=1.0, atr_max=None, slow_mult=2, slow_ema=75, smi=False, fresh=True),
    2: dict(tp=0.02, sl=0.01, tf=15, atr_min=2.0, atr_max=None, slow_mult=2, slow_ema=14, smi=False, fresh=True),
    3: dict(tp=0.03, sl=0.015, tf=60, atr_min=4.0, atr_max=8.0, slow_mult=4, slow_ema=75, smi=True, fresh=False),
    4: dict(tp=0.04, sl=0.02, tf=240, atr_min=8.0, atr_max=None, slow_mult=4, slow_ema=75, smi=True, fresh=False),
    5: dict(tp=0.05, sl=0.025, tf=1440, atr_min=10.0, atr_max=None, slow_mult=4, slow_ema=75, smi=True, fresh=False),
}
INNER = (75, 14, 0.5)
CONFIRM = (100, 10, 0.5)


def entry_signals(bars, version, hourly, atr_max="config"):
    """AND of the inner trigger, the slow trend, the volatility gate and the confirming trend."""
    c = VERSIONS[version]
    top = c["atr_max"] if atr_max == "config" else atr_max
    inner = supertrend(bars, *INNER).select("symbol", "ts", F.col("trend").alias("inner_trend"))
    confirm = supertrend(bars, *CONFIRM).select("symbol", "ts", F.col("trend").alias("confirm_trend"))
    slow = supertrend(resample(bars, c["tf"] * c["slow_mult"]), c["slow_ema"], INNER[1], INNER[2])
    slow = slow.select("symbol", "ts", F.col("trend").alias("slow_trend"))
    base = smi_cross(bars) if c["smi"] else bars.withColumn("smi_buy", F.lit(True))
    d = base.select("symbol", "ts", "close", "smi_buy").join(inner, ["symbol", "ts"]).join(confirm, ["symbol", "ts"])
    d = asof_backward(d, slow, ["symbol"], "ts", "ts", ["slow_trend"])
    d = asof_backward(d, atr_pct(hourly).select("symbol", "ts", "atr_pct"), ["symbol"], "ts", "ts", ["atr_pct"])
    a = F.col("atr_pct")
    if top is not None:
        gate = (a >= c["atr_min"]) & (a < top)
    else:
        gate = a > c["atr_min"] if version == 1 else a >= c["atr_min"]
    buy = (F.col("slow_trend") == 1) & gate
    if c["fresh"]:
        buy = buy & (F.col("inner_trend") == 1) & (TICKBARS.lag("inner_trend") == -1)
    elif c["smi"]:
        buy = buy & F.col("smi_buy")
    return d.withColumn("entry", F.coalesce(buy & (F.col("confirm_trend") == 1), F.lit(False)))


def order_ladder(df, price, base_usd, orders, first_step, step_scale, volume_scale):
    """Safety orders under a base price: cumulative drop and size of each, closed form."""
    k = F.col("order_no").cast("double")
    drop = (
        k * first_step
        if step_scale == 1
        else F.lit(first_step) * (F.pow(F.lit(float(step_scale)), k) - 1.0) / (step_scale - 1.0)
    )
    d = df.withColumn("order_no", F.explode(F.sequence(F.lit(0), F.lit(orders))))
    return d.withColumns(
        {
            "drop_pct": drop,
            "order_price": F.col(price) * (1.0 - drop),
            "volume_usd": F.lit(float(base_usd)) * F.pow(F.lit(float(volume_scale)), k),
        }
    )


# Fixed values: (30-day volume in USD, maker rate, taker rate).
FEE_TIERS = [
    (0, 0.0040, 0.0080),
    (2_500, 0.0030, 0.0060),
    (10_000, 0.0022, 0.0038),
    (25_000, 0.0020, 0.0035),
    (50_000, 0.0014, 0.0024),
    (100_000, 0.0012, 0.0022),
    (250_000, 0.0010, 0.0020),
    (500_000, 0.0008, 0.0018),
    (1_000_000, 0.0006, 0.0016),
    (2_500_000, 0.0004, 0.0014),
    (5_000_000, 0.0002, 0.0012),
    (10_000_000, 0.0000, 0.0010),
]
DEFAULT_SPREAD = 0.0008
TAKER_SLIPPAGE = 0.0010


def rolling_notional(fills, account, notional, days=30, slot_minutes=60):
    """Notional of the fills before each fill that are at most ``days`` old.

    Sum of three parts, none of which gathers an account in one task: the earlier fills
    of the fill's own time slot, the totals of the whole slots between, and the fills of
    the oldest slot at or after the cut-off.  ``fills`` has ``fill_id`` and ``ts``.
    """
    span = days * 1440 // slot_minutes
    epoch = F.lit("1970-01-01").cast(dict(fills.dtypes)["ts"])

    def slot(t):
        return F.floor(F.timestamp_diff("MINUTE", epoch, t) / slot_minutes)

    f = fills.select(account, "fill_id", "ts", F.col(notional).alias("_x"))
    cut = F.expr(f"ts - INTERVAL {days} DAYS")
    real = f.select(account, "fill_id", F.lit(0).alias("_k"), F.col("ts").alias("_t"), "_x")
    probe = f.select(account, "fill_id", F.lit(1).alias("_k"), cut.alias("_t"), F.lit(0.0).alias("_x"))
    u = real.unionByName(probe).withColumn("_s", slot(F.col("_t")))
    part = Window.partitionBy(account, "_s")
    older = part.orderBy("_t", "fill_id").rowsBetween(Window.unboundedPreceding, -1)
    later = part.orderBy(F.col("_t").desc(), "_k").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumns({"_before": F.sum("_x").over(older), "_after": F.sum("_x").over(later)})
    is_real = F.col("_k") == 0
    per = u.groupBy(account, "fill_id").agg(
        F.max(F.when(is_real, F.coalesce("_before", F.lit(0.0)))).alias("_b"),
        F.max(F.when(~is_real, F.col("_after"))).alias("_a"),
        F.max(F.when(is_real, F.col("_s"))).alias("_s"),
    )
    slots = real.withColumn("_s", slot(F.col("_t"))).groupBy(account, "_s").agg(F.sum("_x").alias("_tot"))
    mid = Window.partitionBy(account).orderBy("_s").rangeBetween(-(span - 1), -1)
    slots = slots.select(account, "_s", F.coalesce(F.sum("_tot").over(mid), F.lit(0.0)).alias("_m"))
    out = per.join(slots, [account, "_s"])
    return out.select(account, "fill_id", (F.col("_b") + F.col("_m") + F.col("_a")).alias("volume_30d"))


def fill_costs(df, notional, volume, tiers=None, spread=DEFAULT_SPREAD, slippage=TAKER_SLIPPAGE):
    tiers = tiers or FEE_TIERS
    maker, taker = tier_lookup(volume, tiers, 1), tier_lookup(volume, tiers, 2)
    x = F.col(notional)
    return df.withColumns(
        {
            "maker_rate": maker,
            "taker_rate": taker,
            "maker_cost": x * maker,
            "taker_cost": x * (taker + spread + slippage),
        }
    )
