"""Trade tables: entries, exits, friction, equity curves, attribution."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.windows import DAILY, ratio, row_of
from ..session import staged
from ..sources.tables import PART_ROWS
from .chains import keep_clear
from .joins import interval_join, next_row_after


def momentum_trades(labelled, horizon):
    """One trade per breakout row with its horizon exit."""
    d = labelled.where(
        F.col("is_entry") & F.col("is_momentum_winner").isNotNull() & F.col("exit_close_adj").isNotNull()
    )
    return d.select(
        "symbol",
        F.col("date").alias("entry_date"),
        F.col("close_adj").alias("entry_price"),
        "exit_date",
        F.col("exit_close_adj").alias("exit_price"),
        ((ratio("exit_close_adj", "close_adj") - 1.0) * 100.0).alias("gross_pnl_pct"),
        "forward_max_pct",
        F.col("is_momentum_winner").alias("is_winner_label"),
        "avg_dollar_volume_30d",
        F.lit(horizon).cast("long").alias("realized_horizon_days"),
    )


def equity_curve(trades, by, day, order, pnl, start):
    """Running equity, previous equity and drawdown after each realised trade.

    A range sort deals the trades out by group, day and order.  Sums and maxima run inside a
    task's range and start at those of the ranges before, one small row per group and range,
    so that no task orders a whole strategy or day.
    """
    by = list(by)
    # a null amount counts as nothing, as in a running sum
    d = trades.repartitionByRange(*by, day, *order).withColumn("_range", F.spark_partition_id())
    w = Window.partitionBy(*by, "_range").orderBy(day, *order).rowsBetween(Window.unboundedPreceding, 0)
    d = staged(d.withColumn("_in", F.coalesce(F.sum(pnl).over(w), F.lit(0.0))).withColumn("_mx", F.max("_in").over(w)))
    parts = d.groupBy(*by, "_range").agg(F.coalesce(F.sum(pnl), F.lit(0.0)).alias("_p"), F.max("_in").alias("_m"))
    wb = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_b", F.coalesce(F.sum("_p").over(wb), F.lit(0.0)))
    parts = parts.withColumn("_pk", F.coalesce(F.max(F.col("_b") + F.col("_m")).over(wb), F.lit(0.0)))
    same = F.col("d._range") == F.col("p._range")
    for k in by:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}"))
    d = d.alias("d").join(parts.alias("p"), same).select("d.*", "p._b", "p._pk")
    equity = F.lit(float(start)) + F.col("_b") + F.col("_in")
    peak = F.lit(float(start)) + F.greatest(F.lit(0.0), F.col("_pk"), F.col("_b") + F.col("_mx"))
    prev = equity - F.col(pnl)
    return d.select(
        *trades.columns,
        equity.alias("equity"),
        (F.col(pnl) / F.when(prev == 0, F.lit(1e-9)).otherwise(prev)).alias("event_return"),
        ((equity - peak) / peak).alias("drawdown"),
    )


def curve_stats(curve, by, **more):
    """Count, Sharpe and drawdown per group; ``more`` names further aggregates of the same pass."""
    sd = F.stddev_pop("event_return")
    sharpe = F.when(sd > 0, F.avg("event_return") / F.greatest(sd, F.lit(1e-9)) * math.sqrt(252.0)).otherwise(0.0)
    return curve.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"),
        sharpe.alias("sharpe"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
        *[v.alias(k) for k, v in more.items()],
    )


def window_stats(trades, window_col, position_usd, start):
    """Per window: count, win rate, mean and median return, Sharpe and drawdown of the curve."""
    t = staged(trades.withColumn("usd", F.col("gross_pnl_pct") / 100.0 * position_usd))
    g = F.col("gross_pnl_pct")
    agg = t.groupBy(window_col).agg(
        F.avg((g > 0).cast("double")).alias("win_rate"),
        F.avg(g).alias("mean_gross_pnl_pct"),
        F.sum("usd").alias("total_gross_pnl_usd"),
    )
    med = exact_quantiles(t, [window_col], "gross_pnl_pct", {"median_gross_pnl_pct": 0.5}, stage=False)
    st = curve_stats(equity_curve(t, [window_col], "exit_date", ["symbol", "entry_date"], "usd", start), [window_col])
    return agg.join(med, window_col).join(st, window_col)


# Fixed values: (target, stop, rows) by training label.
LABEL_EXITS = {
    "L1": (0.15, 0.06, 30),
    "L2": (0.20, 0.08, 30),
    "L3": (0.30, 0.12, 60),
    "L4": (0.15, 0.06, 30),
    "L5": (0.20, 0.08, 60),
}


def barrier_exits(bars, entries, exits=None, slippage=0.001, keep=()):
    """Stop, target or time exit for every entry, each on its own.

    ``entries``: (symbol, date, rule_key, label).  The fill is the next row's open; the
    stop is read before the target on the same row.  ``keep`` names columns of the bars that
    come along from the entry's own row.

    Bars and entries are one stream, sorted by symbol and backwards by date, with an entry
    behind the bar of its date; a task reads it in Arrow batches and holds the bars that an
    exit can still reach, so neither a symbol's bars nor its entries are ever one list.  An exit
    depends on symbol, date and label only, so a batch finds it once for each.
    """
    exits = exits or LABEL_EXITS
    prices, keep = ["open", "low", "high", "close_adj"], list(keep)
    left = bars.select("symbol", "date", *[F.col(c).cast("double").alias(c) for c in prices], *[F.col(c).alias(f"keep_{c}") for c in keep])
    right = entries.select("symbol", "date", "rule_key", "label").dropna(subset=["symbol", "date", "label"])
    both = left.where(F.col("symbol").isNotNull()).unionByName(right, allowMissingColumns=True)
    both = both.withColumn("is_entry", F.col("label").isNotNull())
    parts = max(bars.sparkSession.sparkContext.defaultParallelism, math.ceil(bars.count() / PART_ROWS))
    back = [F.col(c).desc() for c in prices]  # rows of one date are in the order of their prices
    both = both.repartition(parts, "symbol").sortWithinPartitions("symbol", F.col("date").desc(), "is_entry", *back)
    kinds = dict(both.dtypes)
    schema = {
        "symbol": kinds["symbol"], "signal_date": kinds["date"], "rule_key": kinds["rule_key"], "entry_date": kinds["date"], "entry_price": "double",
        "exit_date": kinds["date"], "exit_price": "double", "exit_reason": "string", **{c: kinds[f"keep_{c}"] for c in keep},
    }
    return both.mapInArrow(lambda batches: _exits(batches, exits, slippage, keep), ", ".join(f"`{n}` {t}" for n, t in schema.items()))


REASONS = pa.array(["end_of_period", "stop", "target", "time"])


def _exits(batches: Iterator[pa.RecordBatch], exits, slippage, keep) -> Iterator[pa.RecordBatch]:
    """The exits of a sorted stream of bars and entries; see ``barrier_exits``."""
    longest = max(t for _, _, t in exits.values())
    names = pa.array(list(exits))
    # a label without an exit has no barrier and no day
    targets, stops, days = (np.array([*[v[i] for v in exits.values()], missing]) for i, missing in ((0, np.nan), (1, np.nan), (2, 0)))
    held, final = None, None  # the latest bars, and the last one in time of their symbol
    for batch in batches:
        batch = pa.Table.from_batches([batch])
        bars = batch.filter(pc.invert(batch["is_entry"]))
        bars = (bars if held is None else pa.concat_tables([held, bars])).combine_chunks()
        entries = batch.filter(batch["is_entry"])
        if not bars.num_rows:  # entries of symbols that have none
            continue
        symbol = bars["symbol"].combine_chunks()
        new = np.append(True, pc.not_equal(symbol[1:], symbol[:-1]).to_numpy(zero_copy_only=False))
        begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))  # a symbol's last bar in time
        ends = bars.select(["date", "close_adj"])
        if held is not None:  # the first symbol's may be gone from what is held
            ends = pa.concat_tables([final, ends.slice(1)])
        if entries.num_rows:
            yield from _exits_of(bars, ends, begin, entries, batch["is_entry"], names, targets, stops, days, longest, slippage, keep)
        at = begin[-1]
        final = ends.slice(at, 1)
        held = bars.slice(max(at, len(new) - longest - 2))


def _exits_of(bars, ends, begin, entries, is_entry, names, targets, stops, days, longest, slippage, keep) -> Iterator[pa.RecordBatch]:
    """The exits of a batch's entries, whose bars and those after them in time are ``bars``, backwards."""
    is_entry = is_entry.to_numpy()
    own = np.cumsum(~is_entry)[is_entry] + len(begin) - np.count_nonzero(~is_entry) - 1  # the bar before an entry in the stream
    on = (own >= 0) & (own > begin[np.maximum(own, 0)])  # the last bar in time has no next one
    at = pa.array(np.maximum(own, 0))
    for c in ("symbol", "date"):
        on &= pc.fill_null(pc.equal(entries[c], bars[c].take(at)), False).to_numpy()
    entries, own = entries.filter(pa.array(on)), own[on]
    label = pc.fill_null(pc.index_in(entries["label"], value_set=names), len(names)).to_numpy().astype(np.int64)
    case, which = np.unique(own * (len(names) + 1) + label, return_inverse=True)  # an exit for each day and label
    j, label = case // (len(names) + 1), case % (len(names) + 1)

    def ordered(c):
        """Not-a-number is above all numbers; nothing compares with a null."""
        x = bars[c].to_numpy()
        return np.where(bars[c].is_null().to_numpy(), np.nan, np.where(np.isnan(x), np.inf, x))

    low, high = ordered("low"), ordered("high")
    # a fill that is null or not above zero is none
    some = ordered("open")[j - 1] > 0
    price = bars["open"].to_numpy()[j - 1] * (1 + slippage)
    tp, sl, d = price * (1 + targets[label]), price * (1 - stops[label]), days[label]
    known = label < len(names)
    above = lambda x: np.where(np.isnan(x), np.inf, x)
    tp_at, sl_at = above(tp), above(sl)
    ahead = np.minimum(j - 1 - begin[j], longest)
    reach = np.where(some, np.minimum(d, ahead), 0)
    reason, row = np.zeros(len(j), np.int64), begin[j]
    active = np.flatnonzero(reach > 0)
    for k in range(1, longest + 1):
        active = active[reach[active] >= k]
        if not len(active):
            break
        day = j[active] - 1 - k
        stop, hit = low[day] <= sl_at[active], high[day] >= tp_at[active]
        out = stop | hit
        reason[active[out]] = np.where(stop[out], 1, 2)
        row[active[out]] = day[out]
        active = active[~out]
    timed = (reason == 0) & known & (ahead >= d)
    reason[timed], row[timed] = 3, j[timed] - 1 - d[timed]
    last = (reason == 0)[which]
    gross = pc.if_else(pa.array(last), ends["close_adj"].take(pa.array(begin[j][which])), bars["close_adj"].take(pa.array(row[which])))
    barrier = np.where(reason == 1, sl, tp)[which]
    gross = pc.if_else(pa.array(np.isin(reason, (1, 2))[which]), pa.array(barrier), gross)
    exit_date = pc.if_else(pa.array(last), ends["date"].take(pa.array(begin[j][which])), bars["date"].take(pa.array(row[which])))
    mine, fill = pa.array(j[which]), pa.array(j[which] - 1)
    columns = [
        entries["symbol"], entries["date"], entries["rule_key"], bars["date"].take(fill), pa.array(price[which]),
        exit_date, pc.multiply(gross, 1 - slippage), REASONS.take(pa.array(reason[which])), *[bars[f"keep_{c}"].take(mine) for c in keep],
    ]
    out = pa.table(columns, names=["symbol", "signal_date", "rule_key", "entry_date", "entry_price", "exit_date", "exit_price", "exit_reason", *keep])
    yield from out.filter(pa.array(some[which])).combine_chunks().to_batches()


def exit_flags(scored, score, share):
    """True where the score is in its top ``share``, the cut being the interpolated quantile."""
    cut = exact_quantiles(scored, [], score, {"q": 1.0 - share}).scalar()
    return scored.withColumn("would_exit", F.coalesce(F.col(score) >= cut, F.lit(False)))


def two_stage_exits(bars, entries, eligibility=60, cap=60):
    """One row per entry: out at the first exit flag after the fill, else at a cap, else at the data's end.

    ``bars``: open, close_adj and ``would_exit`` per (symbol, date); ``entries``: (symbol, date,
    signal_strength), of which the strongest per (symbol, date) counts.  The fill is the open of
    the next row, and entries on a fill at or below zero are dropped.  Every bar knows the next
    flagged row and the rows at the caps from windows over one partitioning, so an entry only
    looks up its fill row.
    """
    s = DAILY
    back = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    end = F.struct("date", "close_adj", "i")
    d = bars.select("symbol", "date", "open", "close_adj", "would_exit").withColumn("i", F.row_number().over(s.w))
    d = d.withColumns(
        {
            "flag": F.last(F.when(F.col("would_exit"), end), True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
            "late": F.lead(end, eligibility + 1).over(s.w),
            "capped": F.lead(end, cap).over(s.w),
            "final": F.first(end).over(back.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    fill = F.struct("open", "i", "flag", "late", "capped", "final").alias("f")
    strongest = entries.groupBy("symbol", "date").agg(F.max("signal_strength").alias("signal_strength"))
    e = next_row_after(strongest, d.select("symbol", "date", fill), ["symbol"], "date", "date", ["f"]).where("f.open > 0")
    signalled = F.col("f.flag").isNotNull() & (F.col("f.flag.i") - F.col("f.i") <= min(eligibility, cap))
    late = F.lit(eligibility < cap) & F.col("f.late").isNotNull()
    reason = (
        F.when(signalled, "exit_signal").when(late, "eligibility_cap").when(F.col("f.capped").isNotNull(), "hard_cap").otherwise("end_of_data")
    )
    out = F.when(signalled, F.col("f.flag")).when(late, F.col("f.late")).otherwise(F.coalesce("f.capped", "f.final"))
    return e.withColumns({"exit_reason": reason, "x": out}).select(
        "symbol",
        F.col("date").alias("entry_date"),
        F.col("x.date").alias("exit_date"),
        (F.col("x.i") - F.col("f.i")).cast("long").alias("days_held"),
        F.col("f.open").alias("entry_price"),
        F.col("x.close_adj").alias("exit_price"),
        ((F.col("x.close_adj") / F.col("f.open") - 1.0) * 100.0).alias("realized_gain_pct"),
        "exit_reason",
        "signal_strength",
    )


# The gates of an exit variant.
EXIT_GATES = {"mean_hold_days": 30.0, "median_gain_pct": 20.0, "win_rate": 0.5}


def compare_exits(pairs, by="variant"):
    """Per variant: counts by reason, coverage, hold and gain quartiles (nearest rank), win rate and gates."""
    pairs = staged(pairs)
    gain, hold = F.col("realized_gain_pct"), F.col("days_held")
    a = pairs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.count_if(F.col("exit_reason") == "exit_signal").alias("n_with_exit"),
        F.count_if(F.col("exit_reason") == "hard_cap").alias("n_hard_cap"),
        F.avg(hold).alias("mean_hold_days"),
        F.min(hold).alias("min_hold_days"),
        F.max(hold).alias("max_hold_days"),
        F.avg(gain).alias("mean_gain_pct"),
        F.avg((gain > 0).cast("double")).alias("win_rate"),
        F.min(gain).alias("worst_gain_pct"),
    )
    for name, c in (("hold_days", "days_held"), ("gain_pct", "realized_gain_pct")):
        a = a.join(exact_quantiles(pairs, [by], c, {f"median_{name}": 0.5}, stage=False), by)
        a = a.join(exact_quantiles(pairs, [by], c, {f"p25_{name}": 0.25, f"p75_{name}": 0.75}, stage=False, nearest=True), by)
    a = a.withColumn("exit_coverage_pct", 100.0 * F.col("n_with_exit") / F.col("n_entries"))
    gates = {f"passes_{k}": F.col(k) >= v for k, v in EXIT_GATES.items()}
    return a.withColumns(gates).withColumn("passes_all", reduce(lambda x, y: x & y, [F.col(g) for g in gates]))


def non_overlapping(bars, breakout=60, horizon=120, target=0.50, friction_pct=0.35):
    """Per symbol: enter at the first breakout after the last exit, leave at target or horizon.

    Each breakout row first gets its own exit row; which rows stay is found by pointer doubling.
    """
    high = DAILY.roll_prior(F.max, "close", breakout)
    d = bars.select("symbol", "date", "close", F.coalesce(F.col("close") > high, F.lit(False)).alias("up"))
    d = d.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "close", "up"))).alias("bs"))
    found = F.filter(F.transform("bs", lambda b, i: F.struct(b.alias("b"), (i + 1).alias("i"))), lambda x: x["b"]["up"])
    ahead = F.transform(found, lambda x: F.struct(x["b"].alias("b"), x["i"].alias("i"), F.slice("bs", x["i"] + 1, horizon).alias("_f")))
    d = d.select("symbol", F.inline(ahead)).select("symbol", "i", "b.date", "b.close", "_f")
    hit = F.array_position(F.transform("_f", lambda x: x["close"] >= F.col("close") * (1 + target)), F.lit(True))
    d = d.withColumn("_h", hit).withColumn("_n", F.size("_f").cast("long"))
    at = F.when(F.col("_h") > 0, F.col("_h")).otherwise(F.col("_n"))
    reason = F.when(F.col("_h") > 0, "tp").when(F.col("_n") >= horizon, "horizon").otherwise("data_end")
    end = F.get("_f", (at - 1).cast("int"))
    found = staged(
        d.select(
            "symbol",
            F.col("i").cast("long").alias("i"),
            (F.col("i") + at).alias("x"),
            F.col("date").alias("entry_date"),
            F.coalesce(end["date"], F.col("date")).alias("exit_date"),
            F.col("close").alias("entry_price"),
            F.coalesce(end["close"], F.col("close")).alias("exit_price"),
            at.alias("hold_days"),
            reason.alias("exit_reason"),
        )
    )
    t = found.join(keep_clear(found, ["symbol"], "i", "x"), ["symbol", "i"], "left_semi")
    gross = (ratio("exit_price", "entry_price") - 1.0) * 100.0
    return t.select(
        "symbol", "entry_date", "exit_date", "entry_price", "exit_price",
        gross.alias("gross_pnl_pct"), (gross - friction_pct).alias("net_pnl_pct"),
        F.col("hold_days").cast("long").alias("hold_days"), "exit_reason",
    )


def regime_streaks(daily, regime):
    """Hold a series while its label is ``regime``; one row per streak.

    ``daily``: (date, close, regime_label), one row per day.
    """
    w = Window.orderBy("date")
    d = daily.withColumn("_on", (F.col("regime_label") == regime).cast("int"))
    start = (F.col("_on") == 1) & (F.coalesce(F.lag("_on").over(w), F.lit(0)) == 0)
    d = d.withColumns(
        {
            "_start": start.cast("int"),
            "_next": F.lead("close").over(w),
            "_run": F.lead("_on").over(w),
        }
    )
    d = d.withColumn("_id", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    on = d.where(F.col("_on") == 1)
    # the row after the streak's last day gives the exit; a streak open at the end exits at its own close
    return on.groupBy(F.col("_id").alias("streak")).agg(
        F.min("date").alias("entry_date"),
        F.min_by("close", "date").alias("entry_price"),
        F.max_by(F.coalesce("_next", "close"), "date").alias("exit_price"),
        F.count(F.lit(1)).alias("n_days"),
    )


def streak_summary(streaks):
    m = ratio("exit_price", "entry_price")
    total = F.exp(F.sum(F.ln(m)))
    return streaks.agg(
        F.count(F.lit(1)).alias("n_streaks"),
        F.sum("n_days").alias("total_days_in_regime"),
        (F.avg(m - 1.0) * 100.0).alias("mean_net_pnl_pct"),
        ((total - 1.0) * 100.0).alias("total_compound_pct"),
        (F.pow(total, F.lit(252.0) / F.greatest(F.sum("n_days"), F.lit(1))) - 1.0).alias("annualized_cagr"),
    )


def liquidity_tags(trades, bars, min_price, min_volume, entry_col="entry_date"):
    """Attach the 30-row mean volume at entry and mark what the filter keeps."""
    v = bars.select("symbol", F.col("date").alias(entry_col), DAILY.roll(F.avg, "volume", 30).alias("avg_volume_30d"))
    d = trades.join(v, ["symbol", entry_col], "left")
    low, thin = F.col("entry_price") < min_price, F.col("avg_volume_30d") < min_volume
    keep = F.coalesce((F.col("entry_price") >= min_price) & (F.col("avg_volume_30d") >= min_volume), F.lit(False))
    return d.withColumns({"price_fail": low, "volume_fail": thin, "is_kept": keep})


def gross_prices(trades, slippage):
    """Undo the slippage that is baked into entry and exit prices."""
    d = trades.withColumns(
        {
            "gross_entry_price": F.col("entry_price") / (1.0 + slippage),
            "gross_exit_price": F.col("exit_price") / (1.0 - slippage),
        }
    )
    return d.withColumn("gross_pnl_pct", (ratio("gross_exit_price", "gross_entry_price") - 1.0) * 100.0)


def _apply_friction(d, position_usd):
    total = F.col("fee_cost_pct") + F.col("spread_cost_pct") + F.col("slippage_cost_pct")
    d = d.withColumn("net_pnl_pct", F.col("gross_pnl_pct") - total)
    size = F.abs(F.col("gross_pnl_pct"))
    return d.withColumns(
        {
            "friction_pct_of_gross": F.when(size > 0.01, total / size * 100.0),
            "net_pnl_usd": F.col("net_pnl_pct") / 100.0 * position_usd,
            "total_friction_usd": total / 100.0 * position_usd,
        }
    )


def flat_friction(trades, fee_leg=0.0016, spread_rt=0.0005, baked=0.001, extra_rt=0.0, position_usd=1000.0):
    d = gross_prices(trades, baked).withColumns(
        {
            "fee_cost_pct": F.lit(2.0 * fee_leg * 100.0),
            "spread_cost_pct": F.lit(spread_rt * 100.0),
            "slippage_cost_pct": F.lit((2.0 * baked + extra_rt) * 100.0),
        }
    )
    return _apply_friction(d, position_usd)


def atr_friction(trades, atr_col, baked=0.001, spread_leg=0.0004, stop=0.18, market=0.08, position_usd=1000.0):
    """Slippage grows with volatility; a stop pays the larger factor on its exit leg."""
    exit_leg = F.when(F.col("exit_reason") == "stop", F.lit(stop)).otherwise(F.lit(market))
    d = gross_prices(trades, baked).withColumns(
        {
            "fee_cost_pct": F.lit(0.0),
            "spread_cost_pct": F.lit(2.0 * spread_leg * 100.0),
            "slippage_cost_pct": F.col(atr_col) * 100.0 * (F.lit(market) + exit_leg),
        }
    )
    return _apply_friction(d, position_usd)


def haircut(d, share):
    share = max(0.0, min(1.0, share))
    return d.withColumns(
        {
            "haircut_pct": F.lit(share * 100.0),
            "net_pnl_pct_after_haircut": F.col("net_pnl_pct") * (1.0 - share),
            "net_pnl_usd_after_haircut": F.col("net_pnl_usd") * (1.0 - share),
        }
    )


def normalise(trades, strategy, net, hold=None):
    """One schema for every strategy's trades."""
    h = F.col(hold).cast("long") if hold else F.lit(None).cast("long")
    return trades.select(
        F.lit(strategy).alias("strategy_id"),
        F.col("entry_date").cast("date").alias("entry_date"),
        F.col(net).alias("net_pnl_pct"),
        h.alias("hold_days"),
    )


def _per_trade_sharpe(x, hold):
    sd = F.stddev_pop(x)
    yearly = F.sqrt(F.lit(252.0) / F.greatest(F.coalesce(F.avg(hold), F.lit(1.0)), F.lit(1.0)))
    return F.when((F.count(x) >= 2) & (sd > 0), F.avg(x) / sd * yearly).otherwise(0.0)


def per_trade_sharpe(trades, by):
    return trades.groupBy(*by).agg(_per_trade_sharpe(F.col("net_pnl_pct"), F.col("hold_days")).alias("per_trade_sharpe"))


def attribution(trades, labels):
    """Strategy by regime: twelve metrics per cell; days without a label are "unlabeled"."""
    lab = labels.select(F.col("date").alias("entry_date"), "regime_label")
    j = trades.join(lab, "entry_date", "left").withColumn(
        "regime_label", F.coalesce("regime_label", F.lit("unlabeled"))
    )
    j = staged(j)
    x, by = F.col("net_pnl_pct"), ["strategy_id", "regime_label"]
    mean_hold = F.coalesce(F.avg("hold_days"), F.lit(1.0))
    n = F.count(F.lit(1))
    a = j.groupBy(*by).agg(
        n.alias("n_trades"),
        F.count_distinct("entry_date").alias("n_unique_entry_days"),
        F.avg(x).alias("mean_pnl_pct"),
        _per_trade_sharpe(x, F.col("hold_days")).alias("per_trade_sharpe"),
        (F.avg(x) * 252.0 / F.greatest(mean_hold, F.lit(1.0))).alias("comparable_yield_pct"),
        (F.avg((x > 0).cast("double")) * 100.0).alias("win_rate_pct"),
        F.min(x).alias("max_trade_loss_pct"),
        mean_hold.alias("mean_hold_days"),
        F.when(n >= 30, "high").when(n >= 10, "medium").otherwise("low").alias("confidence"),
        F.count(x).alias("_has"),
    )
    med = exact_quantiles(j, by, "net_pnl_pct", {"median_pnl_pct": 0.5}, stage=False)
    sid = F.lower("strategy_id")
    tight = sid.startswith("stream_2c_grid") | sid.contains("dca")
    return (
        a.where(F.col("_has") > 0)
        .join(med, by)
        .withColumn("sharpe_class", F.when(tight, "tp_clustered").otherwise("realistic"))
        .drop("_has")
    )


def per_day_attribution(daily, labels, min_days=5):
    j = daily.join(labels.select("date", "regime_label"), "date", "left").withColumn(
        "regime_label", F.coalesce("regime_label", F.lit("unlabeled"))
    )
    r = F.col("daily_return_pct")
    mean, sd = F.avg(r), F.stddev_pop(r)
    cap = F.coalesce(F.avg("active_capital_pct"), F.lit(0.0))
    return j.groupBy("strategy_id", "regime_label").agg(
        F.count(r).alias("n_active_days"),
        mean.alias("mean_daily_return_pct"),
        (mean * 252).alias("annualized_return_pct"),
        sd.alias("daily_volatility_pct"),
        F.when(sd > 0, mean / sd * math.sqrt(252.0)).otherwise(0.0).alias("daily_sharpe"),
        F.min(r).alias("max_daily_loss_pct"),
        cap.alias("mean_active_capital_pct"),
        (mean * cap).alias("active_capital_weighted_return_pct"),
    ).where(F.col("n_active_days") >= min_days)


def policy_summary(policies, min_days=30):
    """Calendar-time growth, Sharpe, drawdown and switches per policy; one row per day in."""
    w = Window.partitionBy("policy_id").orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = policies.withColumn("_l", F.ln(1.0 + F.col("daily_return_pct") / 100.0))
    d = d.withColumns(
        {
            "_c": F.sum("_l").over(run),
            "_sw": (F.col("active_strategy_id") != F.lag("active_strategy_id").over(w)).cast("int"),
        }
    )
    d = d.withColumn("_dd", (F.exp(F.col("_c") - F.max("_c").over(run)) - 1.0) * 100.0)
    r = F.col("daily_return_pct")
    years = F.greatest(F.datediff(F.max("date"), F.min("date")) / 365.25, F.lit(1e-6))
    a = d.groupBy("policy_id").agg(
        F.count(r).alias("n_days"),
        years.alias("calendar_years"),
        F.exp(F.sum("_l")).alias("_cum"),
        F.avg(r).alias("_m"),
        F.stddev_pop(r).alias("_s"),
        F.min("_dd").alias("max_drawdown_pct"),
        F.coalesce(F.sum("_sw"), F.lit(0)).alias("n_transitions"),
    ).where(F.col("n_days") >= min_days)
    rows = F.col("n_days") / F.col("calendar_years")
    return a.select(
        "policy_id",
        "n_days",
        "calendar_years",
        rows.alias("rows_per_year"),
        ((F.col("_cum") - 1.0) * 100.0).alias("total_return_pct"),
        ((F.pow("_cum", 1.0 / F.col("calendar_years")) - 1.0) * 100.0).alias("cagr_pct"),
        F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt(rows)).otherwise(0.0).alias("daily_sharpe"),
        "max_drawdown_pct",
        "n_transitions",
        (F.col("n_transitions") / F.col("calendar_years")).alias("annual_transitions"),
    )


def regime_cagr(trades, labels):
    """Geometric mean per trade, annualised by the mean hold, per regime of the entry day."""
    lab = labels.select(F.col("date").alias("entry_date"), F.col("regime_label").alias("regime"))
    j = trades.join(lab, "entry_date")
    x = F.col("net_pnl_pct")
    growth = F.exp(F.avg(F.ln(1.0 + x / 100.0)))
    hold = F.greatest(F.avg("hold_days"), F.lit(1.0))
    return j.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n_trades"),
        (F.avg((x > 0).cast("double")) * 100.0).alias("win_rate_pct"),
        F.avg(x).alias("mean_net_pnl_pct"),
        (F.pow(growth, F.lit(252.0) / hold) - 1.0).alias("annualized_cagr"),
        F.avg("hold_days").alias("mean_hold_days"),
    )


def best_per_regime(matrix, k=3):
    w = Window.partitionBy("regime_label").orderBy(F.col("comparable_yield_pct").desc(), "strategy_id")
    return (
        matrix.where(F.col("confidence") != "low")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def daily_curve(trades, bars, strategy, max_open=10):
    """Mean return of the open trades per day; open from the day after entry to exit."""
    panel = bars.select(
        "symbol", "date", ((ratio("close_adj", DAILY.lag("close_adj")) - 1.0) * 100.0).alias("_r")
    ).where(F.col("_r").isNotNull())
    spans = trades.select("symbol", F.date_add("entry_date", 1).alias("_lo"), F.col("exit_date").alias("_hi"))
    j = interval_join(spans, panel, "symbol", "_lo", "_hi", "date")
    n = F.count(F.lit(1))
    capped = F.least(n, F.lit(max_open))
    return j.groupBy("date").agg(
        F.lit(strategy).alias("strategy_id"),
        (F.sum("_r") / n).alias("daily_return_pct"),
        capped.cast("long").alias("open_deal_count"),
        (capped / F.lit(float(max_open)) * 100.0).alias("active_capital_pct"),
    )


def deal_metrics(deals, equity, starting):
    """Win rate, risk-reward, equity Sharpe, drawdown, growth and exit counts.

    ``equity``: (date, equity), one row per day.
    """
    p = F.col("pnl_usd")
    w = Window.orderBy("date")
    e = equity.withColumns(
        {
            "_r": ratio("equity", F.lag("equity").over(w)) - 1.0,
            "_pk": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    sd = F.stddev_samp("_r")
    years = F.greatest(F.datediff(F.max("date"), F.min("date")) / 365.25, F.lit(0.001))
    end = F.max_by("equity", "date")
    es = e.agg(
        F.when(sd > 0, F.avg("_r") / sd * math.sqrt(365.0)).otherwise(0.0).alias("sharpe"),
        (F.min((F.col("equity") - F.col("_pk")) / F.col("_pk")) * 100.0).alias("max_dd_pct"),
        ((F.pow(end / starting, 1.0 / years) - 1.0) * 100.0).alias("cagr_pct"),
        end.alias("final_equity"),
    )
    ds = deals.agg(
        F.count(F.lit(1)).alias("n_deals"),
        F.count_if(p > 0).alias("n_wins"),
        F.avg((p > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("mean_win_usd"),
        F.coalesce(F.avg(F.when(p < 0, -p)), F.lit(0.0)).alias("mean_loss_usd"),
        F.sum(p).alias("net_pnl_usd"),
        F.count_if(F.col("reason") == "tp").alias("n_tp"),
        F.count_if(F.col("reason") == "horizon").alias("n_horizon"),
        F.count_if(F.col("reason") == "data_end").alias("n_data_end"),
    ).withColumn("rr_realized", ratio("mean_loss_usd", "mean_win_usd"))
    row = row_of(es)
    return ds.withColumns({c: row[c] for c in es.columns})


def peak_capital(deals, open_col, close_col, cost):
    """Largest capital in use at once: opens and closes netted per day and side, then swept.

    Opens come before closes on the same day.
    """
    ev = deals.select(
        F.inline(
            F.array(
                F.struct(F.col(open_col).alias("ts"), F.lit(0).alias("side"), F.col(cost).alias("delta")),
                F.struct(F.col(close_col).alias("ts"), F.lit(1).alias("side"), (-F.col(cost)).alias("delta")),
            )
        )
    )
    net = ev.groupBy("ts", "side").agg(F.sum("delta").alias("delta"))
    w = Window.orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    return net.withColumn("_c", F.sum("delta").over(w)).agg(
        F.greatest(F.max("_c"), F.lit(0.0)).alias("peak_capital"), F.count(F.lit(1)).alias("n_event_days")
    )
