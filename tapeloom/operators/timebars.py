"""Time bars from ticks, alignment, sliding windows, split by interval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import DAILY


def bars_from_ticks(ticks, minutes, extra_order="event_id", volume=None):
    """First / max / min / last / sum per (symbol, slot); empty slots do not appear.

    Ticks combine on the map side by hashing, so a symbol with a third of all ticks still
    shuffles as one partial row per slot and task, and no raw tick is sorted: time and the
    whole number ``extra_order`` that breaks its ties are one decimal.
    """
    vol = F.count(F.lit(1)) if volume is None else F.sum(volume)
    slot = F.window("ts", f"{minutes} minutes")["start"]
    epoch = F.lit("1970-01-01").cast(dict(ticks.dtypes)["ts"])
    whole = lambda c: c.cast("long").cast("decimal(20,0)")
    micros = whole(F.timestamp_diff("MICROSECOND", epoch, F.col("ts")))
    place = (micros * F.expr("9223372036854775808") + whole(F.col(extra_order))).cast("decimal(38,0)")
    d = ticks.select("*", slot.alias("_slot"), place.alias("_place")).groupBy("symbol", F.col("_slot").alias("ts")).agg(
        F.min_by("price", "_place").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_place").alias("close"),
        vol.alias("volume"),
    )
    return d.select("symbol", "ts", "open", "high", "low", "close", "volume")


def resample(bars, minutes):
    """Coarser bars from finer ones."""
    slot = F.window("ts", f"{minutes} minutes")["start"]
    return bars.groupBy("symbol", slot.alias("_slot")).agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    ).withColumnRenamed("_slot", "ts")


def daily_last(bars):
    return bars.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.max_by("close", "ts").alias("close"))


def daily_dollar_volume(bars):
    return bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum(F.col("close") * F.col("volume")).alias("dv"))


def daily_log_return(bars, series):
    r = F.ln(F.try_divide(F.col("close"), series.lag("close")))
    d = bars.withColumn("_r", r).where(F.col("_r").isNotNull())
    return d.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum("_r").alias("r"))


CHANNELS = ("open", "high", "low", "close", "close_adj", "volume")


def sliding_windows(bars, label, rows=60, channels=CHANNELS):
    """The last ``rows`` rows of every channel at each labelled row; short symbols drop out."""
    w = DAILY.trailing(rows)
    cell = F.struct(*[F.col(c).cast("float").alias(c) for c in channels])
    d = bars.withColumn("window", F.collect_list(cell).over(w))
    return d.where((F.size("window") == rows) & F.col(label).isNotNull())


def window_znorm(bars, rows=60, channels=CHANNELS, eps=1e-6):
    """z of the last row of each window per channel: population deviation plus eps."""
    w = DAILY.trailing(rows)
    cols = {}
    for c in channels:
        x = F.col(c).cast("double")
        z = (x - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + F.lit(eps))
        cols[f"z_{c}"] = F.when(F.count(x).over(w) == rows, z)
    return bars.withColumns(cols)


def in_interval(df, lo, hi, date_col="date"):
    """Rows with ``lo < date <= hi``; an open end is None."""
    d = F.col(date_col)
    if lo is not None:
        df = df.where(d > F.lit(lo).cast("date"))
    if hi is not None:
        df = df.where(d <= F.lit(hi).cast("date"))
    return df


def choose_interval(available, wanted):
    """The wanted interval, or the finest given one that it can be built from."""
    if wanted in available:
        return wanted
    finer = [i for i in sorted(available, reverse=True) if i <= wanted]
    if not finer:
        raise FileNotFoundError(f"no bars at or below {wanted} minutes")
    return finer[0]


def load_bars(sources, symbol, minutes, start, end):
    """One symbol's bars in [start, end], end day included, resampled when only finer bars exist.

    ``sources``: {interval minutes: bar frame}.
    """
    source = choose_interval(sources, minutes)
    lo, hi = F.lit(start).cast("date"), F.date_add(F.lit(end).cast("date"), 1)
    d = sources[source].where((F.col("symbol") == symbol) & (F.col("ts") >= lo) & (F.col("ts") < hi))
    return resample(d, minutes) if source < minutes else d
