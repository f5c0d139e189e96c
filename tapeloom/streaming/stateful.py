"""Keyed streams with their own state: cooldown and rolling notional to the last row, bars with corrections.

State lives in the RocksDB store and ends by event-time timers.  What still waits for the
watermark at the end of the input is closed by a marker, a row without a key and with a late
time, that ``drain`` appends to the source after everything else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import stage_path

DAY_MS = 86_400_000
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def drain(spark: SparkSession, make: Callable[[], DataFrame], source: str, marker: DataFrame, name: str) -> DataFrame:
    """All that the stream ``make()`` over the files of ``source`` gives, also what waits for a watermark; read back.

    The first run takes the files that are there, the second, from its checkpoint, the marker.
    """
    out, checkpoint = stage_path(spark, f"{name}-out"), stage_path(spark, f"{name}-ckpt")
    with rocksdb(spark):
        for last in (False, True):
            if last:
                marker.coalesce(1).write.mode("append").parquet(source)
            stream = make()
            q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
            q.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _same(value, n: int) -> pd.Series:
    """A column of one value; text stays plain objects."""
    return pd.Series([value] * n, dtype=object if isinstance(value, str) else None)


def _timer(handle: StatefulProcessorHandle, was: int | None, due: int) -> int:
    """A key has one timer, the next one due: each that expires calls the processor, and each call reads the state."""
    if was != due:
        if was is not None:
            handle.deleteTimer(was)
        handle.registerTimer(due)
    return due


class _Cooldown(StatefulProcessor):
    """One value: the last kept day, the days that the watermark has not passed, and the timer."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last int, waiting array<int>, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = set()
        for batch in rows:
            if key[0] is not None:
                new.update(batch["day"].dropna().astype("int64").tolist())
        if new:
            last, waiting, timer = self.state.get() or (None, [], None)
            waiting = sorted({*waiting, *new})
            self.state.update((last, waiting, _timer(self.handle, timer, waiting[0] * DAY_MS + 1)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        last, days, _ = self.state.get() or (None, [], None)
        kept, n = [], 0
        while n < len(days) and days[n] * DAY_MS < mark:
            if last is None or days[n] - last > self.days:
                kept.append(days[n])
                last = days[n]
            n += 1
        days = list(days[n:])
        over = None if last is None else (last + self.days + 1) * DAY_MS + 1
        if days:
            self.state.update((last, days, _timer(self.handle, None, days[0] * DAY_MS + 1)))
        elif over is not None and over > mark:
            self.state.update((last, [], _timer(self.handle, None, over)))
        else:  # the cooldown has passed, so the last kept day says nothing more
            self.state.clear()
        if kept:
            own = {name: _same(k, len(kept)) for name, k in zip(("symbol", "rule_key"), key)}
            yield pd.DataFrame(own | {"day": np.array(kept, np.int32)})

    def close(self) -> None:
        pass


def cooldown(fired: DataFrame, days: int, delay: str = "0 seconds") -> DataFrame:
    """Cooldown over a stream of (symbol, date, rule_key) firings; days are taken in order once the watermark has passed them."""
    d = fired.withColumn("event_time", F.col("date").cast("timestamp")).withWatermark("event_time", delay)
    d = d.select("symbol", "rule_key", "event_time", F.unix_date("date").alias("day"))
    out = d.groupBy("symbol", "rule_key").transformWithStateInPandas(
        _Cooldown(days), "symbol string, rule_key string, day int", "Append", "EventTime"
    )
    return out.select("symbol", "rule_key", F.date_from_unix_date("day").alias("date"))


SLOT_US = 3_600_000_000
KEPT_US = 24 * SLOT_US  # fills of a day are one entry of the state


class _Rolling(StatefulProcessor):
    """A map from day to the day's fills, kept for the span, the time up to which fills are out, and the timer."""

    def __init__(self, days: int):
        self.span = days * DAY_MS * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long", "at array<long>, fill array<long>, x array<double>")
        self.done = handle.getValueState("done", "at long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, known = None, None
        for batch in rows:
            batch = batch.dropna(subset="at").astype({"at": "int64"})
            if key[0] is None or batch.empty:
                continue
            known = self.slots.exists() if known is None else True
            for slot, part in batch.groupby(batch["at"] // KEPT_US):
                old = self.slots.getValue((slot,)) if known and self.slots.containsKey((slot,)) else ([], [], [])
                new = sorted({*zip(*old), *zip(part["at"].tolist(), part["fill_id"].tolist(), part["x"].tolist())})
                self.slots.updateValue((slot,), tuple(map(list, zip(*new))))
            least = int(batch["at"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            at, timer = self.done.get() or (-(1 << 62), None)
            due = (first // SLOT_US + 1) * SLOT_US // 1000
            if timer is None or due < timer:
                self.done.update((at, _timer(self.handle, timer, due)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        done, _ = self.done.get() or (-(1 << 62), None)
        slots = sorted((k[0], v) for k, v in self.slots.iterator())
        at, fill, x = (np.concatenate([np.asarray(v[i], kind) for _, v in slots]) if slots else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, np.float64)))
        until = np.concatenate([[0.0], np.cumsum(x)])  # the notional of the fills before each
        lo, hi = np.searchsorted(at, (done, mark))
        got = np.arange(lo, max(lo, hi))
        volume = until[got] - until[np.searchsorted(at, at[got] - self.span)]
        gone = [slot for slot, _ in slots if (slot + 1) * KEPT_US <= mark - self.span]
        for slot in gone:
            self.slots.removeKey((slot,))
        if len(gone) < len(slots):
            # the next fill to go out, else the time when the last ones have left the span
            due = (int(at[hi]) // SLOT_US + 1) * SLOT_US if hi < len(at) else (slots[-1][0] + 1) * KEPT_US + self.span
            self.done.update((mark, _timer(self.handle, None, due // 1000)))
        else:
            self.done.clear()
        if len(got):
            yield pd.DataFrame({"account": _same(key[0], len(got)), "fill_id": fill[got], "volume_30d": volume})

    def close(self) -> None:
        pass


def rolling_notional(fills: DataFrame, account: str, notional: str, days: int = 30, delay: str = "1 hour") -> DataFrame:
    """(account, fill_id, volume_30d): for each fill the notional of those before it that are at most ``days`` old.

    A fill is out when the watermark has passed its slot.  An account's state are its fills of
    the span, which its own activity bounds.
    """
    f = fills.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    f = f.select(F.col(account).alias("account"), "fill_id", F.unix_micros("event_time").alias("at"), F.col(notional).cast("double").alias("x"), "event_time")
    kind = dict(f.dtypes)["account"]
    return f.groupBy("account").transformWithStateInPandas(_Rolling(days), f"account {kind}, fill_id long, volume_30d double", "Append", "EventTime")


def upsert_bars(ticks: DataFrame, minutes: int, target: str, checkpoint: str, delay: str = "2 hours") -> None:
    """Bars of every slot that a batch touches, open ones too, into ``target``; late ticks within ``delay`` correct theirs.

    Every batch is a folder of its own, so one that is repeated replaces itself.
    """
    t = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    place = F.struct("ts", "event_id")
    d = t.groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", place).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )
    d = d.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    d.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_bars(spark: SparkSession, target: str) -> DataFrame:
    """The newest state of every bar of ``upsert_bars``."""
    d = spark.read.parquet(target)
    rest = F.struct(*[c for c in d.columns if c not in ("symbol", "ts", "batch")])
    return d.groupBy("symbol", "ts").agg(F.max_by(rest, "batch").alias("bar")).select("symbol", "ts", "bar.*")
