"""Sources, time bars, alignment, intraday indicators (S, B, I, J7, J8, J10)."""

from functools import reduce

from pyspark.sql import functions as F

from ..functions.windows import TICKBARS
from ..operators import intraday as it
from ..operators import joins as jn
from ..operators import labels as lb
from ..operators import stats as st
from ..operators import timebars as tb
from ..session import stage_path
from ..sources import readers as rd
from .common import E, Tables, emit
from .registry import add_cte, div, query, roll, win

OHLC = "f:open f:high f:low f:close"
BAR_SPEC = f"symbol d:date {OHLC} f:close_adj volume"
BAR_COLS = [x.rpartition(":")[2] for x in BAR_SPEC.split()]


@query("s1_read_bars_one_symbol", E(BAR_SPEC, "SELECT * FROM bars WHERE symbol = '7'"))
def s1(spark, sf):
    t = Tables(spark, sf)
    from ..sources.tables import bars_from_sales

    # the symbol filter is put on the source column, so the scan can use it
    return emit(bars_from_sales(t.read("lineitem").where(F.col("l_suppkey") == 7)), *BAR_COLS)


@query("s2_peer_groups", "SELECT r_name AS peer_group, n_name AS symbol FROM nation JOIN region ON n_regionkey = r_regionkey")
def s2(spark, sf):
    t = Tables(spark, sf)
    n = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = n.groupBy(F.col("r_name").alias("peer_group")).agg(F.to_json(F.collect_list("n_name")).alias("j"))
    return rd.flatten_groups(lists.select("peer_group", F.from_json("j", "array<string>").alias("symbols")))


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def raw_flags(t):
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.date_format("ts", "yyyy-MM-dd")
    return t.read("events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("symbol"),
        F.when(k % 7 == 0, F.lit("n/a")).when(k % 7 == 1, F.date_format("ts", "yyyy/MM/dd")).otherwise(day).alias("flag_date"),
        F.when(k % 5 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("fired_at"),
        F.when(k % 11 == 0, F.lit("?")).otherwise(F.col("value").cast("string")).alias("pivot_price"),
        F.when(k < 50, "active").when(k < 80, "watch").otherwise("closed").alias("status"),
        k.cast("string").alias("later_column"),
    )


@query(
    "s3_flags_lenient_types",
    E(
        "id symbol d:flag_date has_fired f:pivot_price status later_column",
        f"SELECT event_id AS id, event_type AS symbol, CASE WHEN {_K} % 7 >= 2 THEN CAST(ts AS DATE) END AS flag_date, CASE WHEN {_K} % 5 = 0 THEN 0 ELSE 1 END AS has_fired, "
        f"CASE WHEN {_K} % 11 <> 0 THEN value END AS pivot_price, CASE WHEN {_K} < 50 THEN 'active' WHEN {_K} < 80 THEN 'watch' ELSE 'closed' END AS status, CAST({_K} AS VARCHAR) AS later_column FROM events "
        f"WHERE {_K} < 80 AND CASE WHEN {_K} % 7 = 0 THEN 'n/a' WHEN {_K} % 7 = 1 THEN strftime(ts, '%Y/%m/%d') ELSE strftime(ts, '%Y-%m-%d') END >= '2024-01-10'",
    ),
)
def s3(spark, sf):
    d = rd.typed_flags(raw_flags(Tables(spark, sf)), "2024-01-10T00:00:00Z", "active, watch")
    d = d.withColumn("has_fired", F.col("fired_at").isNotNull().cast("int"))
    return emit(d, "id", "symbol", "flag_date", "has_fired", "pivot_price", "status", "later_column")


@query("s4_bars_range_and_symbols", E(BAR_SPEC, "SELECT * FROM bars WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' AND symbol IN ('1', '2', '3', '5', '8')"))
def s4(spark, sf):
    return emit(rd.select_bars(Tables(spark, sf).bars(), "1998-01-01", "1999-12-31", "1, 2,3, 5,8"), *BAR_COLS)


def hourly(t):
    return tb.bars_from_ticks(t.ticks(), 60)


def ohlcv_sql(minutes, src, vol):
    return (
        f"SELECT symbol, time_bucket(INTERVAL '{minutes} minutes', ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, CAST(sum({vol}) AS BIGINT) AS volume "
        f"FROM {src} GROUP BY 1, 2"
    )


add_cte("h4", ohlcv_sql(240, "hourly", "volume"))
TB_SPEC = f"symbol d:ts {OHLC} i:volume"


@query(
    "s5_intraday_bars",
    E(TB_SPEC, ohlcv_sql(240, "(SELECT * FROM hourly WHERE symbol = 'click' AND ts >= DATE '2024-01-05' AND ts < DATE '2024-01-21')", "volume")),
)
def s5(spark, sf):
    return emit(tb.load_bars({60: hourly(Tables(spark, sf))}, "click", 240, "2024-01-05", "2024-01-20"), "symbol", "ts", "open", "high", "low", "close", "volume")


@query(
    "s6_panel_pivot",
    E("d:date f:s1 f:s2 f:s3", "SELECT date, max(close) FILTER (symbol = '1') AS s1, max(close) FILTER (symbol = '2') AS s2, max(close) FILTER (symbol = '3') AS s3 FROM bars WHERE symbol IN ('1', '2', '3') GROUP BY date"),
)
def s6(spark, sf):
    d = rd.panel(Tables(spark, sf).bars(), ["1", "2", "3"])
    return emit(d.select("date", *[F.col(c).alias(f"s{c}") for c in ("1", "2", "3")]))


@query("s7_merge_archives", E(f"symbol i:interval_min d:ts {OHLC} i:volume", "SELECT *, 60 AS interval_min FROM hourly"))
def s7(spark, sf):
    h = hourly(Tables(spark, sf)).withColumn("interval_min", F.lit(60).cast("long"))
    day = F.dayofmonth("ts")
    parts = [h.where(day <= 12), h.where((day >= 10) & (day <= 22)), h.where(day >= 20)]
    return emit(rd.merge_archives(parts), "symbol", "interval_min", "ts", "open", "high", "low", "close", "volume")


@query("s8_concat_batches", E(f"symbol d:ts f:close source", "SELECT symbol, ts, close, 'hourly' AS source FROM hourly UNION ALL SELECT symbol, ts, close, 'h4' FROM h4"))
def s8(spark, sf):
    h = hourly(Tables(spark, sf))
    a = h.withColumn("source", F.lit("hourly"))
    b = tb.resample(h, 240).withColumn("source", F.lit("h4"))
    return emit(a.unionByName(b), "symbol", "ts", "close", "source")


@query(
    "s9_snapshot_cursor",
    "SELECT CAST((SELECT max(date) FROM bars) AS VARCHAR) AS max_date, (SELECT count(*) FROM bars) AS row_count, (SELECT count(DISTINCT symbol) FROM bars) AS symbol_count, "
    "(SELECT max(event_id) FROM events) AS max_id, (SELECT count(*) FROM events) AS flag_rows, (SELECT count(DISTINCT peer_group) FROM peers) AS group_count, (SELECT count(*) FROM peers) AS entry_count",
)
def s9(spark, sf):
    t = Tables(spark, sf)
    return emit(rd.snapshot_cursor(t.bars(), t.read("events").withColumnRenamed("event_id", "id"), t.peers()))


@query(
    "s10_groups_hash",
    "SELECT 'sha256:' || sha256('{' || string_agg(entry, ', ' ORDER BY r_name) || '}') AS hash FROM (SELECT r_name, '\"' || r_name || '\": [' || string_agg('\"' || n_name || '\"', ', ' ORDER BY n_name) || ']' AS entry FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)",
)
def s10(spark, sf):
    t = Tables(spark, sf)
    n = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rd.groups_hash(n.select(F.col("r_name").alias("peer_group"), F.col("n_name").alias("symbol")))


@query(
    "s11_symbol_status",
    "SELECT symbol, CAST(last_seen AS VARCHAR) AS last_seen, sector, CASE WHEN datediff('day', last_seen, (SELECT max(date) FROM bars)) <= 7 THEN 'active' ELSE 'delisted' END AS status FROM (SELECT symbol, max(date) AS last_seen FROM bars GROUP BY 1) LEFT JOIN peers USING (symbol)",
)
def s11(spark, sf):
    t = Tables(spark, sf)
    return emit(rd.symbol_status(t.bars(), t.peers().select("symbol", "sector")), "symbol", "last_seen", "sector", "status")


@query("s12_parquet_sink", E(BAR_SPEC, "SELECT * FROM bars"))
def s12(spark, sf):
    path = stage_path(spark, "bars")
    rd.write_parquet(Tables(spark, sf).bars().withColumn("year", F.year("date")), path, ["year"], ["symbol", "date"])
    # the partition column is read as a number; symbols stay text
    return emit(spark.read.parquet(path), *BAR_COLS)


@query("s13_ndjson_sink", E(BAR_SPEC, "SELECT * FROM bars"))
def s13(spark, sf):
    from ..schema import BARS

    path = stage_path(spark, "bars-json")
    rd.write_ndjson(Tables(spark, sf).bars(), path)
    return emit(spark.read.schema(BARS).json(path), *BAR_COLS)


@query(
    "s14_universe_snapshot",
    E(
        "symbol d:first_seen_date d:last_seen_date f:mean_avg_dollar_volume_30d f:mean_close_adj n_qualifying_days",
        "SELECT symbol, min(date) AS first_seen_date, max(date) AS last_seen_date, avg(avg_dollar_volume_30d) AS mean_avg_dollar_volume_30d, avg(close_adj) AS mean_close_adj, count(date) AS n_qualifying_days "
        "FROM momentum WHERE close_adj >= 10 AND avg_dollar_volume_30d >= 900000 GROUP BY symbol",
    ),
)
def s14(spark, sf):
    from .q_labels import MOM

    return emit(rd.universe_snapshot(lb.equity_momentum(Tables(spark, sf).bars(), MOM), 10.0, 900_000.0))


# --- time bars ---------------------------------------------------------------------------


@query("b1_bars_from_ticks", E(TB_SPEC, "SELECT * FROM hourly"))
def b1(spark, sf):
    return emit(hourly(Tables(spark, sf)), "symbol", "ts", "open", "high", "low", "close", "volume")


@query("b1_resample", E(TB_SPEC, "SELECT * FROM h4"))
def b1b(spark, sf):
    return emit(tb.resample(hourly(Tables(spark, sf)), 240), "symbol", "ts", "open", "high", "low", "close", "volume")


_ASOF = "SELECT h.symbol, h.ts, h.close, c.close AS slow_close FROM hourly h ASOF LEFT JOIN h4 c ON h.symbol = c.symbol AND h.ts >= c.ts"


@query("b2_asof_align", E("symbol d:ts f:close f:slow_close", _ASOF))
def b2(spark, sf):
    h = hourly(Tables(spark, sf))
    slow = tb.resample(h, 240).withColumnRenamed("close", "slow_close")
    return emit(jn.asof_backward(h.select("symbol", "ts", "close"), slow, ["symbol"], "ts", "ts", ["slow_close"]), "symbol", "ts", "close", "slow_close")


@query(
    "j7_asof_ticks_to_bars",
    E(
        "event_id symbol f:price f:prior_close",
        "SELECT t.event_id, t.symbol, t.price, c.close AS prior_close FROM ticks t ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 60 MINUTE AS ready, close FROM hourly) c ON t.symbol = c.symbol AND t.ts >= c.ready",
    ),
)
def j7(spark, sf):
    """Each tick with the last finished bar: ticks look up their hour, so no symbol is stacked whole."""
    t = Tables(spark, sf)
    ticks = t.ticks().withColumn("slot", F.window("ts", "60 minutes")["start"])
    slots = ticks.select("symbol", "slot").distinct()
    done = hourly(t).select("symbol", F.expr("ts + INTERVAL 60 MINUTES").alias("ready"), F.col("close").alias("prior_close"))
    last = jn.asof_backward(slots.withColumn("x", F.lit(1)), done, ["symbol"], "slot", "ready", ["prior_close"])
    return emit(ticks.join(last, ["symbol", "slot"]), "event_id", "symbol", "price", "prior_close")


add_cte("daily_last", "SELECT symbol, CAST(ts AS DATE) AS date, arg_max(close, ts) AS close FROM hourly GROUP BY 1, 2")


@query("b3_daily_last_close", E("symbol d:date f:close", "SELECT * FROM daily_last"))
def b3(spark, sf):
    return emit(tb.daily_last(hourly(Tables(spark, sf))), "symbol", "date", "close")


add_cte("daily_dv", "SELECT symbol, CAST(ts AS DATE) AS day, sum(close * volume) AS dv FROM hourly GROUP BY 1, 2")


@query("b4_daily_dollar_volume", E("symbol d:day f:dv", "SELECT * FROM daily_dv"))
def b4(spark, sf):
    return emit(tb.daily_dollar_volume(hourly(Tables(spark, sf))), "symbol", "day", "dv")


add_cte("big_days", "SELECT CAST(ts AS DATE) AS day, sum(close) AS pnl FROM hourly WHERE close > 0 GROUP BY 1")
add_cte(
    "dense_big",
    "SELECT day, coalesce(pnl, 0) AS pnl FROM (SELECT CAST(unnest(generate_series((SELECT min(day) FROM big_days), (SELECT max(day) FROM big_days), INTERVAL 1 DAY)) AS DATE) AS day) LEFT JOIN big_days USING (day)",
)


def dense_big(t):
    h = hourly(t).where("close > 0")
    return st.dense_days(h.groupBy(F.to_date("ts").alias("day")).agg(F.sum("close").alias("pnl")), "day", "pnl")


@query("b5_dense_calendar", E("d:day f:pnl", "SELECT * FROM dense_big"))
def b5(spark, sf):
    return emit(dense_big(Tables(spark, sf)), "day", "pnl")


@query(
    "b6_calendar_rolling_sum",
    E("d:day f:roll7", "SELECT *, sum(pnl) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS roll7 FROM dense_big"),
)
def b6(spark, sf):
    return emit(st.calendar_sum(dense_big(Tables(spark, sf)), "day", "pnl", 7, "roll7"), "day", "roll7")


HW = "PARTITION BY symbol ORDER BY ts"


@query(
    "b7_daily_log_return",
    E("symbol d:day f:r", f"SELECT symbol, CAST(ts AS DATE) AS day, sum(ln(close / p)) AS r FROM (SELECT *, lag(close) OVER ({HW}) AS p FROM hourly WHERE close > 0) WHERE p IS NOT NULL GROUP BY 1, 2"),
)
def b7(spark, sf):
    return emit(tb.daily_log_return(hourly(Tables(spark, sf)).where("close > 0"), TICKBARS))


_W60 = win("59 PRECEDING")


@query(
    "b8_sliding_windows",
    E(
        "symbol d:date n_rows f:first_close f:last_volume f:sum_close",
        f"SELECT symbol, date, 60 AS n_rows, CAST(first_value(CAST(close AS FLOAT)) OVER {_W60} AS DOUBLE) AS first_close, CAST(volume AS DOUBLE) AS last_volume, sum(CAST(CAST(close AS FLOAT) AS DOUBLE)) OVER {_W60} AS sum_close FROM bars JOIN winners USING (symbol, date) "
        f"QUALIFY count(*) OVER {_W60} = 60 AND is_winner IS NOT NULL",
    ),
)
def b8(spark, sf):
    d = lb.forward_winner(Tables(spark, sf).bars(), 30, 2.0, "close_adj")
    d = tb.sliding_windows(d, "is_winner")
    w = F.col("window")
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x["close"].cast("double"))
    d = d.select(
        "symbol",
        "date",
        F.size(w).alias("n_rows"),
        w[0]["close"].cast("double").alias("first_close"),
        w[59]["volume"].cast("double").alias("last_volume"),
        total.alias("sum_close"),
    )
    return emit(d)


ZC = ("high", "low", "close", "volume")


@query(
    "b9_window_znorm",
    E(
        "symbol d:date " + " ".join(f"f:z_{c}" for c in ZC),
        "SELECT symbol, date, " + ", ".join(f"CASE WHEN count({c}) OVER {_W60} = 60 THEN ({c} - avg({c}) OVER {_W60}) / (stddev_pop({c}) OVER {_W60} + 1e-6) END AS z_{c}" for c in ZC) + " FROM bars",
    ),
)
def b9(spark, sf):
    return emit(tb.window_znorm(Tables(spark, sf).bars(), channels=ZC), "symbol", "date", *[f"z_{c}" for c in ZC])


@query("b10_window_endpoints", "SELECT symbol, CAST(date AS VARCHAR) AS date FROM bars JOIN winners USING (symbol, date) " f"QUALIFY count(*) OVER {_W60} = 60 AND is_winner IS NOT NULL AND date > DATE '1999-12-31' AND date <= DATE '2000-12-31'")
def b10(spark, sf):
    d = lb.forward_winner(Tables(spark, sf).bars(), 30, 2.0, "close_adj")
    d = tb.sliding_windows(d, "is_winner", channels=("close",)).drop("window")
    return emit(tb.in_interval(d, "1999-12-31", "2000-12-31"), "symbol", "date")


# --- indicators --------------------------------------------------------------------------

add_cte(
    "hn",
    f"SELECT *, row_number() OVER ({HW}) AS i, greatest(high - low, abs(high - lag(close) OVER ({HW})), abs(low - lag(close) OVER ({HW}))) AS tr FROM hourly",
)


def ema_rec(src, x, span, name="y"):
    a = 2.0 / (span + 1)
    return (
        f"(WITH RECURSIVE e AS (SELECT symbol, ts, i, {x} AS {name} FROM {src} WHERE i = 1 UNION ALL "
        f"SELECT b.symbol, b.ts, b.i, e.{name} + {a} * (b.{x} - e.{name}) FROM e JOIN {src} b ON b.symbol = e.symbol AND b.i = e.i + 1) SELECT * FROM e)"
    )


@query("i1_ema", E("symbol d:ts f:ema", f"SELECT * FROM {ema_rec('hn', 'close', 75, 'ema')} q"))
def i1(spark, sf):
    return emit(it.ema_close(hourly(Tables(spark, sf)), 75), "symbol", "ts", "ema")


@query("i2_atr", E("symbol d:ts f:atr", f"SELECT * FROM {ema_rec('hn', 'tr', 14, 'atr')} q"))
def i2(spark, sf):
    return emit(it.atr(hourly(Tables(spark, sf)), 14), "symbol", "ts", "atr")


def st_rec(src, ema_len, atr_len, mult):
    a, b = 2.0 / (ema_len + 1), 2.0 / (atr_len + 1)
    ma, at = f"(s.ma + {a} * (b.close - s.ma))", f"(s.atr + {b} * (b.tr - s.atr))"
    u, d = f"({ma} - {mult} * {at})", f"({ma} + {mult} * {at})"
    return f"""(WITH RECURSIVE s AS (
      SELECT symbol, ts, i, close, close AS ma, tr AS atr, close - {mult} * tr AS up, close + {mult} * tr AS dn, 1 AS trend FROM {src} WHERE i = 1
      UNION ALL
      SELECT b.symbol, b.ts, b.i, b.close, {ma}, {at}, CASE WHEN s.close > s.up THEN greatest({u}, s.up) ELSE {u} END,
             CASE WHEN s.close < s.dn THEN least({d}, s.dn) ELSE {d} END,
             CASE WHEN s.trend = -1 AND b.close > s.dn THEN 1 WHEN s.trend = 1 AND b.close < s.up THEN -1 ELSE s.trend END
      FROM s JOIN {src} b ON b.symbol = s.symbol AND b.i = s.i + 1) SELECT * FROM s)"""


@query("i3_supertrend", E("symbol d:ts f:ma f:atr f:up f:dn trend", f"SELECT * FROM {st_rec('hn', 75, 14, 0.5)} q"))
def i3(spark, sf):
    return emit(it.supertrend(hourly(Tables(spark, sf)), 75, 14, 0.5), "symbol", "ts", "ma", "atr", "up", "dn", "trend")


def troll(agg, x, n):
    return roll(agg, x, n, order="ts")


add_cte("smi0", f"SELECT *, close - ({troll('min', 'close', 14)} + {troll('max', 'close', 14)}) / 2 AS m, {troll('max', 'close', 14)} - {troll('min', 'close', 14)} AS s FROM hn")
add_cte("smi1", f"SELECT *, 100 * {div(troll('avg', 'm', 3), troll('avg', 's', 3))} AS smi FROM smi0")
add_cte("smi2", "SELECT *, coalesce(smi, 0) AS f FROM smi1")


@query(
    "i4_momentum_cross",
    E(
        "symbol d:ts f:smi f:smi_mean b:smi_buy",
        f"SELECT symbol, ts, smi, smi_mean, coalesce(smi > smi_mean AND lag(smi) OVER ({HW}) <= lag(smi_mean) OVER ({HW}) AND smi_mean < 0, false) AS smi_buy FROM smi2 JOIN {ema_rec('smi2', 'f', 2, 'smi_mean')} q USING (symbol, ts)",
    ),
)
def i4(spark, sf):
    return emit(it.smi_cross(hourly(Tables(spark, sf))), "symbol", "ts", "smi", "smi_mean", "smi_buy")


add_cte("atrp", f"SELECT q.symbol, q.ts, atr / nullif(close, 0) * 100 AS atr_pct FROM {ema_rec('hn', 'tr', 9, 'atr')} q JOIN hourly USING (symbol, ts)")


@query("i5_hourly_atr_pct", E("symbol d:ts f:atr_pct", "SELECT * FROM atrp"))
def i5(spark, sf):
    return emit(it.atr_pct(hourly(Tables(spark, sf))), "symbol", "ts", "atr_pct")


def _frames(minutes, slow):
    """Bars of a version and its slow bars, numbered and with their true range."""
    bucket = "time_bucket(INTERVAL '{} minutes', ts, TIMESTAMP '1970-01-01')"
    base = (
        f"SELECT symbol, {bucket.format(minutes)} AS ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, "
        "last(price ORDER BY ts, event_id) AS close FROM ticks GROUP BY 1, 2"
    )
    over = (
        f"SELECT symbol, {bucket.format(slow)} AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close "
        f"FROM v{minutes} GROUP BY 1, 2"
    )
    numbered = f"SELECT *, row_number() OVER ({HW}) AS i, greatest(high - low, abs(high - lag(close) OVER ({HW})), abs(low - lag(close) OVER ({HW}))) AS tr FROM "
    add_cte(f"v{minutes}", base)
    add_cte(f"v{minutes}s", over)
    add_cte(f"v{minutes}n", numbered + f"v{minutes}")
    add_cte(f"v{minutes}sn", numbered + f"v{minutes}s")
    lo, hi = troll("min", "close", 14), troll("max", "close", 14)
    add_cte(f"v{minutes}m0", f"SELECT *, close - ({lo} + {hi}) / 2 AS m, {hi} - {lo} AS s FROM v{minutes}n")
    add_cte(f"v{minutes}m1", f"SELECT *, 100 * {div(troll('avg', 'm', 3), troll('avg', 's', 3))} AS smi FROM v{minutes}m0")
    add_cte(f"v{minutes}m2", f"SELECT *, coalesce(smi, 0) AS f FROM v{minutes}m1")


def _version_sql(version):
    c = it.VERSIONS[version]
    n = c["tf"]
    _frames(n, n * c["slow_mult"])
    gate = f"atr_pct >= {c['atr_min']}" if version != 1 else f"atr_pct > {c['atr_min']}"
    gate += f" AND atr_pct < {c['atr_max']}" if c["atr_max"] is not None else ""
    trigger = f"trend = 1 AND lag(trend) OVER ({HW}) = -1" if c["fresh"] else f"smi > smi_mean AND lag(smi) OVER ({HW}) <= lag(smi_mean) OVER ({HW}) AND smi_mean < 0"
    smi = f" JOIN v{n}m2 m ON m.symbol = a.symbol AND m.ts = a.ts JOIN {ema_rec(f'v{n}m2', 'f', 2, 'smi_mean')} e ON e.symbol = a.symbol AND e.ts = a.ts" if c["smi"] else ""
    more = ", m.smi, e.smi_mean" if c["smi"] else ""
    return (
        f"SELECT '{version}' AS version, symbol, ts, close, coalesce(slow = 1 AND {gate} AND ({trigger}) AND conf = 1, false) AS entry FROM ("
        f"SELECT a.symbol, a.ts, a.close, a.trend, b.trend AS conf, c.trend AS slow, d.atr_pct{more} FROM {st_rec(f'v{n}n', *it.INNER)} a "
        f"JOIN {st_rec(f'v{n}n', *it.CONFIRM)} b ON a.symbol = b.symbol AND a.ts = b.ts{smi} "
        f"ASOF LEFT JOIN {st_rec(f'v{n}sn', c['slow_ema'], it.INNER[1], it.INNER[2])} c ON a.symbol = c.symbol AND a.ts >= c.ts "
        "ASOF LEFT JOIN atrp d ON a.symbol = d.symbol AND a.ts >= d.ts)"
    )


@query("i6_entry_signals", E("version symbol d:ts f:close b:entry", " UNION ALL ".join(_version_sql(v) for v in it.VERSIONS)))
def i6(spark, sf):
    """Entry signals of all six configurations."""
    t = Tables(spark, sf)
    hours = hourly(t)
    parts = []
    for v, c in it.VERSIONS.items():
        d = it.entry_signals(tb.bars_from_ticks(t.ticks(), c["tf"]), v, hours)
        parts.append(d.select(F.lit(str(v)).alias("version"), "symbol", "ts", "close", "entry"))
    return emit(reduce(lambda a, b: a.unionByName(b), parts))


@query(
    "i7_order_ladder",
    E(
        "symbol i:order_no f:drop_pct f:order_price f:volume_usd",
        "SELECT symbol, k AS order_no, 0.01 * (pow(1.3, k) - 1) / (1.3 - 1.0) AS drop_pct, close * (1 - 0.01 * (pow(1.3, k) - 1) / (1.3 - 1.0)) AS order_price, 100.0 * pow(1.5, k) AS volume_usd FROM (SELECT symbol, arg_max(close, date) AS close FROM bars GROUP BY 1), (SELECT unnest(range(7)) AS k)",
    ),
)
def i7(spark, sf):
    last = Tables(spark, sf).bars().groupBy("symbol").agg(F.max_by("close", "date").alias("close"))
    d = it.order_ladder(last, "close", 100.0, 6, 0.01, 1.3, 1.5).withColumn("order_no", F.col("order_no").cast("long"))
    return emit(d, "symbol", "order_no", "drop_pct", "order_price", "volume_usd")


add_cte(
    "rolling_fills",
    "SELECT event_id, user_id, value * 10 AS notional, coalesce(sum(value * 10) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW), 0) AS volume_30d FROM events",
)


def _tier_sql(i):
    return "CASE " + " ".join(f"WHEN volume_30d >= {t[0]} THEN {t[i]}" for t in reversed(it.FEE_TIERS)) + f" ELSE {it.FEE_TIERS[0][i]} END"


def fills(t):
    e = t.read("events").select(F.col("event_id").alias("fill_id"), "user_id", "ts", (F.col("value") * 10).alias("notional"))
    v = it.rolling_notional(e, "user_id", "notional")
    return e.join(v, ["user_id", "fill_id"])


@query(
    "i8_rolling_volume_fees",
    E(
        "event_id f:volume_30d f:maker_rate f:taker_rate f:maker_cost f:taker_cost",
        f"SELECT *, notional * maker_rate AS maker_cost, notional * (taker_rate + 0.0008 + 0.001) AS taker_cost FROM (SELECT *, {_tier_sql(1)} AS maker_rate, {_tier_sql(2)} AS taker_rate FROM rolling_fills)",
    ),
)
def i8(spark, sf):
    d = it.fill_costs(fills(Tables(spark, sf)), "notional", "volume_30d").withColumnRenamed("fill_id", "event_id")
    return emit(d, "event_id", "volume_30d", "maker_rate", "taker_rate", "maker_cost", "taker_cost")


@query("j10_tier_join", f"SELECT taker, count(*) AS n FROM (SELECT round(CAST({_tier_sql(2)} AS DOUBLE), 6) AS taker FROM rolling_fills) GROUP BY 1")
def j10(spark, sf):
    d = fills(Tables(spark, sf)).withColumn("taker", F.round(jn.tier_lookup("volume_30d", it.FEE_TIERS, 2), 6))
    return d.groupBy("taker").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j8_next_bar_after",
    E(
        "order_id symbol d:day d:next_date f:open",
        "SELECT o_orderkey AS order_id, o.symbol, day, n.date AS next_date, n.open FROM (SELECT o_orderkey, CAST(o_custkey % 97 + 1 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) AS day FROM orders) o ASOF LEFT JOIN bars n ON o.symbol = n.symbol AND o.day < n.date",
    ),
)
def j8(spark, sf):
    t = Tables(spark, sf)
    o = t.read("orders").select(
        F.col("o_orderkey").alias("order_id"),
        (F.col("o_custkey") % 97 + 1).cast("string").alias("symbol"),
        F.to_date("o_orderdate").alias("day"),
    )
    # days are looked up once per (symbol, day), however many orders share one
    days = o.select("symbol", "day").distinct()
    nxt = jn.next_row_after(days, t.bars(), ["symbol"], "day", "date", ["open"])
    return emit(o.join(nxt, ["symbol", "day"]), "order_id", "symbol", "day", "next_date", "open")


