"""Trailing features per symbol.

Each function appends columns.  They all use the same partitioning and ordering, so a
chain of them costs one exchange and one sort; only the cross-section features
(peer groups, sector ranks) shuffle again, by date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import DAILY, emas, finite, full, ratio, true_range, with_extremes, with_means


def sma_distance(df, windows=(10, 20, 50, 200)):
    df = with_means(df, {f"_sma{n}": ("close", n) for n in windows})
    df = df.withColumns({f"close_over_sma_{n}": ratio("close", f"_sma{n}") for n in windows})
    return df.drop(*[f"_sma{n}" for n in windows])


def sma_slope(df, window=50, lookback=5):
    df = with_means(df, {"_sma": ("close", window)})
    prev = DAILY.lag("_sma", lookback)
    return df.withColumn(f"sma{window}_slope_{lookback}d", ratio(F.col("_sma") - prev, prev)).drop("_sma")


def band_position(df, window=20):
    mean = DAILY.roll(F.avg, "close", window)
    std = DAILY.roll(F.stddev_samp, "close", window)
    return df.withColumn(
        f"bb_position_{window}", F.when(std > 0, ratio(F.col("close") - mean, 2 * std))
    )


def n_day_high_low(df, windows=(20, 60, 252)):
    wanted = {f"_hi{n}": (F.max, "high", n) for n in windows} | {f"_lo{n}": (F.min, "low", n) for n in windows}
    df = with_extremes(df, wanted)
    cols = {f"pct_of_{n}d_high": ratio("close", f"_hi{n}") for n in windows}
    cols |= {f"pct_of_{n}d_low": ratio("close", f"_lo{n}") for n in windows}
    return df.withColumns(cols).drop(*wanted)


def vol_mult(df, windows=(5, 10, 30, 60)):
    v = F.col("volume").cast("double")
    df = with_means(df, {f"_vm{n}": ("volume", n) for n in windows})
    df = df.withColumns({f"vol_mult_{n}": F.when(F.col(f"_vm{n}") > 0, ratio(v, f"_vm{n}")) for n in windows})
    return df.drop(*[f"_vm{n}" for n in windows])


def obv_slope(df, lookback=20):
    v = F.col("volume").cast("double")
    step = F.col("close") - DAILY.lag("close")
    df = df.withColumn("_sv", F.coalesce(F.signum(step), F.lit(0.0)) * v)
    df = df.withColumn("_obv", F.sum(finite("_sv")).over(DAILY.running()))
    df = with_means(df, {"_vm": ("volume", lookback)})
    change = F.col("_obv") - DAILY.lag("_obv", lookback)
    return df.withColumn(f"obv_slope_{lookback}d", ratio(change, F.col("_vm") * lookback)).drop("_sv", "_obv", "_vm")


def accumulation_distribution(df):
    span = F.col("high") - F.col("low")
    mfm = F.when(span > 0, ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / span).otherwise(0.0)
    return df.withColumn("ad_line", F.sum(finite(mfm * F.col("volume").cast("double"))).over(DAILY.running()))


def atr_pct(df, window=14):
    df = with_means(df.withColumn("_tr", true_range()), {"_atr": ("_tr", window)})
    return df.withColumn(f"atr_pct_{window}", ratio("_atr", "close")).drop("_tr", "_atr")


def bb_squeeze(df, window=20):
    return df.withColumn(
        f"bb_squeeze_{window}",
        ratio(4.0 * DAILY.roll(F.stddev_samp, "close", window), DAILY.roll(F.avg, "close", window)),
    )


def nr4_nr7(df):
    df = df.withColumn("_tr", true_range())
    return df.withColumns(
        {
            "is_nr4": F.col("_tr") == DAILY.roll(F.min, "_tr", 4),
            "is_nr7": F.col("_tr") == DAILY.roll(F.min, "_tr", 7),
        }
    ).drop("_tr")


def hv_ratio(df, short_window=10, long_window=60):
    df = df.withColumn("_lr", F.ln(ratio("close", DAILY.lag("close"))))
    return df.withColumn(
        f"hv_ratio_{short_window}_{long_window}",
        ratio(
            DAILY.roll(F.stddev_samp, "_lr", short_window),
            DAILY.roll(F.stddev_samp, "_lr", long_window),
        ),
    ).drop("_lr")


def rsi(df, windows=(2, 5, 14)):
    step = F.col("close") - DAILY.lag("close")
    df = df.withColumn("_d", F.coalesce(step, F.lit(0.0)))
    df = df.withColumns({"_g": F.greatest(F.col("_d"), F.lit(0.0)), "_l": F.greatest(-F.col("_d"), F.lit(0.0))})
    # short windows are summed directly, so that a tiny mean loss keeps all its digits
    cols = {}
    for n in windows:
        ag, al = DAILY.roll(F.avg, "_g", n), DAILY.roll(F.avg, "_l", n)
        cols[f"rsi_{n}"] = F.when(al == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + ratio(ag, al)))
    return df.withColumns(cols).drop("_d", "_g", "_l")


def macd(df, fast=12, slow=26, signal=9):
    df = emas(df, {"_ef": ("close", fast), "_es": ("close", slow)}, warmup=True)
    df = df.withColumn("macd_line", F.col("_ef") - F.col("_es")).drop("_ef", "_es")
    df = emas(df, {"macd_signal": ("macd_line", signal)}, warmup=True)
    return df.withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal"))


def roc(df, windows=(5, 10, 20, 60)):
    return df.withColumns({f"roc_{n}": ratio("close", DAILY.lag("close", n)) - 1.0 for n in windows})


def consecutive_run(df):
    """Run lengths: rows since the last row that broke the run."""
    step = F.coalesce(F.col("close") - DAILY.lag("close"), F.lit(0.0))
    df = df.withColumn("_i", F.row_number().over(DAILY.w)).withColumn("_d", step)
    last_not_up = F.last(F.when(F.col("_d") <= 0, F.col("_i")), True).over(DAILY.running())
    last_not_down = F.last(F.when(F.col("_d") >= 0, F.col("_i")), True).over(DAILY.running())
    return df.withColumns(
        {
            "consec_up": (F.col("_i") - last_not_up).cast("long"),
            "consec_down": (F.col("_i") - last_not_down).cast("long"),
        }
    ).drop("_i", "_d")


def gap_pct(df):
    prev = DAILY.lag("close")
    return df.withColumn("gap_pct", ratio(F.col("open") - prev, prev))


def range_expansion(df, lookback=5):
    df = df.withColumn("_tr", true_range())
    return df.withColumn(
        f"range_expansion_{lookback}d", ratio("_tr", DAILY.roll_prior(F.avg, "_tr", lookback))
    ).drop("_tr")


def body_range_ratio(df):
    span = F.col("high") - F.col("low")
    return df.withColumn("body_range_ratio", F.when(span > 0, F.abs(F.col("close") - F.col("open")) / span))


def inside_bar(df):
    return df.withColumn(
        "is_inside_bar",
        (F.col("high") < DAILY.lag("high")) & (F.col("low") > DAILY.lag("low")),
    )


def rel_strength_spy(df, benchmark, lookback=20):
    """Return over the benchmark's return; the benchmark has one row per day."""
    from pyspark.sql import Window

    w = Window.orderBy("date")
    b = benchmark.select("date", (ratio("close", F.lag("close", lookback).over(w)) - 1.0).alias("_b"))
    df = df.withColumn("_s", ratio("close", DAILY.lag("close", lookback)) - 1.0).join(F.broadcast(b), "date", "left")
    return df.withColumn(f"rs_spy_{lookback}d", ratio("_s", "_b")).drop("_s", "_b")


def _with_group(df, groups):
    return df.join(groups.select("symbol", F.col("peer_group").alias("_g")), "symbol", "left")


def rel_strength_sector(df, groups, lookback=20):
    """Return over the mean return of the peer group that day.

    The group mean is a map-side combined aggregate of (date, group), joined back, so a
    group that holds most symbols never gathers in one task.
    """
    df = _with_group(df.withColumn("_s", ratio("close", DAILY.lag("close", lookback)) - 1.0), groups)
    mean = df.where(F.col("_g").isNotNull()).groupBy("date", "_g").agg(F.avg("_s").alias("_m"))
    df = df.join(F.broadcast(mean), ["date", "_g"], "left")
    return df.withColumn(f"rs_sector_{lookback}d", ratio("_s", "_m")).drop("_s", "_m", "_g")


def peer_zscore(df, groups, column):
    df = _with_group(df, groups)
    stats = (
        df.where(F.col("_g").isNotNull())
        .groupBy("date", "_g")
        .agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_sd"), F.count(F.lit(1)).alias("_n"))
    )
    df = df.join(F.broadcast(stats), ["date", "_g"], "left")
    z = F.when((F.col("_sd") > 0) & (F.col("_n") >= 2), (F.col(column) - F.col("_m")) / F.col("_sd"))
    return df.withColumn(f"{column}_peer_z", z).drop("_m", "_sd", "_n", "_g")


def days_since_last_20pct(df, lookahead=30, threshold=0.20):
    low = DAILY.roll_prior(F.min, "close", lookahead)
    df = df.withColumn("_hit", F.coalesce(ratio("close", low) >= 1.0 + threshold, F.lit(False)))
    df = df.withColumn("_i", F.row_number().over(DAILY.w))
    event = F.col("_hit") & ~F.coalesce(DAILY.lag("_hit"), F.lit(False))
    df = df.withColumn("_e", F.when(event, F.col("_i")))
    return df.withColumn(
        "days_since_last_20pct", (F.col("_i") - F.last("_e", True).over(DAILY.running())).cast("long")
    ).drop("_hit", "_i", "_e")


def market_regime(benchmark):
    """uptrend / downtrend / chop from two moving averages; one row per day."""
    from pyspark.sql import Window

    w = Window.orderBy("date")
    s50 = full(F.avg, "close", w.rowsBetween(-49, 0), 50)
    s200 = full(F.avg, "close", w.rowsBetween(-199, 0), 200)
    m = benchmark.select("date", "close", s50.alias("_a"), s200.alias("_b"))
    return m.select("date", _regime("close", "_a", "_b").alias("market_regime"))


def build_features(bars: DataFrame, benchmark: DataFrame, groups: DataFrame) -> DataFrame:
    """Every trailing feature in one pass over the bars.

    The same definitions as the single functions, laid out in three steps of windows over
    one sort: everything that reads the bars, then what reads those, then what reads that.
    """
    s, c = DAILY, F.col
    zero = F.lit(0.0)
    sma, vols = (10, 20, 50, 200), (5, 10, 20, 30, 60)
    spans = (20, 60, 252)
    vol = c("volume").cast("double")
    first = {
        "_pc": s.lag("close"),
        "_ph": s.lag("high"),
        "_pl": s.lag("low"),
        "_i": F.row_number().over(s.w),
        "_cc": F.sum(finite("close")).over(s.running()),
        "_nc": F.count(finite("close")).over(s.running()),
        "_cv": F.sum(vol).over(s.running()),
        "_sd": s.roll(F.stddev_samp, "close", 20),
        "_low30": s.roll_prior(F.min, "close", 30),
        **{f"roc_{n}": ratio("close", s.lag("close", n)) - 1.0 for n in (5, 10, 20, 60)},
    }
    # the averages sort once more by block, so they run first, while rows are narrow
    out = n_day_high_low(macd(bars).withColumns(first), spans)
    step = F.coalesce(c("close") - c("_pc"), zero)
    span = c("high") - c("low")
    flow = F.when(span > 0, ((c("close") - c("low")) - (c("high") - c("close"))) / span).otherwise(0.0)
    out = out.withColumns(
        {
            "_tr": F.greatest(span, F.abs(c("high") - c("_pc")), F.abs(c("low") - c("_pc"))),
            "_g": F.greatest(step, zero),
            "_l": F.greatest(-step, zero),
            "_sv": F.signum(step) * vol,
            "_mf": flow * vol,
            "_lr": F.ln(ratio("close", "_pc")),
            "_hit": F.coalesce(ratio("close", "_low30") >= 1.2, F.lit(False)),
            "_up": F.when(step <= 0, c("_i")),
            "_dn": F.when(step >= 0, c("_i")),
        }
    )

    def mean(cum, n, count="_i"):
        have = c(count) - F.coalesce(s.lag(count, n), F.lit(0))
        return F.when(have == n, (c(cum) - F.coalesce(s.lag(cum, n), zero)) / n)

    out = out.withColumns(
        {
            **{f"_s{n}": mean("_cc", n, "_nc") for n in sma},
            **{f"_v{n}": mean("_cv", n) for n in vols},
            "_ct": F.sum(finite("_tr")).over(s.running()),
            "_nt": F.count(finite("_tr")).over(s.running()),
            "_obv": F.sum(finite("_sv")).over(s.running()),
            "ad_line": F.sum(finite("_mf")).over(s.running()),
            "is_nr4": c("_tr") == s.roll(F.min, "_tr", 4),
            "is_nr7": c("_tr") == s.roll(F.min, "_tr", 7),
            "hv_ratio_10_60": ratio(s.roll(F.stddev_samp, "_lr", 10), s.roll(F.stddev_samp, "_lr", 60)),
            "consec_up": (c("_i") - F.last("_up", True).over(s.running())).cast("long"),
            "consec_down": (c("_i") - F.last("_dn", True).over(s.running())).cast("long"),
            "_ev": F.when(c("_hit") & ~F.coalesce(s.lag("_hit"), F.lit(False)), c("_i")),
            **{f"_ag{n}": s.roll(F.avg, "_g", n) for n in (2, 5, 14)},
            **{f"_al{n}": s.roll(F.avg, "_l", n) for n in (2, 5, 14)},
        }
    )

    def slope(n):
        prev = s.lag(f"_s{n}", 5)
        return ratio(c(f"_s{n}") - prev, prev)

    tr_before = s.lag("_ct")
    tr_mean5 = F.when(c("_i") > 5, (tr_before - F.coalesce(s.lag("_ct", 6), zero)) / 5)
    out = out.withColumns(
        {
            **{f"close_over_sma_{n}": ratio("close", f"_s{n}") for n in sma},
            "sma20_slope_5d": slope(20),
            "sma50_slope_5d": slope(50),
            "bb_position_20": F.when(c("_sd") > 0, (c("close") - c("_s20")) / (2 * c("_sd"))),
            "bb_squeeze_20": ratio(4.0 * c("_sd"), "_s20"),
            **{f"vol_mult_{n}": F.when(c(f"_v{n}") > 0, ratio(vol, f"_v{n}")) for n in (5, 10, 30, 60)},
            "obv_slope_20d": ratio(c("_obv") - s.lag("_obv", 20), c("_v20") * 20),
            "atr_pct_14": ratio(mean("_ct", 14, "_nt"), "close"),
            "range_expansion_5d": ratio("_tr", tr_mean5),
            **{
                f"rsi_{n}": F.when(c(f"_al{n}") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + ratio(f"_ag{n}", f"_al{n}")))
                for n in (2, 5, 14)
            },
            "gap_pct": ratio(c("open") - c("_pc"), "_pc"),
            "body_range_ratio": F.when(span > 0, F.abs(c("close") - c("open")) / span),
            "is_inside_bar": (c("high") < c("_ph")) & (c("low") > c("_pl")),
            "days_since_last_20pct": (c("_i") - F.last("_ev", True).over(s.running())).cast("long"),
        }
    )
    out = out.drop(*[n for n in out.columns if n.startswith("_")])
    # both peer statistics come from one aggregate of (date, group); like the benchmark's days it is
    # bounded by the calendar and the regions, so it goes to every task and the wide rows stay where they are
    out = _with_group(out, groups)
    z = c("close_over_sma_20")
    stats = (
        out.where(c("_g").isNotNull())
        .groupBy("date", "_g")
        .agg(
            F.avg("roc_20").alias("_m"),
            F.avg(z).alias("_zm"),
            F.stddev_samp(z).alias("_zs"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    out = out.join(F.broadcast(stats), ["date", "_g"], "left")
    out = out.join(F.broadcast(_benchmark_days(benchmark, 20)), "date", "left")
    out = out.withColumns(
        {
            "rs_sector_20d": ratio("roc_20", "_m"),
            "rs_spy_20d": ratio("roc_20", "_b"),
            "close_over_sma_20_peer_z": F.when((c("_zs") > 0) & (c("_n") >= 2), (z - c("_zm")) / c("_zs")),
        }
    )
    return out.drop("_g", "_m", "_zm", "_zs", "_n", "_b")


def _benchmark_days(benchmark, lookback):
    """Benchmark return and regime per day, from one read of the benchmark."""
    from pyspark.sql import Window

    w = Window.orderBy("date")
    m = benchmark.select(
        "date",
        "close",
        (ratio("close", F.lag("close", lookback).over(w)) - 1.0).alias("_b"),
        full(F.avg, "close", w.rowsBetween(-49, 0), 50).alias("_x"),
        full(F.avg, "close", w.rowsBetween(-199, 0), 200).alias("_y"),
    )
    return m.select("date", "_b", _regime("close", "_x", "_y").alias("market_regime"))


def _regime(px, short, long):
    px, a, b = F.col(px), F.col(short), F.col(long)
    return F.when((px > a) & (a > b), "uptrend").when((px < a) & (a < b), "downtrend").otherwise("chop")


SCAN_FEATURES = (
    "atr_pct_14", "pct_of_252d_high", "pct_of_252d_low",
    "close_over_sma_20", "close_over_sma_50", "close_over_sma_200",
    "vol_ratio_20", "rvol_20", "ret_5d", "ret_20d", "ret_60d",
    "distance_from_max_30", "distance_from_min_30", "hl_pct",
)


def scan_features(df, threshold=0.20, require_history=True):
    """The fourteen adjusted-close features of the single and pairwise scans, and the label.

    The scans' forward maximum also asks for ``lookahead`` rows of history, unlike the
    plain label; ``require_history=False`` drops that.
    """
    px = "close_adj"
    s = DAILY
    df = df.withColumns(
        {
            "_r1": ratio(px, s.lag(px)) - 1.0,
            "hl_pct": ratio(F.col("high") - F.col("low"), "close"),
            "_fmax": s.roll_forward(F.max, px, 30),
            "_row": F.row_number().over(s.w),
        }
    )
    fmax = F.when(F.col("_row") >= 30, F.col("_fmax")) if require_history else F.col("_fmax")
    means = {"atr_pct_14": ("hl_pct", 14), "_vol20": ("volume", 20)}
    means |= {f"_sma{n}": (px, n) for n in (20, 50, 200)}
    tops = {"_top252": (F.max, px, 252), "_low252": (F.min, px, 252), "_top30": (F.max, px, 30), "_low30": (F.min, px, 30)}
    df = with_extremes(with_means(df, means), tops)
    df = df.withColumns(
        {
            "pct_of_252d_high": ratio(px, "_top252"),
            "pct_of_252d_low": ratio(px, "_low252"),
            **{f"close_over_sma_{n}": ratio(px, f"_sma{n}") for n in (20, 50, 200)},
            "vol_ratio_20": ratio(F.col("volume").cast("double"), "_vol20"),
            "rvol_20": s.roll(F.stddev_samp, "_r1", 20),
            "ret_5d": ratio(px, s.lag(px, 5)) - 1.0,
            "ret_20d": ratio(px, s.lag(px, 20)) - 1.0,
            "ret_60d": ratio(px, s.lag(px, 60)) - 1.0,
            "distance_from_max_30": ratio(px, "_top30"),
            "distance_from_min_30": ratio(px, "_low30"),
            "winner": (ratio(fmax, px) >= 1.0 + threshold).cast("int"),
        }
    )
    return df.drop("_r1", "_fmax", "_row", *[n for n in (*means, *tops) if n.startswith("_")])


def panel_features(daily):
    """Daily panel of one series: returns, 60-row drawdown, average and volatility ratios."""
    from pyspark.sql import Window

    w = Window.orderBy("date")

    def r(agg, c, n):
        return full(agg, c, w.rowsBetween(-(n - 1), 0), n)

    df = daily.withColumn("_r", ratio("close", F.lag("close").over(w)) - 1.0)
    top = r(F.max, "close", 60)
    return df.withColumns(
        {
            "r_30d": ratio("close", F.lag("close", 30).over(w)) - 1.0,
            "r_60d": ratio("close", F.lag("close", 60).over(w)) - 1.0,
            "drawdown_60d": ratio(F.col("close") - top, top),
            "sma_ratio": ratio(r(F.avg, "close", 50), r(F.avg, "close", 200)),
            "vol_ratio": ratio(r(F.stddev_samp, "_r", 30), r(F.stddev_samp, "_r", 60)),
        }
    ).drop("_r")


def vol_terciles(daily, vol_window=30, window=252, min_history=60):
    """Low / mid / high against the earlier values of a trailing frame; "mid" by default.

    One row per day, so the single-partition window stays small.
    """
    from pyspark.sql import Window

    w = Window.orderBy("date")
    df = daily.withColumn("_lr", F.ln("close") - F.ln(F.lag("close").over(w)))
    df = df.withColumn("vol_30d", full(F.stddev_samp, "_lr", w.rowsBetween(-(vol_window - 1), 0), vol_window))
    frame = w.rowsBetween(-(window - 1), -1)
    enough = F.count("vol_30d").over(frame) >= min_history
    df = df.withColumns(
        {
            "_lo": F.when(enough, F.percentile("vol_30d", F.lit(0.3333)).over(frame)),
            "_hi": F.when(enough, F.percentile("vol_30d", F.lit(0.6667)).over(frame)),
        }
    )
    tercile = (
        F.when(F.col("vol_30d") <= F.col("_lo"), "low")
        .when(F.col("vol_30d") >= F.col("_hi"), "high")
        .otherwise("mid")
    )
    return df.withColumn("vol_tercile", tercile).drop("_lr", "_lo", "_hi")
