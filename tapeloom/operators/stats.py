"""Aggregations, ranking, correlation and per-series statistics."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles, running_before
from ..functions.windows import Series, ema, ratio, row_of, safe_corr, true_range
from ..session import staged


def unpivot(df, keep, columns, name="feature", value="value"):
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*keep, F.inline(cells))


# --- scans over features ----------------------------------------------------------------


def cohens_d(df, features, label, least=100):
    """Effect size of every feature between the two classes, from one scan."""
    y, v = F.col(label) == 1, F.col("value")
    long = unpivot(df.where(F.col(label).isNotNull()), [label], features).where(v.isNotNull())
    a = long.groupBy("feature").agg(
        F.count(F.when(y, v)).alias("n_winners"),
        F.count(F.when(~y, v)).alias("n_losers"),
        F.avg(F.when(y, v)).alias("_mw"),
        F.avg(F.when(~y, v)).alias("_ml"),
        F.var_samp(F.when(y, v)).alias("_vw"),
        F.var_samp(F.when(~y, v)).alias("_vl"),
    )
    nw, nl = F.col("n_winners"), F.col("n_losers")
    pooled = F.sqrt(((nw - 1) * F.col("_vw") + (nl - 1) * F.col("_vl")) / (nw + nl - 2))
    ok = (nw >= least) & (nl >= least)
    return a.select(
        "feature",
        "n_winners",
        "n_losers",
        F.when(ok, F.col("_mw")).alias("mean_winner"),
        F.when(ok, F.col("_ml")).alias("mean_loser"),
        F.when(ok & (pooled > 0), (F.col("_mw") - F.col("_ml")) / pooled).alias("cohens_d"),
    )


def quartile_bins(df, features, keep):
    """Quartile 0-3 of each value against the whole frame's quartiles; null stays null."""
    long = staged(unpivot(df, keep, features).where(F.col("value").isNotNull()))
    q = exact_quantiles(long, ["feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, stage=False)
    v = F.col("value")
    binned = long.join(F.broadcast(q), "feature")  # one row per feature
    quart = F.when(v < F.col("q25"), 0).when(v < F.col("q50"), 1).when(v < F.col("q75"), 2).otherwise(3)
    return binned.withColumn("q", quart).drop("q25", "q50", "q75"), q


def quartile_columns(df, features, cuts):
    """The same bins as one int column per feature (``cuts`` is one row per feature)."""
    wide = cuts.agg(*[F.max(F.when(F.col("feature") == f, F.struct("q25", "q50", "q75"))).alias(f) for f in features])
    cols, row = {}, row_of(wide)
    for f in features:
        c, v = row[f], F.col(f)
        cols[f"q_{f}"] = F.when(
            v.isNotNull(), F.when(v < c["q25"], 0).when(v < c["q50"], 1).when(v < c["q75"], 2).otherwise(3)
        )
    return df.withColumns(cols)


def feature_cuts(df, features):
    long = unpivot(df, [], features).where(F.col("value").isNotNull())
    return exact_quantiles(long, ["feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, stage=False)


def best_quartile(binned, label):
    """Best quartile of each feature by winner rate (ties to the lower quartile)."""
    cells = binned.groupBy("feature", "q").agg(F.avg(label).alias("rate"), F.count(label).alias("n"))
    w = Window.partitionBy("feature").orderBy(F.round("rate", 9).desc(), "q")
    return cells.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pair_cells(df, features, label):
    """Winner sum and row count of every 4 x 4 quartile cell of every feature pair.

    ``df`` has one ``q_<feature>`` column (0-3 or null) per feature.  Features go in
    blocks of three; a row adds to one cell per pair of blocks, which is a ninth of the
    feature pairs, and the feature pairs are read off the block cells.  Cells combine on
    the map side, so the shuffle is bounded by the number of cells, not of rows.  The
    diagonal pair (x, x) holds the single feature.
    """
    blocks = [list(features[i : i + 3]) for i in range(0, len(features), 3)]
    duos = list(combinations(range(len(blocks)), 2)) or [(0, 0)]

    def members(duo):
        a, b = duo
        return blocks[a] + (blocks[b] if a != b else [])

    # digits in base 5: a quartile, or 4 where the value is missing
    def code(n, duo):
        total = F.lit(n)
        for f in members(duo) + [None] * (6 - len(members(duo))):
            digit = F.lit(4) if f is None else F.coalesce(F.col(f"q_{f}"), F.lit(4))
            total = total * 5 + digit
        return total

    codes = F.array(*[code(n, d) for n, d in enumerate(duos)])
    got = df.select(F.col(label).alias("_y"), F.explode(codes).alias("_c")).groupBy("_c")
    got = got.agg(F.sum("_y").alias("_w"), F.count("_y").alias("_n"))

    def digit(pos):
        return F.floor(F.col("_c") / 5 ** (5 - pos)).cast("int") % 5

    seen, choices = set(), []
    for n, duo in enumerate(duos):
        names, cells = members(duo), []
        for i, x in enumerate(names):
            for j, y in enumerate(names):
                key = (x, y) if features.index(x) <= features.index(y) else None
                if key is None or key in seen:
                    continue
                seen.add(key)
                cells.append(
                    F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), digit(i).alias("qx"), digit(j).alias("qy"))
                )
        choices.append((n, F.array(*cells)))
    pick = None
    for n, cells in choices:
        hit = F.floor(F.col("_c") / 5**6) == n
        pick = F.when(hit, cells) if pick is None else pick.when(hit, cells)
    long = got.select("_w", "_n", F.inline(pick)).where("qx < 4 AND qy < 4")
    return long.groupBy("x", "y", "qx", "qy").agg(F.sum("_w").alias("w"), F.sum("_n").alias("n"))


def pairwise_scan(df, features, label, min_share=0.005):
    """Best 4 x 4 quartile cell of every feature pair and its synergy over single features."""
    features = list(features)
    data = staged(df.where(F.col(label).isNotNull()).select(label, *features))
    cuts = staged(feature_cuts(data, features))
    total = row_of(data.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("base")))
    n_all, base = total["n"], total["base"]
    cells = pair_cells(quartile_columns(data, features, cuts), features, label)
    cells = cells.withColumn("rate", F.col("w") / F.col("n"))
    cells = staged(cells.withColumn("lift", ratio("rate", base)))  # sixteen rows per pair, read three times
    single = cells.where("x = y").groupBy(F.col("x").alias("f")).agg(F.max("lift").alias("best"))
    w = Window.partitionBy("x", "y").orderBy(F.round("lift", 9).desc(), "qx", "qy")
    top = (
        cells.where("x <> y")
        .where(F.col("n") >= n_all * F.lit(min_share))
        .withColumn("_r", F.row_number().over(w))
        .where("_r = 1")
        .drop("_r")
    )
    sx = single.select(F.col("f").alias("x"), F.col("best").alias("marginal_lift_x"))
    sy = single.select(F.col("f").alias("y"), F.col("best").alias("marginal_lift_y"))
    top = top.join(sx, "x").join(sy, "y")
    return top.withColumns(
        {
            "coverage_pct": 100.0 * F.col("n") / n_all,
            "interaction_strength": F.col("lift") - F.greatest("marginal_lift_x", "marginal_lift_y"),
        }
    )


# --- ranking -----------------------------------------------------------------------------


def positions(df, by, order, out="position"):
    """Adds each row's place inside its group and the group's size ``n_group``, however large a group is.

    A range sort deals the rows out by group and order; places are local to a task's range and
    start at the counts of the ranges before, one small row per group and range.
    """
    by, order = list(by), list(order)
    d = staged(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    counts = d.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    earlier = F.coalesce(F.sum("_c").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*by, "_range", earlier.alias("_before"), F.sum("_c").over(w).alias("n_group"))
    local = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return d.withColumn("_local", local).join(counts, [*by, "_range"]).withColumn(out, (F.col("_before") + F.col("_local")).cast("long")).select(
        *df.columns, out, "n_group"
    )


def top_share(df, score, ties, divisor=10):
    """The ``max(1, n div divisor)`` best rows by score, exactly, without ranking them all.

    The score at the cut is found as an order statistic; rows above it are in, and only
    rows equal to it are counted off by the tie keys.
    """
    d = staged(df.where(F.col(score).isNotNull()))
    n = d.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / divisor)).alias("k"), F.count(F.lit(1)).alias("n"))
    k = n.select("k").scalar()
    # distinct scores with the number of rows above each: a two-level prefix
    flip = d.withColumn("_neg", -F.col(score)).withColumn("_one", F.lit(1))
    ranks = running_before(flip, [], "_neg", ["_one"])
    cut = ranks.where(F.col("_one_before") < k).agg(F.max("_neg").alias("s"), F.max("_one_before").alias("above"))
    cut = row_of(staged(cut))
    s, above = cut["s"], cut["above"]
    flip = flip.withColumns({"_s": s, "_left": k - above})
    sure = flip.where(F.col("_neg") < F.col("_s"))
    tied = flip.where(F.col("_neg") == F.col("_s"))
    kept = positions(tied, [], ties, "_r").where(F.col("_r") <= F.col("_left"))
    return sure.select(*df.columns).unionByName(kept.select(*df.columns))


def top_per_group(df, by, order, k, rank="rank"):
    """First ``k`` rows of each group; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def hash_sample(df, by, keys, n):
    """A fixed pseudo-random ``n`` rows per class, the same on every run."""
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    return top_per_group(df.withColumn("_h", h), by, ["_h", *keys], n).drop("_h", "rank")


# --- correlation -------------------------------------------------------------------------


def pearson(df, target, columns):
    wide = df.agg(*[safe_corr(target, c).alias(c) for c in columns])
    return unpivot(wide, [], columns, "metric", "rho")


def average_rank(df, column, out):
    """Rank with ties averaged: rows below plus half of the equals."""
    d = df.withColumn("_one", F.lit(1))
    r = running_before(d, [], column, ["_one"])
    r = r.select(column, (F.col("_one_before") + (F.col("_one") + 1) / 2.0).alias(out))
    return df.join(r, column, "left")


def spearman(df, target, columns):
    d = average_rank(staged(df.select(target, *columns)), target, "_rt")
    for c in columns:
        d = average_rank(d, c, f"_r_{c}")
    wide = d.agg(*[safe_corr("_rt", f"_r_{c}").alias(c) for c in columns])
    return unpivot(wide, [], columns, "metric", "rho")


def halves(df, order, columns, tie):
    """Mean of each column in the high and the low half; the high half is the smaller.

    ``tie`` is a key of the rows.  The half is cut off at an order statistic, without a sort
    of all rows in one task; a row without a value for ``order`` is low.
    """
    df = staged(df)
    high = top_share(df, order, [tie], 2).select(F.col(tie).alias("_k"), F.lit(True).alias("_high"))
    n = df.agg((F.floor(F.count(F.lit(1)) / 2) > 0).alias("some")).scalar()  # of a single row none is high
    d = df.join(high, F.col(tie) == F.col("_k"), "left").withColumn("half", F.when(F.col("_high") & n, "high").otherwise("low"))
    return d.groupBy("half").agg(*[F.avg(c).alias(c) for c in columns])


# --- statistics of one series per key ----------------------------------------------------


def log_returns(bars, s: Series):
    return bars.withColumn("r", F.ln(ratio("close", s.lag("close"))))


def autocorrelation(returns, s: Series, lags=(1, 5, 60)):
    """Correlation of a series with itself shifted; pairs need both values."""
    d = returns.where(F.col("r").isNotNull())
    d = d.withColumns({f"_l{k}": s.lag("r", k) for k in lags})
    return d.groupBy(*s.keys).agg(
        *[safe_corr("r", f"_l{k}").alias(f"autocorr_{k}") for k in lags]
    )


def skew(returns, keys):
    """Bias-corrected skewness; the built-in is the population form."""
    n = F.count("r")
    return returns.groupBy(*keys).agg(
        F.when(n > 2, F.skewness("r") * F.sqrt((n * (n - 1)).cast("double")) / (n - 2)).alias("returns_skew")
    )


def variance_ratio(returns, s: Series, lag):
    d = returns.where(F.col("r").isNotNull())
    d = d.withColumn("_k", s.roll(F.sum, "r", lag))
    n, v1 = F.count("r"), F.var_samp("r")
    vr = F.when((n < 2 * lag) | (v1 == 0), 1.0).otherwise(F.var_samp("_k") / (lag * v1))
    return d.groupBy(*s.keys).agg(vr.alias(f"vr_{lag}"))


def mean_atr_pct(bars, period=14):
    """Mean over a symbol's bars of the exponential mean true range in percent of the close."""
    d = ema(bars.withColumn("_tr", true_range()), "_tr", period, "_atr")
    return d.groupBy("symbol").agg(F.avg(100.0 * ratio("_atr", "close")).alias("mean_atr_pct"))


def hurst_lags(most=100, steps=15):
    """The distinct whole lags of geometric steps from 2 to ``most``."""
    return sorted({int(2 * (most / 2) ** (k / (steps - 1)) + 1e-9) for k in range(steps)})


def hurst(bars, s: Series, lags=None):
    """Rescaled-range exponent of the whole series: slope of ln(mean R/S) on ln(lag).

    A key's closes, which the calendar bounds, are one sorted array, cut into segments of each
    lag in turn, so no row is repeated for the lags.  Keys too short for any lag are absent.
    """
    lags = lags or hurst_lags()

    def exponent(series: pd.Series) -> pd.Series:
        return pd.Series([_exponent(np.asarray(x, np.float64), lags) for x in series], dtype=object)

    row = F.struct(*s.order, F.col("close").cast("double").alias("close"))
    d = bars.groupBy(*s.keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    d = d.select(*s.keys, F.transform("_rows", lambda r: r["close"]).alias("_x"))
    return d.withColumn("hurst", F.pandas_udf(exponent, "double")("_x")).drop("_x").where(F.col("hurst").isNotNull())


def _exponent(x: np.ndarray, lags) -> float | None:
    """A missing value adds nothing to its segment; None if no lag has a segment with two different values."""
    found = []
    for lag in lags:
        n = len(x) // lag
        if n < 2:
            continue
        seg = x[: n * lag].reshape(n, lag)
        there = ~np.isnan(seg)
        seg = seg[np.where(there, seg, -np.inf).max(1) > np.where(there, seg, np.inf).min(1)]
        if not len(seg):
            continue
        dev = seg - np.nanmean(seg, axis=1, keepdims=True)
        run = np.where(np.maximum.accumulate(~np.isnan(dev), axis=1), np.nancumsum(dev, axis=1), np.nan)
        spread = np.nanmax(run, axis=1) - np.nanmin(run, axis=1)
        found.append((math.log(lag), math.log((spread / np.nanstd(seg, axis=1)).mean())))
    if not found:
        return None
    if len(found) < 3:
        return 0.5
    lag, rs = np.array(found).T
    return float(((lag - lag.mean()) * (rs - rs.mean())).sum() / ((lag - lag.mean()) ** 2).sum())


def half_life(bars, s: Series):
    """ln 2 over the pull of the log price to its mean; null when it does not revert."""
    d = bars.withColumn("_lp", F.ln("close")).withColumn("_lag", s.lag("_lp"))
    theta = -F.regr_slope(F.col("_lp") - F.col("_lag"), F.col("_lag"))
    return d.groupBy(*s.keys).agg(theta.alias("_t")).select(
        *s.keys, F.when(F.col("_t") > 0, F.ln(F.lit(2.0)) / F.col("_t")).alias("ou_half_life")
    )


def conditional_recovery(bars, s: Series, drop=0.05, bars_ahead=20):
    """Share of drops that come back to the entry within ``bars_ahead`` rows of the drop.

    Both searches read bounded forward frames; rows too close to the end do not count.
    """
    look = 5 * bars_ahead
    frame = s.w.rowsBetween(1, look + bars_ahead)
    d = bars.withColumns(
        {
            "_f": F.collect_list("close").over(frame),
            "_left": F.count(F.lit(1)).over(Window.partitionBy(*s.keys)) - F.row_number().over(s.w),
        }
    ).where(F.col("_left") >= look)
    first = F.array_position(
        F.transform(F.slice("_f", 1, look), lambda x: x <= F.col("close") * (1 - drop)), F.lit(True)
    )
    d = d.withColumn("_at", first).where(F.col("_at") > 0)
    back = F.array_max(F.slice("_f", F.col("_at").cast("int"), F.lit(bars_ahead))) >= F.col("close")
    return d.groupBy(*s.keys).agg(F.avg(back.cast("double")).alias("p_recovery"), F.count(F.lit(1)).alias("n_attempts"))


def drawdown(bars, s: Series, lookback=200):
    top = F.max("close").over(s.trailing(lookback))
    return bars.withColumn("dd", F.col("close") / top - 1.0)


def continuation(bars, s: Series, first=0.10, deep=0.30, lookback=200):
    """Share of rows in a first drawdown that reach the deep one within the look-ahead."""
    d = drawdown(bars, s, lookback)
    d = d.withColumn("_m", F.min("dd").over(s.w.rowsBetween(0, lookback - 1)))
    d = d.where((F.col("dd") <= -first) & (F.col("dd") > -deep))
    return d.groupBy(*s.keys).agg(
        F.avg((F.col("_m") <= -deep).cast("double")).alias("p_catastrophic"), F.count(F.lit(1)).alias("n_bars")
    )


def underwater(bars, s: Series, lookback=200, mark=-0.10, deep=-0.30):
    """Deepest drawdown, share of time in deep drawdown, mean run length under the mark."""
    d = drawdown(bars, s, lookback).withColumn("_u", (F.col("dd") < mark).cast("int"))
    starts = (F.col("_u") == 1) & (F.coalesce(s.lag("_u"), F.lit(0)) == 0)
    d = d.withColumn("_st", starts.cast("int"))
    return d.groupBy(*s.keys).agg(
        F.min("dd").alias("max_drawdown"),
        F.avg((F.col("dd") < deep).cast("double")).alias("p_drawdown_30pct"),
        F.coalesce(F.try_divide(F.sum("_u"), F.sum("_st")), F.lit(0.0)).alias("mean_recovery_bars"),
    )


def trailing_sharpe(daily, key, value, n=60, periods=365.0):
    """Sharpe of the last ``n`` days per key; 0 with fewer days."""
    w = Window.partitionBy(key).orderBy(F.col("day").desc())
    last = daily.withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= n)
    sd = F.stddev_samp(value)
    full_ = (F.count(value) >= n) & (sd > 0)
    return last.groupBy(key).agg(
        F.when(full_, F.avg(value) / sd * F.sqrt(F.lit(periods))).otherwise(0.0).alias("sharpe_terminal")
    )


def volume_trend(daily, key, value, n=60):
    """Slope of log volume per year, and the z of the last ``n`` days' mean."""
    run = Window.partitionBy(key).orderBy("day")
    back = Window.partitionBy(key).orderBy(F.col("day").desc())
    d = daily.withColumns(
        {
            "_ly": F.when(F.col(value) != 0, F.ln(F.abs(F.col(value)))),
            "_back": F.row_number().over(back),
        }
    )
    d = d.withColumn("_x", (F.count("_ly").over(run.rowsBetween(Window.unboundedPreceding, 0)) - 1) / F.lit(365.0))
    sd = F.stddev_samp(value)
    late = F.avg(F.when(F.col("_back") <= n, F.col(value)))
    return d.groupBy(key).agg(
        F.avg(value).alias("mean_dv"),
        F.when(F.count("_ly") > 10, F.regr_slope("_ly", F.when(F.col("_ly").isNotNull(), F.col("_x")))).alias("vol_slope_yr"),
        F.when(sd > 0, (late - F.avg(value)) / sd).otherwise(0.0).alias("vol_z_late"),
    )


def two_regressors(df, y, x1, x2):
    """Least squares of y on two regressors and a constant, closed form from one scan."""
    c = {n: F.covar_samp(F.col(a), F.col(b)) for n, a, b in (("s12", x1, x2), ("s1y", x1, y), ("s2y", x2, y))}
    m = df.where(F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull()).agg(
        F.var_samp(x1).alias("s11"),
        F.var_samp(x2).alias("s22"),
        *[v.alias(k) for k, v in c.items()],
        F.avg(y).alias("my"),
        F.avg(x1).alias("m1"),
        F.avg(x2).alias("m2"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b1 = (F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y")) / det
    b2 = (F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y")) / det
    return m.select(
        (F.col("my") - b1 * F.col("m1") - b2 * F.col("m2")).alias("alpha"), b1.alias("beta"), b2.alias("gamma")
    )


def ols(df, y, xs):
    """Coefficients, errors and t values on population-standardised regressors."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    m = df.agg(*[F.avg(x).alias(f"m_{x}") for x in xs], *[F.stddev_pop(x).alias(f"s_{x}") for x in xs])
    z = df.withColumns(
        {f"z_{x}": F.coalesce(ratio(F.col(x) - row_of(m)[f"m_{x}"], row_of(m)[f"s_{x}"]), F.lit(0.0)) for x in xs}
    )
    z = z.na.drop(subset=[y])
    v = VectorAssembler(inputCols=[f"z_{x}" for x in xs], outputCol="features").transform(z)
    fit = LinearRegression(featuresCol="features", labelCol=y, solver="normal").fit(v)
    s = fit.summary
    names = [*xs, "intercept"]
    coef = [*[float(c) for c in fit.coefficients], float(fit.intercept)]
    rows = [
        (n, c, float(e), float(t), float(s.r2), float(s.r2adj))
        for n, c, e, t in zip(names, coef, s.coefficientStandardErrors, s.tValues)
    ]
    return df.sparkSession.createDataFrame(
        rows, "term string, coefficient double, std_error double, t_value double, r2 double, adj_r2 double"
    )


def dense_days(daily, day, value):
    """Every calendar day of the span, zero where none is given: one row per day."""
    span = daily.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias(day))
    return days.join(daily, day, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def calendar_sum(dense, day, value, days, out):
    """Sum over the last ``days`` calendar days of a dense daily series."""
    w = Window.orderBy(F.unix_date(day)).rangeBetween(-(days - 1), 0)
    return dense.withColumn(out, F.sum(value).over(w))


def rolling_corr(a, b, w, n):
    """Correlation over ``n`` complete pairs."""
    return F.when(F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).over(w) == n, safe_corr(a, b, w))


