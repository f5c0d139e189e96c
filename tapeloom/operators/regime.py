"""Market-regime panel, rule labels, folds and classifier scoring.

Every frame here has one row per day, so windows without a key stay small however large
the bar table is; the bar table is aggregated to days first.
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.windows import full, ratio
from ..session import staged
from .predicates import first_match
from .stats import rolling_corr
from .boosting import filled


def _w():
    return Window.orderBy("date")


def _roll(agg, c, n):
    return full(agg, c, _w().rowsBetween(-(n - 1), 0), n)


def _lag(c, n=1):
    return F.lag(c, n).over(_w())


def sma_spread_slope(df, out, short=20, mid=50):
    """Change over ``short`` rows of the normalised spread of two averages, per row."""
    m = _roll(F.avg, "close", mid)
    df = df.withColumn("_sp", ratio(_roll(F.avg, "close", short) - m, m))
    return df.withColumn(out, (F.col("_sp") - _lag("_sp", short)) / short).drop("_sp")


def sma_position(mid=50, long=200):
    low = _roll(F.avg, "close", long)
    return ratio(_roll(F.avg, "close", mid) - low, low)


def log_return(n):
    return F.ln(ratio("close", _lag("close", n)))


def volume_z(n=30):
    return ratio(F.col("volume") - _roll(F.avg, "volume", n), _roll(F.stddev_samp, "volume", n))


def drawdown_from_high(n=200):
    return ratio("close", _roll(F.max, "close", n)) - 1.0


def range_position(c, n=30):
    """Where the value lies between the frame's minimum and maximum."""
    lo = _roll(F.min, c, n)
    return ratio(F.col(c) - lo, _roll(F.max, c, n) - lo)


def crypto_block(daily):
    pc = _lag("close")
    d = daily.withColumn(
        "_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    )
    d = sma_spread_slope(d, "btc_sma20_50_slope")
    return d.select(
        "date",
        (ratio(_roll(F.avg, "_tr", 14), "close") * 100.0).alias("btc_atr_pct_daily"),
        "btc_sma20_50_slope",
        sma_position().alias("btc_sma50_200_position"),
        log_return(30).alias("btc_30d_return"),
        volume_z(30).alias("btc_volume_z30"),
        drawdown_from_high(200).alias("btc_drawdown_from_200d_high"),
    )


def equity_block(spy, vix=None, hyg=None, lqd=None):
    """Index position and return, volatility level and position, credit proxy; absent inputs give nulls."""
    d = spy.select("date", sma_position().alias("spx_sma50_200_position"), log_return(126).alias("spx_6mo_return"))
    none = F.lit(None).cast("double")
    if vix is not None:
        v = vix.select("date", F.col("close").alias("spx_vix_level"), range_position("close", 30).alias("spx_vix_pct_30d_rank"))
        d = d.join(v, "date", "left")
    else:
        d = d.withColumns({"spx_vix_level": none, "spx_vix_pct_30d_rank": none})
    if hyg is not None and lqd is not None:
        a = hyg.select("date", F.col("close").alias("_h"))
        b = lqd.select("date", F.col("close").alias("_l"))
        c = a.join(b, "date").select("date", (-F.ln(ratio("_h", "_l"))).alias("spx_credit_spread_proxy"))
        return d.join(c, "date", "left")
    return d.withColumn("spx_credit_spread_proxy", none)


def _returns(series, out):
    return series.select("date", (ratio("close", _lag("close")) - 1.0).alias(out))


def cross_asset_block(btc, spy, alts=None, dxy=None, gold=None, n=30):
    w = _w().rowsBetween(-(n - 1), 0)
    none = F.lit(None).cast("double")
    d = _returns(btc, "btc_ret").join(_returns(spy, "spy_ret"), "date")
    d = d.withColumn("crypto_equity_30d_corr", rolling_corr("btc_ret", "spy_ret", w, n))
    if alts is not None:
        each = Window.partitionBy("symbol").orderBy("date")
        r = alts.withColumn("_r", ratio("close", F.lag("close").over(each)) - 1.0)
        basket = r.groupBy("date").agg(F.avg("_r").alias("_alt"))
        d = d.join(basket, "date", "left").withColumn("crypto_alt_to_btc_corr", rolling_corr("_alt", "btc_ret", w, n))
    else:
        d = d.withColumn("crypto_alt_to_btc_corr", none)
    if dxy is not None:
        x = dxy.withColumn("_l", F.ln("close") - F.ln(_lag("close"))).select("date", _roll(F.avg, "_l", n).alias("dxy_30d_slope"))
        d = d.join(x, "date", "left")
    else:
        d = d.withColumn("dxy_30d_slope", none)
    if gold is not None:
        d = d.join(_returns(gold, "_g"), "date", "left").withColumn("gold_proxy_corr_to_spx", rolling_corr("_g", "spy_ret", w, n))
    else:
        d = d.withColumn("gold_proxy_corr_to_spx", none)
    return d.select("date", "crypto_equity_30d_corr", "crypto_alt_to_btc_corr", "dxy_30d_slope", "gold_proxy_corr_to_spx")


def regime_panel(btc, spy, vix=None, hyg=None, lqd=None, dxy=None, gold=None, alts=None):
    c = crypto_block(btc)
    e = equity_block(spy, vix, hyg, lqd)
    x = cross_asset_block(btc, spy, alts, dxy, gold)
    return c.join(e, "date", "full_outer").join(x, "date", "full_outer")


# Label thresholds.
THRESHOLDS = {
    "crash_vix_floor": 35.0,
    "crash_credit_spread_sigma": 2.0,
    "risk_off_corr_floor": 0.70,
    "bear_spx_6mo_return_ceiling": -0.10,
    "bear_vix_floor": 22.0,
    "decoupled_btc_30d_return_floor": 0.30,
    "decoupled_btc_equity_corr_ceiling": 0.40,
    "choppy_drawdown_threshold": -0.10,
    "choppy_btc_atr_floor": 2.0,
    "steady_vix_ceiling": 18.0,
    "steady_btc_atr_ceiling": 2.0,
    "lowvol_btc_atr_ceiling": 1.5,
    "lowvol_vix_ceiling": 14.0,
    "lowvol_abs_btc_return_ceiling": 0.10,
    "sideways_slope_ceiling": 0.001,
    "sideways_vix_floor": 15.0,
    "sideways_vix_ceiling": 22.0,
}


def assign_labels(panel, thresholds=None):
    """Eight masks in priority order; a day that meets none, or lacks inputs, is "unlabeled"."""
    t = {**THRESHOLDS, **(thresholds or {})}
    c = F.col
    spread = "spx_credit_spread_proxy"
    d = panel.withColumn(
        "_z", ratio(c(spread) - _roll(F.avg, spread, 90), _roll(F.stddev_samp, spread, 90))
    )
    vix, corr, btc_r, spx_r = c("spx_vix_level"), c("crypto_equity_30d_corr"), c("btc_30d_return"), c("spx_6mo_return")
    btc_up, spx_up, atr = c("btc_sma50_200_position") > 0, c("spx_sma50_200_position") > 0, c("btc_atr_pct_daily")
    ladder = [
        ("crash_shock", (vix > t["crash_vix_floor"]) & (c("_z") > t["crash_credit_spread_sigma"])),
        ("high_correlation_risk_off", (corr > t["risk_off_corr_floor"]) & (btc_r < 0) & (spx_r < 0)),
        ("bear_trend", ~spx_up & (spx_r < t["bear_spx_6mo_return_ceiling"]) & (vix > t["bear_vix_floor"])),
        ("crypto_decoupled_bull", (btc_r > t["decoupled_btc_30d_return_floor"]) & (corr < t["decoupled_btc_equity_corr_ceiling"])),
        ("choppy_recovery", btc_up & (c("btc_drawdown_from_200d_high") < t["choppy_drawdown_threshold"]) & (atr > t["choppy_btc_atr_floor"])),
        ("steady_bull", btc_up & spx_up & (vix < t["steady_vix_ceiling"]) & (atr < t["steady_btc_atr_ceiling"])),
        ("low_vol_grind", (atr < t["lowvol_btc_atr_ceiling"]) & (vix < t["lowvol_vix_ceiling"]) & (F.abs(btc_r) < t["lowvol_abs_btc_return_ceiling"])),
        ("sideways_range", (F.abs("btc_sma20_50_slope") < t["sideways_slope_ceiling"]) & (vix > t["sideways_vix_floor"]) & (vix < t["sideways_vix_ceiling"])),
    ]
    d = d.withColumn("regime_label_rule", first_match(ladder, "unlabeled")).drop("_z")
    return d.withColumn("was_unlabeled", F.col("regime_label_rule") == "unlabeled")


def coverage(labelled, label="regime_label_rule"):
    none = F.col(label) == "unlabeled"
    return labelled.agg(
        F.count(F.lit(1)).alias("n_total_days"),
        F.count_if(~none).alias("n_labeled_days"),
        (1.0 - F.avg(none.cast("double"))).alias("coverage_rate"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def folds(labelled, train_days=365, val_days=180, slide_days=90):
    """Expanding-train, rolling-validation boundaries from the label dates."""
    span = labelled.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    start = F.date_add("first", train_days + 1)
    latest = F.date_sub("last", val_days)
    starts = F.when(start <= latest, F.sequence(start, latest, F.expr(f"INTERVAL {slide_days} DAYS")))
    d = span.select("first", F.posexplode(starts).alias("fold", "val_start"))
    return d.select(
        "fold",
        F.col("first").alias("train_start"),
        F.date_sub("val_start", 1).alias("train_end"),
        "val_start",
        F.date_add("val_start", val_days).alias("val_end"),
    )


def fold_members(labelled, fold_table):
    """(fold, role, date): a day belongs to every fold whose training span holds it."""
    d = labelled.join(F.broadcast(fold_table), F.col("date") <= F.col("val_end"))  # one row per fold
    role = F.when(F.col("date") <= F.col("train_end"), "train").when(F.col("date") >= F.col("val_start"), "val")
    return d.withColumn("role", role).where(F.col("role").isNotNull())


def class_weights(df, label, by=()):
    """n / (k * count of the class), per group."""
    by = list(by)
    per = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    per = per.withColumn("class_weight", F.sum("_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("_c")))
    return per.withColumnRenamed("_c", "n_class")


def class_metrics(df, label, predicted, by=()):
    """Precision, recall, F1 and support per class from one confusion table."""
    by = list(by)
    conf = df.groupBy(*by, label, predicted).agg(F.count(F.lit(1)).alias("_n"))
    hit = F.when(F.col(label) == F.col(predicted), F.col("_n")).otherwise(0)
    act = conf.groupBy(*by, F.col(label).alias("class")).agg(F.sum("_n").alias("support"), F.sum(hit).alias("_tp"))
    pre = conf.groupBy(*by, F.col(predicted).alias("class")).agg(F.sum("_n").alias("_pred"), F.sum(hit).alias("_tp2"))
    d = act.join(pre, [*by, "class"], "full_outer")
    tp = F.coalesce("_tp", "_tp2", F.lit(0))
    p = F.coalesce(F.try_divide(tp, F.col("_pred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, F.col("support")), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return d.select(
        *by, "class", p.alias("precision"), r.alias("recall"), f.alias("f1"), F.coalesce("support", F.lit(0)).alias("support")
    )


def f1_summary(metrics, by=()):
    """Macro F1 over the classes that occur as label or prediction, and the support-weighted F1."""
    return metrics.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double")).alias("weighted_f1"),
        F.sum("support").alias("n_val"),
    )


def acceptance(metrics, min_macro=0.5, max_range=0.5, min_precision=0.4, fold="fold"):
    """Gates over folds: mean macro F1, its range, and each class's mean precision where it has support."""
    m = f1_summary(metrics, [fold]).agg(
        F.avg("macro_f1").alias("mean_macro_f1"), (F.max("macro_f1") - F.min("macro_f1")).alias("f1_range")
    )
    p = metrics.where(F.col("support") > 0).groupBy("class").agg(F.avg("precision").alias("_p"))
    failing = p.agg(F.count_if(F.col("_p") < min_precision).alias("n")).scalar()
    m = m.withColumn("n_failing_classes", failing)
    ok = (F.col("mean_macro_f1") >= min_macro) & (F.col("f1_range") <= max_range) & (F.col("n_failing_classes") == 0)
    return m.withColumns(
        {
            "passes_macro_f1": F.col("mean_macro_f1") >= min_macro,
            "passes_stability": F.col("f1_range") <= max_range,
            "passes_all": ok,
        }
    )


def agreement(a, b, left="label_a", right="label_b"):
    """How often two label series agree, and where they differ."""
    j = a.join(b, "date")
    return j.groupBy(left, right).agg(
        F.count(F.lit(1)).alias("n"), F.first((F.col(left) == F.col(right)).cast("int")).alias("agrees")
    )


def point_in_time_sets(days, labelled, buffer_days=30, warmup=None, least=30):
    """Size and last label date of the training set each day may use.

    Running counts over the label days replace the day x day range join.
    """
    lab = labelled if warmup is None else labelled.where(F.col("date") >= F.lit(warmup).cast("date"))
    a = lab.select(F.date_add("date", buffer_days).alias("t"), F.lit(0).alias("side"), F.col("date").alias("lab"))
    b = days.select(F.col("date").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("date").alias("lab"))
    w = Window.orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    d = a.unionByName(b).withColumns(
        {"train_set_size": F.count("lab").over(w), "train_end_date": F.last("lab", True).over(w)}
    )
    d = d.where(F.col("side") == 1).select(F.col("t").alias("date"), "train_set_size", "train_end_date")
    prev = F.lag("train_set_size").over(_w())
    return d.where(F.col("train_set_size") >= least).withColumn(
        "is_refit", F.coalesce(F.col("train_set_size") != prev, F.lit(True))
    )


def refit_schedule(sets, growth=0.25, least=30):
    """One row per model: model_id, first_day (from which it may be used), train_set_size, train_end_date.

    ``sets`` are the sets of ``point_in_time_sets``, which only grow.  A model is fitted when its set
    has ``least`` rows and again whenever the set passes the next power of 1 + ``growth`` of that;
    with a growth of 0, whenever a label is new.
    """
    n = F.col("train_set_size")
    level = F.floor(F.ln(n / F.lit(float(least))) / math.log1p(growth)) if growth else n - least
    first = F.min_by(F.struct(F.col("date").alias("first_day"), "train_set_size", "train_end_date"), "date")
    d = sets.where(n >= least).withColumn("model_id", level.cast("long")).groupBy("model_id").agg(first.alias("m"))
    return d.select("model_id", "m.*")


def walk_forward_scores(days, features, label="regime_label_rule", buffer_days=30, growth=0.25, least=30, trees=200, depth=4):
    """(schedule, scores): every day scored by the newest model of the schedule whose first day it has reached.

    A model is fitted on the labelled days at least ``buffer_days`` before its first day, so no day
    is scored by a model that saw a younger label.  The schedule grows with the logarithm of the days.
    """
    days = staged(days.select("date", label, *features))
    labelled = days.where(F.col(label) != "unlabeled")
    schedule = staged(refit_schedule(point_in_time_sets(days.select("date"), labelled.select("date"), buffer_days, least=least), growth, least))
    plan = schedule.orderBy("first_day").collect()
    scores = None
    for row, after in zip(plan, [*plan[1:], None]):
        train = labelled.where(F.col("date") <= F.lit(row["train_end_date"])).select(label, *features)
        own = days.where((F.col("date") >= F.lit(row["first_day"])) & (F.lit(True) if after is None else F.col("date") < F.lit(after["first_day"])))
        _, out = fit_and_score(train, own.select("date", *features), features, label, trees, depth)
        out = out.select("date", "regime_label", "regime_confidence").withColumns(
            {"model_id": F.lit(row["model_id"]), "train_set_size": F.lit(row["train_set_size"]), "train_end_date": F.lit(row["train_end_date"])}
        )
        scores = out if scores is None else scores.unionByName(out)
    return schedule, scores


def refit_by_fold(days, fold_table, features, label="regime_label_rule", trees=200, depth=4):
    """One model per fold, fitted on its labelled training days: (models, scores of its validation days).

    The folds are a fixed list by year.
    """
    members = staged(fold_members(days, fold_table))
    models, scores = [], None
    for (fold,) in sorted(tuple(r) for r in members.select("fold").distinct().collect()):
        own = members.where(F.col("fold") == fold)
        train = own.where((F.col("role") == "train") & (F.col(label) != "unlabeled"))
        if train.isEmpty():
            continue
        model, out = fit_and_score(train.drop("fold", "role"), own.where("role = 'val'").select("fold", "date", *features), features, label, trees, depth)
        models.append(model)
        out = out.select("fold", "date", "regime_label", "regime_confidence")
        scores = out if scores is None else scores.unionByName(out)
    return models, scores


def fit_and_score(train, score, features, label="regime_label_rule", trees=200, depth=4):
    """Multi-class forest with inverse-frequency weights; label, confidence and class shares per day.

    A missing feature counts as smaller than every other, so every day has a score.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    keep = [c for c in score.columns if c not in features]
    train, score = filled(train, features, label), filled(score, features, *keep)
    train = train.join(class_weights(train, label).select(label, "class_weight"), label)
    index = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc").fit(train)
    vec = VectorAssembler(inputCols=list(features), outputCol="features")
    model = RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="class_weight", numTrees=trees, maxDepth=depth, seed=42
    ).fit(vec.transform(index.transform(train)))
    names = F.array(*[F.lit(x) for x in index.labels])
    out = model.transform(vec.transform(score)).withColumn("p", vector_to_array("probability"))
    out = out.withColumns(
        {
            "regime_label": F.get(names, F.col("prediction").cast("int")),
            "regime_confidence": F.array_max("p"),
            **{f"p_{n}": F.get("p", F.lit(i)) for i, n in enumerate(index.labels)},
        }
    )
    return model, out.select(*keep, "regime_label", "regime_confidence", *[f"p_{n}" for n in index.labels])
