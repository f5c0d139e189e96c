"""Row predicates, encodings and per-row scores."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import functions as F

from ..functions.windows import finite, ratio, row_of

OPS = {
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "==": operator.eq,
    "!=": operator.ne,
}


def check_op(op):
    if op not in OPS:
        raise ValueError(f"unknown op: {op}")


def condition(feature, op, threshold):
    """One comparison that is false, never null, for a missing or non-finite value."""
    check_op(op)
    x = F.col(feature).cast("double")
    return F.coalesce(OPS[op](finite(x), F.lit(float(threshold))), F.lit(False))


def all_hold(conditions):
    return reduce(lambda a, b: a & b, [condition(*c) for c in conditions])


def split_by_date(df, train_end, val_end, date_col="date"):
    """Adds ``split``: train / val / holdout; every dated row lands in exactly one."""
    if not train_end < val_end:
        raise ValueError("train_end must be before val_end")
    d = F.col(date_col)
    return df.withColumn(
        "split",
        F.when(d <= F.lit(train_end), "train").when(d <= F.lit(val_end), "val").when(d.isNotNull(), "holdout"),
    )


def in_ranges(ranges, date_col="date"):
    """True inside any of the inclusive date ranges."""
    d = F.col(date_col)
    return reduce(lambda a, b: a | b, [(d >= F.lit(lo)) & (d <= F.lit(hi)) for lo, hi in ranges])


def range_label(named_ranges, date_col="date"):
    """Name of the first list of ranges the date falls in, else null."""
    out = F.lit(None).cast("string")
    for name, ranges in reversed(list(named_ranges.items())):
        out = F.when(in_ranges(ranges, date_col), F.lit(name)).otherwise(out)
    return out


def one_hot(df, column, levels, drop=True):
    """0/1 columns ``<column>_<level>``; a level unseen in the data gives a column of zeros."""
    cols = {f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in levels}
    df = df.withColumns(cols)
    return df.drop(column) if drop else df


def flags_to_int(df):
    names = [n for n, t in df.dtypes if t == "boolean"]
    return df.withColumns({n: F.col(n).cast("int") for n in names})


# The concept thresholds.
CONCEPTS = (
    ("volume_breakout_5d", "vol_mult_5", ">", 2.0),
    ("volume_persistent", "vol_mult_60", ">", 1.5),
    ("high_atr_regime", "atr_pct_14", ">", 0.04),
    ("low_atr_regime", "atr_pct_14", "<", 0.015),
    ("bb_squeeze_tight", "bb_squeeze_20", "<", 0.05),
    ("bb_expansion", "bb_squeeze_20", ">", 0.15),
    ("range_expansion", "range_expansion_5d", ">", 1.5),
    ("rsi_oversold", "rsi_14", "<", 30.0),
    ("rsi_overbought", "rsi_14", ">", 70.0),
    ("macd_above_signal", "macd_hist", ">", 0.0),
    ("roc_60_positive", "roc_60", ">", 0.0),
    ("sma20_rising", "sma20_slope_5d", ">", 0.0),
    ("sma50_rising", "sma50_slope_5d", ">", 0.0),
    ("near_year_high", "pct_of_252d_high", ">", 0.95),
    ("off_year_high", "pct_of_252d_high", "<", 0.5),
    ("near_year_low", "pct_of_252d_low", "<", 1.1),
    ("above_sma200", "close_over_sma_200", ">", 1.0),
    ("above_sma50", "close_over_sma_50", ">", 1.0),
    ("peer_strength_high", "close_over_sma_20_peer_z", ">", 1.0),
    ("peer_strength_low", "close_over_sma_20_peer_z", "<", -1.0),
    ("outperforming_spy", "rs_spy_20d", ">", 5.0),
    ("market_uptrend", "market_regime_uptrend", "==", 1),
    ("market_downtrend", "market_regime_downtrend", "==", 1),
    ("market_chop", "market_regime_chop", "==", 1),
    ("inside_bar", "is_inside_bar", "==", 1),
    ("nr4_compression", "is_nr4", "==", 1),
    ("nr7_compression", "is_nr7", "==", 1),
    ("fresh_setup", "days_since_last_20pct", ">", 60),
    ("recent_winner_echo", "days_since_last_20pct", "<", 30),
    ("hv_short_above_long", "hv_ratio_10_60", ">", 1.0),
    ("ad_line_negative_distribution", "ad_line", "<", -1_000_000),
)


def concept_labels(df, concepts=CONCEPTS):
    return df.withColumns({name: condition(f, op, t).cast("int") for name, f, op, t in concepts})


def first_match(ladder, default):
    """First name whose mask holds; a null mask does not hold."""
    out = F.lit(default)
    for name, mask in reversed(list(ladder)):
        out = F.when(F.coalesce(mask, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def _argmax(scores):
    """(label, score) of the highest score; the earlier name wins a tie."""
    best = F.greatest(*[s for _, s in scores])
    out = F.lit(scores[-1][0])
    for name, s in reversed(scores[:-1]):
        out = F.when(s == best, F.lit(name)).otherwise(out)
    return out, best


# Thresholds of the loose and strict regime scores.
LOOSE = {
    "bear": {"dd60": -0.20, "r30": -0.05, "sma": 1.0},
    "chop": {"dd60": -0.15, "r30": 0.05, "vol": 1.0},
    "steady": {"sma": 1.05, "r60": 0.20, "vol": 1.0, "dd60": -0.10},
    "sideways": {"r30": 0.10, "sma": (0.95, 1.10), "dd60": -0.15},
}
STRICT = {
    "bear": {"dd60": -0.25, "r30": -0.08, "sma": 0.95},
    "chop": {"dd60": -0.20, "r30": 0.10, "vol": 1.2},
    "steady": {"sma": 1.15, "r60": 0.30, "vol": 0.85, "dd60": -0.05, "r30": 0.10},
    "sideways": {"r30": 0.05, "sma": (0.97, 1.05), "dd60": -0.10},
}


# What each regime asks of a measure, with the steepness of its graded form; the thresholds
# are those of LOOSE or STRICT, and a term that a set has no threshold for is left out.
TERMS = (
    ("bear_trend", "bear", "dd60", "drawdown_60d", "<=", 10),
    ("bear_trend", "bear", "r30", "r_30d", "<=", 20),
    ("bear_trend", "bear", "sma", "sma_ratio", "<", 20),
    ("choppy_recovery", "chop", "dd60", "drawdown_60d", "<=", 10),
    ("choppy_recovery", "chop", "r30", "r_30d", ">=", 20),
    ("choppy_recovery", "chop", "vol", "vol_ratio", ">", 10),
    ("steady_bull", "steady", "sma", "sma_ratio", ">=", 20),
    ("steady_bull", "steady", "r60", "r_60d", ">=", 10),
    ("steady_bull", "steady", "vol", "vol_ratio", "<", 10),
    ("steady_bull", "steady", "dd60", "drawdown_60d", ">", 20),
    ("steady_bull", "steady", "r30", "r_30d", ">=", 20),
)


def heuristic_regime(df, strict=False, continuous=False):
    """Per regime the mean of its terms, met or not, or graded by a sigmoid; label by the largest.

    Sideways has a band of its own, or in the graded form what the others leave.
    """
    limits = STRICT if strict else LOOSE
    terms: dict = {}
    for regime, group, name, column, op, steep in TERMS:
        if name not in limits[group]:
            continue
        x, t = F.col(column), F.lit(float(limits[group][name]))
        above = (x - t) if op in (">", ">=") else (t - x)
        term = 1.0 / (1.0 + F.exp(-above * float(steep))) if continuous else OPS[op](x, t).cast("double")
        terms.setdefault(regime, []).append(term)
    scores = {regime: reduce(operator.add, parts) / float(len(parts)) for regime, parts in terms.items()}
    if continuous:
        side = F.greatest(F.lit(0.0), 1.0 - F.greatest(*scores.values()))
    else:
        q, sma = limits["sideways"], F.col("sma_ratio")
        band = [F.abs("r_30d") < q["r30"], (sma > q["sma"][0]) & (sma < q["sma"][1]), F.col("drawdown_60d") > q["dd60"]]
        side = reduce(operator.add, [b.cast("double") for b in band]) / float(len(band))
    label, score = _argmax([*scores.items(), ("sideways_range", side)])
    known = reduce(operator.and_, [F.col(c).isNotNull() for c in dict.fromkeys(t[3] for t in TERMS)])
    return df.withColumns(
        {
            "regime_label": F.when(known, label).otherwise("sideways_range"),
            "regime_confidence": F.when(known, score).otherwise(0.5),
        }
    )


# Size multipliers by direction and volatility tercile.
SIZE_MATRIX = {
    "bull": {"low": 1.5, "mid": 1.2, "high": 0.8},
    "sideways": {"low": 1.3, "mid": 1.0, "high": 0.7},
    "bear": {"low": 1.0, "mid": 0.7, "high": 0.5},
}
DIRECTION = {
    "steady_bull": "bull",
    "sideways_range": "sideways",
    "choppy_recovery": "sideways",
    "bear_trend": "bear",
}


def size_multiplier(regime, tercile, matrix=None):
    """Lookup by regime and tercile; anything unknown is 1.0."""
    matrix = matrix or SIZE_MATRIX
    cells = []
    for name, way in DIRECTION.items():
        for t, v in matrix[way].items():
            cells += [F.lit(f"{name}|{t}"), F.lit(float(v))]
    table = F.create_map(*cells)
    key = F.concat_ws("|", F.col(regime), F.col(tercile))
    return F.coalesce(F.try_element_at(table, key), F.lit(1.0))


def regime_multiplier(df, labels, profile):
    """Multiplier of the regime on the row's date by a profile map; 1.0 where unmatched."""
    pairs = [x for k, v in profile.items() for x in (F.lit(k), F.lit(float(v)))]
    joined = df.join(labels.select("date", "regime_label"), "date", "left")
    known = F.try_element_at(F.create_map(*pairs), F.coalesce("regime_label", F.lit("")))
    return joined.withColumn("size_multiplier", F.coalesce(known, F.lit(1.0)))


# Fixed value: dollar-volume floor of the liquidity scorer.
VOLUME_FLOOR_USD = 5_000_000.0


def liquidity_score(atr_pct, dollar_volume, friction=0.0016, floor=VOLUME_FLOOR_USD):
    gate = F.least(F.col(dollar_volume) / F.lit(float(floor)), F.lit(1.0))
    return F.pow(F.col(atr_pct), F.lit(5.0)) * gate / F.lit(friction)


def volume_health(slope, kind="linear"):
    x = F.col(slope)
    if kind == "linear":
        return F.greatest(F.lit(0.1), 1 + F.greatest(F.lit(-0.5), F.least(F.lit(0.5), x)))
    if kind == "hard":
        return F.when(x < -0.1, 0.0).otherwise(1.0)
    return 1 / (1 + F.exp(-x * 4))


def cap_bucket(df, shares, bounds=(1e9, 3e9, 6e9, 1.2e10)):
    """Price times current shares outstanding, in five size classes."""
    micro, small, mid, large = bounds
    cap = F.col("close") * F.col("shares_outstanding")
    df = df.join(shares.select("symbol", "shares_outstanding"), "symbol", "left").withColumn("market_cap", cap)
    m = F.col("market_cap")
    return df.withColumn(
        "cap_bucket",
        F.when(m < micro, "micro").when(m < small, "small").when(m < mid, "mid").when(m < large, "large")
        .when(m.isNotNull(), "mega"),
    )


def standardise(df, features, medians, moments):
    """Median impute, then population z.  ``medians``/``moments`` are one-row frames."""
    cols, med, mom = {}, row_of(medians), row_of(moments)
    for f in features:
        x = F.coalesce(finite(f), med[f], F.lit(0.0))
        mean, sd = mom[f"{f}_mean"], mom[f"{f}_sd"]
        cols[f"{f}_z"] = ratio(x - mean, sd)
    return df.withColumns(cols)


def impute_moments(df, features, medians):
    aggs, med = [], row_of(medians)
    for f in features:
        x = F.coalesce(finite(f), med[f], F.lit(0.0))
        aggs += [F.avg(x).alias(f"{f}_mean"), F.stddev_pop(x).alias(f"{f}_sd")]
    return df.agg(*aggs)
