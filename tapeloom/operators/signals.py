"""Signal rows: contract projection, validation, historical regeneration."""

from __future__ import annotations

from pyspark.sql import functions as F

from .rules import cooldown, firings


def literal_table(spark, rows, schema):
    """A fixed list (rules, tiers, windows) as a frame; its size is the list's."""
    return spark.createDataFrame(rows, schema)


def rule_table(spark, rules):
    return literal_table(
        spark, [(r.key, r.conditions_json()) for r in rules], "rule_key string, conditions_json string"
    )


def lift_strength(lift, divisor=3.0):
    return F.least(F.lit(1.0), F.col(lift) / F.lit(divisor))


def ev_strength(ev, divisor):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(ev) / F.lit(divisor)))


def score_strength(score):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))


def contract_rows(deduped, strength, pattern, conditions_json, run_id, horizon=30, expected=None):
    """The nine-column signal contract; ``strength``, ``pattern`` etc. are columns."""
    day = F.date_format("date", "yyyy-MM-dd")
    return deduped.select(
        F.concat_ws("_", F.lit(run_id), "symbol", day, F.lit("ENTRY"), pattern).alias("signal_id"),
        "symbol",
        day.alias("signal_date"),
        F.lit("ENTRY").alias("signal_type"),
        strength.cast("double").alias("signal_strength"),
        pattern.alias("pattern"),
        F.lit(horizon).cast("long").alias("expected_horizon_days"),
        (F.lit(20.0) if expected is None else expected).cast("double").alias("expected_return_pct"),
        conditions_json.alias("conditions_json"),
    )


def validate(signals):
    """Reason a row breaks the contract, or null; ids that repeat are counted apart."""
    s = F.col("signal_strength")
    iso = F.try_to_date(F.col("signal_date"), "yyyy-MM-dd").isNotNull() & F.col("signal_date").rlike(
        r"^\d{4}-\d{2}-\d{2}$"
    )
    reason = (
        F.when(F.coalesce((s < 0) | (s > 1) | F.isnan(s), F.lit(True)), "strength")
        .when(~F.coalesce(F.col("signal_type").isin("ENTRY", "EXIT"), F.lit(False)), "type")
        .when(F.coalesce(F.col("signal_id"), F.lit("")) == "", "id")
        .when(~F.coalesce(iso, F.lit(False)), "date")
        .when(F.coalesce(F.col("symbol"), F.lit("")) == "", "symbol")
    )
    return signals.withColumn("invalid_reason", reason)


def duplicate_ids(signals):
    return signals.groupBy("signal_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def last_dates(df, n):
    """The last ``n`` distinct dates: a top-n over one row per day."""
    return df.select("date").distinct().orderBy(F.col("date").desc()).limit(n)


def historical_entries(features, rules, lift, start, end, days=30, min_strength=0.0, members=None):
    """Firings over a range, deduplicated with a look-back, clipped, with strength."""
    lookback = F.date_sub(F.lit(start).cast("date"), days + 1)
    span = features.where((F.col("date") >= lookback) & (F.col("date") <= F.lit(end).cast("date")))
    kept = cooldown(firings(span, rules), days).where(F.col("date") >= F.lit(start).cast("date"))
    out = kept.join(lift, "rule_key").withColumn("signal_strength", lift_strength("mean_val_lift"))
    out = out.where(F.col("signal_strength") >= min_strength)
    if members is not None:
        out = out.join(members.select("symbol", "date").distinct(), ["symbol", "date"], "left_semi")
    return out.select("symbol", "date", "signal_strength", F.col("rule_key").alias("pattern"))
