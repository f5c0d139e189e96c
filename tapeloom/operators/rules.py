"""Conjunctive rules: evaluation, walk-forward, canonical form, economics, cooldown."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles, running_before
from ..functions.windows import ratio
from ..session import staged
from .chains import keep_clear
from .predicates import OPS, check_op, range_label


@dataclass(frozen=True)
class Rule:
    key: str
    conditions: tuple  # ((feature, op, threshold), ...)
    source: str = ""

    def conditions_json(self):
        import json

        return json.dumps([{"feature": f, "op": o, "threshold": t} for f, o, t in self.conditions])


class RuleTable:
    """Rules as data: distinct conditions, and for every rule which of them it joins.

    A batch of rows is one bit vector per condition, and a rule the conjunction of a few of
    them, so the plan is the same for ten rules and for tens of thousands.  A rule on an
    absent column never fires; a missing or non-finite value meets no condition.
    """

    def __init__(self, rules, columns):
        known = set(columns)
        live = [r for r in rules if all(f in known for f, _, _ in r.conditions)]
        self.keys = np.array([r.key for r in live], object)
        self.features = sorted({f for r in live for f, _, _ in r.conditions})
        place: dict = {}
        self.parts = [[place.setdefault((f, o, float(t)), len(place)) for f, o, t in r.conditions] for r in live]
        self.conditions = list(place)
        for _, op, _ in self.conditions:
            check_op(op)

    def columns(self):
        return [F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(self.features)]

    def fired(self, values):
        """Packed bits of the rows on which each rule holds, rule by rule."""
        n = len(values[0]) if values else 0
        at = {f: i for i, f in enumerate(self.features)}
        usable = [np.isfinite(v) for v in values]
        with np.errstate(invalid="ignore"):
            bits = [np.packbits(OPS[o](values[at[f]], t) & usable[at[f]]) for f, o, t in self.conditions]
        for part in self.parts:
            yield reduce(np.bitwise_and, [bits[k] for k in part]) if part else np.packbits(np.ones(n, bool))

    def pairs(self, values):
        """(row, rule) of every firing, by row and then by rule."""
        n = len(values[0]) if values else 0
        rows = [np.flatnonzero(np.unpackbits(b, count=n)) for b in self.fired(values)]
        rule = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        order = np.argsort(row, kind="stable")
        return row[order], rule[order]


def fired_keys(rules, columns):
    """Array of the keys of all rules that hold on the row."""
    table = RuleTable(rules, columns)
    if not table.features:
        return F.array().cast("array<string>")

    names = pa.array(table.keys, pa.string())

    def keys(*features: pa.Array) -> pa.Array:
        row, rule = table.pairs([f.to_numpy(zero_copy_only=False) for f in features])
        offsets = np.searchsorted(row, np.arange(len(features[0]) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(rule, pa.int64())))

    return F.arrow_udf(keys, "array<string>")(*table.columns())


def firings(df, rules, keep=("symbol", "date")):
    return df.select(*keep, F.explode(fired_keys(rules, df.columns)).alias("rule_key"))


ALL = "*"


def rule_counts(df, rules, label="is_winner", by=()):
    """Rows and positives per (group, rule), with the group's own totals beside them.

    One scan: a task counts bits for every rule and group it meets, the group itself under the
    key ``*``, and the shuffle holds one partial row per (group, rule) and task.
    """
    by = list(by)
    table = RuleTable(rules, df.columns)
    src = df.where(F.col(label).isNotNull()).select(*by, F.col(label).cast("int").alias("_y"), *table.columns())
    types = ", ".join(f"`{c}` {t}" for c, t in src.select(*by).dtypes)
    held = max(1, 2_000_000 // (len(table.keys) + 1))  # groups whose counts a task keeps before it sends them

    def count(batches):
        sums: dict = {}
        for b in batches:
            y = np.packbits(b["_y"].to_numpy(np.int64) == 1)
            fired = list(table.fired([b[f"f{i}"].to_numpy(np.float64) for i in range(len(table.features))]))
            fired.append(np.packbits(np.ones(len(b), bool)))
            place = b.groupby(by, dropna=False, sort=False).ngroup().to_numpy() if by else np.zeros(len(b), np.int64)
            for g, first in zip(*np.unique(place, return_index=True)):
                own = np.packbits(place == g)
                hit = np.empty((len(fired), 2), np.int64)
                for i, bits in enumerate(fired):
                    bits = bits & own
                    hit[i] = np.bitwise_count(bits).sum(), np.bitwise_count(bits & y).sum()
                key = tuple(None if pd.isna(v) else v for v in b[by].iloc[first]) if by else ()
                sums[key] = sums.get(key, 0) + hit
            if len(sums) > held:
                yield from sent(sums)
                sums = {}
        yield from sent(sums)

    def sent(sums):
        names = np.append(table.keys, ALL)
        for group, hit in sums.items():
            some = hit[:, 0] > 0
            out = pd.DataFrame({"rule_key": names[some], "n": hit[some, 0], "h": hit[some, 1]})
            for c, v in zip(reversed(by), reversed(group)):
                out.insert(0, c, v)
            yield out

    d = src.mapInPandas(count, f"{types}, rule_key string, n long, h long".lstrip(", "))
    d = d.groupBy(*by, "rule_key").agg(F.sum("n").alias("coverage_n"), F.sum("h").alias("n_hit"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    own = F.col("rule_key") == ALL
    return d.withColumns(
        {
            "n_rows": F.max(F.when(own, F.col("coverage_n"))).over(w),
            "n_pos": F.max(F.when(own, F.col("n_hit"))).over(w),
        }
    )


def evaluate(df, rules, label="is_winner", by=()):
    """Coverage, precision and lift of every rule that fires, optionally per group."""
    by = list(by)
    hits = rule_counts(df, rules, label, by).where(F.col("rule_key") != ALL)
    return hits.select(
        *by,
        "rule_key",
        "coverage_n",
        "n_hit",
        "n_rows",
        (100.0 * F.col("coverage_n") / F.col("n_rows")).alias("coverage_pct"),
        (F.col("n_hit") / F.col("coverage_n")).alias("precision"),
        ratio(F.col("n_hit") / F.col("coverage_n"), F.col("n_pos") / F.col("n_rows")).alias("lift"),
    )


def examples(df, rules, n=10):
    """First ``n`` firings per rule by (symbol, date); the limit is applied before the shuffle."""
    w = Window.partitionBy("rule_key").orderBy("symbol", "date")
    top = firings(df, rules).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    one = F.struct(F.col("_r"), F.col("symbol"), F.col("date").cast("string").alias("date"))
    packed = F.array_sort(F.collect_list(one))
    return top.groupBy("rule_key").agg(
        F.to_json(F.transform(packed, lambda x: F.struct(x["symbol"].alias("symbol"), x["date"].alias("date")))).alias(
            "example_symbol_dates_json"
        )
    )


def filter_and_rank(evaluated, min_lift, min_coverage_pct, min_precision, max_rules=0):
    """Keep strong rules, renumber by lift x coverage (one row per rule)."""
    kept = evaluated.where(
        (F.col("lift") >= min_lift)
        & (F.col("coverage_pct") >= min_coverage_pct)
        & (F.col("precision") >= min_precision)
    )
    w = Window.orderBy((F.round(F.col("lift") * F.col("coverage_pct"), 6)).desc(), "rule_key")
    out = kept.withColumn("rule_id", F.row_number().over(w) - 1)
    return out.where(F.col("rule_id") < max_rules) if max_rules > 0 else out


def round_significant(x, digits=4):
    """Round to significant figures."""
    x = F.col(x) if isinstance(x, str) else x
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(F.round(x * scale, 0) / scale)


def path_conditions(paths):
    """(path, feature, op, threshold) rows -> (path, conditions) with the tightest bounds.

    A path is one root-to-leaf walk, so the collected list is bounded by the tree depth.
    """
    tight = paths.groupBy("path", "feature", "op").agg(
        F.max("threshold").alias("_hi"), F.min("threshold").alias("_lo")
    )
    tight = tight.withColumn("threshold", F.when(F.col("op") == ">=", F.col("_hi")).otherwise(F.col("_lo")))
    conds = F.array_sort(F.collect_list(F.struct("feature", "op", "threshold")))
    return tight.groupBy("path").agg(conds.alias("conditions"))


def canonical_rules(paths):
    """(path, feature, op, threshold) rows -> distinct rules with the tightest bounds."""
    return (
        path_conditions(paths)
        .groupBy("conditions")
        .agg(F.count(F.lit(1)).alias("n_paths"))
        .withColumn("n_conditions", F.size("conditions").cast("long"))
    )


def window_id(windows, date_col="date"):
    """Index of the walk-forward window a date falls in: a fixed list of ranges, no join."""
    named = {str(i): [w] for i, w in enumerate(windows)}
    return range_label(named, date_col).cast("int")


def walk_forward(df, rules, windows, label="is_winner"):
    """Rule metrics per window, zero rows included where a rule never fires."""
    data = df.withColumn("window_id", window_id(windows)).where(F.col("window_id").isNotNull())
    got = rule_counts(data, rules, label, ["window_id"])
    # one map per window over the fixed rule list, read once per rule
    cell = F.struct("coverage_n", "n_hit")
    per = got.groupBy("window_id").agg(
        F.map_from_entries(F.collect_list(F.struct("rule_key", cell))).alias("m"),
        F.max("n_rows").alias("n"),
        F.max("n_pos").alias("p"),
    )
    d = per.select("window_id", "n", "p", "m", F.explode(F.array(*[F.lit(r.key) for r in rules])).alias("rule_key"))
    got = F.try_element_at("m", F.col("rule_key"))
    match, hit = F.coalesce(got["coverage_n"], F.lit(0)), F.coalesce(got["n_hit"], F.lit(0))
    prec = F.coalesce(F.try_divide(hit, match), F.lit(0.0))
    return d.select(
        "rule_key",
        "window_id",
        F.coalesce(ratio(prec, F.col("p") / F.col("n")), F.lit(0.0)).alias("val_lift"),
        prec.alias("val_precision"),
        (match / F.col("n")).alias("val_coverage"),
        hit.alias("val_n_winners"),
        F.col("n").alias("val_n_samples"),
        match.alias("n_match"),
    )


def survivors(wf, train_lift, lift_min=1.5, decay_max=0.5, relative_decay=False):
    """Aggregate windows per rule and flag rules that hold everywhere.

    Decay is ``train - mean``, or ``1 - mean/train`` when ``relative_decay``.
    """
    agg = wf.groupBy("rule_key").agg(
        F.avg("val_lift").alias("mean_val_lift"),
        F.min("val_lift").alias("min_val_lift"),
        F.max("val_lift").alias("max_val_lift"),
        F.stddev_samp("val_lift").alias("std_val_lift"),
        F.count_if(F.col("val_lift") >= lift_min).alias("n_windows_ge_min"),
        F.avg("val_precision").alias("mean_val_precision"),
        F.avg("val_coverage").alias("mean_val_coverage"),
        F.sum("n_match").alias("total_n_match"),
    )
    out = agg.join(train_lift, "rule_key", "left")
    decay = (
        F.when(F.col("train_lift") > 0, 1.0 - ratio("mean_val_lift", "train_lift"))
        if relative_decay
        else F.col("train_lift") - F.col("mean_val_lift")
    )
    out = out.withColumn("lift_decay", decay)
    calm = F.col("lift_decay") < decay_max
    if relative_decay:
        calm = F.col("lift_decay").isNull() | calm
    return out.withColumn("is_survivor", F.coalesce((F.col("min_val_lift") >= lift_min) & calm, F.lit(False)))


def durability(per_group, groups, min_lift, min_groups, group_col="regime_label"):
    """Pivot lift by group; durable when enough groups pass."""
    kept = per_group.where(F.col("lift") >= min_lift)
    wide = kept.groupBy("rule_key").pivot(group_col, list(groups)).agg(F.max("lift"))
    n = sum((F.col(g).isNotNull().cast("long") for g in groups), F.lit(0).cast("long"))
    return wide.select(
        "rule_key",
        *[F.col(g).alias(f"lift_{g}") for g in groups],
        n.alias("n_regimes_durable"),
        (n >= min_groups).alias("is_durable"),
    )


def feature_stability(ranked, top=20):
    """In how many labels' top rules a feature appears; ``conditions_json`` is parsed."""
    schema = "array<struct<feature:string,op:string,threshold:double>>"
    used = ranked.where(F.col("rule_id") < top).select(
        "label_id", F.explode(F.from_json("conditions_json", schema)).alias("c")
    )
    return used.groupBy(F.col("c.feature").alias("feature_name")).agg(
        F.count_distinct("label_id").alias("n_labels_top"),
        F.array_join(F.array_sort(F.collect_set("label_id")), ",").alias("label_ids_present"),
    )


def cooldown(fired, days, keys=("symbol", "rule_key")):
    """Keep a firing only when more than ``days`` calendar days follow the last kept one.

    A firing without a date is dropped, and firings of one key and day are one.
    """
    day = F.unix_date("date").alias("_day")
    d = fired.where(F.col("date").isNotNull()).select(*keys, day).withColumn("_end", F.col("_day") + days)
    kept = keep_clear(d, keys, "_day", "_end")
    return kept.select(*keys, F.date_from_unix_date(F.col("_day").cast("int")).alias("date"))


def trade_economics(fired, endpoint="forward_endpoint_pct", hold=20):
    """Fires, distinct dates, win rate, mean gain and loss, expected value per rule."""
    fired = staged(fired.select("rule_key", "date", endpoint))
    x = F.col(endpoint)
    win = x > 0
    agg = fired.groupBy("rule_key").agg(
        F.count(F.lit(1)).alias("n_fires"),
        F.count_distinct("date").alias("n_unique_dates"),
        F.avg(x).alias("mean_endpoint_pct"),
        F.coalesce(F.avg(F.when(win, x)), F.lit(0.0)).alias("mean_gain_pct"),
        F.coalesce(F.avg(F.when(~win, x)), F.lit(0.0)).alias("mean_loss_pct"),
        F.avg(win.cast("double")).alias("win_rate"),
    )
    med = exact_quantiles(fired, ["rule_key"], endpoint, {"median_endpoint_pct": 0.5}, stage=False)
    ev = F.col("win_rate") * F.col("mean_gain_pct") + (1.0 - F.col("win_rate")) * F.col("mean_loss_pct")
    agg = agg.join(med, "rule_key").withColumn("ev_per_trade_pct", ev)
    grow = 1.0 + F.col("ev_per_trade_pct") / 100.0
    return agg.withColumns(
        {
            "signal_volume_per_day": F.col("n_fires") / F.col("n_unique_dates"),
            "annualized_return_est": F.pow(grow, F.lit(252.0 / hold)) - 1.0,
        }
    )


def gates(economics, min_ev, min_median, min_win_rate):
    ev, med, win = (
        F.col("ev_per_trade_pct") > min_ev,
        F.col("median_endpoint_pct") >= min_median,
        F.col("win_rate") >= min_win_rate,
    )
    return economics.withColumns(
        {"passes_ev": ev, "passes_median_gain": med, "passes_win_rate": win, "passes_all": ev & med & win}
    )


def threshold_sweep(df, score, label, thresholds, by=()):
    """Precision, recall, lift and fires at each threshold, per group, in one scan.

    Lift is against the base rate of the whole frame.
    """
    by = list(by)
    y, s = F.col(label).cast("int"), F.col(score)
    aggs = [F.count(F.lit(1)).alias("n_samples"), F.sum(y).alias("n_positives")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if(s >= t).alias(f"f{i}"), F.sum(F.when(s >= t, y).otherwise(0)).alias(f"h{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    wide = wide.withColumn("base_all", df.agg(F.avg(y.cast("double")).alias("b")).scalar())
    cells = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"f{i}").alias("n_fires"), F.col(f"h{i}").alias("n_hit"))
            for i, t in enumerate(thresholds)
        ]
    )
    out = wide.select(*by, "n_samples", "n_positives", "base_all", F.inline(cells))
    prec = F.coalesce(ratio(F.col("n_hit").cast("double"), F.col("n_fires").cast("double")), F.lit(0.0))
    return out.select(
        *by,
        "threshold",
        "n_samples",
        "n_fires",
        prec.alias("precision"),
        (F.col("n_hit") / F.greatest(F.col("n_positives"), F.lit(1))).alias("recall"),
        F.coalesce(ratio(prec, "base_all"), F.lit(0.0)).alias("lift"),
    )


def auc(df, score, label, by=()):
    """Exact area under the curve: rank sums with average ranks for ties.

    Rows collapse to distinct scores; the rank prefix is two-level, so no group is
    ranked in one task.
    """
    by = list(by)
    y = F.col(label).cast("long")
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *by, F.col(score).alias("_s"), y.alias("_pos"), (1 - y).alias("_neg")
    )
    r = running_before(d, by, "_s", ["_pos", "_neg"])
    wins = F.sum(F.col("_pos") * (F.col("_neg_before") + F.col("_neg") / 2.0))
    out = r.groupBy(*by).agg(wins.alias("_w"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg")).where("n_pos IS NOT NULL")
    return out.select(
        *by, "n_pos", "n_neg", ratio("_w", (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc")
    )
