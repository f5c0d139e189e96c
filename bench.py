"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from tapeloom.plans import QUERIES
from tapeloom.session import build_session, input_dir, staging

HEADLINE = (
    "f1_sma_distance",
    "f14_macd",
    "f26_feature_matrix",
    "l6_spec_sweep",
    "l8_first_touch_return",
    "u4_rule_evaluation",
    "u6_walk_forward",
    "u11_cooldown_dedup",
    "u12_trade_economics",
    "u16_auc_by_window",
    "x3_barrier_exits",
    "x4_non_overlapping_trades",
    "x10_equity_curve",
    "x12_attribution_matrix",
    "x17_daily_portfolio_curve",
    "a9_pairwise_scan",
    "k1_top_decile",
    "k2_top_per_day",
    "q4_hurst",
    "g7_regime_labels",
    "b1_bars_from_ticks",
    "b2_asof_align",
    "i3_supertrend",
    "i8_rolling_volume_fees",
    "v5_nearest_losers_euclidean",
)


def main():
    folder = input_dir()
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "tapeloom-bench", int(cpus) if cpus.isdigit() else 8)
    times = {}
    # one untimed query starts the JVM and the scan path
    QUERIES["b1_bars_from_ticks"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        t = time.perf_counter()
        with staging():
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
        )
    )


if __name__ == "__main__":
    main()
