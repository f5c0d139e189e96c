"""Rules and signals."""

from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..operators import features as fx
from ..operators import labels as lb
from ..operators import predicates as pr
from ..operators import rules as ru
from ..operators import signals as sg
from ..operators.rules import Rule
from ..session import staged
from .common import E, Tables, emit
from .registry import add_cte, query

RULES = [
    Rule("r00", (("close_over_sma_20", "<", 0.703), ("atr_pct_14", ">=", 1.003)), "L1"),
    Rule("r01", (("close_over_sma_20", "<", 0.503),), "L2"),
    Rule("r02", (("roc_20", "<", -0.4503), ("rsi_14", "<", 45.3)), "L3"),
    Rule("r03", (("rsi_14", ">=", 55.7),), "L4"),
    Rule("r04", (("vol_mult_30", ">=", 1.503), ("close_over_sma_20", "<", 0.903)), "L5"),
    Rule("r05", (("pct_of_60d_high", "<", 0.353),), "L1"),
    Rule("r06", (("pct_of_60d_low", "<", 1.503),), "L2"),
    Rule("r07", (("pct_of_60d_low", ">=", 5.03), ("rsi_14", ">=", 50.7)), "L3"),
    Rule("r08", (("atr_pct_14", ">=", 2.003),), "L4"),
    Rule("r09", (("roc_20", ">=", 1.003), ("vol_mult_30", "<", 0.803)), "L5"),
    Rule("r10", (("close_over_sma_20", "<", 0.903), ("rsi_14", "<", 50.3), ("vol_mult_30", ">=", 0.503)), "L1"),
    Rule("r11", (("close_over_sma_20", ">=", 1.303),), "L2"),
    Rule("r12", (("no_such_feature", ">=", 1.0),), "L3"),
]
LIVE = [r for r in RULES if r.key != "r12"]
WINDOWS = [(f"{y}-01-01", f"{y}-12-31") for y in range(1997, 2002)]
TRAIN_END, VAL_END = "1998-12-31", "1999-12-31"


def rule_frame(t: Tables):
    d = fx.sma_distance(t.series(), (20,))
    d = fx.atr_pct(d)
    d = fx.roc(d, (20,))
    d = fx.rsi(d, (14,))
    d = fx.vol_mult(d, (30,))
    d = fx.n_day_high_low(d, (60,))
    d = lb.forward_winner(d, 30, 2.0, "close_adj")
    return lb.forward_returns(d, 20)


add_cte(
    "rf",
    "SELECT f.symbol, f.date, f.open, f.close, f.close_adj, f.high, f.low, f.volume, close_over_sma_20, atr_pct_14, roc_20, rsi_14, vol_mult_30, "
    "pct_of_60d_high, pct_of_60d_low, is_winner, forward_max_pct, forward_endpoint_pct "
    "FROM features f JOIN fwd20 q USING (symbol, date) JOIN winners w USING (symbol, date)",
)
add_cte(
    "winners",
    "SELECT symbol, date, CASE WHEN count(close_adj) OVER ww = 30 THEN max(close_adj) OVER ww END / nullif(close_adj, 0) >= 3.0 AS is_winner "
    "FROM bars WINDOW ww AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)",
)


def rule_sql(r):
    return " AND ".join(f"{f} {o} {t}" for f, o, t in r.conditions)


add_cte(
    "fired",
    " UNION ALL ".join(
        f"SELECT symbol, date, '{r.key}' AS rule_key, is_winner, forward_endpoint_pct, forward_max_pct, close_adj FROM rf WHERE {rule_sql(r)}"
        for r in LIVE
    ),
)
EVAL = (
    "SELECT rule_key, coverage_n, n_hit, 100.0 * coverage_n / n_rows AS coverage_pct, n_hit / coverage_n AS precision, "
    "(n_hit / coverage_n) / (n_pos / n_rows) AS lift FROM "
    "(SELECT rule_key, count(*) AS coverage_n, count(*) FILTER (is_winner) AS n_hit FROM fired WHERE is_winner IS NOT NULL {w} GROUP BY rule_key), "
    "(SELECT count(*) AS n_rows, count(*) FILTER (is_winner) AS n_pos FROM rf WHERE is_winner IS NOT NULL {w})"
)
add_cte("eval_all", EVAL.format(w=""))
EVAL_SPEC = "rule_key coverage_n n_hit f:coverage_pct f:precision f:lift"


@query("u4_rule_evaluation", E(EVAL_SPEC, "SELECT * FROM eval_all"))
def u4(spark, sf):
    d = ru.evaluate(rule_frame(Tables(spark, sf)), RULES)
    return emit(d, "rule_key", "coverage_n", "n_hit", "coverage_pct", "precision", "lift")


@query(
    "u4_rule_examples",
    "SELECT rule_key, '[' || string_agg('{\"symbol\":\"' || symbol || '\",\"date\":\"' || CAST(date AS VARCHAR) || '\"}', ',' ORDER BY symbol, date) || ']' "
    "AS example_symbol_dates_json FROM (SELECT *, row_number() OVER (PARTITION BY rule_key ORDER BY symbol, date) AS r FROM fired) WHERE r <= 10 GROUP BY rule_key",
)
def u4x(spark, sf):
    return ru.examples(rule_frame(Tables(spark, sf)), RULES)


@query(
    "p3_condition_operators",
    "SELECT count(*) FILTER (rsi_14 < 40) AS lt, count(*) FILTER (rsi_14 <= 40) AS le, count(*) FILTER (rsi_14 > 40) AS gt, "
    "count(*) FILTER (rsi_14 >= 40) AS ge, count(*) FILTER (volume = 25) AS eq, count(*) FILTER (volume <> 25) AS ne FROM rf",
)
def p3(spark, sf):
    d = rule_frame(Tables(spark, sf))
    cs = [("rsi_14", "<", 40), ("rsi_14", "<=", 40), ("rsi_14", ">", 40), ("rsi_14", ">=", 40)]
    cs += [("volume", "==", 25), ("volume", "!=", 25)]
    return d.agg(*[F.count_if(pr.condition(*c)).alias(n) for c, n in zip(cs, ("lt", "le", "gt", "ge", "eq", "ne"))])


@query(
    "j9_rows_by_rules",
    "SELECT symbol, CAST(date AS VARCHAR) AS date, rule_key FROM fired",
)
def j9(spark, sf):
    return emit(ru.firings(rule_frame(Tables(spark, sf)), RULES), "symbol", "date", "rule_key")


@query(
    "u10_firings_in_window",
    "SELECT symbol, CAST(date AS VARCHAR) AS date, rule_key FROM fired WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'",
)
def u10(spark, sf):
    d = rule_frame(Tables(spark, sf)).where(pr.in_ranges([("2000-01-01", "2000-12-31")]))
    return emit(ru.firings(d, RULES), "symbol", "date", "rule_key")


GRID_FEATURES = ("close_over_sma_20", "roc_20", "rsi_14", "vol_mult_30", "pct_of_60d_high")
# ten cut points per feature; every pair of features and of cuts is a rule: 2,000 in all
GRID_CUTS = {
    "close_over_sma_20": (0.5, 0.153), "roc_20": (-0.7, 0.305), "rsi_14": (30.5, 4.3), "vol_mult_30": (0.3, 0.203), "pct_of_60d_high": (0.1, 0.093)
}


def grid_rules():
    cut = {f: [round(a + b * i, 6) for i in range(10)] for f, (a, b) in GRID_CUTS.items()}
    return [
        Rule(f"{f}>={cut[f][i]:.6f} & {g}<{cut[g][j]:.6f}", ((f, ">=", cut[f][i]), (g, "<", cut[g][j])))
        for f in GRID_FEATURES
        for g in GRID_FEATURES
        if f != g
        for i in range(10)
        for j in range(10)
    ]


add_cte(
    "grid_cuts",
    " UNION ALL ".join(
        f"SELECT '{f}' AS f, round(CAST({a} AS DOUBLE) + CAST({b} AS DOUBLE) * i, 6) AS c FROM range(10) r(i)" for f, (a, b) in GRID_CUTS.items()
    ),
)
add_cte(
    "grid_rows",
    "SELECT row_number() OVER () AS rid, is_winner, " + ", ".join(GRID_FEATURES) + " FROM rf WHERE is_winner IS NOT NULL",
)
_GRID = " UNION ALL ".join(f"SELECT '{f}' AS f, rid, is_winner, {f} AS v FROM grid_rows" for f in GRID_FEATURES)


@query(
    "u4_rule_table",
    E(
        EVAL_SPEC,
        "WITH g AS (" + _GRID + "), cutrow AS (SELECT g.rid, g.is_winner, g.f, c.c, g.v >= c.c AS over FROM g JOIN grid_cuts c ON c.f = g.f WHERE g.v IS NOT NULL) "
        "SELECT rule_key, m AS coverage_n, h AS n_hit, 100.0 * m / n AS coverage_pct, h / m AS precision, (h / m) / (p / n) AS lift FROM ("
        "SELECT printf('%s>=%.6f & %s<%.6f', a.f, a.c, b.f, b.c) AS rule_key, count(*) AS m, count(*) FILTER (a.is_winner) AS h "
        "FROM cutrow a JOIN cutrow b ON a.rid = b.rid AND a.f <> b.f WHERE a.over AND NOT b.over GROUP BY 1) z, "
        "(SELECT count(*) AS n, count(*) FILTER (is_winner) AS p FROM grid_rows) t",
    ),
)
def u4t(spark, sf):
    """Two thousand rules at once, as a table."""
    d = ru.evaluate(rule_frame(Tables(spark, sf)), grid_rules())
    return emit(d, "rule_key", "coverage_n", "n_hit", "coverage_pct", "precision", "lift")


# --- model paths and canonical rules ---------------------------------------------------


@query(
    "u2_round_significant",
    E(
        "symbol f:rounded_price f:rounded_ratio",
        "SELECT symbol, "
        + ", ".join(
            f"round({x} * pow(10.0, 3 - floor(log10(abs({x}))))) / pow(10.0, 3 - floor(log10(abs({x})))) AS {n}"
            for x, n in (("p", "rounded_price"), ("q", "rounded_ratio"))
        )
        + " FROM (SELECT symbol, median(close) AS p, median(close / high) AS q FROM bars GROUP BY symbol)",
    ),
)
def u2(spark, sf):
    # one symbol's bars are bounded by the calendar, so the built-in percentile serves
    d = Tables(spark, sf).bars().groupBy("symbol").agg(
        F.percentile("close", 0.5).alias("p"), F.percentile(F.col("close") / F.col("high"), 0.5).alias("q")
    )
    d = d.select(
        "symbol",
        ru.round_significant("p").alias("rounded_price"),
        ru.round_significant("q").alias("rounded_ratio"),
    )
    return emit(d)


def _sig1(x):
    return f"CASE WHEN {x} = 0 THEN 0 ELSE round({x} * pow(10.0, -floor(log10(abs({x}))))) / pow(10.0, -floor(log10(abs({x})))) END"


add_cte(
    "paths",
    "SELECT path, feature, op, " + _sig1("t") + " AS threshold FROM ("
    "SELECT symbol AS path, 'price' AS feature, '>=' AS op, quantile_cont(close, 0.25) AS t FROM bars GROUP BY symbol UNION ALL "
    "SELECT symbol, 'price', '>=', quantile_cont(close, 0.4) FROM bars GROUP BY symbol UNION ALL "
    "SELECT symbol, 'price', '<', quantile_cont(close, 0.75) FROM bars GROUP BY symbol UNION ALL "
    "SELECT symbol, 'volume', '<', quantile_cont(CAST(volume AS DOUBLE), 0.6) FROM bars GROUP BY symbol UNION ALL "
    "SELECT symbol, 'volume', '<', quantile_cont(CAST(volume AS DOUBLE), 0.7) FROM bars GROUP BY symbol)",
)


@query(
    "u3_canonical_rules",
    "SELECT rule, count(*) AS n_paths, max(n) AS n_conditions FROM (SELECT path, string_agg(feature || op || CAST(CAST(threshold AS BIGINT) AS VARCHAR), ' & ' ORDER BY feature, op) AS rule, count(*) AS n "
    "FROM (SELECT path, feature, op, CASE WHEN op = '>=' THEN max(threshold) ELSE min(threshold) END AS threshold FROM paths GROUP BY path, feature, op) GROUP BY path) GROUP BY rule",
)
def u3(spark, sf):
    b = Tables(spark, sf).bars().groupBy("symbol").agg(
        F.percentile("close", F.array(F.lit(0.25), F.lit(0.4), F.lit(0.75))).alias("p"),
        F.percentile(F.col("volume").cast("double"), F.array(F.lit(0.6), F.lit(0.7))).alias("v"),
    )

    def cond(f, op, t):
        return F.struct(F.lit(f).alias("feature"), F.lit(op).alias("op"), ru.round_significant(t, 1).alias("threshold"))

    p, v = F.col("p"), F.col("v")
    conds = [cond("price", ">=", p[0]), cond("price", ">=", p[1]), cond("price", "<", p[2])]
    conds += [cond("volume", "<", v[0]), cond("volume", "<", v[1])]
    paths = b.select(F.col("symbol").alias("path"), F.inline(F.array(*conds)))
    text = F.transform(
        "conditions", lambda c: F.concat(c["feature"], c["op"], c["threshold"].cast("long").cast("string"))
    )
    return ru.canonical_rules(paths).select(F.array_join(text, " & ").alias("rule"), "n_paths", "n_conditions")


@query(
    "u5_filter_and_rank",
    E(
        "i:rule_id rule_key f:lift f:coverage_pct",
        "SELECT *, row_number() OVER (ORDER BY round(lift * coverage_pct, 6) DESC, rule_key) - 1 AS rule_id FROM eval_all "
        "WHERE lift >= 1.05 AND coverage_pct >= 1.0 AND precision >= 0.3",
    ),
)
def u5(spark, sf):
    d = ru.evaluate(rule_frame(Tables(spark, sf)), RULES)
    d = ru.filter_and_rank(d, 1.05, 1.0, 0.3)
    return emit(d.withColumn("rule_id", F.col("rule_id").cast("long")), "rule_id", "rule_key", "lift", "coverage_pct")


add_cte(
    "wf_windows",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, DATE '{lo}', DATE '{hi}')" for i, (lo, hi) in enumerate(WINDOWS))
    + ") v(window_id, lo, hi)",
)
add_cte(
    "wf_base",
    "SELECT window_id, count(*) AS n, count(*) FILTER (is_winner) AS p FROM rf JOIN wf_windows ON date BETWEEN lo AND hi "
    "WHERE is_winner IS NOT NULL GROUP BY window_id",
)
add_cte(
    "wf",
    "SELECT k.rule_key, b.window_id, n AS val_n_samples, coalesce(m, 0) AS n_match, coalesce(h, 0) AS val_n_winners, "
    "coalesce(h / m, 0) AS val_precision, coalesce((h / m) / nullif(p / n, 0), 0) AS val_lift, coalesce(m / n, 0) AS val_coverage "
    f"FROM (SELECT unnest([{', '.join(repr(r.key) for r in RULES)}]) AS rule_key) k CROSS JOIN wf_base b LEFT JOIN "
    "(SELECT rule_key, window_id, count(*) AS m, count(*) FILTER (is_winner) AS h FROM fired JOIN wf_windows ON date BETWEEN lo AND hi "
    "WHERE is_winner IS NOT NULL GROUP BY ALL) f ON f.rule_key = k.rule_key AND f.window_id = b.window_id",
)
WF_SPEC = "rule_key i:window_id f:val_lift f:val_precision f:val_coverage i:val_n_winners i:val_n_samples"


@query("u6_walk_forward", E(WF_SPEC, "SELECT * FROM wf"))
def u6(spark, sf):
    d = ru.walk_forward(rule_frame(Tables(spark, sf)), RULES, WINDOWS)
    d = d.withColumn("window_id", F.col("window_id").cast("long"))
    return emit(d, "rule_key", "window_id", "val_lift", "val_precision", "val_coverage", "val_n_winners", "val_n_samples")


add_cte("eval_train", EVAL.format(w="AND date <= DATE '1998-12-31'"))


def surv_sql(decay, lift_min, calm):
    return (
        f"SELECT *, coalesce(min_val_lift >= {lift_min} AND {calm}, false) AS is_survivor FROM (SELECT *, {decay} AS lift_decay FROM "
        "(SELECT rule_key, avg(val_lift) AS mean_val_lift, min(val_lift) AS min_val_lift, max(val_lift) AS max_val_lift, stddev_samp(val_lift) AS std_val_lift, "
        f"count(*) FILTER (val_lift >= {lift_min}) AS n_windows_ge_min, avg(val_precision) AS mean_val_precision, avg(val_coverage) AS mean_val_coverage, CAST(sum(n_match) AS BIGINT) AS total_n_match "
        "FROM wf GROUP BY rule_key) LEFT JOIN (SELECT rule_key, lift AS train_lift FROM eval_train) USING (rule_key))"
    )


SURV_SPEC = (
    "rule_key f:train_lift f:mean_val_lift f:min_val_lift f:max_val_lift f:std_val_lift n_windows_ge_min "
    "f:mean_val_precision f:mean_val_coverage total_n_match f:lift_decay b:is_survivor"
)
SURV_COLS = [x.rpartition(":")[2] for x in SURV_SPEC.split()]
add_cte("surv", surv_sql("train_lift - mean_val_lift", 1.02, "lift_decay < 0.5"))


def train_and_walk(t):
    d = rule_frame(t)
    train = ru.evaluate(d.where(F.col("date") <= F.lit(TRAIN_END).cast("date")), RULES)
    return d, train.select("rule_key", F.col("lift").alias("train_lift")), ru.walk_forward(d, RULES, WINDOWS)


@query("u7_survivors_absolute_decay", E(SURV_SPEC, "SELECT * FROM surv"))
def u7(spark, sf):
    _, train, wf = train_and_walk(Tables(spark, sf, share=True))
    return emit(ru.survivors(wf, train, 1.02, 0.5), *SURV_COLS)


@query(
    "u7_survivors_relative_decay",
    E(SURV_SPEC, surv_sql("CASE WHEN train_lift > 0 THEN 1 - mean_val_lift / train_lift END", 1.2, "(lift_decay IS NULL OR lift_decay < 0.5)")),
)
def u7b(spark, sf):
    _, train, wf = train_and_walk(Tables(spark, sf, share=True))
    return emit(ru.survivors(wf, train, 1.2, 0.5, True), *SURV_COLS)


RANGES = {
    "bull": [("1996-01-01", "1997-06-30")],
    "bear": [("1997-07-01", "1998-06-30")],
    "chop": [("1998-07-01", "1998-12-31"), ("2000-01-01", "2000-08-31")],
    "recovery": [("1999-01-01", "1999-12-31")],
}
add_cte(
    "ranged",
    "SELECT *, CASE "
    + " ".join(
        "WHEN " + " OR ".join(f"date BETWEEN DATE '{lo}' AND DATE '{hi}'" for lo, hi in rs) + f" THEN '{n}'"
        for n, rs in RANGES.items()
    )
    + " END AS regime_label FROM fired WHERE is_winner IS NOT NULL",
)
add_cte(
    "regime_eval",
    "SELECT rule_key, regime_label, m AS coverage_n, (h / m) / (p / n) AS lift, 100.0 * m / n AS coverage_pct, h / m AS precision FROM "
    "(SELECT rule_key, regime_label, count(*) AS m, count(*) FILTER (is_winner) AS h FROM ranged WHERE regime_label IS NOT NULL GROUP BY ALL) "
    "JOIN (SELECT CASE "
    + " ".join(
        "WHEN " + " OR ".join(f"date BETWEEN DATE '{lo}' AND DATE '{hi}'" for lo, hi in rs) + f" THEN '{n}'"
        for n, rs in RANGES.items()
    )
    + " END AS regime_label, count(*) AS n, count(*) FILTER (is_winner) AS p FROM rf WHERE is_winner IS NOT NULL GROUP BY 1) USING (regime_label)",
)


def regime_eval(t):
    d = rule_frame(t).withColumn("regime_label", pr.range_label(RANGES)).where(F.col("regime_label").isNotNull())
    return ru.evaluate(d, RULES, by=["regime_label"])


@query(
    "u8_regime_evaluation",
    E("rule_key regime_label coverage_n f:lift f:coverage_pct f:precision", "SELECT * FROM regime_eval"),
)
def u8(spark, sf):
    return emit(regime_eval(Tables(spark, sf)), "rule_key", "regime_label", "coverage_n", "lift", "coverage_pct", "precision")


@query(
    "u8_regime_durability",
    E(
        "rule_key f:lift_bull f:lift_bear f:lift_chop f:lift_recovery i:n_regimes_durable b:is_durable",
        "SELECT rule_key, max(lift) FILTER (regime_label = 'bull') AS lift_bull, max(lift) FILTER (regime_label = 'bear') AS lift_bear, "
        "max(lift) FILTER (regime_label = 'chop') AS lift_chop, max(lift) FILTER (regime_label = 'recovery') AS lift_recovery, "
        "count(*) AS n_regimes_durable, count(*) >= 3 AS is_durable FROM regime_eval WHERE lift >= 1.05 GROUP BY rule_key",
    ),
)
def u8b(spark, sf):
    return emit(ru.durability(regime_eval(Tables(spark, sf)), list(RANGES), 1.05, 3))


LABEL_NAMES = ("lbl_L1", "lbl_L2", "lbl_L3", "lbl_L4", "lbl_L5")
add_cte("families", "SELECT symbol, date, lbl_L1, lbl_L2, lbl_L3, lbl_L4, lbl_L5 FROM ({})".format(
    __import__("tapeloom.plans.q_labels", fromlist=["FAMILY"]).FAMILY))
add_cte(
    "label_ranked",
    " UNION ALL ".join(
        f"SELECT '{n}' AS label_id, rule_key, row_number() OVER (ORDER BY round(lift * coverage_pct, 6) DESC, rule_key) - 1 AS rule_id FROM ("
        "SELECT rule_key, (h / m) / (p / n) AS lift, 100.0 * m / n AS coverage_pct, h / m AS precision FROM "
        f"(SELECT rule_key, count(*) AS m, count(*) FILTER ({n}) AS h FROM fired JOIN families USING (symbol, date) WHERE {n} IS NOT NULL GROUP BY 1), "
        f"(SELECT count(*) AS n, count(*) FILTER ({n}) AS p FROM families WHERE {n} IS NOT NULL)) WHERE lift >= 1.02 AND coverage_pct >= 1.0 AND precision >= 0.1"
        for n in LABEL_NAMES
    ),
)
_RULE_FEATURES = ", ".join(f"('{r.key}', '{f}')" for r in LIVE for f in dict.fromkeys(c[0] for c in r.conditions))


@query(
    "u9_feature_stability",
    "SELECT feature_name, count(DISTINCT label_id) AS n_labels_top, string_agg(DISTINCT label_id, ',' ORDER BY label_id) AS label_ids_present "
    f"FROM label_ranked JOIN (VALUES {_RULE_FEATURES}) v(rule_key, feature_name) USING (rule_key) WHERE rule_id < 20 GROUP BY 1",
)
def u9(spark, sf):
    d = lb.label_family(rule_frame(Tables(spark, sf)), 10.0)
    d = staged(d.select("symbol", "date", *LABEL_NAMES, *sorted({c[0] for r in LIVE for c in r.conditions})))
    ranked = None
    table = sg.rule_table(spark, LIVE)
    for n in LABEL_NAMES:
        one = ru.filter_and_rank(ru.evaluate(d, LIVE, n), 1.02, 1.0, 0.1).select("rule_key", "rule_id")
        one = one.join(table, "rule_key").withColumn("label_id", F.lit(n))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ru.feature_stability(ranked, 20)


# --- cooldown, contract, validation ----------------------------------------------------

COOL = """WITH RECURSIVE c AS (
    SELECT symbol, rule_key, min(date) AS date FROM fired GROUP BY 1, 2
    UNION ALL
    SELECT c.symbol, c.rule_key, n.date FROM c JOIN (SELECT DISTINCT symbol, rule_key, date FROM fired) n
      ON n.symbol = c.symbol AND n.rule_key = c.rule_key AND n.date > c.date + 30
    QUALIFY row_number() OVER (PARTITION BY c.symbol, c.rule_key ORDER BY n.date) = 1)
"""
COOL = COOL.replace(
    """    SELECT c.symbol, c.rule_key, n.date FROM c JOIN (SELECT DISTINCT symbol, rule_key, date FROM fired) n
      ON n.symbol = c.symbol AND n.rule_key = c.rule_key AND n.date > c.date + 30
    QUALIFY row_number() OVER (PARTITION BY c.symbol, c.rule_key ORDER BY n.date) = 1)""",
    """    SELECT symbol, rule_key, nxt FROM (
      SELECT c.symbol, c.rule_key, min(n.date) AS nxt FROM c JOIN fired n
        ON n.symbol = c.symbol AND n.rule_key = c.rule_key AND n.date > c.date + 30 GROUP BY 1, 2) z)""",
)


@query("u11_cooldown_dedup", COOL + "SELECT symbol, rule_key, CAST(date AS VARCHAR) AS date FROM c")
def u11(spark, sf):
    fired = ru.firings(rule_frame(Tables(spark, sf)), RULES)
    return emit(ru.cooldown(fired, 30), "symbol", "rule_key", "date")


_JSON = ", ".join(f"('{r.key}', '{r.conditions_json()}')" for r in LIVE)
ENTRY_COLS = (
    "signal_id symbol signal_date signal_type f:signal_strength pattern i:expected_horizon_days "
    "f:expected_return_pct conditions_json"
)
_DAYS = "(SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 60)"


def entry_signals(t: Tables):
    d, train, wf = train_and_walk(t)
    good = ru.survivors(wf, train, 1.02, 0.5).where("is_survivor").select("rule_key", "mean_val_lift")
    kept = ru.cooldown(ru.firings(d, LIVE), 30).join(sg.last_dates(t.bars(), 60), "date", "left_semi")
    kept = kept.join(good, "rule_key").join(sg.rule_table(t.spark, LIVE), "rule_key")
    return sg.contract_rows(
        kept, sg.lift_strength("mean_val_lift"), F.col("rule_key"), F.col("conditions_json"), "2001-12-31-001"
    )


add_cte("cooled", COOL + "SELECT * FROM c")
add_cte(
    "entry_signals",
    "SELECT '2001-12-31-001_' || symbol || '_' || CAST(date AS VARCHAR) || '_ENTRY_' || rule_key AS signal_id, symbol, CAST(date AS VARCHAR) AS signal_date, 'ENTRY' AS signal_type, "
    "least(1.0, mean_val_lift / 3.0) AS signal_strength, rule_key AS pattern, 30 AS expected_horizon_days, 20.0 AS expected_return_pct, conditions_json "
    f"FROM cooled JOIN surv USING (rule_key) JOIN (VALUES {_JSON}) v(rule_key, conditions_json) USING (rule_key) WHERE is_survivor AND date IN {_DAYS}",
)


@query("p12_contract_rows_lift", E(ENTRY_COLS, "SELECT * FROM entry_signals"))
def p12(spark, sf):
    return emit(entry_signals(Tables(spark, sf, share=True)))


def ev_signals(t):
    d = rule_frame(t)
    fired = ru.firings(d.where(F.col("forward_endpoint_pct").isNotNull()), LIVE, ("symbol", "date", "forward_endpoint_pct"))
    eco = ru.trade_economics(fired).select("rule_key", "ev_per_trade_pct", "mean_endpoint_pct")
    kept = ru.cooldown(ru.firings(d, LIVE), 20).join(sg.last_dates(t.bars(), 30), "date", "left_semi")
    kept = kept.join(eco, "rule_key").join(sg.rule_table(t.spark, LIVE), "rule_key")
    pattern = F.concat(F.lit("sw1_g200_rule_"), F.col("rule_key"))
    capped = F.round(F.least(F.col("mean_endpoint_pct"), F.lit(60.0)), 2)
    return sg.contract_rows(
        kept, sg.ev_strength("ev_per_trade_pct", 500.0), pattern, F.col("conditions_json"), "2001-12-31-002", 20, capped
    )


@query(
    "p12_contract_rows_ev_capped",
    E(
        ENTRY_COLS,
        "SELECT '2001-12-31-002_' || symbol || '_' || CAST(date AS VARCHAR) || '_ENTRY_sw1_g200_rule_' || rule_key AS signal_id, symbol, CAST(date AS VARCHAR) AS signal_date, 'ENTRY' AS signal_type, "
        "least(1.0, greatest(0.0, ev / 500.0)) AS signal_strength, 'sw1_g200_rule_' || rule_key AS pattern, 20 AS expected_horizon_days, round(least(me, 60.0), 2) AS expected_return_pct, conditions_json FROM ("
        + COOL.replace("date > c.date + 30", "date > c.date + 20")
        + "SELECT * FROM c) JOIN (SELECT rule_key, avg(forward_endpoint_pct) AS me, "
        "avg(CASE WHEN forward_endpoint_pct > 0 THEN 1.0 ELSE 0.0 END) * coalesce(avg(forward_endpoint_pct) FILTER (forward_endpoint_pct > 0), 0) + "
        "(1 - avg(CASE WHEN forward_endpoint_pct > 0 THEN 1.0 ELSE 0.0 END)) * coalesce(avg(forward_endpoint_pct) FILTER (forward_endpoint_pct <= 0), 0) AS ev "
        "FROM fired WHERE forward_endpoint_pct IS NOT NULL GROUP BY 1) USING (rule_key) "
        f"JOIN (VALUES {_JSON}) v(rule_key, conditions_json) USING (rule_key) WHERE date IN (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 30)",
    ),
)
def p12b(spark, sf):
    return emit(ev_signals(Tables(spark, sf, share=True)))


@query(
    "p11_signal_validation",
    "SELECT CAST(NULL AS VARCHAR) AS invalid_reason, count(*) AS n, "
    "(SELECT count(*) FROM (SELECT 1 FROM entry_signals GROUP BY signal_id HAVING count(*) > 1)) AS n_duplicate_ids FROM entry_signals HAVING count(*) > 0",
)
def p11(spark, sf):
    s = entry_signals(Tables(spark, sf, share=True))
    n_dup = sg.duplicate_ids(s).agg(F.count(F.lit(1)).alias("n")).scalar()
    v = sg.validate(s).groupBy("invalid_reason").agg(F.count(F.lit(1)).alias("n"))
    return v.withColumn("n_duplicate_ids", n_dup)


# --- economics and sweeps --------------------------------------------------------------

add_cte("fired_ret", "SELECT * FROM fired WHERE forward_endpoint_pct IS NOT NULL AND close_adj >= 1")
add_cte(
    "economics",
    "SELECT *, n_fires / n_unique_dates AS signal_volume_per_day, pow(1 + ev_per_trade_pct / 100, 12.6) - 1 AS annualized_return_est FROM ("
    "SELECT *, win_rate * mean_gain_pct + (1 - win_rate) * mean_loss_pct AS ev_per_trade_pct FROM ("
    "SELECT rule_key, count(*) AS n_fires, count(DISTINCT date) AS n_unique_dates, avg(forward_endpoint_pct) AS mean_endpoint_pct, median(forward_endpoint_pct) AS median_endpoint_pct, "
    "coalesce(avg(forward_endpoint_pct) FILTER (forward_endpoint_pct > 0), 0) AS mean_gain_pct, coalesce(avg(forward_endpoint_pct) FILTER (forward_endpoint_pct <= 0), 0) AS mean_loss_pct, "
    "avg(CASE WHEN forward_endpoint_pct > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM fired_ret GROUP BY rule_key))",
)
ECO_SPEC = (
    "rule_key n_fires n_unique_dates f:mean_endpoint_pct f:median_endpoint_pct f:mean_gain_pct f:mean_loss_pct "
    "f:win_rate f:ev_per_trade_pct f:signal_volume_per_day"
)
ECO_COLS = [x.rpartition(":")[2] for x in ECO_SPEC.split()]


def fired_returns(t):
    d = rule_frame(t).where(F.col("forward_endpoint_pct").isNotNull() & (F.col("close_adj") >= 1))
    return ru.firings(d, LIVE, ("symbol", "date", "forward_endpoint_pct"))


@query("u12_trade_economics", E(ECO_SPEC + " f:log_annualized", "SELECT *, ln(1 + annualized_return_est) AS log_annualized FROM economics"))
def u12(spark, sf):
    d = ru.trade_economics(fired_returns(Tables(spark, sf)))
    d = d.withColumn("log_annualized", F.ln(1 + F.col("annualized_return_est")))
    return emit(d, *ECO_COLS, "log_annualized")


GATE_SQL = (
    "SELECT *, ev_per_trade_pct > 150 AS passes_ev, median_endpoint_pct >= 10 AS passes_median_gain, win_rate >= 0.55 AS passes_win_rate, "
    "ev_per_trade_pct > 150 AND median_endpoint_pct >= 10 AND win_rate >= 0.55 AS passes_all FROM economics"
)


@query(
    "u13_gates",
    E("rule_key b:passes_ev b:passes_median_gain b:passes_win_rate b:passes_all", GATE_SQL),
)
def u13(spark, sf):
    d = ru.gates(ru.trade_economics(fired_returns(Tables(spark, sf))), 150.0, 10.0, 0.55)
    return emit(d, "rule_key", "passes_ev", "passes_median_gain", "passes_win_rate", "passes_all")


@query(
    "a4_weighted_rule_means",
    E(
        "i:total_fires f:weighted_ev f:weighted_win_rate f:median_of_medians",
        "SELECT sum(n_fires) AS total_fires, sum(ev_per_trade_pct * n_fires) / sum(n_fires) AS weighted_ev, "
        "sum(win_rate * n_fires) / sum(n_fires) AS weighted_win_rate, median(median_endpoint_pct) AS median_of_medians FROM economics",
    ),
)
def a4(spark, sf):
    d = ru.trade_economics(fired_returns(Tables(spark, sf)))
    n = F.col("n_fires")
    return emit(
        d.agg(
            F.sum(n).alias("total_fires"),
            (F.sum(F.col("ev_per_trade_pct") * n) / F.sum(n)).alias("weighted_ev"),
            (F.sum(F.col("win_rate") * n) / F.sum(n)).alias("weighted_win_rate"),
            # one value per rule: a bounded list
            F.percentile("median_endpoint_pct", 0.5).alias("median_of_medians"),
        )
    )


# the score of a row: share of the live rules it fires
SCORE_SQL = (
    "SELECT symbol, date, is_winner, ("
    + " + ".join(f"coalesce(CAST({rule_sql(r)} AS INT), 0)" for r in LIVE)
    + f") / {float(len(LIVE))} AS score FROM rf WHERE is_winner IS NOT NULL"
)
add_cte("scored", SCORE_SQL)
add_cte("scored_w", "SELECT * FROM scored JOIN wf_windows ON date BETWEEN lo AND hi")
TAUS = (0.2, 0.3, 0.45)


def scored(t, prepare=lambda d: d):
    d = prepare(rule_frame(t)).where(F.col("is_winner").isNotNull())
    n = F.size(ru.fired_keys(LIVE, d.columns)) / F.lit(float(len(LIVE)))
    return d.withColumn("score", n).withColumn("window_id", ru.window_id(WINDOWS).cast("long"))


@query(
    "u14_threshold_sweep",
    E(
        "i:window_id f:threshold n_samples n_fires f:precision f:recall f:lift",
        " UNION ALL ".join(
            f"SELECT window_id, {t} AS threshold, count(*) AS n_samples, count(*) FILTER (score >= {t}) AS n_fires, "
            f"coalesce(avg(CAST(is_winner AS INT)) FILTER (score >= {t}), 0) AS precision, "
            f"count(*) FILTER (score >= {t} AND is_winner) / greatest(count(*) FILTER (is_winner), 1) AS recall, "
            f"coalesce(avg(CAST(is_winner AS INT)) FILTER (score >= {t}), 0) / (SELECT avg(CAST(is_winner AS INT)) FROM scored_w) AS lift FROM scored_w GROUP BY window_id"
            for t in TAUS
        ),
    ),
)
def u14(spark, sf):
    d = scored(Tables(spark, sf, share=True)).where(F.col("window_id").isNotNull())
    return emit(ru.threshold_sweep(d, "score", "is_winner", TAUS, ["window_id"]))


_PASS = "ev > 100 AND win_rate >= 0.5 AND median_gain >= 5 AND mean_hold >= 10 AND n_fires >= 50"
add_cte("score_ret", "SELECT s.symbol, s.date, s.score, r.bsq_realized_gain_pct AS g, r.bsq_hold_trading_days AS h FROM scored s JOIN realized60 r USING (symbol, date) WHERE r.bsq_realized_gain_pct IS NOT NULL")
add_cte(
    "score_sweep",
    " UNION ALL ".join(
        f"SELECT {t} AS threshold, count(*) AS n_fires, count(DISTINCT date) AS n_unique_dates, avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, median(g) AS median_gain, "
        "coalesce(avg(g) FILTER (g > 0), 0) AS mean_gain, coalesce(avg(g) FILTER (g <= 0), 0) AS mean_loss, avg(h) AS mean_hold, "
        "avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END) * coalesce(avg(g) FILTER (g > 0), 0) + (1 - avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END)) * coalesce(avg(g) FILTER (g <= 0), 0) AS ev "
        f"FROM score_ret WHERE score >= {t}"
        for t in TAUS
    ),
)


@query(
    "u15_economics_sweep",
    E(
        "f:threshold n_fires n_unique_dates f:win_rate f:median_gain f:mean_gain f:mean_loss f:mean_hold f:ev b:passes_all b:is_highest_passing",
        f"SELECT *, coalesce(threshold = max(CASE WHEN passes_all THEN threshold END) OVER (), false) AS is_highest_passing FROM (SELECT *, {_PASS} AS passes_all FROM score_sweep)",
    ),
)
def u15(spark, sf):
    t = Tables(spark, sf, share=True)
    d = scored(t, lambda x: lb.first_touch_return(x, 60, 200.0)).where(F.col("bsq_realized_gain_pct").isNotNull())
    taus = F.array(*[F.when(F.col("score") >= x, F.lit(float(x))) for x in TAUS])
    d = d.select("date", F.col("bsq_realized_gain_pct").alias("g"), F.col("bsq_hold_trading_days").alias("h"), F.explode(F.array_compact(taus)).alias("threshold"))
    g = F.col("g")
    win = g > 0
    a = d.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n_fires"),
        F.count_distinct("date").alias("n_unique_dates"),
        F.avg(win.cast("double")).alias("win_rate"),
        F.coalesce(F.avg(F.when(win, g)), F.lit(0.0)).alias("mean_gain"),
        F.coalesce(F.avg(F.when(~win, g)), F.lit(0.0)).alias("mean_loss"),
        F.avg("h").alias("mean_hold"),
    )
    a = a.join(exact_quantiles(d, ["threshold"], "g", {"median_gain": 0.5}), "threshold")
    a = a.withColumn("ev", F.col("win_rate") * F.col("mean_gain") + (1 - F.col("win_rate")) * F.col("mean_loss"))
    ok = (F.col("ev") > 100) & (F.col("win_rate") >= 0.5) & (F.col("median_gain") >= 5) & (F.col("mean_hold") >= 10)
    a = a.withColumn("passes_all", ok & (F.col("n_fires") >= 50))
    best = a.agg(F.max(F.when(F.col("passes_all"), F.col("threshold")))).scalar()
    a = a.withColumn("is_highest_passing", F.coalesce(F.col("threshold") == best, F.lit(False)))
    return emit(a, "threshold", "n_fires", "n_unique_dates", "win_rate", "median_gain", "mean_gain", "mean_loss", "mean_hold", "ev", "passes_all", "is_highest_passing")


def auc_sql(src, part=""):
    by, over = (f"{part}, ", f"PARTITION BY {part} ") if part else ("", "")
    return (
        f"SELECT {by}count(*) FILTER (is_winner) AS n_pos, count(*) FILTER (NOT is_winner) AS n_neg, "
        "(sum(CASE WHEN is_winner THEN ar END) - count(*) FILTER (is_winner) * (count(*) FILTER (is_winner) + 1) / 2.0) / "
        "(count(*) FILTER (is_winner) * count(*) FILTER (NOT is_winner)) AS auc FROM "
        f"(SELECT *, rank() OVER ({over}ORDER BY score) + (count(*) OVER (PARTITION BY {by}score) - 1) / 2.0 AS ar FROM {src}) "
        + (f"GROUP BY {part}" if part else "")
    )


@query("u16_auc_overall", E("n_pos n_neg f:auc", auc_sql("scored")))
def u16(spark, sf):
    return emit(ru.auc(scored(Tables(spark, sf)), "score", "is_winner"))


@query("u16_auc_by_window", E("i:window_id n_pos n_neg f:auc", auc_sql("scored_w", "window_id")))
def u16b(spark, sf):
    d = scored(Tables(spark, sf)).where(F.col("window_id").isNotNull())
    return emit(ru.auc(d, "score", "is_winner", ["window_id"]))


@query(
    "u17_selectivity_gates",
    "SELECT symbol, CAST(date AS VARCHAR) AS date, rule_key FROM fired WHERE rule_key IN "
    "(SELECT rule_key FROM surv WHERE is_survivor AND min_val_lift >= 1.04 AND lift_decay <= 0.05)",
)
def u17(spark, sf):
    d, train, wf = train_and_walk(Tables(spark, sf, share=True))
    good = ru.survivors(wf, train, 1.02, 0.5).where("is_survivor AND min_val_lift >= 1.04 AND lift_decay <= 0.05")
    return emit(ru.firings(d, LIVE).join(good, "rule_key", "left_semi"), "symbol", "date", "rule_key")


# --- sweeps over specs -----------------------------------------------------------------

SPECS = lb.sweep_specs(400.0, 20.0, 20.0)


def sus(s, x=""):
    return (
        f"CASE WHEN {x}close_adj >= 1 AND {x}forward_max_pct IS NOT NULL AND {x}forward_endpoint_pct IS NOT NULL "
        f"THEN {x}forward_max_pct >= {s.touch_pct} AND {x}forward_endpoint_pct >= {s.endpoint_pct} END"
    )


add_cte("spec_rows", " UNION ALL ".join(f"SELECT symbol, date, '{s.name}' AS spec, {sus(s)} AS y FROM rf" for s in SPECS))
add_cte("spec_fired", " UNION ALL ".join(f"SELECT rule_key, date, '{s.name}' AS spec, {sus(s)} AS y FROM fired" for s in SPECS))
add_cte(
    "spec_wf",
    "SELECT rule_key, spec, window_id, (h / m) / nullif(p / n, 0) AS lift FROM (SELECT rule_key, spec, window_id, count(*) AS m, count(*) FILTER (y) AS h "
    "FROM spec_fired JOIN wf_windows ON date BETWEEN lo AND hi WHERE y IS NOT NULL GROUP BY ALL) JOIN "
    "(SELECT spec, window_id, count(*) AS n, count(*) FILTER (y) AS p FROM spec_rows JOIN wf_windows ON date BETWEEN lo AND hi WHERE y IS NOT NULL GROUP BY ALL) USING (spec, window_id)",
)
add_cte(
    "spec_rule",
    "SELECT *, coalesce(lo_lift >= 1.0, false) AS ok FROM (SELECT spec, rule_key, avg(lift) AS mean_lift, min(lift) AS lo_lift FROM spec_wf GROUP BY ALL)",
)


@query(
    "u20_spec_summary",
    E(
        "spec n_rules n_survivors f:survivor_rate f:median_mean_lift b:is_pick",
        "SELECT *, coalesce(spec = max(CASE WHEN survivor_rate >= 0.25 THEN spec END) OVER (), false) AS is_pick FROM (SELECT spec, count(*) AS n_rules, count(*) FILTER (ok) AS n_survivors, "
        f"count(*) FILTER (ok) / {float(len(LIVE))} AS survivor_rate, median(mean_lift) AS median_mean_lift FROM spec_rule GROUP BY spec)",
    ),
)
def u20(spark, sf):
    d = rule_frame(Tables(spark, sf, share=True)).withColumn("window_id", ru.window_id(WINDOWS)).where("window_id IS NOT NULL")
    # every spec is a label on the same row: one scan, then one partial row per (spec, window, rule)
    d = d.withColumn("fk", ru.fired_keys(LIVE, d.columns))
    specs = F.array(*[F.struct(F.lit(s.name).alias("spec"), lb.sustained_label(s).alias("y")) for s in SPECS])
    d = d.select("window_id", "fk", F.inline(specs)).where(F.col("y").isNotNull())
    y = F.col("y").cast("int")
    base = d.groupBy("spec", "window_id").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("p"))
    hit = d.select("spec", "window_id", "y", F.explode("fk").alias("rule_key"))
    hit = hit.groupBy("spec", "window_id", "rule_key").agg(F.count(F.lit(1)).alias("m"), F.sum(y).alias("h"))
    lift = F.try_divide(F.col("h") / F.col("m"), F.col("p") / F.col("n"))
    r = hit.join(F.broadcast(base), ["spec", "window_id"]).groupBy("spec", "rule_key").agg(
        F.avg(lift).alias("mean_lift"), F.min(lift).alias("lo_lift")
    )
    ok = F.coalesce(F.col("lo_lift") >= 1.0, F.lit(False))
    s = r.groupBy("spec").agg(
        F.count(F.lit(1)).alias("n_rules"),
        F.count_if(ok).alias("n_survivors"),
        (F.count_if(ok) / F.lit(float(len(LIVE)))).alias("survivor_rate"),
        F.percentile("mean_lift", 0.5).alias("median_mean_lift"),  # one value per rule
    )
    pick = s.agg(F.max(F.when(F.col("survivor_rate") >= 0.25, F.col("spec")))).scalar()
    return emit(s.withColumn("is_pick", F.coalesce(F.col("spec") == pick, F.lit(False))))


@query(
    "u21_historical_entries",
    E(
        "symbol d:date f:signal_strength pattern",
        "SELECT symbol, date, least(1.0, mean_val_lift / 3.0) AS signal_strength, rule_key AS pattern FROM ("
        + COOL.replace("FROM fired", "FROM (SELECT * FROM fired WHERE date BETWEEN DATE '1999-11-30' AND DATE '2000-10-31')").replace(
            "JOIN fired n", "JOIN (SELECT * FROM fired WHERE date BETWEEN DATE '1999-11-30' AND DATE '2000-10-31') n"
        )
        + "SELECT * FROM c) JOIN surv USING (rule_key) WHERE is_survivor AND date >= DATE '1999-12-31' AND least(1.0, mean_val_lift / 3.0) >= 0.35",
    ),
)
def u21(spark, sf):
    d, train, wf = train_and_walk(Tables(spark, sf, share=True))
    good = ru.survivors(wf, train, 1.02, 0.5).where("is_survivor").select("rule_key", "mean_val_lift")
    return emit(sg.historical_entries(d, LIVE, good, "1999-12-31", "2000-10-31", 30, 0.35), "symbol", "date", "signal_strength", "pattern")


@query(
    "u22_rule_distribution",
    E(
        "metric f:q25 f:q50 f:q75",
        " UNION ALL ".join(
            f"SELECT '{m}' AS metric, quantile_cont({m}, 0.25) AS q25, quantile_cont({m}, 0.5) AS q50, quantile_cont({m}, 0.75) AS q75 FROM eval_all"
            for m in ("lift", "precision", "coverage_pct")
        ),
    ),
)
def u22(spark, sf):
    d = ru.evaluate(rule_frame(Tables(spark, sf)), RULES)
    ms = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("lift", "precision", "coverage_pct")])
    # one value per rule and metric
    q = d.select(F.inline(ms)).groupBy("metric").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return emit(q.select("metric", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75")))


@query(
    "u23_cohort_guard",
    E(
        "spec n_train_positive b:is_skipped",
        "SELECT spec, count(*) FILTER (y AND date <= DATE '1998-12-31') AS n_train_positive, count(*) FILTER (y AND date <= DATE '1998-12-31') < 5000 AS is_skipped FROM spec_rows GROUP BY spec",
    ),
)
def u23(spark, sf):
    d = rule_frame(Tables(spark, sf)).where(F.col("date") <= F.lit(TRAIN_END).cast("date"))
    wide = d.agg(*[F.count_if(lb.sustained_label(s)).alias(s.name) for s in SPECS])
    cells = F.array(*[F.struct(F.lit(s.name).alias("spec"), F.col(s.name).alias("n_train_positive")) for s in SPECS])
    out = wide.select(F.inline(cells))
    return emit(out.withColumn("is_skipped", F.col("n_train_positive") < 5000))
