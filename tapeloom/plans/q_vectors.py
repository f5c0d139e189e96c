"""Vectors, clusters, models."""

from pyspark.sql import functions as F

from ..functions.windows import safe_corr
from ..operators import boosting as bo
from ..operators import exits as ex
from ..operators import features as fx
from ..operators import labels as lb
from ..operators import mixtures as mx
from ..operators import models as md
from ..operators import predicates as pr
from ..operators import rules as ru
from ..operators import stats as st
from ..operators import trades as tr
from ..operators import vectors as vx
from ..session import staged
from .common import E, Tables, emit
from .q_regime import _CONCEPTS, concepts_of
from .q_rules import LIVE, rule_frame
from .registry import add_cte, query


def vecs(t):
    return t.read("embeddings").select("vec_id", F.col("embedding").alias("vec"), F.col("label").cast("long").alias("label"))


def split(t):
    v = vecs(t)
    w = v.where("label <= 2").select(F.col("vec_id").alias("winner_id"), "vec")
    return w, v.where("label > 2").select(F.col("vec_id").alias("neighbor_id"), "vec")


add_cte("vw", "SELECT vec_id AS winner_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label <= 2")
add_cte("vl", "SELECT vec_id AS neighbor_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label > 2")
_D = {
    "euclidean": "list_distance(a.v, b.v)",
    "cosine": "list_cosine_distance(a.v, b.v)",
    "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))",
}


def knn_sql(metric, a="vw", b="vl", k=5):
    return (
        f"SELECT winner_id, neighbor_id, distance, neighbor_rank FROM (SELECT *, row_number() OVER (PARTITION BY winner_id ORDER BY distance, neighbor_id) AS neighbor_rank FROM "
        f"(SELECT a.winner_id, b.neighbor_id, {_D[metric]} AS distance FROM {a} a, {b} b)) WHERE neighbor_rank <= {k}"
    )


K_SPEC = "winner_id neighbor_id f:distance neighbor_rank"
add_cte("nn5", knn_sql("euclidean").replace("FROM vw a, vl b", "FROM vw a CROSS JOIN vl b"))


def knn(t, metric):
    w, lo = split(t)
    return vx.knn_join(w, lo, 5, "winner_id", "neighbor_id", metric=metric)


for _m in ("euclidean", "cosine", "manhattan"):

    @query(f"v5_nearest_losers_{_m}", E(K_SPEC, knn_sql(_m).replace("FROM vw a, vl b", "FROM vw a CROSS JOIN vl b")))
    def v5(spark, sf, metric=_m):
        return emit(knn(Tables(spark, sf, share=True), metric), "winner_id", "neighbor_id", "distance", "neighbor_rank")


@query("v5_nearest_losers_approximate")
def v5_approximate(spark, sf):
    """The hash-table form; its rows are those of the exact join but for the audited loss of recall."""
    w, lo = split(Tables(spark, sf, share=True))
    near, _ = vx.approximate_knn(w, lo, 5, "winner_id", "neighbor_id")
    return emit(near, "winner_id", "neighbor_id", "distance", "neighbor_rank")


@query("j11_nearest_neighbour_join", E(K_SPEC, "SELECT * FROM nn5"))
def j11(spark, sf):
    return emit(knn(Tables(spark, sf, share=True), "euclidean"), "winner_id", "neighbor_id", "distance", "neighbor_rank")


add_cte("vl_long", "SELECT neighbor_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS component FROM vl")
add_cte("vw_long", "SELECT winner_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS component FROM vw")


@query(
    "v6_neighbour_deltas",
    E(
        "i:component f:mean_delta f:std_delta f:z_delta i:rank direction",
        "SELECT *, row_number() OVER (ORDER BY round(abs(z_delta), 9) DESC, component) - 1 AS rank, CASE WHEN z_delta > 0 THEN '+' ELSE '-' END AS direction FROM "
        "(SELECT component, avg(x - m) AS mean_delta, stddev_pop(x - m) AS std_delta, avg(x - m) / (stddev_pop(x) + 1e-9) AS z_delta FROM vw_long JOIN "
        "(SELECT winner_id, component, avg(x) AS m FROM nn5 JOIN vl_long USING (neighbor_id) GROUP BY 1, 2) USING (winner_id, component) GROUP BY component)",
    ),
)
def v6(spark, sf):
    w, lo = split(Tables(spark, sf, share=True))
    pairs = vx.knn_join(w, lo, 5, "winner_id", "neighbor_id").select("winner_id", "neighbor_id")
    d = vx.neighbour_deltas(w, lo, pairs, "winner_id", "neighbor_id").withColumn("component", F.col("component").cast("long"))
    return emit(d, "component", "mean_delta", "std_delta", "z_delta", "rank", "direction")


add_cte("cent", "SELECT label, component, avg(x) AS value FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS component FROM embeddings) GROUP BY 1, 2")
add_cte("centv", "SELECT label, list(value ORDER BY component) AS c FROM cent GROUP BY label")


@query("v8_centroids", E("i:label i:component f:value", "SELECT * FROM cent"))
def v8(spark, sf):
    d = vx.centroids(vecs(Tables(spark, sf, share=True)), "label", "vec")
    return emit(d.withColumn("component", F.col("component").cast("long")))


@query(
    "v8_cluster_radii",
    E(
        "i:label n_members f:radius f:mean_outcome",
        "SELECT label, count(*) AS n_members, quantile_cont(d, 0.9) AS radius, avg(o) AS mean_outcome FROM (SELECT e.label, list_distance(CAST(embedding AS DOUBLE[]), c) AS d, CAST(embedding[1] AS DOUBLE) AS o FROM embeddings e JOIN centv ON centv.label = e.label) GROUP BY label",
    ),
)
def v8b(spark, sf):
    v = vecs(Tables(spark, sf, share=True)).withColumn("o", F.col("vec")[0].cast("double"))
    return emit(vx.radii(v, "label", "vec", 0.9, "o"), "label", "n_members", "radius", "mean_outcome")


add_cte("proto", "SELECT label AS winner_id, c AS v FROM centv")
add_cte("vall", "SELECT vec_id AS neighbor_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings")


def proto_knn(t, k):
    v = vecs(t)
    protos = vx.centroid_arrays(vx.centroids(v, "label", "vec"), "label").select(F.col("label").alias("prototype"), F.col("centroid").alias("vec"))
    return vx.knn_join(staged(protos), v, k, "prototype", "vec_id")


@query(
    "v9_prototype_archetypes",
    E(
        "i:prototype archetype n_winners n_losers",
        "SELECT winner_id AS prototype, arg_min(neighbor_id, neighbor_rank) AS archetype, count(*) FILTER (label <= 2) AS n_winners, count(*) FILTER (label > 2) AS n_losers FROM ("
        + knn_sql("euclidean", "proto", "vall", 10).replace("FROM proto a, vall b", "FROM proto a CROSS JOIN vall b")
        + ") JOIN vall USING (neighbor_id) GROUP BY 1",
    ),
)
def v9(spark, sf):
    t = Tables(spark, sf, share=True)
    n = proto_knn(t, 10).join(vecs(t).select("vec_id", "label"), "vec_id")
    return n.groupBy("prototype").agg(
        F.min_by("vec_id", "neighbor_rank").alias("archetype"),
        F.count_if(F.col("label") <= 2).alias("n_winners"),
        F.count_if(F.col("label") > 2).alias("n_losers"),
    )


add_cte(
    "assigned",
    "SELECT vec_id, e.label, arg_min(centv.label, list_distance(CAST(embedding AS DOUBLE[]), c)) AS predicted, min(list_distance(CAST(embedding AS DOUBLE[]), c)) AS distance FROM embeddings e CROSS JOIN centv GROUP BY vec_id, e.label",
)


@query("v10_predict_cluster", E("vec_id i:predicted f:distance", "SELECT * FROM assigned"))
def v10(spark, sf):
    v = vecs(Tables(spark, sf, share=True))
    c = vx.centroid_arrays(vx.centroids(v, "label", "vec"), "label")
    return emit(vx.predict(v, "vec", c, "label"), "vec_id", "predicted", "distance")


add_cte("fit_part", "SELECT vec_id AS neighbor_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % 5 = 0")
add_cte("new_part", "SELECT vec_id AS winner_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 5 <> 0")


@query(
    "v11_label_propagation",
    E(
        "vec_id i:label",
        "SELECT winner_id AS vec_id, label FROM (" + knn_sql("euclidean", "new_part", "fit_part", 1).replace("FROM new_part a, fit_part b", "FROM new_part a CROSS JOIN fit_part b") + ") JOIN fit_part USING (neighbor_id)",
    ),
)
def v11(spark, sf):
    """Cluster labels known on a fitted fifth spread to all other rows by the nearest fitted row."""
    v = vecs(Tables(spark, sf, share=True))
    fit = v.where("vec_id % 5 = 0").select(F.col("vec_id").alias("fit_id"), "vec", "label")
    new = v.where("vec_id % 5 <> 0").select("vec_id", "vec")
    n = vx.knn_join(new, fit, 1, "vec_id", "fit_id")
    return n.join(fit.select("fit_id", "label"), "fit_id").select("vec_id", "label")


add_cte("clus", "SELECT symbol, date, is_winner, CAST(floor(rsi_14 / 20.003) AS BIGINT) AS cluster_id, CASE WHEN date <= DATE '1998-12-31' THEN 'train' ELSE 'holdout' END AS split FROM rf WHERE rsi_14 IS NOT NULL AND is_winner IS NOT NULL")
add_cte("clift", "SELECT split, cluster_id, count(*) AS size, count(*) FILTER (is_winner) AS n_winners, avg(CAST(is_winner AS INT)) AS winner_fraction, avg(CAST(is_winner AS INT)) / min(b) AS lift_vs_base FROM clus JOIN (SELECT split, avg(CAST(is_winner AS INT)) AS b FROM clus GROUP BY 1) USING (split) GROUP BY 1, 2")


def clus(t):
    d = rule_frame(t).where("rsi_14 IS NOT NULL AND is_winner IS NOT NULL")
    return d.withColumns(
        {
            "cluster_id": F.floor(F.col("rsi_14") / 20.003).cast("long"),
            "split": F.when(F.col("date") <= F.lit("1998-12-31").cast("date"), "train").otherwise("holdout"),
        }
    )


@query(
    "v7_cluster_lift",
    E(
        "split i:cluster_id size n_winners f:winner_fraction f:lift_vs_base b:is_cluster_of_interest",
        "SELECT *, cluster_id = (SELECT arg_max(cluster_id, winner_fraction) FROM clift WHERE split = 'train') AS is_cluster_of_interest FROM clift",
    ),
)
def v7(spark, sf):
    return emit(vx.cluster_lift(clus(Tables(spark, sf, share=True)), "split", "cluster_id", "is_winner"))


ZF = ("close_over_sma_20", "roc_20", "vol_mult_30", "pct_of_60d_low", "pct_of_60d_high", "atr_pct_14", "rsi_14")


@query(
    "v4_cluster_signatures",
    E(
        "i:cluster_id feature f:mean_z direction size",
        "SELECT *, CASE WHEN mean_z > 0 THEN '+' ELSE '-' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(abs(mean_z), 9) DESC, feature) AS r FROM (SELECT cluster_id, feature, avg(z) AS mean_z, count(*) AS size FROM ("
        + " UNION ALL ".join(f"SELECT cluster_id, '{f}' AS feature, ({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS z FROM cz" for f in ZF)
        + ") GROUP BY 1, 2)) WHERE r <= 8 AND abs(mean_z) > 0.1",
    ).replace("SELECT cluster_id, feature", "WITH cz AS (SELECT cluster_id, rf.* FROM clus JOIN rf USING (symbol, date) WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in ZF) + ") SELECT cluster_id, feature", 1),
)
def v4(spark, sf):
    d = staged(clus(Tables(spark, sf, share=True)).na.drop(subset=list(ZF)).select("cluster_id", *ZF))
    m = d.agg(*[F.avg(f).alias(f"{f}_mean") for f in ZF], *[F.stddev_pop(f).alias(f"{f}_sd") for f in ZF])
    zero = d.agg(*[F.lit(0.0).alias(f) for f in ZF])
    z = pr.standardise(d, ZF, zero, m).select("cluster_id", *[F.col(f"{f}_z").alias(f) for f in ZF])
    return emit(vx.signatures(z, "cluster_id", ZF), "cluster_id", "feature", "mean_z", "direction", "size")


add_cte("names", "SELECT unnest([" + ", ".join(f"'{n}'" for n, *_ in _CONCEPTS) + "]) AS concept")
add_cte("cw", "SELECT * FROM concepts JOIN winners USING (symbol, date) WHERE is_winner IS NOT NULL")


@query(
    "v12_concept_importance",
    E(
        "concept f:correlation f:mean_winners f:mean_losers f:gap",
        " UNION ALL ".join(
            f"SELECT '{n}' AS concept, CASE WHEN min({n}) < max({n}) THEN corr({n}, CAST(is_winner AS INT)) END AS correlation, avg({n}) FILTER (is_winner) AS mean_winners, avg({n}) FILTER (NOT is_winner) AS mean_losers, "
            f"abs(avg({n}) FILTER (is_winner) - avg({n}) FILTER (NOT is_winner)) AS gap FROM cw"
            for n, *_ in _CONCEPTS
        ),
    ),
)
def v12(spark, sf):
    names = [n for n, *_ in _CONCEPTS]
    d = lb.forward_winner(concepts_of(Tables(spark, sf, share=True)), 30, 2.0, "close_adj").where("is_winner IS NOT NULL")
    y = F.col("is_winner").cast("int")
    # long form combines on the map side to one partial row per concept
    long = st.unpivot(d.withColumn("y", y), ["y"], names, "concept")
    v = F.col("value")
    out = long.groupBy("concept").agg(
        safe_corr("value", "y").alias("correlation"),
        F.avg(F.when(F.col("y") == 1, v)).alias("mean_winners"),
        F.avg(F.when(F.col("y") == 0, v)).alias("mean_losers"),
    )
    return emit(out.withColumn("gap", F.abs(F.col("mean_winners") - F.col("mean_losers"))))


DIM = 64
HYBRID = ("close_over_sma_20", "atr_pct_14", "roc_20", "rsi_14", "vol_mult_30", "pct_of_60d_high", "pct_of_60d_low")


@query(
    "v13_hybrid_matrix",
    E(
        "symbol d:date " + " ".join(f"f:{f}" for f in HYBRID) + " " + " ".join(f"f:emb_{i}" for i in range(DIM)),
        "SELECT rf.symbol, rf.date, " + ", ".join(HYBRID) + ", " + ", ".join(f"embedding[{i + 1}] AS emb_{i}" for i in range(DIM))
        + " FROM rf JOIN embeddings ON CAST(vec_id AS VARCHAR) = rf.symbol",
    ),
)
def v13(spark, sf):
    """Features of every (symbol, day) beside all components of the symbol's vector."""
    t = Tables(spark, sf, share=True)
    v = vecs(t).select(F.col("vec_id").cast("string").alias("symbol"), "vec")
    d = rule_frame(t).select("symbol", "date", *HYBRID).join(v, "symbol")
    return emit(vx.hybrid(d, "vec", DIM))


MF = list(HYBRID)

# every model feature of the matrix: all of its numeric columns besides the bars and what looks forward
MODEL_FEATURES = (
    "macd_line macd_signal macd_hist roc_5 roc_10 roc_20 roc_60 pct_of_20d_high pct_of_60d_high pct_of_252d_high pct_of_20d_low pct_of_60d_low "
    "pct_of_252d_low ad_line is_nr4 is_nr7 hv_ratio_10_60 consec_up consec_down close_over_sma_10 close_over_sma_20 close_over_sma_50 "
    "close_over_sma_200 sma20_slope_5d sma50_slope_5d bb_position_20 bb_squeeze_20 vol_mult_5 vol_mult_10 vol_mult_30 vol_mult_60 obv_slope_20d "
    "atr_pct_14 range_expansion_5d rsi_2 rsi_5 rsi_14 gap_pct body_range_ratio is_inside_bar days_since_last_20pct rs_sector_20d rs_spy_20d "
    "close_over_sma_20_peer_z"
).split()
ROUNDS, DEPTH = 100, 6
TRAIN_UNTIL = "1999-12-31"
_fitted: dict = {}


def model_frame(t):
    """The feature matrix with the label, every day of every symbol that has one."""
    d = fx.build_features(t.series(), t.market(), t.peers())
    d = lb.forward_winner(d, 30, 2.0, "close_adj").where("is_winner IS NOT NULL")
    return staged(d.select("symbol", "date", "is_winner", *MODEL_FEATURES))


def train_sets(d):
    cut = F.lit(TRAIN_UNTIL).cast("date")
    return d.where(F.col("date") <= cut), d.where(F.col("date") > cut)


def boosted(t, train):
    """The ensemble of the training days; queries of one session on one folder share it."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _fitted:
        _fitted[key] = bo.fit(train, MODEL_FEATURES, "is_winner", ROUNDS, DEPTH)
    return _fitted[key]


@query("v1_boosted_model_scores")
def v1(spark, sf):
    t = Tables(spark, sf, share=True)
    train, hold = train_sets(model_frame(t))
    d = bo.explained(hold, boosted(t, train), "symbol", "date", "is_winner")
    return emit(d, "symbol", "date", "is_winner", "score")


@query(
    "v1_scored_days",
    E(
        "symbol d:date b:is_winner n_bad_scores",
        f"SELECT symbol, date, is_winner, 0 AS n_bad_scores FROM winners WHERE is_winner IS NOT NULL AND date > DATE '{TRAIN_UNTIL}'",
    ),
)
def v1k(spark, sf):
    """Every labelled day after the training days has one score, a probability."""
    t = Tables(spark, sf, share=True)
    train, hold = train_sets(model_frame(t))
    d = bo.explained(hold, boosted(t, train), "symbol", "date", "is_winner")
    fine = F.coalesce((F.col("score") >= 0) & (F.col("score") <= 1), F.lit(False))
    return emit(d.withColumn("n_bad_scores", F.when(fine, 0).otherwise(1)), "symbol", "date", "is_winner", "n_bad_scores")


@query("v2_feature_attribution")
def v2(spark, sf):
    t = Tables(spark, sf, share=True)
    train, hold = train_sets(model_frame(t))
    return emit(bo.attribution(hold, boosted(t, train)))


@query(
    "v2_contribution_sums",
    E(
        "symbol d:date n_features b:adds_up",
        f"SELECT symbol, date, {len(MODEL_FEATURES)} AS n_features, true AS adds_up FROM winners WHERE is_winner IS NOT NULL AND date > DATE '{TRAIN_UNTIL}'",
    ),
)
def v2s(spark, sf):
    """Per row: bias and contributions of all features add up to the margin."""
    t = Tables(spark, sf, share=True)
    train, hold = train_sets(model_frame(t))
    d = bo.explained(hold, boosted(t, train), "symbol", "date")
    total = F.aggregate("contributions", F.col("bias"), lambda a, x: a + x)
    d = d.withColumns({"n_features": F.size("contributions"), "adds_up": F.abs(total - F.col("margin")) < 1e-9})
    return emit(d, "symbol", "date", "n_features", "adds_up")


# --- exit models of variants ----------------------------------------------------------------

EXIT_MODELS = (
    ex.Variant("g15_f20", 15.0, 20, 20, 66.0, 60, 60),
    ex.Variant("g30_f20", 30.0, 20, 20, 66.0, 30, 60),
    ex.Variant("g15_f40", 15.0, 20, 40, 50.0, 20, 40),
)
EXIT_ROUNDS = 40


def model_exits(t):
    bars = ["open", "close_adj"]
    d = fx.build_features(t.series(), t.market(), t.peers()).select("symbol", "date", *bars, *MODEL_FEATURES)
    rank = F.create_map(*[x for i, r in enumerate(LIVE) for x in (F.lit(r.key), F.lit(1.0 / (i + 1)))])
    entries = ru.firings(rule_frame(t), LIVE).select("symbol", "date", rank[F.col("rule_key")].alias("signal_strength"))
    return ex.model_exits(d, entries, MODEL_FEATURES, EXIT_MODELS, TRAIN_UNTIL, rounds=EXIT_ROUNDS)


@query("u19_exit_models")
def u19m(spark, sf):
    """The variants compared with each one's own exit model."""
    d = tr.compare_exits(model_exits(Tables(spark, sf, share=True)))
    cols = "mean_gain_pct median_gain_pct p25_gain_pct p75_gain_pct worst_gain_pct".split()
    return emit(d, *d.columns, coarse=tuple(cols))


@query(
    "u19_model_entries",
    E(
        "variant symbol d:entry_date f:entry_price f:signal_strength b:is_later",
        "SELECT variant, symbol, date AS entry_date, open AS entry_price, signal_strength, true AS is_later FROM entry_fills, "
        f"(VALUES {', '.join(f'({chr(39)}{v.name}{chr(39)})' for v in EXIT_MODELS)}) v(variant) WHERE date > DATE '{TRAIN_UNTIL}'",
    ),
)
def u19e(spark, sf):
    """Every entry after the training days has one exit, later than its entry, under every variant's model."""
    d = model_exits(Tables(spark, sf, share=True)).withColumn("is_later", F.col("exit_date") > F.col("entry_date"))
    return emit(d, "variant", "symbol", "entry_date", "entry_price", "signal_strength", "is_later")


# --- rules read out of the trees ---------------------------------------------------------


@query("u1_tree_paths")
def u1(spark, sf):
    t = Tables(spark, sf, share=True)
    found = ru.canonical_rules(bo.paths(spark, boosted(t, train_sets(model_frame(t))[0])))
    return found.select(md.rule_text().alias("rule"), "n_paths", "n_conditions")


@query("u1_mined_rule_evaluation")
def u1e(spark, sf):
    """From trees to evaluated rules: fit on the training days, read the rules out, measure them on the rest."""
    t = Tables(spark, sf, share=True)
    train, hold = train_sets(model_frame(t))
    mined = bo.mined_rules(spark, boosted(t, train))
    d = ru.evaluate(bo.filled(hold, MODEL_FEATURES, "is_winner"), mined)
    return emit(d, "rule_key", "coverage_n", "n_hit", "coverage_pct", "precision", "lift")


@query(
    "u1_leaf_agreement",
    f"SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_leaves_apart FROM winners WHERE is_winner IS NOT NULL AND date > DATE '{TRAIN_UNTIL}'",
)
def u1l(spark, sf):
    """On the later days every leaf's rule fires as often as rows end on the leaf, in every tree."""
    t = Tables(spark, sf, share=True)
    train, hold = train_sets(model_frame(t))
    model = boosted(t, train)
    fired = ru.evaluate(bo.filled(hold, model.features, "is_winner"), bo.leaf_rules(spark, model)).select(F.col("rule_key").alias("path"), "coverage_n")
    both = bo.leaf_rows(hold, model).join(fired, "path", "full_outer")
    apart = both.agg(F.count_if(~F.col("n_rows").eqNullSafe(F.col("coverage_n"))).alias("n_leaves_apart"), (F.sum("n_rows") / len(model.root)).alias("n"))
    return apart.select(F.col("n").cast("long").alias("n_rows"), "n_leaves_apart")


@query(
    "v2_direction_rule",
    E(
        "feature f:correlation direction",
        "SELECT *, CASE WHEN correlation >= 0.3 THEN '+' WHEN correlation <= -0.3 THEN '-' ELSE 'mixed' END AS direction FROM ("
        + " UNION ALL ".join(f"SELECT '{f}' AS feature, corr({f}, forward_endpoint_pct) FILTER ({f} IS NOT NULL) AS correlation FROM rf" for f in MF)
        + ")",
    ),
)
def v2b(spark, sf):
    return emit(md.direction(rule_frame(Tables(spark, sf, share=True)), MF, "forward_endpoint_pct"))


@query("v3_cluster_choice")
def v3(spark, sf):
    return emit(vx.cluster_choice(staged(vecs(Tables(spark, sf, share=True))), "vec", (5, 8, 12, 20)))


STEP_CLUSTERS = 5
_LOG_SHARE = "ln(m.n / t.n) - 0.5 * list_sum(list_transform(list_zip(x.v, m.mu, m.var), lambda z: ln(2 * pi() * z[3]) + (z[1] - z[2]) * (z[1] - z[2]) / z[3]))"


def _moments_sql(source, share):
    """Weight, mean and variance of every (cluster, component) of rows (c, v) with a share."""
    return (
        f"SELECT c, j, sum({share}) AS n, sum({share} * y) / sum({share}) AS mu, "
        f"greatest(sum({share} * y * y) / sum({share}) - (sum({share} * y) / sum({share})) * (sum({share} * y) / sum({share})), 0) + 1e-6 AS var "
        f"FROM (SELECT c, {share}, unnest(range(len(v))) AS j, unnest(v) AS y FROM {source}) u GROUP BY c, j"
    )


@query(
    "v3_mixture_step",
    E(
        "i:cluster i:component f:weight f:mean f:variance",
        "WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label % 5 AS c, 1.0 AS r FROM embeddings), t AS (SELECT count(*) AS n FROM x), "
        f"a AS ({_moments_sql('x', 'r')}), "
        "m AS (SELECT c, any_value(n) AS n, list(mu ORDER BY j) AS mu, list(var ORDER BY j) AS var FROM a GROUP BY c), "
        f"l AS (SELECT x.vec_id, x.v, m.c, {_LOG_SHARE} AS lp FROM x, m, t), "
        "e AS (SELECT v, c, exp(lp - max(lp) OVER w) / sum(exp(lp - top)) OVER w AS r FROM (SELECT *, max(lp) OVER (PARTITION BY vec_id) AS top FROM l) q WINDOW w AS (PARTITION BY vec_id)) "
        f"SELECT b.c AS cluster, b.j AS component, b.n / t.n AS weight, b.mu AS mean, b.var AS variance FROM ({_moments_sql('e', 'r')}) b, t",
    ),
)
def v3s(spark, sf):
    """One round of the mixture from the clusters of the labels."""
    d = staged(vecs(Tables(spark, sf, share=True)).withColumn("start", F.pmod("label", F.lit(STEP_CLUSTERS))))
    m, _ = mx.step(d, "vec", mx.from_groups(d, "vec", "start", STEP_CLUSTERS))
    rows = [(c, j, float(w), float(a), float(b)) for c, w in enumerate(m.weights) for j, (a, b) in enumerate(zip(m.means[c], m.variances[c]))]
    return emit(spark.createDataFrame(rows, "cluster long, component long, weight double, mean double, variance double"))
