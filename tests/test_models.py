import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tapeloom.operators import boosting as bo
from tapeloom.operators import exits as ex
from tapeloom.operators import mixtures as mx
from tapeloom.operators import regime as rg
from tapeloom.operators import rules as ru
from tapeloom.operators import vectors as vx
from tapeloom.session import staged

NAN = float("nan")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(600):
        a, b, c = rng.random(), rng.randint(0, 4), rng.random()
        win = a > 0.6 and b >= 2 or rng.random() < 0.1
        out.append((i, rng.choice([a, a, a, None, NAN]) if i % 7 == 0 else a, b, c < 0.5, win if i % 50 else None))
    return staged(spark.createDataFrame(out, "id int, a double, b int, flag boolean, win boolean"))


@pytest.fixture(scope="module")
def model(rows):
    return bo.fit(rows, ["a", "b", "flag"], "win", rounds=12, depth=3)


def test_contributions_add_up_to_the_score(rows, model):
    got = bo.explained(rows, model, "id", "win").collect()
    assert [r.id for r in sorted(got)] == list(range(600))
    for r in got:
        assert math.isclose(r.bias + sum(r.contributions), r.margin, rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(r.score, 1 / (1 + math.exp(-2 * r.margin)))
    assert len({round(r.score, 9) for r in got}) > 5
    wins = [r.score for r in got if r.win]
    rest = [r.score for r in got if r.win is False]
    assert sum(wins) / len(wins) > sum(rest) / len(rest) + 0.2


def test_scores_equal_those_of_the_fitted_model(spark, rows, tmp_path, monkeypatch):
    kept = {}
    read = bo._read

    def spy(session, path, *more):
        kept["path"] = path
        return read(session, path, *more)

    monkeypatch.setattr(bo, "_read", spy)
    model = bo.fit(rows, ["a", "b"], "win", rounds=7, depth=4)
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(bo.filled(rows, ["a", "b"], "id"))
    want = {r.id: r.p for r in GBTClassificationModel.load(kept["path"]).transform(data).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    got = {r.id: r.score for r in bo.explained(rows, model, "id").collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_every_leaf_rule_fires_on_its_rows_only(spark, rows, model):
    data = bo.filled(rows, model.features, "win")
    x = np.array([[r[f] for f in model.features] for r in data.collect()])
    _, _, leaves = bo.walk(model, x)
    rules = bo.leaf_rules(spark, model)
    assert len(rules) == int((model.left < 0).sum())
    by_path = {f"{t}:{i}": n for n, (t, i) in enumerate(zip(model.tree, model.id))}
    for rule in rules:
        fires = np.ones(len(x), bool)
        for f, op, cut in rule.conditions:
            value = x[:, model.features.index(f)]
            fires &= value < cut if op == "<" else value >= cut
        node = by_path[rule.key]
        assert (fires == (leaves[:, model.tree[node]] == node)).all()
    counted = {r.rule_key: r.coverage_n for r in ru.evaluate(data, rules, "win").collect()}
    assert counted == {r.path: r.n_rows for r in bo.leaf_rows(rows.where("win IS NOT NULL"), model).collect()}


def test_attribution_and_mined_rules(spark, rows, model):
    got = {r.feature: r for r in bo.attribution(rows, model).collect()}
    assert set(got) == {"a", "b", "flag"}
    assert got["a"].direction == got["b"].direction == "+" and got["a"].mean_abs_contribution > got["flag"].mean_abs_contribution
    assert got["a"].n_present < 600 == got["b"].n_present
    few = {r.feature: r.direction for r in bo.attribution(rows.limit(50), model).collect()}
    assert set(few.values()) == {"mixed"}
    assert len({r.key for r in bo.mined_rules(spark, model)}) == len(bo.mined_rules(spark, model)) > 3


def test_four_hundred_rounds(spark):
    d = spark.createDataFrame([(float(i % 10), i % 3 == 0) for i in range(60)], "x double, y boolean").coalesce(1)
    model = bo.fit(d, ["x"], "y", rounds=400, depth=1)
    assert len(model.root) == 400 and np.isfinite(model.value).all()


def vectors(spark, n=300, d=5, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(scale=4, size=(3, d))
    return spark.createDataFrame(
        [(i, (centers[i % 3] + rng.normal(scale=1 + i % 3, size=d)).tolist(), i % 3) for i in range(n)], "id int, vec array<double>, g int"
    )


def plain_step(x, weights, means, variances):
    log = np.stack([np.log(w) - 0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(axis=1) for w, m, v in zip(weights, means, variances)], axis=1)
    top = log.max(axis=1, keepdims=True)
    share = np.exp(log - top)
    total = (top + np.log(share.sum(axis=1, keepdims=True))).sum()
    share /= share.sum(axis=1, keepdims=True)
    n = share.sum(axis=0)
    mean = share.T @ x / n[:, None]
    var = np.stack([(share[:, k : k + 1] * (x - mean[k]) ** 2).sum(axis=0) / n[k] for k in range(len(n))])
    return n / len(x), mean, var + mx.VARIANCE_FLOOR, total


def test_mixture_rounds_equal_numpy_and_never_fall(spark):
    d = staged(vectors(spark).repartition(5))
    rows = d.collect()
    x, g = np.array([r.vec for r in rows]), np.array([r.g for r in rows])
    start = mx.from_groups(d, "vec", "g", 3)
    for k in range(3):
        assert start.means[k] == pytest.approx(x[g == k].mean(axis=0)) and start.variances[k] == pytest.approx(x[g == k].var(axis=0) + 1e-6)
    now, want = start, (start.weights, start.means, start.variances)
    for _ in range(3):
        now, likelihood = mx.step(d, "vec", now)
        *want, total = plain_step(x, *want)
        assert likelihood == pytest.approx(total)
        for a, b in zip((now.weights, now.means, now.variances), want):
            assert a == pytest.approx(b)
    # a poor start, so that many rounds follow
    poor = mx.from_groups(d.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int")), "vec", "h", 4)
    _, trace = mx.fit(d, "vec", poor, 40, 1e-7)
    assert len(trace) > 3 and all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))


def test_mixture_finds_groups_and_keeps_odd_tables(spark):
    d = staged(vectors(spark))
    fitted, _ = mx.fit(d, "vec", mx.from_groups(d, "vec", "g", 3))
    hit = mx.assign(d, "vec", fitted).where("prediction = g").count()
    assert hit > 270
    empty = mx.from_groups(d, "vec", "g", 5)  # two clusters without members
    after, likelihood = mx.step(d, "vec", empty)
    assert np.isfinite(after.means).all() and math.isfinite(likelihood) and after.weights[3:].sum() == 0
    none = d.limit(0)
    assert mx.fit(none, "vec", fitted) == (fitted, [])
    choice = {(r.algorithm, r.k): r for r in vx.cluster_choice(d, "vec", (3,)).collect()}
    assert set(choice) == {("kmeans", 3), ("gmm", 3)} and choice["gmm", 3].silhouette > 0


def test_walk_forward_models_grow_and_see_no_young_label(spark):
    rng = random.Random(8)
    start = date(2020, 1, 1)
    rows = []
    for i in range(220):
        a = rng.random()
        label = "unlabeled" if i % 4 == 1 else "up" if a > 0.5 else "down"
        rows.append((start + timedelta(days=i), label, None if i % 11 == 0 else a, rng.random()))
    d = spark.createDataFrame(rows, "date date, regime_label_rule string, a double, b double")
    schedule, scores = rg.walk_forward_scores(d, ["a", "b"], growth=0.5, trees=5, depth=3)
    plan = {r.model_id: r for r in schedule.collect()}
    got = sorted(scores.collect(), key=lambda r: r.date)
    labels = [r[0] for r in rows if r[1] != "unlabeled"]
    want = [day for day, *_ in rows if sum(x <= day - timedelta(days=30) for x in labels) >= 30]
    assert [r.date for r in got] == want and len(plan) > 2
    for r in got:
        m = plan[r.model_id]
        newest = max(p.first_day for p in plan.values() if p.first_day <= r.date)
        assert m.first_day == newest and (r.date - m.train_end_date).days >= 30
        assert m.train_set_size == sum(x <= m.first_day - timedelta(days=30) for x in labels) == r.train_set_size
    every = rg.refit_schedule(rg.point_in_time_sets(d.select("date"), d.where("regime_label_rule <> 'unlabeled'").select("date"), 30), growth=0)
    assert every.count() == len({sum(x <= day - timedelta(days=30) for x in labels) for day in want})


def test_exit_model_is_fitted_on_earlier_days_and_flags_later_ones(spark):
    rng = random.Random(11)
    rows, start = [], date(2021, 1, 1)
    for s in range(6):
        price, mood = 100.0, 0.0
        for i in range(400):
            if i % 50 == 0:
                mood = rng.choice([0.03, -0.03])
            price *= 1 + mood + rng.gauss(0, 0.01)
            rows.append((f"s{s}", start + timedelta(days=i), price, price, float(50 - i % 50), rng.random()))
    d = staged(spark.createDataFrame(rows, "symbol string, date date, open double, close_adj double, left double, noise double"))
    v = ex.Variant("v", 10.0, 10, 10, 50.0, 30, 40)
    scores = staged(ex.exit_scores(d, ["left", "noise"], v, "2021-09-01", rounds=10, depth=3))
    cut = date(2021, 9, 1)
    got = scores.collect()
    want = {(r.symbol, r.date) for r in ex.labelled(d, v).collect() if r.date > cut}
    assert {(r.symbol, r.date) for r in got} == want and len(got) == len(want)
    bars = staged(ex.flagged_bars(d, scores, 0.1))
    flagged = {(r.symbol, r.date) for r in bars.where("would_exit").collect()}
    assert bars.count() == len(rows) and flagged <= want and 0.1 * len(want) <= len(flagged) < 0.5 * len(want)
    assert min(r.exit_score for r in got if (r.symbol, r.date) in flagged) >= max(r.exit_score for r in got if (r.symbol, r.date) not in flagged)
    # nothing after the day is learned from: other closes there leave the model's scores of unchanged rows alone
    other = d.withColumn("left", F.when((F.col("date") > F.lit(cut)) & (F.col("symbol") == "s0"), 0.0).otherwise(F.col("left")))
    again = {(r.symbol, r.date): r.exit_score for r in ex.exit_scores(other, ["left", "noise"], v, "2021-09-01", rounds=10, depth=3).collect()}
    assert all(again[r.symbol, r.date] == r.exit_score for r in got if r.symbol != "s0")
    entries = d.where("date >= DATE '2021-08-20'").select("symbol", "date", F.lit(1.0).alias("signal_strength"))
    out = ex.model_exits(d, entries, ["left", "noise"], [v, ex.Variant("w", 5.0, 10, 10, 50.0, 5, 40)], "2021-09-01", 0.1, 10, 3).collect()
    assert {r.variant for r in out} == {"v", "w"} and all(r.entry_date > cut and r.exit_date > r.entry_date for r in out)
    assert {r.exit_reason for r in out} >= {"exit_signal"}
