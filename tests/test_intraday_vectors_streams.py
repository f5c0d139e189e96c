import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import intraday as it
from tapeloom.operators import rules as ru
from tapeloom.operators import vectors as vx
from tapeloom.session import stage_path
from tapeloom.sources import readers as rd
from tapeloom.streaming import keyed as ks
from tapeloom.streaming import stateful as sx

T0 = datetime(2024, 1, 1)


def test_supertrend_equals_a_loop_across_batches(spark):
    rng = random.Random(5)
    closes = [100.0]
    for _ in range(400):
        closes.append(closes[-1] + rng.gauss(0, 2))
    rows = [(s, T0 + timedelta(hours=i), c + 1, c - 1, c) for s in ("A", "B") for i, c in enumerate(closes)]
    d = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, high double, low double, close double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = it.supertrend(d, 10, 5, 0.5).where("symbol = 'B'").orderBy("ts").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    ma = atr = None
    for i, c in enumerate(closes):
        true = 2.0 if i == 0 else max(2.0, abs(c + 1 - closes[i - 1]), abs(c - 1 - closes[i - 1]))
        ma = c if ma is None else ma + (2 / 11) * (c - ma)
        atr = true if atr is None else atr + (2 / 6) * (true - atr)
        u, dn = ma - 0.5 * atr, ma + 0.5 * atr
        if i == 0:
            trend = 1
        else:
            if trend == -1 and c > pd_:
                trend = 1
            elif trend == 1 and c < pu:
                trend = -1
            u = max(u, pu) if closes[i - 1] > pu else u
            dn = min(dn, pd_) if closes[i - 1] < pd_ else dn
        pu, pd_ = u, dn
        assert got[i]["trend"] == trend and math.isclose(got[i]["up"], u, rel_tol=1e-9) and math.isclose(got[i]["dn"], dn, rel_tol=1e-9)


def test_rolling_notional_equals_brute_force_with_a_hot_account(spark):
    rng = random.Random(8)
    rows, used = [], set()
    for i in range(600):
        acc = "hot" if i % 3 == 0 else rng.choice("abc")
        ts = T0 + timedelta(minutes=rng.randint(0, 60 * 24 * 20))
        if (acc, ts) in used:
            continue
        used.add((acc, ts))
        rows.append((acc, i, ts, float(rng.randint(1, 99))))
    d = spark.createDataFrame(rows, "account string, fill_id int, ts timestamp_ntz, notional double")
    got = {r["fill_id"]: r["volume_30d"] for r in it.rolling_notional(d, "account", "notional", 3, 60).collect()}
    for acc, i, ts, _ in rows:
        want = sum(x for a, _, t, x in rows if a == acc and ts - timedelta(days=3) <= t < ts)
        assert math.isclose(got[i], want), (acc, ts)


def test_fee_tiers(spark):
    d = spark.createDataFrame([(0.0,), (2499.0,), (2500.0,), (1e8,)], "v double").withColumn("n", F.lit(100.0))
    got = it.fill_costs(d, "n", "v").orderBy("v").collect()
    assert [r["taker_rate"] for r in got] == [0.008, 0.008, 0.006, 0.001]
    assert math.isclose(got[0]["taker_cost"], 100 * (0.008 + 0.0008 + 0.001))


@pytest.mark.parametrize("metric", vx.METRICS)
def test_nearest_neighbours_equal_brute_force_with_a_hot_cell(spark, metric):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(size=(200, 6)), rng.normal(size=(150, 6)) * 0.01 + 2])
    pts = np.vstack([pts, pts[:5]])  # exact copies: ties go to the smaller id
    qs = rng.normal(size=(25, 6))
    p = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(pts)], "pid long, vec array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(qs)], "qid long, vec array<double>")
    got = {}
    for r in vx.knn_join(q, p, 4, "qid", "pid", metric=metric, n_pivots=5, block_rows=40).collect():
        got.setdefault(r["qid"], {})[r["neighbor_rank"]] = (r["pid"], r["distance"])
    for i, v in enumerate(qs):
        if metric == "manhattan":
            d = np.abs(pts - v).sum(1)
        elif metric == "cosine":
            d = 1 - pts @ v / (np.linalg.norm(pts, axis=1) * np.linalg.norm(v))
        else:
            d = np.linalg.norm(pts - v, axis=1)
        best = sorted(range(len(pts)), key=lambda j: (round(d[j], 9), j))[:4]
        assert [got[i][k + 1][0] for k in range(4)] == best
        assert np.allclose([got[i][k + 1][1] for k in range(4)], d[best], atol=1e-7)


def test_more_neighbours_than_points(spark):
    p = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "pid long, vec array<double>")
    q = spark.createDataFrame([(9, [0.0, 0.9])], "qid long, vec array<double>")
    got = vx.knn_join(q, p, 5, "qid", "pid", n_pivots=2).orderBy("neighbor_rank").collect()
    assert [r["pid"] for r in got] == [1, 2]


def test_cooldown_stream_over_several_batches_equals_batch(spark):
    rng = random.Random(6)
    rows = sorted({(rng.choice("AB"), date(2024, 1, 1) + timedelta(days=rng.randint(0, 200)), rng.choice("rq")) for _ in range(300)}, key=lambda r: r[1])
    schema = "symbol string, date date, rule_key string"
    path = stage_path(spark, "fired")
    for i in range(0, len(rows), 60):
        spark.createDataFrame(rows[i : i + 60], schema).coalesce(1).write.mode("append").parquet(path)
    whole = spark.createDataFrame(rows, schema)
    s = ks.cooldown_stream(ks.file_stream(spark, path, whole.schema, 1), 30)
    got = {tuple(r) for r in ks.run_once(s, "cool").select("symbol", "rule_key", "date").collect()}
    last = max(r[1] for r in rows)
    want = {tuple(r) for r in ru.cooldown(whole, 30).select("symbol", "rule_key", "date").collect()}
    assert got == {r for r in want if r[2] < last}


def test_flags_are_read_leniently(spark):
    raw = spark.createDataFrame(
        [("1", "2024-01-02", "x", "active", "new"), ("?", "soon", "1.5", "closed", None)],
        "id string, flag_date string, rsi string, status string, later string",
    )
    got = rd.typed_flags(raw).collect()
    assert (got[0]["id"], got[0]["flag_date"], got[0]["rsi"], got[0]["later"]) == (1, date(2024, 1, 2), None, "new")
    assert (got[1]["id"], got[1]["flag_date"], got[1]["rsi"]) == (None, None, 1.5)
    assert rd.typed_flags(raw, status="active").count() == 1


def test_group_file_and_symbol_limit(spark):
    path = stage_path(spark, "groups")
    spark.createDataFrame([('{"tech": ["A", "B"], "oil": ["C"]}',)], "value string").write.text(path)
    got = {(r["peer_group"], r["symbol"]) for r in rd.read_groups_json(spark, path).collect()}
    assert got == {("tech", "A"), ("tech", "B"), ("oil", "C")}
    with pytest.raises(ValueError):
        rd.select_bars(spark.range(1), symbols=["x"] * 5001)


def test_neighbours_far_from_the_origin_and_many_queries_in_a_cell(spark):
    rng = np.random.default_rng(8)
    for offset in (0.0, 1e6):
        pts = rng.normal(size=(400, 6)) + offset
        qs = np.concatenate([pts[:20], pts[7] + rng.normal(size=(300, 6)) * 1e-3])  # exact copies, and most of one place
        p = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(pts)], "p long, vec array<double>")
        q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(qs)], "q long, vec array<double>")
        got = {}
        for r in vx.knn_join(q, p, 5, "q", "p", block_rows=50).collect():
            got.setdefault(r["q"], []).append((r["neighbor_rank"], r["p"], r["distance"]))
        for i, v in enumerate(qs):
            d = np.sqrt(((pts - v) ** 2).sum(axis=1))
            best = np.lexsort((np.arange(400), d))[:5]
            mine = sorted(got[i])
            assert [m[1] for m in mine] == best.tolist()
            assert np.allclose([m[2] for m in mine], d[best], rtol=1e-9, atol=0)
            assert i >= 20 or mine[0][2] == 0.0


def _marker(spark, df, time_col):
    late = "CAST('2100-01-01' AS {})"
    return spark.range(1).select(*[F.expr(late.format(k) if c == time_col else f"CAST(NULL AS {k})").alias(c) for c, k in df.dtypes])


def test_cooldown_stream_to_the_last_day(spark):
    rng = random.Random(6)
    rows = sorted({(rng.choice("AB"), date(2024, 1, 1) + timedelta(days=rng.randint(0, 200)), rng.choice("rq")) for _ in range(300)}, key=lambda r: r[1])
    schema = "symbol string, date date, rule_key string"
    path = stage_path(spark, "fired")
    for i in range(0, len(rows), 60):
        spark.createDataFrame(rows[i : i + 60], schema).coalesce(1).write.mode("append").parquet(path)
    whole = spark.createDataFrame(rows, schema)
    s = sx.drain(spark, lambda: sx.cooldown(ks.file_stream(spark, path, whole.schema, 1), 30), path, _marker(spark, whole, "date"), "cool")
    got = [tuple(r) for r in s.select("symbol", "rule_key", "date").collect()]
    assert sorted(got) == sorted(tuple(r) for r in ru.cooldown(whole, 30).select("symbol", "rule_key", "date").collect())


def test_notional_stream_gives_every_fill(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "b", "c"]), i, T0 + timedelta(minutes=i * 17, seconds=rng.randint(0, 59)), float(rng.randint(1, 99))) for i in range(600)]
    rows += [("gap", 1000, T0, 5.0), ("gap", 1001, T0 + timedelta(days=3), 7.0), ("gap", 1002, T0 + timedelta(days=3), 7.0), ("gap", 1003, T0 + timedelta(days=6, seconds=1), 1.0)]
    rows.sort(key=lambda r: r[2])
    schema = "account string, fill_id long, ts timestamp_ntz, notional double"
    path = stage_path(spark, "fills")
    for i in range(0, len(rows), 151):
        spark.createDataFrame(rows[i : i + 151], schema).coalesce(1).write.mode("append").parquet(path)
    whole = spark.createDataFrame(rows, schema)
    make = lambda: sx.rolling_notional(ks.file_stream(spark, path, whole.schema, 1), "account", "notional", 3)
    got = sx.drain(spark, make, path, _marker(spark, whole, "ts"), "notional").collect()
    assert len(got) == len(rows)
    want = {r["fill_id"]: r["volume_30d"] for r in it.rolling_notional(whole, "account", "notional", 3, 60).collect()}
    assert {r["fill_id"]: r["volume_30d"] for r in got} == pytest.approx(want)


def test_bars_stream_corrects_and_repeats(spark):
    rng = random.Random(2)
    rows = [(f"s{i % 3}", T0 + timedelta(minutes=i), i, float(rng.randint(1, 50))) for i in range(200)]
    late = [rows.pop(k) for k in (150, 120)]  # an hour old, within the delay
    schema = "symbol string, ts timestamp_ntz, event_id long, price double"
    source, target, cursor = (stage_path(spark, n) for n in ("ticks", "bars", "cursor"))

    def check(ticks):
        want = {}
        for sym, ts, n, price in sorted(ticks, key=lambda r: (r[1], r[2])):
            slot = ts.replace(minute=0)
            o, h, low, _, v = want.get((sym, slot), (price, price, price, price, 0))
            want[sym, slot] = (o, max(h, price), min(low, price), price, v + 1)
        got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in sx.current_bars(spark, target).collect()}
        assert got == want

    seen = []
    for part in (rows[:100], rows[100:], late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        sx.upsert_bars(ks.file_stream(spark, source, spark.createDataFrame(part, schema).schema), 60, target, cursor)
        seen += part
        check(seen)
    sx.upsert_bars(ks.file_stream(spark, source, spark.createDataFrame(late, schema).schema), 60, target, cursor)
    first = spark.read.parquet(f"{target}/batch=0")
    spark.createDataFrame(first.collect(), first.schema).write.mode("overwrite").parquet(f"{target}/batch=0")  # as a repeated batch does
    check(seen)


@pytest.mark.parametrize("metric", vx.METRICS)
def test_approximate_neighbours_reach_their_recall_with_a_hot_bucket(spark, metric):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, 16)) * 4
    pts = np.vstack([middle[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16)), np.ones((450, 16)) + rng.normal(size=(450, 16)) * 1e-3])
    qs = middle[rng.integers(0, 12, 300)] + rng.normal(size=(300, 16))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pts)], "pid long, vec array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "qid long, vec array<double>")
    got, stated = vx.approximate_knn(q, p, 5, "qid", "pid", metric=metric, audit=64, block_rows=100)
    want = {(r["qid"], r["pid"]): r["distance"] for r in vx.knn_join(q, p, 5, "qid", "pid", metric=metric).collect()}
    got = got.collect()
    hit = [r for r in got if (r["qid"], r["pid"]) in want]
    assert stated >= 0.9 and len(hit) / len(want) >= 0.9
    assert all(abs(r["distance"] - want[r["qid"], r["pid"]]) < 1e-9 for r in hit)
    assert len({(r["qid"], r["neighbor_rank"]) for r in got}) == len(got)


def test_approximate_neighbours_of_empty_tables(spark):
    some = spark.createDataFrame([(1, [0.0, 1.0])], "id long, vec array<double>")
    none = some.limit(0)
    as_q, as_p = (lambda d: d.withColumnRenamed("id", "qid")), (lambda d: d.withColumnRenamed("id", "pid"))
    for a, b in ((some, none), (none, some)):
        got, _ = vx.approximate_knn(as_q(a), as_p(b), 3, "qid", "pid")
        assert got.count() == 0
    got, recall = vx.approximate_knn(as_q(some), as_p(some), 3, "qid", "pid")
    assert got.count() == 1 and recall == 1.0


def test_search_tasks_follow_the_pairs(spark, monkeypatch):
    # 30 cells of a few kB: by bytes they would be one task
    monkeypatch.setattr(vx, "PAIRS", 5_000, raising=False)
    rows = [(i, [float(i), 1.0], i % 30) for i in range(1200)]
    who = spark.createDataFrame(rows, "_q long, _qv array<double>, _cell int")
    p = spark.createDataFrame(rows, "_p long, _pv array<double>, _cell int")
    cells = p.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    found = vx._probe_cells(who, p, cells, 1, "manhattan", 20_000, "_q long, _p long, _d double")
    got = found.withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 1200 and all(r["_q"] == r["_p"] for r in got)
    assert len({r["task"] for r in got}) >= 10


@pytest.mark.parametrize("metric", vx.METRICS[:2])
def test_bounded_search_loses_no_neighbour(metric):
    rng = np.random.default_rng(12)
    for dim, n, k in ((1, 50, 3), (6, 5000, 5), (200, 300, 4), (3, 2, 5)):
        b = rng.normal(size=(n, dim)).round(rng.integers(1, 4))
        b[rng.integers(0, n, 5)] *= 1e6  # far beyond the others
        a = np.vstack([rng.normal(size=(20, dim)), b[:2]])
        ids = rng.permutation(n)
        full = vx._distances(b, a, metric).T
        best = [np.lexsort((ids, d))[:k] for d in full]
        kth = np.array([d[x].max() for d, x in zip(full, best)])
        for bound in (None, kth, np.where(np.arange(len(a)) % 2, kth, np.inf)):
            row, col, dist = vx._nearest(a, b, ids, k, metric, *([] if bound is None else [bound]))
            for i, x in enumerate(best):
                assert ids[col[row == i]].tolist() == ids[x].tolist()
                assert np.allclose(dist[row == i], full[i][x])


def test_vectors_that_are_not_finite_hide_no_neighbour():
    b = np.vstack([np.arange(12.0).reshape(6, 2), [[np.nan, 1.0], [np.inf, 0.0]]])
    a = np.array([[0.0, 1.0], [np.nan, 0.0], [9.0, 9.0]])
    row, col, dist = vx._nearest(a, b, np.arange(8), 7, "manhattan")
    assert col[row == 0].tolist() == [0, 1, 2, 3, 4, 5, 7] and col[row == 2].tolist()[:2] == [4, 5]
    assert np.isnan(dist[row == 1]).all()
