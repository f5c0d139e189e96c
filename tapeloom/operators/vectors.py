"""Vectors: nearest neighbours, clusters, centroids, signatures."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.windows import ratio
from ..session import staged
from .stats import top_per_group, unpivot

METRICS = ("euclidean", "manhattan", "cosine")


def unit(vec):
    """Vector scaled to length one; a zero vector stays."""
    v = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def distance(a, b, metric="euclidean"):
    """Distance of two array columns, inside codegen."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    if metric == "manhattan":
        return F.aggregate(d, F.lit(0.0), lambda s, x: s + F.abs(x))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def _distances(a, b, metric):
    """Distances of the rows of ``a`` to a few vectors, from direct differences."""
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(b):
        d = a - row
        out[:, i] = np.abs(d).sum(axis=1) if metric == "manhattan" else np.sqrt(np.einsum("nd,nd->n", d, d))
    return out


def _pair_distances(a, b, row, col, metric):
    """Distances of the given pairs of rows, from direct differences, a slice at a time."""
    out = np.empty(len(row))
    for s in range(0, len(row), 1 << 16):
        d = b[col[s : s + (1 << 16)]] - a[row[s : s + (1 << 16)]]
        out[s : s + (1 << 16)] = np.abs(d).sum(axis=1) if metric == "manhattan" else np.sqrt(np.einsum("nd,nd->n", d, d))
    return out


def _best(row, col, dist, ids, k):
    """The ``k`` nearest of each row's pairs, ties by id."""
    order = np.lexsort((ids[col], dist, row))
    row, col, dist = row[order], col[order], dist[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], dist[keep]


STEP_DIMS = 128  # up to so many components a sum of steps fits 16 bits with room to tell near from far
TILE = 1 << 17  # pairs whose sums of steps stay in a core's cache


def _near_by_steps(a, b, k, bound):
    """(row of a, row of b, distance): pairs among which each row's ``k`` nearest by Manhattan distance within ``bound`` are.

    Components become whole steps of one width; those beyond the borders that hold nearly all of
    them count as on the border, which only brings vectors closer.  So a sum of steps is no more
    than the distance in steps and one for each component, whatever the data, and only pairs that
    this doesn't rule out are measured.  A row without a bound takes the k-th of its first tile.
    """
    dim = a.shape[1]
    kind = np.int16 if dim <= STEP_DIMS else np.int32
    most = np.iinfo(kind).max
    low, high = np.quantile(b, [0.001, 0.999], axis=0)
    step = (high - low).sum() / (most - 3 * dim)
    step = step if step > 0 else 1.0
    steps = lambda x: np.ascontiguousarray(np.rint((np.clip(x, low, high) - low) / step).astype(kind).T)
    x, y = steps(a), steps(b)
    bound, found = bound.copy(), []
    width = min(len(b), 4096)
    height = max(1, TILE // width)
    for r in range(0, len(a), height):
        for c in range(0, len(b), width):
            u, v = x[:, r : r + height], y[:, c : c + width]
            total, part = np.zeros((u.shape[1], v.shape[1]), kind), np.empty((u.shape[1], v.shape[1]), kind)
            for j in range(dim):
                np.subtract(v[j][None, :], u[j][:, None], out=part)
                np.abs(part, out=part)
                np.add(total, part, out=total)
            free = np.flatnonzero(np.isinf(bound[r : r + height]))
            if len(free) and v.shape[1] >= k:
                some = np.argpartition(total[free], k - 1, axis=1)[:, :k]
                near = _pair_distances(a[r:], b[c:], np.repeat(free, k), some.reshape(-1), "manhattan")
                bound[r + free] = near.reshape(-1, k).max(axis=1)
            limit = np.minimum(np.floor(bound[r : r + height] / step * (1 + 1e-9)) + dim + 1, most).astype(kind)
            row, col = np.nonzero(total <= limit[:, None])
            if len(row):
                found.append((row + r, col + c, _pair_distances(a[r:], b[c:], row, col, "manhattan")))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(map(np.concatenate, zip(*found)))


def _nearest(a, b, ids, k, metric, bound=None):
    """(row of a, row of b, distance) of the ``k`` nearest, ties by id; pairs beyond a row's ``bound`` may be left out.

    Candidates come from a form that is cheap to compute, kept as far as its rounding could
    matter: the centred Gram form, or sums of whole steps for Manhattan distance.  What is
    returned is measured by direct differences.  Vectors that are not finite are measured with all.
    """
    bound = np.full(len(a), np.inf) if bound is None else bound
    if metric == "manhattan":
        fine_a, fine_b = (np.flatnonzero(np.isfinite(x).all(axis=1)) for x in (a, b))
        odd_a, odd_b = (np.flatnonzero(~np.isfinite(x).all(axis=1)) for x in (a, b))
        pairs = []
        if len(fine_a) and len(fine_b):
            row, col, dist = _near_by_steps(a[fine_a], b[fine_b], k, bound[fine_a])
            pairs.append((fine_a[row], fine_b[col], dist))
        for rows, cols in ((odd_a, np.arange(len(b))), (fine_a[np.isinf(bound[fine_a])], odd_b)):
            for i in rows:
                pairs.append((np.full(len(cols), i), cols, _pair_distances(a, b, np.full(len(cols), i), cols, metric)))
        if not pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return _best(*map(np.concatenate, zip(*pairs)), ids, k)
    centre = b.mean(axis=0)
    x, y = a - centre, b - centre
    xx, yy = np.einsum("nd,nd->n", x, x), np.einsum("nd,nd->n", y, y)
    rough = xx[:, None] + yy[None, :] - 2.0 * (x @ y.T)
    room = 1e-12 * (xx + yy.max()) * np.sqrt(a.shape[1])
    reach = bound * bound * (1 + 1e-9) + 2.0 * room
    free = np.flatnonzero(np.isinf(bound))
    if len(free):
        m = min(k, len(b))
        reach[free] = np.partition(rough[free], m - 1, axis=1)[:, m - 1] + 2.0 * room[free]
    row, col = np.nonzero(rough <= reach[:, None])
    return _best(row, col, _pair_distances(a, b, row, col, metric), ids, k)


def pivots(points, vec, n):
    """``n`` pivot vectors by hash order: a bounded list that comes to the driver."""
    rows = points.select(vec).orderBy(F.xxhash64(vec)).limit(n).collect()
    return np.array([[float(x) for x in r[0]] for r in rows])


def _assign(df, vec, centers, metric, out, dist):
    """Nearest center of every row; the centers travel in the closure, a fixed small list."""

    @F.pandas_udf("struct<c int, d double>")
    def nearest(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"c": pd.Series([], dtype="int32"), "d": pd.Series([], dtype="float64")})
        m = _distances(np.stack(v.to_numpy()).astype("float64"), centers, metric)
        c = m.argmin(axis=1)
        return pd.DataFrame({"c": c.astype("int32"), "d": m[np.arange(len(c)), c]})

    return df.withColumn("_a", nearest(vec)).withColumns({out: F.col("_a.c"), dist: F.col("_a.d")}).drop("_a")


PAIRS = 100_000_000  # of a task, some seconds


def _probe_cells(who, p, cells, k, metric, block_rows, schema, hint=lambda deal: deal):
    """The ``k`` nearest points of a cell for each query sent there; both sides are dealt into blocks by their counts.

    ``who``: a written table (_q, _qv, _cell), and if it is known (_t, _visit): how far the k-th
    neighbour is at most, and the parts of the cell that may hold something closer; ``p``: (_p,
    _pv, _cell), then also _part; ``cells``: (_cell, _n).  Each (query, block) gives back at most
    ``k`` rows for each part, so no cell is one task, and there are as many tasks as the pairs ask for.
    """
    known = [c for c in ("_t", "_visit") if c in who.columns]

    def search(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"_q": left["_q"][:0], "_p": right["_p"][:0], "_d": pd.Series([], dtype="float64")})
        a, b = (np.stack(v.to_numpy()).astype("float64") for v in (left["_qv"], right["_pv"]))
        ids, names = right["_p"].to_numpy(), left["_q"].to_numpy()
        if known:
            bound, part = left["_t"].to_numpy(), right["_part"].to_numpy()
            visit = left["_visit"].to_numpy()
            goes, who_goes = np.concatenate(visit), np.repeat(np.arange(len(a)), [len(v) for v in visit])
            turns = [(who_goes[goes == c], np.flatnonzero(part == c)) for c in np.unique(part)]
        else:
            bound, turns = np.full(len(a), np.inf), [(np.arange(len(a)), np.arange(len(b)))]
        out = [(names[:0], ids[:0], np.empty(0))]
        for mine, theirs in turns:
            points, point_ids = b[theirs], ids[theirs]
            # queries go through in slices, so the distance block stays small
            for s in range(0, len(mine), 256):
                some = mine[s : s + 256]
                row, col, dist = _nearest(a[some], points, point_ids, k, metric, bound[some])
                out.append((names[some[row]], point_ids[col], dist))
        return pd.DataFrame(dict(zip(("_q", "_p", "_d"), map(np.concatenate, zip(*out)))))

    many = who.groupBy("_cell").agg(F.count(F.lit(1)).alias("_m"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block_rows)).cast("long")
    met = cells.join(many, "_cell")
    deal = staged(met.select("_cell", parts("_n").alias("_pb"), parts("_m").alias("_qb"), (F.col("_n") * F.col("_m")).alias("_pairs")))
    pairs = deal.agg(F.sum(F.col("_pairs").cast("double"))).collect()[0][0] or 0.0
    # by bytes these tasks would be few: what they cost is pairs
    tasks = max(who.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS))

    def dealt(df, key, own, other, mine, theirs):
        d = df.join(hint(deal), "_cell")
        d = d.withColumn(mine, F.pmod(F.xxhash64(key), F.col(own)))
        return d.withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))

    keys = ("_cell", "_pblock", "_qblock")
    a = dealt(who, "_q", "_qb", "_pb", "_qblock", "_pblock").select(*keys, "_q", "_qv", *known).repartition(tasks, *keys)
    b = dealt(p, "_p", "_pb", "_qb", "_pblock", "_qblock").select(*keys, "_p", "_pv", *(["_part"] if known else [])).repartition(tasks, *keys)
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(search, schema)


def _packs(sizes, room):
    """Number of the pack of each cell: small cells share one of about ``room`` points."""
    out, pack, held = [], 0, 0
    for n in sizes:
        if held and held + n > room:
            pack, held = pack + 1, 0
        out.append(pack)
        held += n
    return out


def _own_type(df, vec):
    """The vectors with the components of their type if they are floating point, else as doubles."""
    return F.col(vec) if dict(df.dtypes)[vec] in ("array<float>", "array<double>") else F.transform(vec, lambda x: x.cast("double"))


def knn_join(queries, points, k, query_id, point_id, vec="vec", metric="euclidean", n_pivots=None, block_rows=20_000):
    """The exact ``k`` nearest points of every query, without comparing every pair.

    Points are split into cells around pivots, as many as the number of points asks for.  In a
    cell both sides are dealt into blocks by their counts, so neither a cell of a third of all
    points nor one that most queries visit is one task; a side is repeated only for the blocks
    of the other.  A query first searches its own cell; the k-th distance found there bounds
    the answer, and by the triangle inequality only cells whose ring [near, far] can hold
    something closer are searched next, for what is within the bound.  Small cells share a
    block there, in which a query goes to its own ones, so it travels once for each block.
    Where nothing can be ruled out (random vectors), that is every pair, in tasks of a fixed
    number of pairs.  Ties go to the smaller point id.

    Cosine distance is half the squared Euclidean distance of unit vectors, so it is
    searched as Euclidean and converted.
    """
    inner = "euclidean" if metric == "cosine" else metric
    prep = lambda df: unit(F.col(vec)) if metric == "cosine" else _own_type(df, vec)
    q = queries.select(F.col(query_id).alias("_q"), prep(queries).alias("_qv"))
    p = staged(points.select(F.col(point_id).alias("_p"), prep(points).alias("_pv")))
    centers = pivots(p, "_pv", n_pivots or min(256, max(16, int(p.count() ** 0.5) // 8)))
    if not len(centers):  # no points, no neighbours
        ids = [f"{out} {dict(df.dtypes)[out]}" for df, out in ((queries, query_id), (points, point_id))]
        return p.sparkSession.createDataFrame([], ", ".join([*ids, "distance double, neighbor_rank long"]))
    p = staged(_assign(p, "_pv", centers, inner, "_cell", "_pd"))
    cells = staged(p.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_pd").alias("_near"), F.max("_pd").alias("_far")))
    q = staged(_assign(q, "_qv", centers, inner, "_home", "_qd"))
    types = {n: t for n, t in q.dtypes} | {n: t for n, t in p.dtypes}
    schema = f"_q {types['_q']}, _p {types['_p']}, _d double"
    # one row per pivot
    first = staged(_probe_cells(q.select("_q", "_qv", F.col("_home").alias("_cell")), p, cells, k, inner, block_rows, schema, F.broadcast))
    kth = top_per_group(first, ["_q"], ["_d", "_p"], k, "_r").groupBy("_q").agg(
        F.max(F.when(F.col("_r") == k, F.col("_d"))).alias("_tau")
    )
    rings = sorted(cells.collect())  # one row per pivot
    held, near, far = (np.array([r[c] for r in rings]) for c in ("_cell", "_near", "_far"))
    packs = dict(zip(held.tolist(), _packs([r["_n"] for r in rings], block_rows)))

    @F.pandas_udf("array<int>")
    def visits(v: pd.Series, home: pd.Series, bound: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        away = _distances(np.stack(v.to_numpy()).astype("float64"), centers[held], inner)
        gap = np.maximum(away - far, near - away)
        # distances are exact to rounding, which is relative to their size
        goes = ~(gap > bound.to_numpy()[:, None] + 1e-9 * (away + far))
        goes &= held != home.to_numpy()[:, None]
        return pd.Series([held[g].astype("int32") for g in goes])

    pack_of = F.create_map(*[F.lit(x) for pair in packs.items() for x in pair])
    more = q.join(kth, "_q", "left").withColumn("_t", F.coalesce(F.nanvl("_tau", F.lit(float("inf"))), F.lit(float("inf"))))
    more = more.withColumn("_cells", visits("_qv", "_home", "_t"))
    more = more.withColumn("_pack", F.explode(F.array_distinct(F.transform("_cells", lambda c: pack_of[c]))))
    more = staged(more.select("_q", "_qv", F.col("_pack").alias("_cell"), "_t", F.filter("_cells", lambda c: pack_of[c] == F.col("_pack")).alias("_visit")))
    packed = p.select("_p", "_pv", F.col("_cell").alias("_part"), pack_of[F.col("_cell")].alias("_cell"))
    sizes = packed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    rest = _probe_cells(more, packed, sizes, k, inner, block_rows, schema, F.broadcast)
    top = top_per_group(first.unionByName(rest), ["_q"], ["_d", "_p"], k, "neighbor_rank")
    d = F.col("_d") * F.col("_d") / 2.0 if metric == "cosine" else F.col("_d")
    return top.select(
        F.col("_q").alias(query_id), F.col("_p").alias(point_id), d.alias("distance"), F.col("neighbor_rank").cast("long").alias("neighbor_rank")
    )


def _buckets(df, vec, out, directions, shifts, width, probes):
    """Adds the bucket of each hash table, and up to ``probes`` buckets beside it, as an array of 64-bit codes.

    A code is the table's number and the steps of ``width`` that the vector has gone in each of
    the table's directions; beside it means one step over the nearest border.
    """
    tables, bits = shifts.shape

    @F.pandas_udf("array<long>")
    def codes(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        x = np.stack(v.to_numpy()).astype("float64")
        at = (x @ directions.T).reshape(len(x), tables, bits) / width + shifts
        step = np.floor(at)
        inside = at - step
        mix = np.uint64(0x9E3779B97F4A7C15)

        def code(steps):
            h = np.broadcast_to(np.arange(1, tables + 1, dtype="uint64"), steps.shape[:2]).copy()
            for b in range(bits):
                h = (h ^ steps[:, :, b].astype("int64").view("uint64")) * mix
                h ^= h >> np.uint64(29)
            return h.view("int64")

        found = [code(step)]
        gap = np.minimum(inside, 1.0 - inside)
        order = np.argsort(gap, axis=2)
        for near in range(min(probes, bits)):
            b = order[:, :, near : near + 1]
            move = np.where(np.take_along_axis(inside, b, 2) < 0.5, -1.0, 1.0)
            moved = step.copy()
            np.put_along_axis(moved, b, np.take_along_axis(step, b, 2) + move, 2)
            found.append(code(moved))
        return pd.Series(list(np.concatenate(found, axis=1)))

    return df.withColumn(out, F.array_distinct(codes(vec)))


def approximate_knn(queries, points, k, query_id, point_id, vec="vec", metric="euclidean", target=0.9, audit=256, tables=8, bits=None, seed=7, block_rows=20_000):
    """(neighbours, recall): the ``k`` nearest points that share a bucket of random-projection hash tables with the query.

    Every table cuts the space by ``bits`` random directions (as many as leave some 1,000 points
    a bucket where a direction has four steps) into steps four times as wide as
    the median audited query is far from its k-th neighbour.  ``audit`` queries, by hash order, are also searched
    exactly; while their recall is below ``target`` the steps are widened by half and the
    tables doubled, and beyond 64 tables the exact join answers.  ``recall`` is the share of
    the audited queries' exact neighbours that were found.  A query that no bucket fills has
    fewer than ``k`` rows.  Buckets of any size are dealt into blocks, none is cut.
    """
    inner = "euclidean" if metric == "cosine" else metric
    prep = unit(F.col(vec)) if metric == "cosine" else F.transform(vec, lambda x: x.cast("double"))
    q = staged(queries.select(F.col(query_id).alias("_q"), prep.alias("_qv")))
    p = staged(points.select(F.col(point_id).alias("_p"), prep.alias("_pv")))
    bits = bits or max(1, math.ceil(math.log(max(1, p.count()) / 1000, 4)))
    types = dict(q.dtypes) | dict(p.dtypes)
    schema = f"_q {types['_q']}, _p {types['_p']}, _d double"
    sample = staged(q.orderBy(F.xxhash64("_q"), "_q").limit(audit))
    truth = staged(knn_join(sample, p.withColumnRenamed("_pv", "_qv"), k, "_q", "_p", "_qv", inner))
    true_pairs = truth.select("_q", "_p")
    n_true = true_pairs.count()
    far = truth.groupBy("_q").agg(F.max("distance").alias("d")).agg(F.expr("percentile(d, 0.5)")).scalar()
    dim = q.select(F.size("_qv").alias("n")).limit(1).collect()
    width = 4.0 * ((truth.select(far.alias("w")).limit(1).collect() or [[0.0]])[0][0] or 1.0)

    def search(who):
        rng = np.random.default_rng(seed)
        directions, shifts = rng.normal(size=(tables * bits, dim[0][0])), rng.random((tables, bits))
        spread = lambda df, v, probes: staged(
            _buckets(df, v, "_cs", directions, shifts, width, probes).withColumn("_cell", F.explode("_cs")).drop("_cs")
        )
        a, b = spread(who, "_qv", bits), spread(p, "_pv", 0)
        cells = b.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
        found = staged(_probe_cells(a, b, cells, k, inner, block_rows, schema)).dropDuplicates(["_q", "_p"])
        return staged(top_per_group(found, ["_q"], ["_d", "_p"], k, "neighbor_rank"))

    recall = 1.0
    top = None
    while n_true and tables <= 64:
        got = search(sample)
        recall = got.join(true_pairs, ["_q", "_p"], "left_semi").count() / n_true
        if recall >= target:
            top = search(q)
            break
        width, tables = width * 1.5, tables * 2
    if top is None:
        exact = knn_join(q, p.withColumnRenamed("_pv", "_qv"), k, "_q", "_p", "_qv", inner)
        top, recall = exact.withColumnRenamed("distance", "_d"), 1.0
    d = F.col("_d") * F.col("_d") / 2.0 if metric == "cosine" else F.col("_d")
    return top.select(
        F.col("_q").alias(query_id), F.col("_p").alias(point_id), d.alias("distance"), F.col("neighbor_rank").cast("long").alias("neighbor_rank")
    ), recall


def neighbour_deltas(queries, points, pairs, query_id, point_id, vec="vec"):
    """Per component: mean of query minus mean of its neighbours, scaled by the queries' spread."""
    n = pairs.join(points.select(point_id, F.posexplode(vec).alias("component", "x")), point_id)
    means = n.groupBy(query_id, "component").agg(F.avg(F.col("x").cast("double")).alias("m"))
    q = queries.select(query_id, F.posexplode(vec).alias("component", "x"))
    d = q.join(means, [query_id, "component"]).withColumn("delta", F.col("x").cast("double") - F.col("m"))
    a = d.groupBy("component").agg(
        F.avg("delta").alias("mean_delta"),
        F.stddev_pop("delta").alias("std_delta"),
        (F.avg("delta") / (F.stddev_pop(F.col("x").cast("double")) + 1e-9)).alias("z_delta"),
    )
    # one row per component
    w = Window.orderBy(F.round(F.abs("z_delta"), 9).desc(), "component")
    return a.withColumns(
        {"rank": (F.row_number().over(w) - 1).cast("long"), "direction": F.when(F.col("z_delta") > 0, "+").otherwise("-")}
    )


# --- clusters ------------------------------------------------------------------------------


def to_ml(df, vec, out="features"):
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(out, array_to_vector(F.transform(vec, lambda x: x.cast("double"))))


def cluster_choice(df, vec, ks, seed=42, max_iter=100):
    """K-means and a diagonal mixture, which starts from its clusters, per k with their silhouette and rounds.

    Both run on all rows and all components.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    from . import mixtures as mx

    spark = df.sparkSession
    d = staged(to_ml(df, vec).select("features", F.transform(vec, lambda x: x.cast("double")).alias("vec")))
    out = []

    def judged(name, k, got, rounds):
        sil = ClusteringEvaluator().evaluate(got) if got.select("prediction").distinct().limit(2).count() > 1 else 0.0
        out.append((name, k, float(sil), rounds))

    for k in ks:
        model = KMeans(k=k, seed=seed, maxIter=max_iter).fit(d)
        got = staged(model.transform(d))
        judged("kmeans", k, got, model.summary.numIter)
        fitted, trace = mx.fit(d, "vec", mx.from_groups(got, "vec", "prediction", k), max_iter)
        judged("gmm", k, mx.assign(d, "vec", fitted), len(trace))
    return spark.createDataFrame(out, "algorithm string, k int, silhouette double, rounds int")


def centroids(df, cluster, vec):
    """Mean vector per cluster as (cluster, component, value) rows."""
    return df.select(cluster, F.posexplode(vec).alias("component", "x")).groupBy(cluster, "component").agg(
        F.avg(F.col("x").cast("double")).alias("value")
    )


def centroid_arrays(components, cluster):
    """One array per cluster; its length is the vector's."""
    return components.groupBy(cluster).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("component", "value"))), lambda s: s["value"]).alias("centroid")
    )


def radii(df, cluster, vec, share=0.9, outcome=None):
    """Distance percentile of the members to their centroid, member count, mean outcome."""
    c = staged(centroid_arrays(centroids(df, cluster, vec), cluster))
    d = df.join(c, cluster).withColumn("_d", distance(F.col(vec), F.col("centroid")))
    q = exact_quantiles(d, [cluster], "_d", {"radius": share})
    agg = [F.count(F.lit(1)).alias("n_members")]
    if outcome:
        agg.append(F.avg(outcome).alias("mean_outcome"))
    return d.groupBy(cluster).agg(*agg).join(q, cluster)


def predict(df, vec, centers, cluster):
    """Nearest centroid of every row; ``centers``: (cluster, centroid), one row per cluster."""
    table = centers.agg(F.array_sort(F.collect_list(F.struct(cluster, "centroid"))).alias("c")).scalar()
    d = df.withColumn("_c", table)
    best = F.array_min(
        F.transform("_c", lambda s: F.struct(distance(F.col(vec), s["centroid"]).alias("d"), s[cluster].alias("k")))
    )
    return d.withColumn("_b", best).withColumns({"predicted": F.col("_b.k"), "distance": F.col("_b.d")}).drop("_c", "_b")


def signatures(z, cluster, features, top=8, least=0.1):
    """Mean z of every feature per cluster, strongest first, weak ones dropped."""
    long = unpivot(z, [cluster], features)
    m = long.groupBy(cluster, "feature").agg(F.avg("value").alias("mean_z"), F.count(F.lit(1)).alias("size"))
    m = top_per_group(m, [cluster], [F.round(F.abs("mean_z"), 9).desc(), "feature"], top)
    return m.where(F.abs("mean_z") > least).withColumn("direction", F.when(F.col("mean_z") > 0, "+").otherwise("-"))


def cluster_lift(df, split, cluster, label):
    """Winner share and lift per split and cluster; the cluster of interest is the best of the train split."""
    y = F.col(label).cast("int")
    base = df.groupBy(split).agg(F.avg(y).alias("_b"))
    a = df.groupBy(split, cluster).agg(F.count(F.lit(1)).alias("size"), F.sum(y).alias("n_winners"), F.avg(y).alias("winner_fraction"))
    a = a.join(F.broadcast(base), split).withColumn("lift_vs_base", ratio("winner_fraction", "_b")).drop("_b")
    best = a.where(F.col(split) == "train").agg(F.max_by(cluster, F.struct("winner_fraction", -F.col(cluster)))).scalar()
    return a.withColumn("is_cluster_of_interest", F.col(cluster) == best)


def hybrid(df, vec, n, prefix="emb_"):
    """Vector components as columns next to the other columns."""
    return df.select(*[c for c in df.columns if c != vec], *[F.get(F.col(vec), F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(n)])
