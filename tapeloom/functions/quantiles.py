"""Exact order statistics of groups of any size.

The built-in exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, so it is only used where a group is bounded (one symbol's bars, one
row per day).  Here a sketch brackets each wanted rank, rows below the bracket are only
counted, and the few rows inside it are collapsed to (value, count) and ranked.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import staged

ACCURACY = 20_000
MARGIN = 4.0 / ACCURACY


def exact_quantiles(df, by, value, quantiles, few_groups=False, stage=True, nearest=False):
    """One row per group with linear-interpolated quantiles, or the values of the nearest ranks.

    ``quantiles``: {output column: probability}.  Groups without values are absent.
    ``few_groups`` says the groups are a fixed list (windows, specs, rules), which bounds
    the sketch table that is broadcast; otherwise the join strategy is left to Spark.
    ``stage=False`` when ``df`` is already a written table.
    """
    by = list(by)
    names, probs = list(quantiles), [float(p) for p in quantiles.values()]
    v = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    v = staged(v) if stage else v
    grid = [x for p in probs for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    sketch = v.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", F.array(*[F.lit(x) for x in grid]), F.lit(ACCURACY)).alias("_q"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    pieces = []
    for i, p in enumerate(probs):
        k = (F.col("_n") - 1) * F.lit(p)
        k = F.floor(k + 0.5).cast("double") if nearest else k
        # the margin has to span several ranks; a group too small for that is ranked whole
        room = F.col("_n") * MARGIN
        small = room < 4
        lo = F.when(small | (F.floor(k) <= room), F.col("_min")).otherwise(F.col("_q")[2 * i])
        hi = F.when(small | (F.ceil(k) >= F.col("_n") - 1 - room), F.col("_max")).otherwise(F.col("_q")[2 * i + 1])
        pieces.append(F.struct(F.lit(i).alias("i"), lo.alias("lo"), hi.alias("hi"), k.alias("k")))
    sketch = sketch.select(*by, F.array(*pieces).alias("_b"))
    if by:
        rows = v.join(F.broadcast(sketch) if few_groups else sketch, by)
    else:
        rows = v.withColumn("_b", sketch.select("_b").scalar())
    hit = rows.select(*by, "_v", F.explode(F.filter("_b", lambda b: F.col("_v") <= b["hi"])).alias("_x"))
    # below the bracket only the count matters, so those rows collapse on the map side
    point = F.when(F.col("_v") >= F.col("_x.lo"), F.col("_v"))
    counts = hit.groupBy(*by, F.col("_x.i").alias("_i"), F.col("_x.k").alias("_k"), point.alias("_p")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    w = Window.partitionBy(*by, "_i").orderBy(F.col("_p").asc_nulls_first())
    counts = counts.withColumn("_cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.col("_cum") - F.col("_c")

    def at(k):
        return F.max(F.when((first <= k) & (k < F.col("_cum")), F.col("_p")))

    lo_rank, hi_rank = F.floor("_k"), F.ceil("_k")
    frac = F.max(F.col("_k") - F.floor("_k"))
    low, high = at(lo_rank), at(hi_rank)
    got = counts.groupBy(*by, "_i").agg((low + (high - low) * frac).alias("_val"))
    wide = [F.max(F.when(F.col("_i") == i, F.col("_val"))).alias(n) for i, n in enumerate(names)]
    return got.groupBy(*by).agg(*wide)


BUCKET_ROWS = 20_000


def order_bucket(df, value, out, n=None):
    """Cut ``value`` at sketch quantiles, keeping order: equal values share a bucket.

    Without ``n`` there are as many buckets as the number of rows asks for.
    """
    n = n or max(8, df.count() // BUCKET_ROWS)
    cuts = sorted(set(df.stat.approxQuantile(value, [i / n for i in range(1, n)], 1.0 / (4 * n)))) or [0.0]
    return Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol=value, outputCol=out, handleInvalid="keep"
    ).transform(df)


def running_before(df, by, value, sums, n=None):
    """For every distinct (by, value): the sums, and the sums over all smaller values.

    Rows collapse to distinct values first, then a prefix over the bucket
    totals per group is added to a prefix inside the bucket, so no task sees a whole
    group.  Output columns: by, value, each sum, and ``<sum>_before``.
    """
    by = list(by)
    d = staged(df.groupBy(*by, value).agg(*[F.sum(c).alias(c) for c in sums]))
    d = order_bucket(d, value, "_bk", n)
    tot = d.groupBy(*by, "_bk").agg(*[F.sum(c).alias(c) for c in sums])
    wt = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*by, "_bk", *[F.coalesce(F.sum(c).over(wt), F.lit(0)).alias("_t" + c) for c in sums])
    wi = Window.partitionBy(*by, "_bk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"_i" + c: F.coalesce(F.sum(c).over(wi), F.lit(0)) for c in sums}).join(tot, [*by, "_bk"])
    return d.select(*by, value, *sums, *[(F.col("_t" + c) + F.col("_i" + c)).alias(c + "_before") for c in sums])

