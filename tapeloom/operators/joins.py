"""Joins Spark has no direct operator for: interval, as-of, next row, tier lookup."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


def interval_join(spans, points, key, lo, hi, point, bucket_days=32):
    """Spans x points of the same key with ``lo <= point <= hi``.

    A span is repeated once per time bucket it touches and joined on (key, bucket), so
    one key's spans never meet all of that key's points, and a hot key spreads over its
    buckets.  Each pair meets in exactly one bucket, the point's.
    """
    b = F.lit(bucket_days)

    def bucket(c):
        return F.floor(F.unix_date(c) / b)

    s = spans.where(F.col(lo) <= F.col(hi)).withColumn("_bk", F.explode(F.sequence(bucket(F.col(lo)), bucket(F.col(hi)))))
    p = points.withColumn("_bk", bucket(F.col(point)))
    return s.join(p, [key, "_bk"]).where((F.col(point) >= F.col(lo)) & (F.col(point) <= F.col(hi))).drop("_bk")


def asof_backward(left, right, keys, left_ts, right_ts, values):
    """Each left row with the latest right row at or before it.

    The two sides are stacked and the last right values carried forward; a right row
    sorts before a left row of the same time.  Both sides are time-slot tables, so a
    key's stack is bounded by its slots.
    """
    keys = list(keys)
    extra = [c for c in left.columns if c not in keys and c != left_ts]
    a = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*extra).alias("_row"), F.lit(None).cast(
        right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_v"))
    b = right.select(
        *keys,
        F.col(right_ts).alias("_t"),
        F.lit(0).alias("_side"),
        F.lit(None).cast(left.select(F.struct(*extra).alias("v")).schema["v"].dataType).alias("_row"),
        F.struct(*values).alias("_v"),
    )
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_last", F.last("_v", True).over(w)).where(F.col("_side") == 1)
    return out.select(*keys, F.col("_t").alias(left_ts), "_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def next_row_after(left, bars, keys, left_date, bar_date, values):
    """Each left row with the first bar strictly after its date, whether or not that date has a bar."""
    keys = list(keys)
    extra = [c for c in left.columns if c not in keys and c != left_date]
    payload = F.struct(F.col(bar_date).alias("next_date"), *values)
    kind = bars.select(payload.alias("v")).schema["v"].dataType
    rkind = left.select(F.struct(*extra).alias("v")).schema["v"].dataType if extra else None
    row = F.struct(*extra) if extra else F.lit(None).cast("int")
    a = left.select(*keys, F.col(left_date).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(kind).alias("_v"))
    none = F.lit(None).cast(rkind if rkind is not None else "int")
    b = bars.select(*keys, F.col(bar_date).alias("_t"), F.lit(0).alias("_side"), none.alias("_row"), payload.alias("_v"))
    # backwards in time: a left row sorts before the bars of its own date, which do not count
    w = Window.partitionBy(*keys).orderBy(F.col("_t").desc(), F.col("_side").desc())
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    out = a.unionByName(b).withColumn("_n", F.last("_v", True).over(w)).where(F.col("_side") == 1)
    cols = ["_row.*"] if extra else []
    return out.select(*keys, F.col("_t").alias(left_date), *cols, "_n.*")


def tier_lookup(value, tiers, field):
    """Value of the highest tier whose threshold is at or below ``value``; a fixed ladder, no join.

    ``tiers``: ascending list of tuples with the threshold first.
    """
    out = F.lit(float(tiers[0][field]))
    x = F.col(value) if isinstance(value, str) else value
    for t in tiers[1:]:
        out = F.when(x >= t[0], F.lit(float(t[field]))).otherwise(out)
    return out


def presence(a, b, on, a_flag, b_flag):
    """Full outer join that says on which side each key occurs."""
    x = a.select(*on).distinct().withColumn(a_flag, F.lit(True))
    y = b.select(*on).distinct().withColumn(b_flag, F.lit(True))
    j = x.join(y, list(on), "full_outer")
    return j.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in (a_flag, b_flag)})


def overlap(a, b, on):
    """Intersection size, shares of each side, Jaccard."""
    p = presence(a, b, on, "_a", "_b")
    n_a, n_b, both = F.count_if(F.col("_a")), F.count_if(F.col("_b")), F.count_if(F.col("_a") & F.col("_b"))
    s = p.agg(n_a.alias("n_a"), n_b.alias("n_b"), both.alias("n_both"))
    return s.select(
        "n_a",
        "n_b",
        "n_both",
        F.coalesce(F.try_divide("n_both", "n_a"), F.lit(0.0)).alias("share_of_a"),
        F.coalesce(F.try_divide("n_both", "n_b"), F.lit(0.0)).alias("share_of_b"),
        (F.col("n_both") / F.greatest(F.col("n_a") + F.col("n_b") - F.col("n_both"), F.lit(1))).alias("jaccard"),
    )
