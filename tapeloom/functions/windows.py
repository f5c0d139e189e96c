"""Window helpers shared by the keyed-series operators.

Daily bars hold one row per (symbol, date) and time bars one row per (symbol, slot),
so a symbol's series is bounded by the calendar however many raw ticks the symbol has.
That bound is what makes ``partitionBy("symbol")`` safe; raw ticks are always
pre-aggregated first and never windowed by symbol.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


class Series:
    """Row frames over one keyed, ordered series."""

    def __init__(self, keys=("symbol",), order=("date",)):
        self.keys = tuple(keys)
        self.order = tuple(order)

    @property
    def w(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def trailing(self, n):
        return self.w.rowsBetween(-(n - 1), 0)

    def prior(self, n):
        return self.w.rowsBetween(-n, -1)

    def forward(self, n):
        return self.w.rowsBetween(1, n)

    def running(self):
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    def before(self):
        return self.w.rowsBetween(Window.unboundedPreceding, -1)

    def lag(self, c, n=1):
        return F.lag(_c(c), n).over(self.w)

    def lead(self, c, n=1):
        return F.lead(_c(c), n).over(self.w)

    # aggregates that are null unless the whole frame holds values
    def roll(self, agg, c, n):
        return full(agg, c, self.trailing(n), n)

    def roll_prior(self, agg, c, n):
        return full(agg, c, self.prior(n), n)

    def roll_forward(self, agg, c, n):
        return full(agg, c, self.forward(n), n)


DAILY = Series()
TICKBARS = Series(order=("ts",))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """Not-a-number and infinities become null."""
    c = _c(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def full(agg, c, frame, n) -> Column:
    """``agg(c)`` over ``frame`` when all ``n`` values are there, else null."""
    c = _c(c)
    return F.when(F.count(c).over(frame) == n, agg(c).over(frame))


def ratio(a, b) -> Column:
    """Division that gives null for a zero divisor."""
    return F.try_divide(_c(a), _c(b))


def safe_corr(x, y, over=None) -> Column:
    """Pearson correlation over complete pairs; null for a constant side, where the built-in raises."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)

    def ov(c):
        return c if over is None else c.over(over)

    return F.when(
        ov(F.max(a)) > ov(F.min(a)),
        F.try_divide(ov(F.covar_pop(a, b)), ov(F.stddev_pop(a)) * ov(F.stddev_pop(b))),
    )


def with_means(df, wanted, s=None):
    """Rolling means as differences of one running sum: linear in rows whatever the window.

    ``wanted``: {output: (column, window)}.  A sliding frame re-adds its whole window on
    every row, which dominates long averages; the difference does not, and it is exact
    where a window sums to zero, because adding zero leaves the running sum unchanged.
    """
    s = s or DAILY
    cols = {}
    for c, _ in wanted.values():
        cols.setdefault(c, f"_{len(cols)}")
    base = {}
    for c, tag in cols.items():
        # what is not finite counts as missing: one such value would spoil every later difference
        x = finite(F.col(c).cast("double"))
        base["_cum" + tag] = F.sum(x).over(s.running())
        base["_cnt" + tag] = F.count(x).over(s.running())
    df = df.withColumns(base)
    out = {}
    for name, (c, n) in wanted.items():
        cum, cnt = "_cum" + cols[c], "_cnt" + cols[c]
        total = F.col(cum) - F.coalesce(s.lag(cum, n), F.lit(0.0))
        have = F.col(cnt) - F.coalesce(s.lag(cnt, n), F.lit(0))
        out[name] = F.when(have == n, total / n)
    return df.withColumns(out).drop(*base)


def with_extremes(df, wanted, s=None):
    """Rolling maxima and minima over long windows from short ones.

    ``wanted``: {output: (agg, column, window)}.  A window of N rows is covered by about
    sqrt(N) shorter windows of sqrt(N) rows each, read back with ``lag``, so a row costs
    2 sqrt(N) steps instead of N.  The covers may overlap, which an extreme allows.
    """
    s = s or DAILY
    short, plan = {}, {}
    for name, (agg, c, n) in wanted.items():
        b = math.isqrt(n - 1) + 1
        tag = f"_x_{agg.__name__}_{c}_{b}"
        short[tag] = s.roll(agg, c, b)
        plan[name] = (agg, tag, sorted({*range(0, n - b, b), n - b}))
    df = df.withColumns(short)
    out = {}
    for name, (agg, tag, offsets) in plan.items():
        parts = [F.col(tag) if k == 0 else s.lag(tag, k) for k in offsets]
        pick = F.greatest if agg is F.max else F.least
        whole = parts[0].isNotNull()
        for x in parts[1:]:
            whole = whole & x.isNotNull()
        out[name] = F.when(whole, pick(*parts) if len(parts) > 1 else parts[0])
    return df.withColumns(out).drop(*short)


def row_of(df) -> Column:
    """A one-row frame as one struct-valued scalar subquery; its fields share a single run."""
    return df.select(F.struct(*df.columns).alias("r")).scalar()


def emas(df, wanted, keys=("symbol",), order=("date",), warmup=False):
    """Exponential means, alpha = 2/(span+1), started at the first non-null value.

    ``wanted``: {output: (column, span)}; the columns share their null pattern.

    y[t] = (1-a) y[t-1] + a x[t] is linear, so each key's series is cut into blocks of L
    rows: inside a block the mean is a scaled running sum, and a block's start needs only
    the closing value of the block before it, because L is chosen so that the weight of
    anything older, (1-a)^L = 1e-17, is below double precision.  The whole thing is
    running windows over one partitioning: no Python, linear in rows.

    ``warmup`` leaves the first ``span - 1`` values null.
    """
    s = Series(keys, order)
    rest = sorted(wanted.items(), key=lambda item: -item[1][1])
    while rest:
        # a block as long as a wide span needs would overflow the powers of a much narrower one
        widest = rest[0][1][1]
        now = {n: cs for n, cs in rest if cs[1] * 8 >= widest}
        rest = [(n, cs) for n, cs in rest if n not in now]
        df = _emas_of_like_spans(df, now, s, widest, warmup)
    return df


def _emas_of_like_spans(df, wanted, s, widest, warmup):
    value = {n: finite(_c(c).cast("double")) for n, (c, _) in wanted.items()}
    lead = next(iter(value.values()))
    block = max(2, math.ceil(39.2 / -math.log(1.0 - 2.0 / (widest + 1.0))))
    df = df.withColumn("_en", F.count(lead).over(s.running()) - 1)
    df = df.withColumns({"_eb": F.floor(F.col("_en") / block), "_ep": (F.col("_en") % block).cast("double")})
    inside = Window.partitionBy(*s.keys, "_eb").orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0)
    inner = {}
    for name, (_, span) in wanted.items():
        a = 2.0 / (span + 1.0)
        d = F.lit(1.0 - a)
        # a missing input repeats the previous position and adds nothing
        term = F.when(F.col("_en") == 0, 1.0).otherwise(a) * value[name] * F.pow(d, -F.col("_ep"))
        inner["_ei_" + name] = F.sum(term).over(inside) * F.pow(d, F.col("_ep"))
    df = df.withColumns(inner)
    ends = (F.col("_ep") == block - 1) & lead.isNotNull()
    carry = {"_ec_" + n: F.last(F.when(ends, F.col("_ei_" + n)), True).over(s.before()) for n in wanted}
    df = df.withColumns(carry)
    out = {}
    for name, (_, span) in wanted.items():
        d = F.lit(1.0 - 2.0 / (span + 1.0))
        y = F.col("_ei_" + name) + F.pow(d, F.col("_ep") + 1.0) * F.coalesce(F.col("_ec_" + name), F.lit(0.0))
        out[name] = F.when(F.col("_en") >= ((span - 1) if warmup else 0), y)
    return df.withColumns(out).drop("_en", "_eb", "_ep", *inner, *carry)


def ema(df, value, span, out, keys=("symbol",), order=("date",), warmup=False):
    return emas(df, {out: (value, span)}, keys, order, warmup)


def true_range(s: Series = DAILY) -> Column:
    """max(h-l, |h-c'|, |l-c'|); nulls are skipped, so the first row is h-l."""
    pc = s.lag("close")
    return F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - pc),
        F.abs(F.col("low") - pc),
    )
