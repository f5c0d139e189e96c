"""Shaping shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import Tables  # noqa: F401


def rounded(x, places: int):
    """``round`` of a double by the same rule and to the same value, without a decimal number for most of them.

    An integer below 2^53 over a power of ten is the nearest double to the rounded decimal.  Only what
    is too close to half a unit, too large or not finite takes the decimal.
    """
    scaled = x * float(10**places)
    whole = F.floor(scaled + 0.5)
    plain = (F.abs(scaled) < float(1 << 40)) & (F.abs(scaled - whole) < 0.499)
    return F.when(plain, whole / float(10**places)).otherwise(F.round(x, places))


def emit(df, *cols, coarse=()):
    """Select ``cols`` in comparable form: doubles to 6 places, flags as ints, dates as text.

    ``coarse`` columns are kept to 2 places: quotients whose divisor comes close to zero.
    """
    types = dict(df.dtypes)
    out = []
    for c in cols or df.columns:
        t, x = types[c], F.col(c)
        if t in ("double", "float"):
            x = rounded(x.cast("double"), 2 if c in coarse else 6)
        elif t == "boolean":
            x = x.cast("int")
        elif t.startswith(("date", "timestamp")):
            x = x.cast("string")
        out.append(x.alias(c))
    return df.select(*out)


def E(spec: str, body: str) -> str:
    """The SQL side of ``emit``: ``d:`` date/time as text, ``f:`` double, ``g:`` coarse double, ``b:`` flag, ``i:`` bigint."""
    out = []
    for item in spec.split():
        kind, _, name = item.rpartition(":")
        out.append(
            {
                "": name,
                "d": f"CAST({name} AS VARCHAR) AS {name}",
                "f": f"round(CAST({name} AS DOUBLE), 6) + 0.0 AS {name}",
                "g": f"round(CAST({name} AS DOUBLE), 2) + 0.0 AS {name}",
                "b": f"CAST({name} AS INTEGER) AS {name}",
                "i": f"CAST({name} AS BIGINT) AS {name}",
            }[kind]
        )
    return f"SELECT {', '.join(out)} FROM ({body}) q_out"
