"""Query registry: a Spark plan and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

import re

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_ORDER = "ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice"

# Named SQL fragments; a query names the ones it uses and their needs follow.
CTES: dict[str, str] = {
    "bars": f"""
      SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
             first(l_extendedprice {_ORDER}) AS open,
             max(l_extendedprice) AS high, min(l_extendedprice) AS low,
             last(l_extendedprice {_ORDER}) AS close,
             last(l_extendedprice * (1 - l_discount) {_ORDER}) AS close_adj,
             CAST(sum(l_quantity) AS BIGINT) AS volume
      FROM lineitem GROUP BY 1, 2""",
    "market": "SELECT date, avg(close) AS close FROM bars GROUP BY date",
    "market_ohlcv": """
      SELECT date, avg(close) AS close, avg(high) AS high, avg(low) AS low,
             CAST(sum(volume) AS DOUBLE) AS volume FROM bars GROUP BY date""",
    "peers": """
      SELECT CAST(s_suppkey AS VARCHAR) AS symbol, r_name AS peer_group, n_name AS sector
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ticks": """
      SELECT event_type AS symbol, ts, event_id, user_id, value AS price FROM events""",
    "hourly": """
      SELECT symbol, time_bucket(INTERVAL '60 minutes', ts) AS ts,
             first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
             last(price ORDER BY ts, event_id) AS close, count(*) AS volume
      FROM ticks GROUP BY 1, 2""",
}


def add_cte(name: str, sql: str) -> None:
    CTES[name] = sql


def sql(body: str) -> str:
    """Prefix ``body`` with every fragment it refers to, in dependency order."""
    need: list[str] = []

    def visit(text):
        for name in CTES:
            if name not in need and re.search(rf"\b(?:FROM|JOIN|from|join)\s+{name}\b", text):
                visit(CTES[name])
                if name not in need:
                    need.append(name)

    visit(body)
    if not need:
        return body
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in need)
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if m:
        return f"WITH {m.group(1) or ''}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, oracle: str | None = None):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return fn

    return register


def R(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


W = "(PARTITION BY symbol ORDER BY date)"


def win(lo: str, hi: str = "CURRENT ROW", part: str = "symbol", order: str = "date") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"({p}ORDER BY {order} ROWS BETWEEN {lo} AND {hi})"


def roll(agg: str, x: str, n: int, part: str = "symbol", order: str = "date") -> str:
    w = win(f"{n - 1} PRECEDING", part=part, order=order)
    return f"(CASE WHEN count({x}) OVER {w} = {n} THEN {agg}({x}) OVER {w} END)"


def prior(agg: str, x: str, n: int, part: str = "symbol", order: str = "date") -> str:
    w = win(f"{n} PRECEDING", "1 PRECEDING", part=part, order=order)
    return f"(CASE WHEN count({x}) OVER {w} = {n} THEN {agg}({x}) OVER {w} END)"


def fwd(agg: str, x: str, n: int, part: str = "symbol", order: str = "date") -> str:
    w = win("1 FOLLOWING", f"{n} FOLLOWING", part=part, order=order)
    return f"(CASE WHEN count({x}) OVER {w} = {n} THEN {agg}({x}) OVER {w} END)"


def lag(x: str, n: int = 1, part: str = "symbol", order: str = "date") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"lag({x}, {n}) OVER ({p}ORDER BY {order})"


def lead(x: str, n: int = 1, part: str = "symbol", order: str = "date") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"lead({x}, {n}) OVER ({p}ORDER BY {order})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"
