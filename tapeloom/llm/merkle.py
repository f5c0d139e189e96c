"""Merkle manifest of a dataset by lag and lead windows.

Every row is a leaf; leaves of a group ascend by id, and every three consecutive nodes of a
level become their hash until one is left, the group's subroot.  Subroots in the order of the
groups give the root the same way.

Six levels are made over blocks of 3^6 = 729 consecutive nodes: a node stays on the row of its
first leaf, so its siblings on a level are lag and lead columns at fixed offsets, masked by the
slot in the run and the length of the run, and the row of the first child hashes the parent.
One exchange and one sort serve the six levels.  The tops of the blocks are the nodes of the
next table, a 729th as large; a proof joins the steps inside its block with those of the
block's top.  A group of any size is spread over its blocks.

Defined cases: a null field is a mark of its own; a null group is the first group, null ids
come first in it; rows that share an id are ordered by their leaf; a group of one leaf is its
own subroot, one group's subroot the root; a text without line breaks is not changed by
tampering, a null id is never tampered with; no rows, no result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stats import positions
from ..session import staged

FAN = 3
LEVELS = 6  # of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _digest(*parts) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(x: Column) -> Column:
    s = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS, text_col: str = "text",
) -> DataFrame:
    """(id, g, hash, tampered): leaf hashes, and those of texts without line breaks where the tampering test says so."""
    names = [f"f{i}" for i in range(len(fields))]
    src = docs.select(F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("source"), *[F.col(f).alias(n) for f, n in zip(fields, names)])
    parts = {f: _field(F.col(n)) for f, n in zip(fields, names)}
    text = F.col(names[list(fields).index(text_col)]).cast("string")
    altered = parts | {text_col: _field(F.translate(text, "\n", ""))}
    hit = (F.pmod(F.crc32(F.col("id").cast("string")), F.lit(2)) == 0) & text.contains("\n")
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null first, then by bytes
    return src.select(
        "id", group.alias("g"), _digest(*parts.values()).alias("hash"), F.when(hit, _digest(*altered.values())).alias("tampered")
    )


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``at``, the place in the group from 0, and ``n``, the group's size; written."""
    got = positions(rows, ["g"], order, "place")
    return staged(got.withColumn("at", F.col("place") - 1).withColumnRenamed("n_group", "n").drop("place"))


def _climbed(nodes: DataFrame) -> DataFrame:
    """Adds block, hash0 .. hash6 (nodes by level, on the row of their first leaf) and step0 .. step5 (their siblings)."""
    size = FAN**LEVELS
    w = Window.partitionBy("g", "block").orderBy("at")
    d = nodes.withColumn("block", F.expr(f"at div {size}")).withColumn("hash0", F.col("hash"))
    for level in range(LEVELS):
        width = FAN**level
        count, place = F.expr(f"(n + {width - 1}) div {width}"), F.expr(f"at div {width}")
        own = F.col(f"hash{level}")
        slot = F.pmod(place, F.lit(FAN))
        run = F.least(F.lit(FAN), count - place + slot)
        before = [F.when(slot >= k, F.lag(own, k * width).over(w)) for k in range(FAN - 1, 0, -1)]
        after = [F.when(slot + k < run, F.lead(own, k * width).over(w)) for k in range(1, FAN)]
        live = (F.pmod(F.col("at"), F.lit(width)) == 0) & (count > 1)
        d = d.withColumns({"before": F.concat_ws("", *before), "after": F.concat_ws("", *after)})
        parent = F.when(count <= 1, own).when(live & (slot == 0), _digest(own, "after"))
        step = F.when(live, F.struct("before", "after"))
        d = d.withColumns({f"step{level}": step, f"hash{level + 1}": parent}).drop("before", "after")
    return d


def _tops(nodes: DataFrame) -> DataFrame:
    """The nodes of the next table: the top of every block."""
    size = FAN**LEVELS
    top = _climbed(nodes).where(F.pmod(F.col("at"), F.lit(size)) == 0)
    return staged(top.select("g", F.col("block").alias("at"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col(f"hash{LEVELS}").alias("hash")))


def _with_steps(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """Adds to every node its steps, inside the block and then those of ``upper`` (g, at, steps, ...) at the block's place."""
    w = Window.partitionBy("g", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = [F.last(f"step{level}", ignorenulls=True).over(w) for level in range(LEVELS)]  # of the ancestor on that level
    d = _climbed(nodes).select(*nodes.columns, "block", F.filter(F.array(*own), lambda s: s.isNotNull()).alias("own"))
    high = upper.withColumnsRenamed({"at": "block", "steps": "more"})
    got = d.join(high, ["g", "block"])
    rest = [c for c in upper.columns if c not in ("g", "at", "steps")]
    return got.select(*nodes.columns, *rest, F.concat("own", "more").alias("steps"))


def _tables(nodes: DataFrame) -> list[DataFrame]:
    """The nodes and the tables over them, up to one node a group."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        out.append(_tops(out[-1]))
        most = -(-most // FAN**LEVELS)
    return out


def _down(tables: list[DataFrame], over: DataFrame) -> DataFrame:
    """Steps of the nodes of the first table, from those (g, at, steps, ...) of the last table's."""
    got = over
    for i, nodes in enumerate(reversed(tables[:-1])):
        got = _with_steps(nodes, got)
        if i < len(tables) - 2:
            rest = [c for c in over.columns if c not in ("g", "at", "steps")]
            got = staged(got.select("g", "at", "steps", *rest))
    return got


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS, text_col: str = "text",
) -> DataFrame:
    """(id, leaf, tampered, subroot, root, steps) of every row.

    ``steps`` are the siblings (before, after) of the leaf's ancestors up to the root, and
    ``tampered`` is null where tampering changes nothing.
    """
    hashed = staged(leaves(docs, id_col, group_col, fields, text_col))  # the range sort reads it twice
    tables = _tables(_placed(hashed, ["id", "hash"]))
    subroots = tables[-1].select(F.lit(0).alias("g"), F.col("g").alias("group"), "hash")
    sources = _tables(_placed(subroots, ["group"]))
    root = sources[-1].select("hash").first()
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    end = sources[-1].select("g", "at", nothing.alias("steps"))
    named = _down(sources, end) if len(sources) > 1 else sources[0].withColumn("steps", nothing)
    over = staged(named.select(F.col("group").alias("g"), F.lit(0).cast("long").alias("at"), "steps", F.col("hash").alias("subroot")))
    if len(tables) == 1:  # every group has one leaf
        got = tables[0].join(over.drop("at"), "g")
    else:
        got = _down(tables, over)
    return got.select("id", F.col("hash").alias("leaf"), "tampered", "subroot", F.lit(root and root[0]).cast("string").alias("root"), "steps")


def proof_digest(steps: Column) -> Column:
    """The hash of all siblings, from the leaf to the root and from left to right."""
    return _digest(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda h, s: _digest(s["before"], h, s["after"]))
