"""Connected components of an edge table by alternating large and small stars.

Every round is a group minimum, which combines on the map side, and a join of the edges with
one row per node; the edge table is written to the shared folder between rounds.  No list of
neighbours is ever built, so a node may touch a third of all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b rehung on the least neighbour of each node.

    The joins are sorted merges: packed files and exploded sides are larger in memory than Spark sizes them.
    """
    if large:
        sides = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        sides = sides.select("e.a", "e.b")
        least = sides.groupBy("a").agg(F.min("b").alias("m"))
        hung = sides.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        hung = edges.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.toDF("a", "b"))
    return hung.where("a > b").distinct()


def _mark(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that some edge names.

    Self loops, repeated and reversed edges are fine; rows with a null end are ignored.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    now = staged(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    mark = _mark(now)
    while mark[0]:
        after = staged(_star(_star(now, True), False))
        discard(now)
        now, (before, mark) = after, (mark, _mark(after))
        if mark == before:
            break
    roots = now.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots)
