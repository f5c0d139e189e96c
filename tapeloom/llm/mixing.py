"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential number divided by its quality weight, from a hash of its
id, so reruns agree.  A source first takes complete epochs; the rest of its budget goes to
its documents in key order, as far as their prefix sum reaches.

Defined cases: a null text has no words; a null source is a source of its own, after all
others; documents without words are never taken; rows of one source with equal id and text
share their key and are taken together; no rows, no result; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .memory import release

WEIGHTS = (1.0, 2.0, 3.0)
LIMIT = 3  # a document is repeated so often at most
ROWS_A_BUCKET = 50_000

_SPACE = bytes([9, 10, 11, 12, 13, 32])
_NO_LETTER = bytes(b for b in range(128) if not chr(b).isalpha())


def _measured(texts: pa.Array) -> pa.Array:
    size, quality = [], []
    for text in texts.cast(pa.binary()):
        x = text.as_py() or b""
        dense, letters = len(x.translate(None, _SPACE)), len(x.translate(None, _NO_LETTER))
        quality.append(0.05 + 0.95 * (letters / dense) if dense else 0.05)
        size.append(len(x.split()))  # bytes.split() parts at exactly the six white-space bytes
    release()
    return pa.StructArray.from_arrays([pa.array(size, pa.int64()), pa.array(quality, pa.float64())], ["size", "quality"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *more) -> DataFrame:
    """(id, source, size, key, *more): words, and the exponential key by the share of letters."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    unit = (F.conv(F.substring(F.md5(ident), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    measure = F.arrow_udf(_measured, "struct<size: long, quality: double>")
    src = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), measure(F.col(text_col).cast("string")).alias("m"), unit.alias("u"), *more
    )
    names = [c for c in src.columns if c not in ("m", "u", "id", "source")]
    return src.select("id", "source", "m.size", (-F.log("u") / F.col("m.quality")).alias("key"), *names)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from one row per source with its size.

    Sources share the whole by weight; what exceeds ``limit`` times a source's size goes to
    the others by weight until none is above.  Sorted by limit per weight, the sources that
    stop there are a prefix, which running sums find in one pass.  A source is a row here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("top", F.col("source_size") * limit).withColumn("ratio", F.col("top") / F.col("w"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    room = F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0))
    rest = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("level", room / rest)
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    s = s.withColumn("share", F.coalesce(F.col("w") * level, F.col("top").cast("double")))
    return s.select("source", "source_size", F.least("share", F.col("top").cast("double")).alias("target"))


def cuts(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target, epochs, cut): complete epochs, and the border of the fraction.

    ``cut`` is the (key, id) of the document on which the budget ends, the words of it that
    still fit, and its size.

    Prefix sums are taken inside a bucket of keys and added to the sums of the buckets before,
    so a source that holds a third of all rows is spread over many tasks.
    """
    # one row per source; its size as a written table lets Spark broadcast it instead of dealing rows out by source
    goals = staged(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    buckets = max(1, sized.count() // ROWS_A_BUCKET * 4)
    bucket = F.floor((1 - F.exp(-F.col("key"))) * buckets).cast("long")
    rows = sized.where("size > 0").groupBy("source", "key", "id").agg(F.sum("size").alias("size")).withColumn("bucket", bucket)
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(totals, rows["source"].eqNullSafe(totals["s"]) & (rows["bucket"] == totals["b"]))
    plan = goals.select(F.col("source").alias("g"), "budget")
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["g"]))
    start = F.col("start") + F.col("before")
    over = rows.where(start + F.col("size") > F.col("budget"))
    border = F.struct("key", "id", (F.col("budget") - start).alias("part"), "size")
    first = over.groupBy("source").agg(F.min(border).alias("cut")).withColumnRenamed("source", "l")
    return goals.join(first, goals["source"].eqNullSafe(first["l"]), "left").select("source", "source_size", "target", "epochs", "cut")


def _decided(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds whole (times taken, the border document by the larger half) and taken (words, to the budget)."""
    plan = plan.withColumnRenamed("source", "p")
    joined = sized.join(plan, sized["source"].eqNullSafe(plan["p"])).drop("p")
    place, cut = F.struct("key", "id"), F.struct("cut.key", "cut.id")
    share = F.col("cut.part") / F.col("cut.size")
    fraction = F.when((F.col("size") == 0) | F.col("cut").isNull() | (place > cut), 0.0).when(place < cut, 1.0).otherwise(share)
    times = F.col("epochs") + fraction
    taken = F.col("epochs") * F.col("size") + F.floor(fraction * F.col("size") + 0.5)
    return joined.withColumn("whole", F.floor(times + 0.5)).withColumn("taken", taken.cast("long"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT,
) -> DataFrame:
    """(id, source, size, source_size, target, whole, taken) for every row.

    ``taken`` ends with the budget inside the border document; ``whole`` counts that document
    if the larger half of it fits.  Repeated rows on the border share its part evenly.
    """
    sized = staged(measured(docs, id_col, text_col, source_col))
    got = _decided(sized, staged(cuts(sized, weights, limit)))
    return got.select("id", "source", "size", "source_size", "target", "whole", "taken")


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT,
) -> DataFrame:
    """The rows of the mix with all their columns, whole, each as often as it is taken."""
    sized = staged(measured(docs, id_col, text_col, source_col))
    plan = staged(cuts(sized, weights, limit))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    got = _decided(measured(docs, id_col, text_col, source_col, row), plan).where("whole > 0 and size > 0")
    return got.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "whole"))).select("row.*")
