"""SimHash fingerprints of word shingles, linked by Hamming distance with pigeonring filtering.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other;
a text with fewer words than a shingle is one shingle; repeated rows are separate members of
one fingerprint; columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .components import connected_components
from .memory import release

BITS = 64
HASH_SEED = 42


def fingerprint(text: str | bytes | None, words: int = 3) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64.  Bytes are UTF-8."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    parts = raw.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_digest
    spans = zip(start[:n].tolist(), end[len(parts) - n :].tolist())
    raw = b"".join([digest(joined[a:b], HASH_SEED) for a, b in spans])
    # one row of 8 bytes per shingle, most significant first
    ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _print_column(text_col: str, words: int):
    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        got = np.fromiter((fingerprint(t.as_py(), words) for t in texts.cast(pa.binary())), np.uint64, len(texts))
        release()
        return pa.array(got.view(np.int64))

    return fp(F.col(text_col).cast("string"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fingerprint as a signed long) for every row."""
    return docs.select(F.col(id_col).alias("id"), _print_column(text_col, words).alias("fp"))


def _segments(col, parts: int):
    """The ring of ``parts`` equal bit segments of a fingerprint."""
    width = BITS // parts
    return [F.shiftrightunsigned(col, width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(parts)]


def _ring_ok(x, y, radius: int, parts: int):
    """Pigeonring condition: from some start every chain of segments stays in its share of the radius."""
    width = BITS // parts
    diff = x.bitwiseXOR(y)
    gaps = [F.bit_count(s) for s in _segments(diff, parts)]
    starts = []
    for i in range(parts):
        total, ok = F.lit(0), F.lit(True)
        for length in range(1, parts + 1):
            total = total + gaps[(i + length - 1) % parts]
            ok = ok & (total <= length * radius // parts)
        starts.append(ok)
    assert width * parts == BITS
    any_start = starts[0]
    for s in starts[1:]:
        any_start = any_start | s
    return any_start


def links(prints: DataFrame, radius: int = 3, parts: int = 4) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, a > b, that differ in at most ``radius`` bits.

    The ring has ``parts`` > radius segments.  By the pigeonring principle some start has an
    equal first segment and at most ``2 * radius // parts`` differing bits in the first two,
    so candidates meet on the exact first segment and a variant of the second.  Chains of all
    lengths prune them before the full check.  A fingerprint has a bounded number of others
    within the radius, and equal ones are one row here, so links grow with the input.
    """
    if not radius < parts or BITS % parts or 2 * radius // parts > 1:
        raise ValueError("needs radius < parts, parts dividing 64, and one differing bit at most in two segments")
    width = BITS // parts
    fp = F.col("fp")
    seg = _segments(fp, parts)

    def key(i):
        return F.shiftleft(seg[i], width).bitwiseOR(seg[(i + 1) % parts])

    starts = F.explode(F.array(*[F.struct(F.lit(i).alias("ring"), key(i).alias("key")) for i in range(parts)])).alias("s")
    index = prints.select("fp", starts).select("s.ring", "s.key", F.col("fp").alias("b"))
    flips = [0] + [1 << j for j in range(width)] * (2 * radius // parts)
    probe = prints.select("fp", starts).select("s.ring", F.col("fp").alias("a"), "s.key", F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip"))
    probe = probe.select("ring", "a", F.col("key").bitwiseXOR(F.col("flip").cast("long")).alias("key"))
    # the tables are exploded here, and Spark sizes them as before that: they would be sent whole to the driver
    met = probe.join(index.hint("merge"), ["ring", "key"]).where("a > b")
    a, b = F.col("a"), F.col("b")
    met = met.where(_ring_ok(a, b, radius, parts)).where(F.bit_count(a.bitwiseXOR(b)) <= radius)
    return met.select("a", "b").distinct()


def _components(prints: DataFrame, radius: int, parts: int) -> DataFrame:
    """(fp, component, root): component is the smallest id of the linked fingerprints, root one of them."""
    classes = staged(prints.groupBy("fp").agg(F.min("id").alias("first")))
    joined = connected_components(links(classes.select("fp"), radius, parts)).toDF("fp", "root")
    named = classes.join(joined.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    return named.join(least.hint("merge"), "root").select("fp", "component", "root")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, parts: int = 4
) -> DataFrame:
    """(id, fp, component) for every row: component is the smallest id its links reach.

    Where a group has null ids only, its component is null.
    """
    prints = staged(fingerprints(docs, id_col, text_col, words))
    return prints.join(_components(prints, radius, parts).hint("merge"), "fp").select("id", "fp", "component")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, parts: int = 4
) -> DataFrame:
    """Keeps one document of each group: the smallest id (null last), one row of it.

    Rows keep their columns, whatever those are called.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    tagged = staged(docs.select(F.col(id_col).alias("id"), _print_column(text_col, words).alias("fp"), row))
    prints = tagged.select("id", "fp")
    named = prints.distinct().join(_components(prints, radius, parts).hint("merge"), "fp")
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("fp").alias("fp"))
    best = named.groupBy("root").agg(F.min(order).alias("best")).select("best.id", "best.fp")
    rows = tagged.join(best, tagged["id"].eqNullSafe(best["id"]) & (tagged["fp"] == best["fp"]), "left_semi")
    first = Window.partitionBy("id", "fp").orderBy(F.xxhash64("row"))
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("row.*")
