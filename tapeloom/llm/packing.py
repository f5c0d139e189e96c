"""Best-fit packing of token sequences by minimum bin slack.

Spark tokenizes, cuts and counts.  Only the histogram of piece lengths, at most ``capacity``
rows, reaches the driver.  There each kind of bin is found by a bitset subset-sum over the
lengths still available: the fullest feasible combination that holds the longest piece left,
used as often as its lengths last.  Pieces then look their place up by length and rank.

Defined cases: null and empty texts are the closing token alone; repeated rows are separate
pieces; no rows, no pieces; columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .memory import release
from .tokens import slices, tokenized

CAPACITY = 4096
END_ID = 1
ROWS_A_SALT = 20_000


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and where each text's ids begin and end."""
    got = tokenized(texts, path)
    return got.ids, got.bounds


def closed(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    texts = len(bounds) - 1
    out = np.full(len(ids) + texts, end_id, "<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(texts), np.diff(bounds))] = ids
    return out, bounds + np.arange(texts + 1)


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the closed token sequence in pieces of ``capacity``."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                ids, bounds = closed(*token_ids(part.column("text"), tokenizer), end_id)
                size = np.diff(bounds)
                many = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), many)
                n = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                at = n * capacity
                length = np.minimum(size[doc] - at, capacity)
                raw, begin = memoryview(ids).cast("B"), bounds[doc] + at
                crc = [zlib.crc32(raw[b:e]) for b, e in zip((begin * 4).tolist(), ((begin + length) * 4).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(doc)), pa.array(n.astype(np.int32)), *map(pa.array, (at, length, np.array(crc, np.int64)))],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )
        release()

    return src.mapInArrow(cut, f"id {dict(src.dtypes)['id']}, piece int, start long, length long, ids_crc32 long")


def bin_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, pieces of each length in a bin) that use up all the counts.

    Each kind of bin holds the longest piece left and fills the rest as far as any
    combination of the others can, by subset sums in the bits of an integer.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left, reverse=True)
    out = []
    first = 0
    while left:
        while lengths[first] not in left:
            first += 1
        if first > 256:
            lengths, first = sorted(left, reverse=True), 0
        longest = lengths[first]
        room = capacity - longest
        used = {longest: 1}
        if room:
            used = _fill(left, lengths, first, longest, room)
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
        out.append((times, used))
    return out


def _fill(left, lengths, first, longest, room):
    """The pieces of the fullest bin that holds ``longest``; stops at the first exact fill."""
    full = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for n in lengths[first:]:
        if n > room or n not in left:
            continue
        most = min(left[n] - (n == longest), room // n)
        take = 1
        while most > 0:
            k = min(take, most)
            steps.append((sums, n, k))
            sums |= (sums << (n * k)) & full
            most -= k
            take *= 2
        if sums >> room:
            break
    total = sums.bit_length() - 1
    used = {longest: 1}
    for before, n, k in reversed(steps):
        if not (before >> total) & 1:
            total -= n * k
            used[n] = used.get(n, 0) + k
    return used


def _places(patterns, capacity):
    """Arrays for the lookup: from each (length, first rank), where those pieces go."""
    nexts: dict[int, int] = {}
    rows, sequence = [], 0
    for times, used in patterns:
        at = 0
        for n in sorted(used, reverse=True):
            k = used[n]
            rows.append((n, nexts.get(n, 0), k, sequence, at))
            nexts[n] = nexts.get(n, 0) + times * k
            at += n * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (id, piece, length, ..., dealt).

    Ranks inside a length are local to a salt and start at the salt's prefix sum, so a length
    that a third of all pieces share is not ranked in one task.  ``dealt`` is any number of the
    row's own, so that equal rows have different salts; it is dropped.
    """
    total = cut.count()
    salts = max(1, total // ROWS_A_SALT)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32", "dealt"), F.lit(salts)))
    by_salt = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_salt = by_salt.select("length", "salt", before.alias("before"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = _places(bin_patterns(histogram, capacity), capacity)  # at most a few rows per length and kind of bin
    shared = cut.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = shared.value
        span = np.int64(1) << 40
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        row = t[np.searchsorted(t[:, 0] * span + t[:, 1], n * span + r, side="right") - 1]
        inside = r - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + inside // row[:, 2], "offset": row[:, 4] + inside % row[:, 2] * n})

    local = Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("local", F.row_number().over(local) - 1).join(by_salt, ["length", "salt"])
    placed = ranked.withColumn("at", place("length", F.col("before") + F.col("local")))
    return placed.select(*[c for c in cut.columns if c != "dealt"], "at.sequence_id", "at.offset")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, tokenizer, id_col, text_col, capacity, end_id)
    return assign(staged(cut.withColumn("dealt", F.monotonically_increasing_id())), capacity)
