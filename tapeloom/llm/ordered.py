"""Order-preserving packing: window cuts by dynamic programming over document and sentence borders.

Documents follow each other by id.  A window ends at the end of a document, at the end of a
sentence inside one (a soft cut) or, where a sentence is long, at every 128th token of it (a
hard cut).  Chosen are the cuts with the least padding plus penalties: the cost of the best
cuts up to a border is its penalty, plus the least over the borders at most one capacity
before it of their cost and the padding between, which a monotone queue keeps; windows whose
length is a power of two have no padding and are looked up one by one.

Tasks that read the texts send each document's borders with the checksum of the ids before
them, not the ids; the checksum of a piece follows from those of its two ends.  The order is
parted into segments of a fixed number of tokens by prefix sums, and a segment is one task's
group.

Defined cases: null and empty texts are the closing token alone; null ids come first, rows
that share an id by length and checksum; repeated rows are separate documents; a sentence or
a word of any length has hard cuts; no rows, no pieces; columns other than the id and the text
are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .memory import release
from .packing import closed
from .tokens import runs, slices, tokenized

CAPACITY = 4096
END_ID = 2
SEGMENT = 2_000_000  # tokens; its last window is the only one that no next document fills
HARD_EVERY = 128  # tokens of a sentence
SOFT, HARD = 16, 64  # penalties in tokens of padding
_SENTENCE_END = r"""[.!?…]["'”’»)\]]*$"""
_INITIAL = r"^[A-Za-z]\.$"

_CRC_POLY = 0xEDB88320  # of zlib's CRC-32, bits reflected


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo that of the CRC."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_CRC_POLY if b & 1 else 0)
    return out


@lru_cache(maxsize=1 << 16)
def _shift(tokens: int) -> int:
    """x to the number of bits in so many 32-bit ids."""
    if tokens == 0:
        return 1 << 31
    half = _shift(tokens // 2)
    out = _times(half, half)
    return _times(out, _times(1 << 15, 1 << 15)) if tokens % 2 else out  # x^16 twice


def crc_between(before: int, after: int, tokens: int) -> int:
    """The CRC of the last ``tokens`` ids of a sequence, from that without them and that of the whole."""
    return after ^ _times(_shift(tokens), before)


def _borders(bounds: np.ndarray, word_end: np.ndarray, ends_sentence: np.ndarray, word_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in its ids, whether hard) of the places inside texts where a window may end, in order."""
    text = word_text[ends_sentence]
    place = word_end[ends_sentence] - bounds[text]
    inside = place < (bounds[text + 1] - bounds[text])  # the last sentence ends with its document
    text, place = text[inside], place[inside]
    # stretches between them, from each text's start to its closing token
    texts = np.arange(len(bounds) - 1)
    owner = np.concatenate([texts, text])
    begin = np.concatenate([np.zeros(len(texts), np.int64), place])
    order = np.lexsort((begin, owner))
    owner, begin = owner[order], begin[order]
    last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
    end = np.where(last, np.diff(bounds)[owner] + 1, np.append(begin[1:], 0))
    many = np.maximum(end - begin - 1, 0) // HARD_EVERY
    hard_text, hard_place = np.repeat(owner, many), HARD_EVERY * (runs(np.ones(len(many), np.int64), many)) + np.repeat(begin, many)
    text, place = np.concatenate([text, hard_text]), np.concatenate([place, hard_place])
    hard = np.arange(len(text)) >= len(text) - len(hard_text)
    order = np.lexsort((place, text))
    return text[order], place[order], hard[order]


def borders(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(id, tokens, crc, ends, crcs, hard): the closed length and checksum of each row, and its inner borders."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                t = tokenized(part.column("text"), tokenizer)
                ending = pc.and_not(pc.match_substring_regex(t.distinct, _SENTENCE_END), pc.match_substring_regex(t.distinct, _INITIAL))
                flag = ending.to_numpy(zero_copy_only=False)[t.word]
                owner = np.repeat(np.arange(part.num_rows), np.diff(t.text_words))
                text, place, hard = _borders(t.bounds, t.word_end[1:], flag, owner)
                ids, bounds = closed(t.ids, t.bounds, end_id)
                many = np.bincount(text, minlength=part.num_rows)
                offsets = np.concatenate([[0], np.cumsum(many)])
                raw = memoryview(ids).cast("B")
                starts, stops, at = (bounds * 4).tolist(), ((bounds[text] + place) * 4).tolist(), offsets.tolist()
                crcs, whole_crc = [0] * len(text), [0] * part.num_rows
                for doc in range(part.num_rows):
                    crc, begin = 0, starts[doc]
                    for k in range(at[doc], at[doc + 1]):
                        end = stops[k]
                        crcs[k] = crc = zlib.crc32(raw[begin:end], crc)
                        begin = end
                    whole_crc[doc] = zlib.crc32(raw[begin : starts[doc + 1]], crc)
                signed = np.array(crcs, np.uint32).view(np.int32)
                listed = lambda values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(bounds)), pa.array(np.array(whole_crc, np.int64)),
                     listed(pa.array(place.astype(np.int32))), listed(pa.array(signed)), listed(pa.array(hard))],
                    ["id", "tokens", "crc", "ends", "crcs", "hard"],
                )
        release()

    return src.mapInArrow(found, f"id {dict(src.dtypes)['id']}, tokens long, crc long, ends array<int>, crcs array<int>, hard array<boolean>")


def best_cuts(place: np.ndarray, penalty: np.ndarray, capacity: int = CAPACITY) -> tuple[list[int], int]:
    """(rows of ``place`` at which the windows end, their cost) for borders in ascending order from 0.

    No two neighbours are further apart than ``capacity``.  Among equal costs the longer window is taken.
    """
    exact = [np.empty((0, 2), np.int64)]
    width = 1
    while width <= capacity:
        at = np.searchsorted(place, place - width)
        hit = place[at] == place - width
        exact.append(np.stack([np.flatnonzero(hit), at[hit]], axis=1))
        width *= 2
    pairs = np.concatenate(exact)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    first = np.searchsorted(pairs[:, 0], np.arange(len(place) + 1)).tolist()
    before = pairs[:, 1].tolist()
    t, cut = place.tolist(), penalty.tolist()
    cost, key, back = [0] * len(t), [0] * len(t), [0] * len(t)
    queue: deque[int] = deque()
    for j in range(1, len(t)):
        k = key[j - 1] = cost[j - 1] + t[j - 1]
        while queue and key[queue[-1]] > k:
            queue.pop()
        queue.append(j - 1)
        here = t[j]
        while t[queue[0]] < here - capacity:
            queue.popleft()
        i = queue[0]
        best = key[i] + capacity - here
        for n in range(first[j], first[j + 1]):
            if cost[before[n]] < best:
                i = before[n]
                best = cost[i]
        cost[j], back[j] = best + cut[j], i
    out, j = [], len(t) - 1
    while j > 0:
        out.append(j)
        j = back[j]
    return out[::-1], cost[-1]


def _packed(segment: pa.Table, capacity: int, soft: int, hard: int) -> pa.Table:
    """The pieces of a segment's documents."""
    d = segment.sort_by("before").combine_chunks()
    size = d["tokens"].to_numpy()
    start = np.cumsum(size) - size
    flat = lambda name: pc.list_flatten(d[name]).to_numpy(zero_copy_only=False)
    inner = np.repeat(start, pc.list_value_length(d["ends"]).to_numpy()) + flat("ends")
    place = np.concatenate([[0], inner, start + size])
    crc = np.concatenate([[0], flat("crcs").astype(np.int32).view(np.uint32).astype(np.int64), d["crc"].to_numpy()])
    penalty = np.concatenate([[0], np.where(flat("hard").astype(bool), hard, soft), np.zeros(len(size), np.int64)]).astype(np.int64)
    order = np.argsort(place, kind="stable")
    place, crc, penalty = place[order], crc[order], penalty[order]
    chosen, _ = best_cuts(place, penalty, capacity)
    window = np.concatenate([[0], place[chosen]])
    begin = np.union1d(start, window[:-1])
    end = np.append(begin[1:], window[-1:])
    doc = np.searchsorted(start, begin, side="right") - 1
    sequence = np.searchsorted(window, begin, side="right") - 1
    own = begin - start[doc]
    after = crc[np.searchsorted(place, end)].tolist()
    for n in np.flatnonzero(own).tolist():
        after[n] = crc_between(int(crc[np.searchsorted(place, begin[n])]), after[n], int(end[n] - begin[n]))
    return pa.table(
        {
            "id": d["id"].take(pa.array(doc)), "start": own, "length": end - begin, "ids_crc32": np.array(after, np.int64),
            "doc_tokens": size[doc], "sequence_id": (d["segment"][0].as_py() << 32) + sequence, "offset": begin - window[sequence],
        }
    )


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID, soft: int = SOFT, hard: int = HARD, segment: int = SEGMENT,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  ``capacity`` is 128 or more."""
    found = staged(borders(docs, tokenizer, id_col, text_col, end_id).withColumn("dealt", F.monotonically_increasing_id()))
    order = ["id", "tokens", "crc", "dealt"]
    ranged = staged(found.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("tokens").alias("n"))  # a row for each partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(totals, "part")
    placed = placed.withColumn("before", F.col("first") + F.col("inside")).withColumn("segment", F.expr(f"before div {segment}"))
    kind = dict(found.dtypes)["id"]
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    parts = placed.select("id", "tokens", "crc", "ends", "crcs", "hard", "before", "segment")
    return parts.groupBy("segment").applyInArrow(lambda part: _packed(part, capacity, soft, hard), schema)
