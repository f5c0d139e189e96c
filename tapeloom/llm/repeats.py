"""Removal of byte strings that occur more than once, by a sparse enhanced suffix array.

Every window of ``length`` bytes has an anchor, the smallest hash of its ``GRAM``-byte grams
(the leftmost of equals), so equal windows have equal anchors at the same place.  Spark groups
the anchors; only those that occur again are looked at further, with the stretch of bytes that
their own windows span.  Equal stretches are one class.  Where an anchor has several classes,
their suffixes from the anchor on are sorted, the common-prefix intervals are found by a stack
scan, and inside each interval the left contexts are sorted too: where they part, the repeat
can't be extended for all, and the finest group of every member is a maximal repeat.  A class
then covers what its groups span, for each of its occurrences.

Defined cases: a null or empty text has no bytes and keeps none; texts under ``length`` bytes
keep all; equal texts, and rows given twice, are occurrences of each other and lose all their
windows; ids may be null or repeated; no rows, no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, staged

TAG_SEED = 42
LENGTH = 200
GRAM = 32
LARGEST_GROUP = 5_000  # classes of one anchor that a task sorts; of more, Spark groups every window
_PLACE = np.uint64((1 << 31) - 1)


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from every place on."""
    n = len(data) - GRAM + 1
    words = np.empty(len(data) - 7, np.uint64)
    for k in range(8):
        words[k::8] = np.frombuffer(data, "<u8", (len(data) - k) // 8, k)
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9) + words[k : n + k] * np.uint64(odd)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, from block-wise running minima."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes], length: int = LENGTH):
    """Of all windows inside the texts: text, place in it, hash, class, and bytes to the left and right of each anchor."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    data = b"".join(texts)
    empty = np.zeros(0, np.int64)
    if not len(data) or size.max() < length:
        return (empty,) * 6
    h = gram_hashes(data)
    least = _sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    doc = np.repeat(np.arange(len(texts)), size)[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= end[doc])
    at = (least[start] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    low, high = start[first], start[np.concatenate([first[1:], [len(start)]]) - 1] + length
    at, doc = at[first], doc[low]
    digest = xxhash.xxh3_64_intdigest
    kind = np.fromiter(
        (digest(data[a:b], m) for a, b, m in zip(low.tolist(), high.tolist(), (at - low).tolist())), np.uint64, len(at)
    )
    return doc, at - (end - size)[doc], h[at].view(np.int64), kind.view(np.int64), at - low, high - at


def _common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    differs = int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])
    return n - (differs.bit_length() + 7) // 8


def prefix_intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the interval tree of sorted suffixes, leaves up, by a stack scan.

    ``common[i]`` is the common prefix of suffixes i and i + 1.
    """
    stack = [(0, 0)]
    for i, depth in enumerate([*common, 0], 1):
        first = i - 1
        while depth < stack[-1][0]:
            top, first = stack.pop()
            yield top, first, i - 1
        if depth > stack[-1][0]:
            stack.append((depth, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(member, bytes to the left, bytes to the right) of each member's finest repeat in every interval.

    ``lefts`` are reversed, both start at the anchor; repeats shorter than ``length`` are left out.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    by_left = {m: i for i, m in enumerate(sorted(range(len(lefts)), key=lefts.__getitem__))}
    common = [_common(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    for depth, first, last in prefix_intervals(common):
        group = sorted(order[first : last + 1], key=by_left.__getitem__)
        # equal left neighbours all along a group extend it; where they part, the group is maximal
        shared = [0, *(_common(lefts[a], lefts[b]) for a, b in zip(group, group[1:])), 0]
        for i, member in enumerate(group):
            left = max(shared[i], shared[i + 1])
            if left + depth >= length:
                yield member, left, depth


def _slices(batch: pa.RecordBatch, column: str, room: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``room`` bytes of text, at least one row each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + room, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return pc.fill_null(batch.column("text").cast(pa.binary()), b"").to_pylist()


def _anchor_rows(src: DataFrame, length: int) -> DataFrame:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _slices(whole, "text"):
                texts = _texts(part)
                doc, place, anchor, kind, left, right = anchors(texts, length)
                tag = np.fromiter((xxhash.xxh64_intdigest(t, TAG_SEED) for t in texts), np.uint64, len(texts)).view(np.int64)
                cols = [part.column("id").take(pa.array(doc)), pa.array(tag[doc]), pa.array(place.astype(np.int32)), pa.array(anchor), pa.array(kind)]
                cols += [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "tag", "place", "anchor", "kind", "lead", "tail"])

    kind = dict(src.dtypes)["id"]
    return src.mapInArrow(find, f"id {kind}, tag long, place int, anchor long, kind long, lead int, tail int")


def _same_doc(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["rid"]) & (a["tag"] == b["rtag"])


def _contexts(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, kind, members, lefts, rights): the bytes around one occurrence of each wanted class."""
    place = F.struct("anchor", "kind", "members", "place", "lead", "tail")
    lists = wanted.groupBy("rid", "rtag").agg(F.collect_list(place).alias("places"))
    joined = src.join(lists, _same_doc(src, lists)).select("text", "places")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _slices(whole, "text"):
                rows = []
                for text, places in zip(_texts(part), part.column("places").to_pylist()):
                    for x in places:
                        p = x["place"]
                        rows.append((x["anchor"], x["kind"], x["members"], text[p - x["lead"] : p][::-1], text[p : p + x["tail"]]))
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays(cols, ["anchor", "kind", "members", "lefts", "rights"])

    return joined.mapInArrow(cut, "anchor long, kind long, members long, lefts binary, rights binary")


def _sorted_groups(contexts: DataFrame, length: int) -> DataFrame:
    """(anchor, kind, lead, tail) by suffix sorting; all classes of an anchor are next to each other in one task."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kinds, lefts, rights, out = None, [], [], [], []

        def close():
            out.extend((now, kinds[m], a, b) for m, a, b in maximal_repeats(lefts, rights, length))

        for batch in batches:
            for anchor, kind, left, right in zip(*(batch.column(c).to_pylist() for c in ("anchor", "kind", "lefts", "rights"))):
                if anchor != now:
                    if len(kinds) > 1:
                        close()
                    now, kinds, lefts, rights = anchor, [], [], []
                kinds.append(kind)
                lefts.append(left)
                rights.append(right)
            if len(out) > 50_000:
                yield table(out)
                out = []
        if len(kinds) > 1:
            close()
        yield table(out)

    def table(rows):
        cols = list(zip(*rows)) or [()] * 4
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["anchor", "kind", "lead", "tail"])

    near = contexts.select("anchor", "kind", "lefts", "rights").repartition("anchor").sortWithinPartitions("anchor")
    return near.mapInArrow(scan, "anchor long, kind long, lead int, tail int")


def _window_groups(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many classes: Spark groups the 128-bit hashes of their windows."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, kind, left, right in zip(*(batch.column(c).to_pylist() for c in ("anchor", "kind", "lefts", "rights"))):
                text, n = left[::-1] + right, len(left)
                lead = list(range(n, n - (len(text) - length) - 1, -1))
                marks = [xxhash.xxh3_128_digest(text[i : i + length]) for i in range(len(lead))]
                cols = [pa.array([anchor] * len(lead)), pa.array([kind] * len(lead)), pa.array(lead, pa.int32()), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "kind", "lead", "mark"])

    windows = staged(contexts.mapInArrow(spread, "anchor long, kind long, lead int, mark binary"))
    again = windows.groupBy("anchor", "lead", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return windows.join(again, ["anchor", "lead", "mark"]).select("anchor", "kind", "lead", (F.lit(length) - F.col("lead")).alias("tail"))


def _tag():
    """As in the tasks: Spark's 64-bit hash of one column is XXH64 of its bytes with this seed."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, largest_group: int = LARGEST_GROUP
) -> DataFrame:
    """(id, tag, spans): the byte ranges [begin, end) of each text that repeats cover, unsorted and overlapping.

    ``tag`` is a 64-bit hash of the text; it tells rows with one id, as null ids, apart.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.select("id", "text", _tag().alias("tag"))
    every = staged(_anchor_rows(src.select("id", "text"), length))
    again = staged(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    near = staged(every.join(again, "anchor", "left_semi"))
    discard(every, again)
    rep = F.min(F.struct(F.col("id").alias("rid"), F.col("tag").alias("rtag"), "place", "lead", "tail")).alias("rep")
    classes = staged(near.groupBy("anchor", "kind").agg(F.count(F.lit(1)).alias("n"), rep).select("anchor", "kind", "n", "rep.*"))
    several = staged(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    contexts = staged(_contexts(src, classes.join(several, "anchor")))
    discard(several)
    found = staged(_sorted_groups(contexts.where(F.col("members") <= largest_group), length))
    large = contexts.where(F.col("members") > largest_group)
    if not large.isEmpty():
        found = found.unionAll(_window_groups(large, length))
    once = classes.where("n = 1").select("anchor", "kind")
    whole = classes.where("n > 1").select("anchor", "kind", "lead", "tail")
    cover = staged(found.join(once, ["anchor", "kind"], "left_semi").unionAll(whole))
    discard(contexts)
    hit = near.select("id", "tag", "place", "anchor", "kind").join(cover, ["anchor", "kind"])
    span = F.struct((F.col("place") - F.col("lead")).alias("begin"), (F.col("place") + F.col("tail")).alias("end"))
    spans = staged(hit.groupBy("id", "tag").agg(F.collect_set(span).alias("spans")))
    discard(near, classes, cover, found)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or adjacent ranges."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, largest_group: int = LARGEST_GROUP
) -> DataFrame:
    """(id, n_bytes, runs, kept): the removed runs of every text, and the bytes that remain."""
    spans = repeated_spans(docs, id_col, text_col, length, largest_group).withColumnsRenamed({"id": "rid", "tag": "rtag"})
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("tag", _tag())
    joined = src.join(spans, _same_doc(src, spans), "left").select("id", "text", "spans")

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for part in _slices(whole, "text"):
                size, runs, kept = [], [], []
                for text, own in zip(_texts(part), part.column("spans").to_pylist()):
                    gone = merged([(s["begin"], s["end"]) for s in own or ()])
                    edges = [0, *(e for r in gone for e in r), len(text)]
                    size.append(len(text))
                    runs.append([{"begin": a, "end": b} for a, b in gone])
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                cols = [part.column("id"), pa.array(size, pa.int64()), pa.array(runs, run), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_bytes", "runs", "kept"])

    kind = dict(src.dtypes)["id"]
    return joined.mapInArrow(remove, f"id {kind}, n_bytes long, runs array<struct<begin: int, end: int>>, kept binary")
