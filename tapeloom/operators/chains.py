"""Rows that a rule keeps one after the other, each by where the last kept one ends."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F


def keep_clear(rows, keys, pos, reach):
    """(keys, pos) of the rows kept when a key is read upwards: a row stays if it lies above the reach of the last kept one.

    ``pos`` and ``reach`` (at least ``pos``) are whole numbers; of rows at the same place the
    first alone can stay.  One sort by (keys, pos) and one pass: a task reads its keys one after
    the other in Arrow batches and holds no more than the last reach, so no key is a list.
    """
    keys = list(keys)
    names = [f"k{i}" for i in range(len(keys))]
    d = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(pos).cast("long").alias("_p"), F.col(reach).cast("long").alias("_r"))
    first = F.row_number().over(Window.partitionBy(*names).orderBy("_p", "_r")) == 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = None
        for batch in batches:
            kept = []
            for new, p, r in zip(*[batch.column(c).to_pylist() for c in ("_first", "_p", "_r")]):
                kept.append(new or p > end)
                if kept[-1]:
                    end = r
            yield batch.select([*names, "_p"]).filter(pa.array(kept, pa.bool_()))

    kinds = dict(d.dtypes)
    schema = ", ".join([*[f"{n} {kinds[n]}" for n in names], "_p long"])
    return d.withColumn("_first", first).mapInArrow(scan, schema).toDF(*keys, pos)
