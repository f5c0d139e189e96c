"""Readers, merges, snapshot cursors and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import row_of

MAX_SYMBOLS = 5000

# Types of the contract's flag columns; any other column is text.
FLAG_TYPES = {
    "id": "bigint",
    "symbol": "string",
    "flag_date": "date",
    "fired_at": "timestamp",
    "pivot_price": "double",
    "vol_mult": "double",
    "rsi": "double",
    "sma20": "double",
    "sma50": "double",
    "peer_group": "string",
    "tier": "string",
    "status": "string",
    "position_units": "double",
    "entry_price": "double",
    "entry_at": "timestamp",
    "peak_price": "double",
    "trailing_stop": "double",
    "invalidated_at": "timestamp",
    "exited_at": "timestamp",
    "exit_reason": "string",
    "dismissed_until": "date",
    "notes": "string",
}


def select_bars(bars, since=None, until=None, symbols=None, max_symbols=MAX_SYMBOLS):
    """Bars of a date range and a symbol list; both filters reach the scan."""
    if symbols:
        names = [s.strip() for s in symbols.split(",") if s.strip()] if isinstance(symbols, str) else list(symbols)
        if len(names) > max_symbols:
            raise ValueError(f"symbols list exceeds max of {max_symbols}")
        bars = bars.where(F.col("symbol").isin(names))
    if since:
        bars = bars.where(F.col("date") >= F.lit(since).cast("date"))
    if until:
        bars = bars.where(F.col("date") <= F.lit(until).cast("date"))
    return bars


def flatten_groups(groups):
    """(group, [symbols]) -> one row per pair."""
    return groups.select("peer_group", F.explode("symbols").alias("symbol"))


def read_groups_json(spark, path):
    """A JSON object of lists, one object per line or file."""
    text = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,array<string>>")
    return flatten_groups(text.select(F.explode(m).alias("peer_group", "symbols")))


def typed_flags(raw, since=None, status=None):
    """Text columns to the contract's types, leniently; unknown columns stay text."""
    cast = {}
    for c in raw.columns:
        kind = FLAG_TYPES.get(c, "string")
        x = F.col(c)
        if kind == "date":
            # one format only: anything else is null, not guessed at
            x = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))
        elif kind == "timestamp":
            x = F.try_to_timestamp(x)
        else:
            x = x.try_cast(kind)
        cast[c] = x
    d = raw
    if since:
        d = d.where(F.col("flag_date") >= since.split("T", 1)[0])
    if status:
        d = d.where(F.col("status").isin([s.strip() for s in status.split(",") if s.strip()]))
    return d.select(*[x.alias(c) for c, x in cast.items()])


def read_flags(spark, path, since=None, status=None):
    """Flag files of different ages: columns are merged, missing ones are null."""
    d = spark.read.option("mergeSchema", "true").parquet(path)
    return typed_flags(d.select(*[F.col(c).cast("string").alias(c) for c in d.columns]), since, status)


def panel(long, symbols, key="symbol", value="close"):
    """Long closes to one column per listed symbol; one row per day."""
    return long.where(F.col(key).isin(list(symbols))).groupBy("date").pivot(key, list(symbols)).agg(F.first(value))


def merge_archives(parts, key=("symbol", "interval_min", "ts")):
    """Union of archives under a primary key; an equal key may occur in several archives."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates(list(key))


def snapshot_cursor(bars, flags, groups):
    """High-water marks of the three feeds as one row."""
    b = bars.agg(
        F.max("date").alias("max_date"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct("symbol").alias("symbol_count"),
    )
    f = flags.agg(F.coalesce(F.max("id"), F.lit(0)).alias("max_id"), F.count(F.lit(1)).alias("flag_rows"))
    g = groups.agg(F.count_distinct("peer_group").alias("group_count"), F.count(F.lit(1)).alias("entry_count"))
    for side in (f, g):
        row = row_of(side)
        b = b.withColumns({c: row[c] for c in side.columns})
    return b


def groups_hash(groups):
    """SHA-256 of the canonical JSON of a group map (a contract over the whole, small map)."""

    def quoted(x):
        return F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))

    body = F.array_join(F.transform(F.array_sort(F.collect_list("symbol")), quoted), ", ")
    per = groups.groupBy("peer_group").agg(
        F.concat(quoted(F.col("peer_group")), F.lit(": ["), body, F.lit("]")).alias("entry")
    )
    entries = F.array_sort(F.collect_list(F.struct("peer_group", "entry")))
    text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: e["entry"]), ", "), F.lit("}"))
    return per.agg(F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256)).alias("hash"))


def symbol_status(bars, metadata, days=7):
    """Last bar per symbol; active when near the universe's last date."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("last_seen"))
    newest = bars.agg(F.max("date").alias("m")).scalar()
    d = last.join(metadata, "symbol", "left").withColumn("_newest", newest)
    active = F.datediff("_newest", "last_seen") <= days
    return d.withColumn("status", F.when(active, "active").otherwise("delisted")).drop("_newest")


def universe_snapshot(bars_with_volume, min_price, min_dollar_volume):
    ok = (F.col("close_adj") >= min_price) & (F.col("avg_dollar_volume_30d") >= min_dollar_volume)
    return bars_with_volume.where(ok).groupBy("symbol").agg(
        F.min("date").alias("first_seen_date"),
        F.max("date").alias("last_seen_date"),
        F.avg("avg_dollar_volume_30d").alias("mean_avg_dollar_volume_30d"),
        F.avg("close_adj").alias("mean_close_adj"),
        F.count("date").alias("n_qualifying_days"),
    )


def write_parquet(df, path, partition_by=(), sort_by=()):
    """Parquet sink; partitioned by a coarse key so a later date or interval filter prunes files."""
    if partition_by and sort_by:
        df = df.repartition(*partition_by).sortWithinPartitions(*partition_by, *sort_by)
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_ndjson(df, path):
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
