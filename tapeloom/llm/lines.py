"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A run is ``run`` consecutive lines, or one line of ``long_words`` words or more.  Of every
window of ``run`` lines the smallest line hash is a fingerprint; two equal runs have the same
one at the same place, so only around fingerprints that occur again can a run repeat.  There
every run that holds the fingerprint is described by hashes of its lines, places with equal
descriptions are grouped, and each run but its first occurrence is deleted.  A longer match is
the union of the runs in it.  Overlapping runs merge.

First is by id (null last), by hash among unequal texts of one id, then by line.  A run that
overlaps its own first occurrence counts as later.  Blank lines are neither compared nor
deleted; lines are compared without outer blanks.

Defined cases: a null text stays null, an empty one empty; rows with equal id and text are one
document and get the same result; no rows, no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, staged

RUN = 2
LONG_WORDS = 20


def _lines(text):
    return F.split(text, "\n")


def _shapes(lines, long_words):
    """For every line that is not blank: its place and two independent 64-bit hashes, and whether it is long."""
    spaces = lambda x: F.length(x) - F.length(F.translate(x, " ", ""))
    shape = lambda x, i: F.struct(
        i.alias("at"),
        F.xxhash64(x).alias("h"),
        F.xxhash64(F.lit("second"), x).alias("g"),
        (spaces(x) >= long_words - 1).alias("long"),
    )
    trimmed = F.transform(lines, lambda x: F.trim(x))
    return F.filter(F.transform(trimmed, shape), lambda s: s["h"] != F.xxhash64(F.lit("")))


def _windows(run: int):
    """The places in ``s`` where a run of ``run`` lines can begin."""
    s = F.col("s")
    return F.when(F.size(s) >= run, F.sequence(F.lit(0), F.size(s) - run)).otherwise(F.array().cast("array<int>"))


def fingerprints(shaped: DataFrame, run: int) -> DataFrame:
    """(print) once for each fingerprint that stands at more than one place."""
    s = F.col("s")
    least = F.transform(_windows(run), lambda i: F.array_min(F.transform(F.slice(s, i + 1, run), lambda x: F.struct(x["h"], x["at"]))))
    alone = F.transform(F.filter(s, lambda x: x["long"]), lambda x: F.struct(x["h"], x["at"]))
    places = shaped.select(F.explode(F.array_distinct(F.concat(least, alone))).alias("p"))
    return places.groupBy(F.col("p.h").alias("print")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")


def _runs(shaped: DataFrame, run: int) -> DataFrame:
    """One row per possible run: its line numbers, its fingerprint and two hashes of its content."""
    s = F.col("s")

    def described(part):
        return F.struct(
            F.transform(part, lambda x: x["at"]).alias("ats"),
            F.array_min(F.transform(part, lambda x: x["h"])).alias("print"),
            F.xxhash64(F.transform(part, lambda x: x["h"])).alias("h"),
            F.xxhash64(F.transform(part, lambda x: x["g"])).alias("g"),
        )

    many = F.transform(_windows(run), lambda i: described(F.slice(s, i + 1, run)))
    one = F.transform(F.filter(s, lambda x: x["long"]), lambda x: described(F.array(x)))
    return shaped.select("id", "tag", F.explode(F.concat(many, one)).alias("r")).select("id", "tag", "r.*")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long_words: int = LONG_WORDS) -> DataFrame:
    """(id, tag, ats): the line numbers of every run that occurs earlier."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    shaped = src.select("id", F.xxhash64("text").alias("tag"), _shapes(_lines(F.col("text")), long_words).alias("s"))
    shaped = staged(shaped.where(F.size("s") > 0).dropDuplicates(["id", "tag"]))
    # tables of their own, so that a fingerprint or run of very many places is a skewed join that Spark splits;
    # never sent whole: a packed file is several times as large in memory
    prints = staged(fingerprints(shaped, run))
    near = staged(_runs(shaped, run).join(prints.hint("merge"), "print", "left_semi").withColumn("lines", F.size("ats")).drop("print"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "tag", F.get("ats", 0).alias("at"))
    first = near.groupBy("lines", "h", "g").agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("n"))
    first = staged(first.where("n > 1").drop("n"))
    later = staged(near.join(first.hint("merge"), ["lines", "h", "g"]).where(place > F.col("origin")).select("id", "tag", "ats"))
    discard(shaped, prints, near, first)
    return later


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long_words: int = LONG_WORDS
) -> DataFrame:
    """(id, kept, lines_in, lines_removed, blocks_removed, rest): rest holds the other columns of the row.

    ``blocks_removed`` counts maximal blocks of adjacent removed lines.
    """
    later = repeated_runs(docs, id_col, text_col, run, long_words)
    gone = later.groupBy(F.col("id").alias("gid"), F.col("tag").alias("gtag")).agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("gone"))
    text = F.col(text_col).cast("string")
    mark = "_".join(docs.columns) + "_"  # a struct needs a field, and no column has this name
    rest = F.struct(F.lit(True).alias(mark), *[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest")
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tag"), _lines(text).alias("lines"), rest)
    got = src.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("tag") == F.col("gtag")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    blocks = F.aggregate(
        F.array_sort("gone"),
        F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + (x > a["last"] + 1).cast("int")).alias("n")),
        lambda a: a["n"],
    )
    return got.select(
        "id",
        F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(kept).alias("kept"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("lines_in"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("lines_removed"),
        F.coalesce(blocks, F.lit(0)).cast("long").alias("blocks_removed"),
        "rest",
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows with their own columns and the text that remains; a text that is all repeats becomes empty."""
    got = dedup_lines(docs, id_col, text_col, **how)
    return got.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
