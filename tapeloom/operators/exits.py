"""Exit models: a classifier per variant, fitted on exit labels up to a day and scored on later days only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import functions as F

from ..session import discard, staged
from . import boosting as bo
from . import labels as lb
from . import trades as tr


@dataclass(frozen=True)
class Variant:
    name: str
    gain_pct: float = 15.0  # of a position that may be left
    lookback: int = 20
    forward: int = 20
    giveback_pct: float = 66.0
    eligibility: int = 60
    cap: int = 60


def labelled(matrix, variant):
    """The rows of the feature matrix that a position of the variant could be left on, with ``exit_label``."""
    return lb.exit_labels(matrix, variant.gain_pct, variant.lookback, variant.forward, variant.giveback_pct)


def exit_scores(matrix, features, variant, train_until, rounds=400, depth=6):
    """(symbol, date, exit_label, exit_score) of the labelled rows after ``train_until``.

    Rows up to that day are the model's training rows.
    """
    rows = staged(labelled(matrix, variant).select("symbol", "date", "exit_label", *features))
    cut = F.lit(train_until).cast("date")
    model = bo.fit(rows.where(F.col("date") <= cut), features, "exit_label", rounds, depth)
    scores = bo.explained(rows.where(F.col("date") > cut), model, "symbol", "date", "exit_label")
    scores = staged(scores.select("symbol", "date", "exit_label", F.col("score").alias("exit_score")))
    discard(rows)  # the next variant writes its own
    return scores


def flagged_bars(matrix, scores, share):
    """All bars with ``would_exit``: true where a row's score is in the top ``share`` of the scored ones."""
    flags = tr.exit_flags(scores, "exit_score", share).select("symbol", "date", "would_exit")
    bars = matrix.select("symbol", "date", "open", "close_adj").join(flags, ["symbol", "date"], "left")
    return bars.withColumn("would_exit", F.coalesce("would_exit", F.lit(False)))


def model_exits(matrix, entries, features, variants, train_until, share=0.02, rounds=400, depth=6):
    """The two-stage exits of the entries after ``train_until`` under each variant's own model, by ``variant``."""
    matrix = staged(matrix)
    later = staged(entries.where(F.col("date") > F.lit(train_until).cast("date")))
    out = []
    for v in variants:
        bars = flagged_bars(matrix, exit_scores(matrix, features, v, train_until, rounds, depth), share)
        out.append(tr.two_stage_exits(bars, later, v.eligibility, v.cap).withColumn("variant", F.lit(v.name)))
    return reduce(lambda a, b: a.unionByName(b), out)
