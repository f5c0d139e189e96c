"""Language identification by interpolated Kneser-Ney character models.

One model of letters and word gaps per language, learned from labelled rows.  Spark counts
the n-grams; the model is a sorted array of n-gram hashes per order with the log probabilities
of the languages that have them, and a sorted array of contexts with the back-off weights.  A
text gets the language of the lowest cross-entropy per character, and is rejected when that
is above what texts of the language and length have.

Defined cases: a null text or one without letters is ``und`` with score 0 and is rejected;
so is everything if no row is labelled; ties go to the smaller language; rows with a null id
are never learned from; a language with one row that can be learned from is learned from it;
of more than ``MOST_LANGUAGES`` labels those with the most characters are learned; repeated
rows count each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .memory import release
from .tokens import parts, runs

ORDER = 4  # characters of 16 bits in one 64-bit n-gram
SAMPLE_CHARS = 3_000_000  # expected characters learned from per language
CALIBRATION_CHARS = 1_000_000
SAMPLE_TOTAL = 100_000_000  # of all languages together, which share it evenly; both bound the model's size
MOST_LANGUAGES = 1_000  # those with the most characters are learned
CELLS = 1 << 21  # (character, language) pairs measured at a time
LEARNED = 0.75  # share of a language's rows to learn from; the others are for calibration
LEAST_TEXTS = 30  # for calibration of a language by itself
UNDETERMINED = "und"
FALSE_REJECTIONS = 0.001  # share of the calibration texts beyond the limit before its margin
MARGIN = 1.5
FOREIGN = 2.0  # and the entropy is at least so many times the language's mean
OTHER_LETTER = 0xFFFF
GAP = 32
_ALPHABET = 1 << 16


@cache
def _folding() -> np.ndarray:
    """For every 16-bit code point: its lower-case letter, or the gap."""
    table = np.full(1 << 16, GAP, np.uint16)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 and ord(low) < OTHER_LETTER else i
    return table


def _folded(texts: list[str]):
    """Letters and single gaps of all texts, the text of each, and which follow a text's lead."""
    lead = " " * (ORDER - 1)
    raw = np.frombuffer((lead + lead.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _folding()[np.minimum(raw, OTHER_LETTER)]
    high = np.flatnonzero(raw > OTHER_LETTER)
    if high.size:
        codes[high] = [OTHER_LETTER if chr(c).isalpha() else GAP for c in raw[high]]
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER - 1
    start = np.cumsum(size) - size
    own = np.ones(len(codes), bool)
    for k in range(ORDER - 1):
        own[start + k] = False
    keep = codes != GAP
    keep[1:] |= codes[:-1] != GAP
    keep |= ~own
    doc = np.repeat(np.arange(len(texts)), size)
    return codes[keep].astype(np.uint64), doc[keep], own[keep]


def _grams(codes: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each character; the first ones are incomplete."""
    out = codes.copy()
    for k in range(1, ORDER):
        out[k:] |= codes[:-k] << np.uint64(16 * k)
    return out


class Sparse(NamedTuple):
    """Values of (key, language) pairs: keys sorted, those of one key side by side."""

    keys: np.ndarray
    start: np.ndarray
    language: np.ndarray
    value: np.ndarray

    def entries(self, wanted: np.ndarray):
        """(place in ``wanted``, language, value) of all pairs with these keys."""
        if not len(self.keys):
            return self.start[:0], self.language[:0], self.value[:0]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == wanted)
        begin = self.start[at[hit]]
        size = self.start[at[hit] + 1] - begin
        rows = runs(begin, size)
        return np.repeat(hit, size), self.language[rows], self.value[rows]


def _sparse(parts: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
    """From (keys, values) of each language in turn."""
    keys = np.concatenate([k for k, _ in parts])
    language = np.repeat(np.arange(len(parts), dtype=np.int32), [len(k) for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    distinct, many = np.unique(keys, return_counts=True)
    value = np.concatenate([v for _, v in parts]).astype(np.float32)
    return Sparse(distinct, np.concatenate([[0], np.cumsum(many)]), language[order], value[order])


@dataclass
class Model:
    languages: list[str]
    chances: list[Sparse]  # by order from 1: n-gram, language, log probability of the last character
    weights: list[Sparse]  # context, language, log weight of the lower order
    mean: np.ndarray | None = None  # by language, of calibration texts
    spread: np.ndarray | None = None
    limit: float = np.inf


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The joint model of {language: (n-grams, counts)}."""
    languages = sorted(counts)
    sixteen = np.uint64(16)
    seen = []  # by language, by order: grams, log p, contexts, log weight
    for lang in languages:
        grams, number = counts[lang]
        by_order = [(grams, number)]
        for n in range(ORDER - 1, 0, -1):  # below the top a count is the number of different left neighbours
            by_order.append(np.unique(by_order[-1][0] & np.uint64((1 << 16 * n) - 1), return_counts=True))
        levels, lower = [], None
        for n, (g, c) in enumerate(reversed(by_order), 1):
            c = c.astype(np.float64)
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once else 0.5
            heads, at = np.unique(g >> sixteen if n > 1 else np.zeros_like(g), return_inverse=True)
            total, kinds = np.bincount(at, c), np.bincount(at)
            weight = discount * kinds / total
            below = 1 / _ALPHABET if lower is None else lower[1][np.searchsorted(lower[0], g & np.uint64((1 << 16 * (n - 1)) - 1))]
            chance = np.maximum(c - discount, 0) / total[at] + weight[at] * below
            levels.append((g, chance, heads, weight))
            lower = (g, chance)
        seen.append(levels)
    chances = [_sparse([(s[n][0], np.log(s[n][1])) for s in seen]) for n in range(ORDER)]
    weights = [_sparse([(s[n][2], np.log(s[n][3])) for s in seen]) for n in range(ORDER)]
    return Model(languages, chances, weights)


def log_chances(model: Model, grams: np.ndarray) -> np.ndarray:
    """(n-gram, language): log probability of each n-gram's last character."""
    out = np.full((len(grams), len(model.languages)), -np.log(_ALPHABET), np.float32)
    for n in range(1, ORDER + 1):
        part = grams & np.uint64((1 << 16 * n) - 1)
        row, language, weight = model.weights[n - 1].entries(part >> np.uint64(16) if n > 1 else np.zeros_like(part))
        out[row, language] += weight
        row, language, chance = model.chances[n - 1].entries(part)
        out[row, language] = chance
    return out


def entropies(model: Model, texts: list[str]):
    """Cross-entropy per character by text and language, characters and letters of each text."""
    codes, doc, own = _folded(texts)
    grams, doc = _grams(codes)[own], doc[own]
    sums = np.zeros((len(texts), len(model.languages)))
    block = max(256, CELLS // max(1, len(model.languages)))
    for at in range(0, len(grams), block):
        different, which = np.unique(grams[at : at + block], return_inverse=True)
        part = doc[at : at + block]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sums[part[first]] += np.add.reduceat(log_chances(model, different)[which], first, axis=0, dtype=np.float64)
    n = np.bincount(doc, minlength=len(texts))
    letters = np.bincount(doc, codes[own] != GAP, minlength=len(texts))
    return -sums / np.maximum(n, 1)[:, None], n, letters


def classify(model: Model, texts: list[str | None]) -> pd.DataFrame:
    """lang_pred, score, entropy (nats per character) and rejected."""
    made = pd.DataFrame({"lang_pred": UNDETERMINED, "score": 0.0, "entropy": 0.0, "rejected": True}, index=range(len(texts)))
    if not model.languages or not texts:
        return made
    at, size = 0, 0
    for stop in range(1, len(texts) + 1):
        size += len(texts[stop - 1] or "")
        if size > 1 << 19 or stop == len(texts):  # about half a million characters at a time
            part = [t or "" for t in texts[at:stop]]
            entropy, n, letters = entropies(model, part)
            best = entropy.argmin(axis=1)
            low = entropy[np.arange(len(part)), best]
            # confidence of at most 64 characters' evidence: neighbours in a text are not independent
            score = 1 / np.exp(-(entropy - low[:, None]) * np.minimum(n, 64)[:, None]).sum(axis=1)
            ok = letters > 0
            if model.mean is None:
                beyond = np.zeros(len(part), bool)
            else:
                beyond = (_excess(model, low, best, n) > model.limit) & (low > FOREIGN * model.mean[best])
            made.iloc[at:stop, 0] = np.where(ok, np.array(model.languages, object)[best], UNDETERMINED)
            made.iloc[at:stop, 1] = np.where(ok, score, 0.0)
            made.iloc[at:stop, 2] = np.where(ok, low, 0.0)
            made.iloc[at:stop, 3] = ~ok | beyond
            at, size = stop, 0
    return made


def _excess(model, low, best, n):
    """How far an entropy is above its language's mean, in deviations for that length."""
    return (low - model.mean[best]) / np.sqrt(model.spread[best, 0] + model.spread[best, 1] / np.maximum(n, 1))


def calibrate(model: Model, sample: pd.DataFrame) -> Model:
    """Sets the rejection limit from (language, entropy, n) of texts not learned from, by their best language.

    Languages with fewer than ``LEAST_TEXTS`` get the mean and spread of all texts.
    """
    k = len(model.languages)
    model.mean, model.spread = np.zeros(k), np.ones((k, 2))
    excess = [np.zeros(0)]
    for i, lang in enumerate(model.languages):
        s = sample[sample["language"] == lang]
        pool = s if len(s) >= LEAST_TEXTS else sample
        if len(pool) < 2:
            continue
        n, e = pool["n"].to_numpy(np.float64), pool["entropy"].to_numpy(np.float64)
        middle = np.average(e, weights=n)
        square = (e - middle) ** 2
        by_char = np.average(square * n, weights=1 / (1 + n / n.mean()))  # short texts show the variance per character
        between = np.average(square, weights=n)
        model.mean[i] = middle
        model.spread[i] = max(between, 1e-6), max(by_char, 1e-6)
        n, e = s["n"].to_numpy(np.float64), s["entropy"].to_numpy(np.float64)
        excess.append((e - middle) / np.sqrt(model.spread[i, 0] + model.spread[i, 1] / n))
    every = np.concatenate(excess)
    model.limit = max(4.0, float(np.quantile(every, 1 - FALSE_REJECTIONS))) * MARGIN if len(every) else np.inf
    return model


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text is divisible by 5, or the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """The calibrated model of the labelled rows that are not held out.

    Character totals cover all rows.  N-grams come from a sample by id hash of about
    ``SAMPLE_CHARS`` characters a language, the limit from a disjoint one, a fixed share of
    each language however small; these and ``SAMPLE_TOTAL`` are bounds that do not grow with
    the table, so the counted n-grams fit the driver.
    """
    spark = docs.sparkSession
    src = docs.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    src = src.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("string").alias("language"), F.col(text_col).cast("string").alias("text"))
    src = src.where(F.col("text").rlike(r"\p{L}"))
    draw = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = src.withColumn("draw", draw)
    total = drawn.groupBy("language").agg(F.sum(F.length("text")).alias("many"), F.min("draw").alias("low"))
    # one row per label, written, so that Spark knows its size and sends it to the texts
    total = staged(total.orderBy(F.col("many").desc(), "language").limit(MOST_LANGUAGES))
    share = SAMPLE_TOTAL // max(1, total.count())
    sampled = drawn.join(total, "language")
    # the smallest draw of a language is always learned from, also where none is in the learners' share
    learner = (F.col("draw") < LEARNED) | (F.col("draw") == F.col("low"))
    within = lambda first, chars: (F.col("draw") - first) * F.col("many") < min(chars, share)
    fitted = sampled.where(learner & within(F.col("low"), SAMPLE_CHARS)).select("language", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("language")["text"]:
                codes, _, own = _folded(list(texts))
                grams, number = np.unique(_grams(codes)[own], return_counts=True)
                yield pd.DataFrame({"language": lang, "gram": grams.view(np.int64), "number": number})

    counted = fitted.mapInPandas(count, "language string, gram long, number long")
    table = counted.groupBy("language", "gram").agg(F.sum("number").alias("number")).toPandas()
    counts = {}
    for lang, t in table.groupby("language"):
        grams = t["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(grams)
        counts[lang] = (grams[order], t["number"].to_numpy(np.int64)[order])
    if not counts:
        return Model([], [], [])
    model = fit(counts)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            e, n, letters = entropies(m, list(b["text"]))
            names = np.array(m.languages, object)[e.argmin(axis=1)]
            yield pd.DataFrame({"language": names, "entropy": e.min(axis=1), "n": n})[letters > 0]

    # the best language counts, as it does for a text to be judged: a wrong label says nothing about the spread
    rest = sampled.where((F.col("draw") >= LEARNED) & ~learner & within(F.lit(LEARNED), CALIBRATION_CHARS)).select("language", "text")
    got = rest.mapInPandas(measure, "language string, entropy double, n long").toPandas()
    if got.empty:  # few rows: all of them were learned from
        got = fitted.mapInPandas(measure, "language string, entropy double, n long").toPandas()
    shared.unpersist()
    return calibrate(model, got)


_PREDICTED = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])


def identified(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """All columns and the struct ``out``: lang_pred, score, entropy, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> pa.Array:
        made = []
        for part in parts(texts, 1 << 20):
            got = classify(shared.value, part.to_pylist())
            made.append(pa.StructArray.from_arrays([pa.array(got[f.name], f.type) for f in _PREDICTED], fields=list(_PREDICTED)))
        release()
        return pa.concat_arrays(made) if made else pa.array([], _PREDICTED)

    predicted = F.arrow_udf(predict, "struct<lang_pred: string, score: double, entropy: double, rejected: boolean>")
    return docs.withColumn(out, predicted(F.col(text_col).cast("string")))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, entropy, rejected) for every row."""
    model = learn(docs, id_col, text_col, label_col)
    src = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return identified(src, model).select("id", "held_out", "language.*")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows whose language is not rejected, with their own columns."""
    model = learn(docs, id_col, text_col, label_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    tagged = identified(docs.select(F.col(text_col).alias("text"), row), model)
    return tagged.where(~F.col("language.rejected")).select("row.*")
