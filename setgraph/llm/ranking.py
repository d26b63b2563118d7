"""Quality scores from preference pairs.

Bradley-Terry: each document has a strength, linear in its features, and the odds that one is preferred to another
are the exponential of the difference of strengths. Pairs of a preferred and a rejected document come from all
labelled rows; the weights minimise logistic loss on feature differences. Documents at or above a quantile of the
labelled rows' strengths pass. Rows and pairs stay in tasks, whose sums the driver adds up.

Null texts count as empty, and an empty text has all features 0. With no usable pairs every strength is 0 and the
score 0.5. Rows are scored one by one: repeated rows, null doc_ids (held_out false) and extra columns do no harm.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pairs import dense_index
from ..plans.lineage import cut_lineage
from .common import table, text_of
from .labelled import derivatives, labelled_rows, newton, remainder, summed

#: So many pairs for each row of the rarer side, so many more cuts than one that are tried, and rows or pairs of a task.
PAIRS_EACH, CUTS, TASK_ROWS = 6, 400, 50_000

FEATURES = (
    "length", "words", "word_length", "long_words", "distinct", "stutter", "symbols", "bars", "capitals", "digits",
    "ends", "marks", "lone_symbols", "line_repeats", "spread",
)

_CLASS = np.zeros(256, np.int64)  # of bytes: 0 other, 1 lower case and beyond ASCII, 2 capital, 3 digit, 4 space, 5 end of a sentence, 6 symbol, 7 bar
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,?:;'"]] = 5
_CLASS[[ord(c) for c in "#$%&*+<=>@[]^_`{}~\\/!"]] = 6
_CLASS[ord("|")] = 7


def features(text: str) -> list[float]:
    """FEATURES of one text: shares that don't depend on the language, and its size."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / len(raw)
    lengths = np.fromiter(map(len, words), np.int32, n)
    kinds = len(set(words))
    lines = [x for x in text.split("\n") if x.strip()]
    lone = sum(not any(map(str.isalnum, w)) for w in set(words)) and sum(w in "|#*-_=~%&$+" or w in ("||", "--", "***") for w in words)
    return [
        float(np.log1p(len(text))),
        float(np.log1p(n)),
        float(lengths.mean()),
        float((lengths > 25).mean()),
        float(np.log(kinds) / np.log(n)) if n > 1 else 1.0,
        sum(map(operator.eq, words, words[1:])) / n,
        float(count[6]),
        float(count[7]),
        float(count[2]),
        float(count[3]),
        float(count[5]),
        text.count("!") / len(text),
        lone / n,
        1 - len(set(lines)) / len(lines),
        float(lengths.std()),
    ]


def _curved(x: np.ndarray) -> np.ndarray:
    """Features and square roots of the shares, so that small shares count as well."""
    return np.hstack([x, np.sqrt(np.maximum(x[:, 5:14], 0)), x[:, 4:5] ** 2, x[:, 2:3] ** 2])


@dataclass
class Ranking:
    """Standardised weights, the strength at the threshold, and how steeply the score rises there."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    threshold: float = 0.0
    slope: float = 1.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((_curved(x) - self.mean) / self.scale) @ np.array(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.threshold) * self.slope, -35, 35)))


_feature_column = F.pandas_udf(lambda texts: texts.map(features), T.ArrayType(T.DoubleType()))


def _parted(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """rows in parts of about TASK_ROWS, each in a fixed order, written once."""
    return cut_lineage(rows.repartition(-(-n // TASK_ROWS), *by).sortWithinPartitions(*by))


def preference_pairs(rows: DataFrame, n_good: int, n_bad: int, each: int = PAIRS_EACH) -> DataFrame:
    """better, worse: features of preferred and rejected rows; every row of the rarer side against `each` of the other, in turn."""
    n = max(n_good, n_bad, each * min(n_good, n_bad))
    turns = rows.sparkSession.range(n)
    for y, size, name in ((1, n_good, "better"), (0, n_bad, "worse")):
        side = rows.filter(F.col("y") == y)
        placed = side.join(dense_index(side, "doc_id"), "doc_id").select(F.col("idx").alias("_at"), F.col("x").alias(name))
        turns = turns.withColumn("_at", F.expr(f"(id + id div {size}) % {size}")).join(placed, "_at").drop("_at")
    return _parted(turns, n, "id").select("better", "worse")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(-1, len(FEATURES))


def _quantiles(placed: DataFrame, n: int, wanted: np.ndarray) -> np.ndarray:
    """Quantiles of strengths that are numbered in ascending order, with those between two rows interpolated."""
    place = wanted * (n - 1)
    below = np.floor(place).astype(int)
    needed = sorted({int(i) for i in below} | {min(n - 1, int(i) + 1) for i in below})
    asked = placed.sparkSession.createDataFrame([(i,) for i in needed], "idx long")
    at = {r["idx"]: r["strength"] for r in placed.join(F.broadcast(asked), "idx").collect()}
    low, high = np.array([at[int(i)] for i in below]), np.array([at[min(n - 1, int(i) + 1)] for i in below])
    return low + (high - low) * (place - below)


def fit(rows: DataFrame, quantile: float | None = None) -> Ranking:
    """A ranking from rows (doc_id, y, x) of labels (1 preferred) and features. The threshold is a quantile of the strengths
    of all rows, by default the one at which most rows of either label are on their side of it."""
    rows = cut_lineage(rows)
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_good, n_bad, n = counts.get(1, 0), counts.get(0, 0), sum(counts.values())
    width = _curved(np.zeros((1, len(FEATURES)))).shape[1]
    if not n_good or not n_bad:
        return Ranking([0.0] * width, [1.0] * width, [0.0] * width)
    rows = _parted(rows, n, "doc_id")
    mean = summed(rows, lambda b: _curved(_matrix(b["x"])).sum(0)) / n
    scale = np.sqrt(summed(rows, lambda b: ((_curved(_matrix(b["x"])) - mean) ** 2).sum(0)) / n)
    scale[scale < 1e-9] = 1.0
    pairs = preference_pairs(rows, n_good, n_bad)

    def slopes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def of(batch: pd.DataFrame) -> np.ndarray:
            difference = (_curved(_matrix(batch["better"])) - _curved(_matrix(batch["worse"]))) / scale
            gradient, hessian = derivatives(difference, np.ones(len(difference)), w)
            return np.append(gradient, hessian)

        sums = summed(pairs, of)
        return sums[:width], sums[width:].reshape(width, width)

    ranking = Ranking(mean.tolist(), scale.tolist(), newton(slopes, np.zeros(width), pull=3.0).tolist())
    strength = F.pandas_udf(lambda x: pd.Series(ranking.strength(_matrix(x))), T.DoubleType())
    strong = cut_lineage(rows.select(F.struct(strength("x").alias("strength"), "doc_id", "y").alias("at")))
    placed = cut_lineage(dense_index(strong, "at").select("at.strength", "at.y", "idx"))
    if quantile is None:
        tried = np.linspace(0, 1, CUTS + 1)
        cuts = _quantiles(placed, n, tried)

        def beyond(batch: pd.DataFrame) -> np.ndarray:
            # Rows at or above each cut, preferred ones and others.
            passed = np.searchsorted(cuts, batch["strength"].to_numpy(), side="right")
            reached = [np.bincount(passed[(batch["y"] == y).to_numpy()], minlength=len(cuts) + 1) for y in (1, 0)]
            return np.concatenate([r[::-1].cumsum()[::-1][1:] for r in reached])

        good, bad = summed(placed, beyond).reshape(2, -1)
        right = good / n_good + (n_bad - bad) / n_bad
        quantile = float(tried[np.flatnonzero(right >= right.max() - 1e-12)].mean())
    ranking.threshold = float(_quantiles(placed, n, np.array([quantile]))[0])
    return ranking


def learn_from(docs: DataFrame, labels: DataFrame) -> Ranking:
    """A ranking from all labelled rows whose crc32 remainder by 3 isn't 1."""
    known = labelled_rows(docs, labels, "quality", remainder(3) != 1)
    return fit(known.select("doc_id", "y", _feature_column(F.col("text")).alias("x")))


def quality(ranking: Ranking, text: str = "text") -> Column:
    """The score of a text column, from 0 to 1."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(ranking.score(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))))

    return score(text_of(text))


def op9_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    ranking = learn_from(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), quality(ranking).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
