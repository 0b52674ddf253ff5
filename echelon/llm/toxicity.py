"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; any text of the corpus, whatever its label, is unlabelled and so a draw of the whole
distribution. With the class prior p the risk of a linear classifier is p * R+(positives as 1) + max(0, R(unlabelled as 0) -
p * R(positives as 0)): the negative part is estimated without a single confirmed clean text, and is kept from falling below
zero, where it would only fit noise. The classifier is a logistic model over the presence of hashed words and word beginnings. It is fitted with
numpy in one task on a sample whose size is a parameter; scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from echelon.llm.common import text_of

BUCKETS = 1 << 18
FEATURES = 2048
#: Log-likelihood that a bucket must gain to be used; chance gives this to about one bucket in a million.
LEAST_GAIN = 12.0
#: Bounds of the training sample.
MOST_POSITIVE = 4_000
MOST_UNLABELLED = 16_000
STEPS = 300
RIDGE = 1e-5
PREFIXES = (4, 5)
WORD = re.compile(r"[^\W_]+")


def buckets_of(text: str) -> list[int]:
    """The buckets of the distinct words of a text and of how they begin, so that unseen forms of a word count too."""
    words = set(WORD.findall(text.lower()))
    for length in PREFIXES:
        words |= {"^" + word[:length] for word in words if len(word) > length and word[0] != "^"}
    return list({zlib.crc32(word.encode()) % BUCKETS for word in words})


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Presence:
    """A sparse 0/1 matrix as (row, column) pairs."""

    def __init__(self, texts: list[np.ndarray], columns: np.ndarray):
        place = np.full(BUCKETS, -1, np.int64)
        place[columns] = np.arange(len(columns))
        lengths = [len(one) for one in texts]
        column = place[np.concatenate(texts).astype(np.int64)] if sum(lengths) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(texts)), lengths)
        self.row, self.column = row[column >= 0], column[column >= 0]
        self.rows, self.columns = len(texts), len(columns)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.rows)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, values[self.row], self.columns)


def chosen_columns(positive: list[np.ndarray], unlabelled: list[np.ndarray], most: int) -> np.ndarray:
    """The buckets whose share among positives differs most from that among the unlabelled, by the likelihood ratio."""
    a = np.bincount(np.concatenate(positive).astype(np.int64), minlength=BUCKETS) if positive else np.zeros(BUCKETS)
    b = np.bincount(np.concatenate(unlabelled).astype(np.int64), minlength=BUCKETS) if unlabelled else np.zeros(BUCKETS)
    n, m = len(positive), len(unlabelled)
    both = (a + b) / (n + m)

    def part(count: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(count > 0, count * np.log(count / (size * both)), 0) + np.where(count < size, (size - count) * np.log((size - count) / (size * (1 - both))), 0)

    gain = np.nan_to_num(part(a, n) + part(b, m))
    best = np.argsort(-gain, kind="stable")[:most]
    return np.sort(best[gain[best] >= LEAST_GAIN])


def best_cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The cut between two different scores of least estimated error, the widest of equally good ones.

    The error is the same non-negative risk, counted instead of by the logistic loss: positives at or below the cut, by the prior,
    and the unlabelled above it that the prior does not account for. All texts with one score are on one side.
    """
    scores, at = np.unique(np.concatenate([positive, unlabelled]), return_inverse=True)
    ends = np.array([scores[0] - 2, *scores, scores[-1] + 2])
    # for the cut before each score and after the last: shares of texts above it
    above_p = np.append(np.cumsum(np.bincount(at[: len(positive)], minlength=len(scores))[::-1])[::-1], 0) / len(positive)
    above_u = np.append(np.cumsum(np.bincount(at[len(positive) :], minlength=len(scores))[::-1])[::-1], 0) / len(unlabelled)
    error = prior * (1 - above_p) + np.maximum(0, above_u - prior * above_p)
    good = np.flatnonzero(error <= error.min() + 0.5 / len(unlabelled))
    widest = good[np.argmax((ends[1:] - ends[:-1])[good])]
    return float(ends[widest] + ends[widest + 1]) / 2


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, most: int = FEATURES, steps: int = STEPS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, float]:
    """Columns, weights and bias that minimise the non-negative risk (logistic loss, ridge penalty, Adam steps).

    At last the bias is set to the cut of least counted risk, see `best_cut`.
    """
    columns = chosen_columns(positive, unlabelled, most)
    p, u = Presence(positive, columns), Presence(unlabelled, columns)
    weights, bias = np.zeros(len(columns)), math.log(prior / (1 - prior))
    first, second = np.zeros(len(columns) + 1), np.zeros(len(columns) + 1)
    for step in range(1, steps + 1):
        zp, zu = p.dot(weights) + bias, u.dot(weights) + bias
        sp, su = logistic(zp), logistic(zu)
        as_one = prior * (sp - 1) / p.rows  # gradient of the loss of positives taken as 1
        as_zero_u, as_zero_p = su / u.rows, prior * sp / p.rows  # and of texts taken as 0
        negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        if negative >= 0:
            gp, gu = as_one - as_zero_p, as_zero_u
        else:  # the estimate is held at zero
            gp, gu = as_one, 0 * as_zero_u
        slope = np.append(p.back(gp) + u.back(gu) + ridge * weights, gp.sum() + gu.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return columns, weights, -best_cut(p.dot(weights), u.dot(weights), prior)


@dataclass(frozen=True)
class Model:
    """At most `FEATURES` weights, by bucket. Without a confirmed toxic text every score is 0."""

    weights: dict[int, float]
    bias: float
    trained: bool = True

    def scores(self, texts: Iterable[str]) -> list[float]:
        if not self.trained:
            return [0.0 for _ in texts]
        known = self.weights.get
        return logistic(np.array([self.bias + sum([known(b, 0.0) for b in buckets_of(text)]) for text in texts], float)).tolist()


def held_out(id: str | Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves no rest by 5; a null id is not held out."""
    return F.coalesce(F.crc32((F.col(id) if isinstance(id, str) else id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _drawn(id: Column, salt: str, share: float) -> Column:
    """A pseudo-random share of the ids, the same ones in every run."""
    return F.pmod(F.xxhash64(id, F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Fit on a sample of about `most_positive` confirmed toxic and `most_unlabelled` other draws of the rows not held out.

    The prior is the share of toxic rows among the labels that are not held out. Labels with a null id or label don't count;
    an id with several labels counts as toxic if one of them says so.
    """
    told = labels.select(F.col(id).alias("id"), F.col(label).alias("label")).where("id IS NOT NULL AND label IS NOT NULL").where(~held_out("id"))
    per_id = told.groupBy("id").agg(F.max("label").alias("label"))
    known = per_id.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    if not known.toxic:
        return Model({}, 0.0, trained=False)
    prior = min(0.9, max(1e-4, known.toxic / known.n))
    rows = docs.select(F.col(id).alias("id"), text_of(text).alias("text")).where(~held_out("id") & F.col("id").isNotNull())
    positives = per_id.where("label = 1").select("id").where(_drawn(F.col("id"), "positive", most_positive / known.toxic))
    total = docs.count()
    # about `most_positive` ids: small enough to send to all tasks
    marked = rows.join(F.broadcast(positives.withColumn("positive", F.lit(True))), "id", "left")
    sample = marked.select("text", F.coalesce("positive", F.lit(False)).alias("positive"), _drawn(F.col("id"), "unlabelled", most_unlabelled / max(1, total)).alias("unlabelled")).where("positive OR unlabelled")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [buckets_of(value.as_py()) for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("unlabelled"), pa.array(found, pa.list_(pa.int32()))], ["positive", "unlabelled", "found"])

    def fitted(sampled: pd.DataFrame) -> pd.DataFrame:
        positive = [np.asarray(one) for one in sampled.found[sampled.positive]]
        unlabelled = [np.asarray(one) for one in sampled.found[sampled.unlabelled]]
        if not positive or not unlabelled:
            return pd.DataFrame({"bucket": pd.Series([], dtype="int64"), "weight": pd.Series([], dtype="float64")})
        columns, weights, bias = fit(positive, unlabelled, prior)
        return pd.DataFrame({"bucket": np.append(columns, -1).astype("int64"), "weight": np.append(weights, bias)})

    found = sample.mapInArrow(features, "positive boolean, unlabelled boolean, found array<int>")
    weights = {row.bucket: row.weight for row in found.groupBy().applyInPandas(fitted, "bucket long, weight double").collect()}
    bias = weights.pop(-1, None)
    return Model(weights, bias or 0.0, trained=bias is not None)


def toxicity(text: str | Column, model: Model) -> Column:
    """The score of a text column, 0 to 1; a null text counts as empty and gets what the bias alone says."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(text.as_py() for text in texts), pa.float64())

    return score(text_of(text))


def score_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of `docs`: id, held_out, score and predicted (1 from 0.5 on). Learns only from rows not held out.

    Null ids are scored, not trained on. Repeated rows stay rows of their own; other columns are not read; an empty table
    gives no rows.
    """
    model = train(docs, labels, id, text, **options)
    scored = docs.select(id, held_out(id).alias("held_out"), toxicity(text, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with all its columns, without the rows that are predicted to be toxic."""
    return docs.where(toxicity(text, train(docs, labels, id, text, **options)) < 0.5)
