"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier is trained from confirmed toxic texts and unlabelled ones.
With the share of toxic texts (the prior) known, the risk on clean texts is the
unlabelled risk less the prior times the positive texts' risk of being taken for
clean; where that estimate falls below zero, it is held at zero by stepping back
up, so a flexible model can't profit from it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstream.llm.common import bounded_sample, held_out

#: Most confirmed and most unlabelled texts of the fit, texts of the sample that a word has to be in, and classifiers whose scores are averaged.
POSITIVES, UNLABELLED, LEAST_TEXTS, MEMBERS = 4000, 12_000, 4, 3
#: Standard errors that a feature's shares of toxic and of unlabelled texts have to be apart.
LEAST_Z = 5.0
#: Words that a worker remembers.
REMEMBERED = 300_000
#: Lengths of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6, 7)
TOKEN = re.compile(r"[^\W_]+")


def parts(word: str) -> list[str]:
    """Features of a word: itself, and its beginnings as stems."""
    return [word, *(f"{word[:k]}-" for k in STEMS if len(word) > k)]


def tokens(text: str | None) -> set[str]:
    """The different features of a text: words (runs of letters and digits, lower case) and stems."""
    return {p for w in set(TOKEN.findall(text.lower())) for p in parts(w)} if text else set()


@dataclass
class Model:
    """weights: word -> weight, the members' mean; bias alike."""

    weights: dict[str, float]
    bias: float
    seen: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def known(self, word: str) -> tuple[str, ...]:
        """Features of a word that have a weight; a bounded number of words is remembered."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        self.seen[word] = out = tuple(p for p in parts(word) if p in self.weights)
        return out

    def score(self, text: str | None) -> float:
        """Probability of being toxic; the bias alone for a text without known features."""
        words = set(TOKEN.findall(text.lower())) if text else ()
        found = {p for w in words for p in (self.seen[w] if w in self.seen else self.known(w))}
        return float(1 / (1 + math.exp(-min(max(self.bias + math.fsum(self.weights[p] for p in found), -40.0), 40.0))))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], width: int, prior: float, seed: int = 0, rounds: int = 400, share: float = 0.8, rate: float = 0.05, penalty: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from feature indices of each text: the non-negative risk estimator with the logistic loss, full gradients and Adam.

    Each fit sees its own random ``share`` of the texts of either kind.
    """
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))

    def pack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        which = rng.permutation(len(rows))[: max(1, round(share * len(rows)))]
        return np.concatenate([rows[i] for i in which]), np.repeat(np.arange(len(which)), [len(rows[i]) for i in which]), len(which)

    (pf, pr, p), (uf, ur, u) = pack(positive), pack(unlabelled)

    def pull(features: np.ndarray, row: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(features, weights=slope[row], minlength=width), slope.sum()) / len(slope)

    for step in range(1, rounds + 1):
        zp = np.bincount(pr, weights=w[pf], minlength=p) + w[-1]
        zu = np.bincount(ur, weights=w[uf], minlength=u) + w[-1]
        # loss of taking for clean is log(1 + e^z), its slope the sigmoid
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        clean_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        clean = pull(uf, ur, su) - prior * pull(pf, pr, sp)
        slope = -clean if clean_risk < 0 else clean + prior * pull(pf, pr, sp - 1)
        slope[:-1] += penalty * w[:-1]
        m += 0.1 * (slope - m)
        v += 0.01 * (slope * slope - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, members: int = MEMBERS) -> Model:
    """A model from bounded samples of rows that are not held out.

    Confirmed texts are those marked toxic. The prior is the share of toxic
    marks among all marks; a mark of 0 is used for nothing else. The unlabelled
    are drawn from all texts, whatever their mark, so the prior holds for them. Without a toxic or an unlabelled text the score is the
    prior for every text.
    """
    open_labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out(F.col("doc_id")))
    n, n_toxic = open_labels.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic")), F.lit(0))).first()
    prior = min(max(n_toxic / n, 1e-3), 0.9) if n else 1e-3
    base = Model({}, float(np.log(prior / (1 - prior))))
    toxic = open_labels.filter("toxic = 1").select("doc_id").distinct()
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().filter(~held_out(F.col("doc_id"))).distinct()
    drawn = bounded_sample(toxic, "doc_id", positives).withColumn("toxic", F.lit(1)).union(
        bounded_sample(ids, "doc_id", unlabelled).withColumn("toxic", F.lit(0))
    )

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(tokens(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.string()))], ["doc_id", "toxic", "words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").dropDuplicates(["toxic", "text"])
    described = texts.select("doc_id", "text", "toxic").mapInArrow(describe, "doc_id long, toxic int, words array<string>")
    # a feature has to be more frequent, or less, in toxic texts than chance allows; only such features reach the driver
    totals = {r.toxic: r.n for r in described.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, u = totals.get(1, 0), totals.get(0, 0)
    if not p or not u:
        return base
    counts = described.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    share = (F.col("a") + F.col("b")) / (p + u)
    apart = F.abs(F.col("a") / p - F.col("b") / u) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / p + 1 / u))
    vocabulary = sorted(r.word for r in counts.filter((F.col("a") + F.col("b") >= LEAST_TEXTS) & (apart >= LEAST_Z)).select("word").collect())
    index = {w: i for i, w in enumerate(vocabulary)}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array([index[w] for w in sorted(tokens(t)) if w in index], dtype="<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "toxic", "features"])

    rows = sorted(texts.select("doc_id", "text", "toxic").mapInArrow(number, "doc_id long, toxic int, features binary").collect())
    groups = [[np.frombuffer(r.features, dtype="<i4").astype(np.int64) for r in rows if r.toxic == k] for k in (1, 0)]
    if not vocabulary:
        return base
    fits = [fit(*groups, len(vocabulary), prior, seed) for seed in range(members)]
    weights, bias = np.mean([w for w, _ in fits], axis=0), float(np.mean([b for _, b in fits]))
    return Model({w: float(x) for w, x in zip(vocabulary, weights, strict=True) if abs(x) > 1e-4}, bias)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, from the text alone.

    Null and empty texts, and texts without known words, get the score of the
    model's bias; long texts are read whole; equal texts score alike; a null
    doc_id is not held out; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
