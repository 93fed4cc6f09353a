"""Operator 2: toxicity by non-negative positive-unlabelled learning.

Linear numpy classifiers over the words that occur in a text are trained from confirmed
toxic documents (P) and documents taken as unlabelled (U) with the class-prior-corrected
risk  pi * R_P(+) + max(0, R_U(-) - pi * R_P(-));  when the second part would become
negative, the step goes uphill on it instead (so that it cannot be over-fitted).

* Only labels of rows outside the held-out fold are read; the class prior is the share
  of toxic rows among them.  A document with several label rows is toxic if one says so.
* The learning sample is bounded: about ``positives`` toxic and ``unlabelled`` other
  rows.  ``members`` classifiers train on all of P and disjoint parts of U, one task each;
  their logits are averaged.  Features are words and word beginnings of 4 and 6 letters; those whose
  share in P differs from that in U by ``z_least`` standard errors are kept.
* A score is computed from the whole text; labels, lang, source and doc_id do not enter.
  Null and empty texts get the score of a text without known words.  No positive label
  or no label at all: the prior (0 without labels) is the score of every text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docatlas.llm.common import remainder, share

BEGINNING = "…"
EDGES = ".,;:!?\"'()[]{}<>|*_-–—«»¿¡…"


def features_of(text: str) -> set[str]:
    words = {t.strip(EDGES) for t in set(text.lower().split())}
    return words | {w[:4] + BEGINNING for w in words if len(w) > 4} | {w[:6] + BEGINNING for w in words if len(w) > 6}


def fit(texts: list[set[str]], positive: np.ndarray, prior: float, z_least: float, steps: int) -> tuple[dict[str, float], float]:
    """Feature weights and bias of one classifier: full-batch Adam on the logistic non-negative risk."""
    n_p, n_u = positive.sum(), (~positive).sum()
    in_p = Counter(w for t, p in zip(texts, positive) if p for w in t)
    in_u = Counter(w for t, p in zip(texts, positive) if not p for w in t)

    def z(w: str) -> float:
        a, b = in_p[w] / n_p, in_u[w] / n_u
        both = (in_p[w] + in_u[w]) / (n_p + n_u)
        return abs(a - b) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-12)

    index = {w: i for i, w in enumerate(sorted(w for w in in_p.keys() | in_u.keys() if w and in_p[w] + in_u[w] > 9 and z(w) >= z_least))}
    rows, cols = [], []
    for i, t in enumerate(texts):
        own = [index[w] for w in t if w in index]
        rows += [i] * len(own)
        cols += own
    rows, cols = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)
    n, k = len(texts), len(index)
    is_p, is_u = positive.astype(float), (~positive).astype(float)
    p_share, u_share = is_p / max(1, is_p.sum()), is_u / max(1, is_u.sum())
    w = np.zeros(k + 1)
    w[k] = np.log(prior / (1 - prior))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    decay = np.append(np.full(k, 1e-4), 0)
    for step in range(1, steps + 1):
        g = np.bincount(rows, weights=w[cols], minlength=n) + w[k]
        up = 1 / (1 + np.exp(-g))            # d/dg of log(1+e^g), the loss of "not toxic"
        loss_neg = np.logaddexp(0, g)
        rest = (u_share * loss_neg).sum() - prior * (p_share * loss_neg).sum()
        d_pos, d_rest = prior * p_share * (up - 1), (u_share - prior * p_share) * up
        d = d_pos + d_rest if rest >= 0 else -d_rest
        grad = np.append(np.bincount(cols, weights=d[rows], minlength=k), d.sum()) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return {x: float(w[i]) for x, i in index.items()}, float(w[k])


def train(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 9000, members: int = 3,
          z_least: float = 6.0, steps: int = 400) -> tuple[dict[str, float], float]:
    """Averaged word weights and bias from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    head = marks.agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("p")).head()
    total = docs.select("doc_id").count()
    if not head["n"] or not head["p"] or not total:
        return {}, -np.inf
    prior = min(0.95, max(1e-4, head["p"] / head["n"]))
    sure = marks.where("toxic > 0").where(share("pu-positive", "doc_id") < min(1.0, positives / head["p"])).select("doc_id", F.lit(True).alias("positive"))
    d = docs.select("doc_id", "text").where("text is not null")
    chosen = d.where(share("pu-unlabelled", "doc_id", "text") < min(1.0, unlabelled / total)).withColumn("positive", F.lit(False))
    known = d.join(sure, "doc_id")
    every = known.select("*", F.explode(F.array(*[F.lit(i) for i in range(members)])).alias("member"))
    rows = every.unionByName(chosen.withColumn("member", F.pmod(F.xxhash64("doc_id", "text"), F.lit(members)).cast("int")))

    def one(table: pa.Table) -> pa.Table:
        texts = [features_of(t) for t in table["text"].to_pylist()]
        positive = np.array(table["positive"].to_pylist(), dtype=bool)
        if not positive.any() or positive.all():
            return pa.table({"word": pa.array([], pa.string()), "weight": pa.array([], pa.float64())})
        weights, bias = fit(texts, positive, prior, z_least, steps)
        return pa.table({"word": pa.array([None, *weights], pa.string()), "weight": pa.array([bias, *weights.values()], pa.float64())})

    got = rows.groupBy("member").applyInArrow(one, "word string, weight double").toArrow()  # bounded by the sample
    words, weights = got["word"].to_pylist(), got["weight"].to_pylist()
    n = sum(w is None for w in words)
    if not n:
        return {}, float(np.log(prior / (1 - prior)))
    mean: dict[str, float] = {}
    bias = 0.0
    for w, x in zip(words, weights):
        if w is None:
            bias += x / n
        else:
            mean[w] = mean.get(w, 0.0) + x / n
    return mean, bias


def score(docs: DataFrame, model: tuple[dict[str, float], float], keep: list[str]) -> DataFrame:
    """``keep`` columns with score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col("text").alias("text_to_judge"), *keep)
    schema = T.StructType(d.schema.fields[1:]).add("score", T.DoubleType()).add("predicted", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        known = weights.keys()
        for batch in batches:
            logits = [bias + sum(map(weights.__getitem__, sorted(features_of(t.as_py() or "") & known))) for t in batch.column(0)]
            s = np.where(np.isneginf(logits), 0.0, 1 / (1 + np.exp(-np.clip(logits, -700, 700))))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())],
                                             [*batch.schema.names[1:], "score", "predicted"])

    return d.mapInArrow(run, schema)


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = remainder(5)
    model = train(d.where(fold > 0), labels.where(fold > 0))
    return score(d.withColumn("held_out", fold == 0), model, ["doc_id", "held_out"]).select("doc_id", "held_out", "score", "predicted")
