"""Toxicity: cumulative-link ordinal regression on sparse text features.

Features are words and word beginnings (so that inflected forms share one). Those tied most to the
labels are chosen by an aggregate, the model is fitted on a bounded sample of labelled rows, and every
text is scored whole in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter as Tally
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import free_name, text_tie
from tidewatch.session import cut_lineage

# Labelled rows that features and model are fitted on, and features that the model may have.
FIT_ROWS = 20_000
FEATURES = 512
MIN_DOCS = 5
MIN_Z = 4.0
PREFIXES = (4, 5)
# Words tied to toxicity from which a toxic text has grade 2 and grade 3.
GRADE_WORDS = (3, 8)
REJECT_AT = 0.5
CACHE_WORDS = 400_000
FEATURE_ROWS = 100_000

_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked with ``*``."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


@dataclass(frozen=True)
class Model:
    """P(grade <= k) = logistic(cuts[k] - weights . x), x the logarithm of 1 + each feature's count."""

    index: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """One row per score, one column per grade."""
        up_to = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - score[:, None], -60, 60)))
        edges = np.concatenate((np.zeros((len(score), 1)), up_to, np.ones((len(score), 1))), axis=1)
        return np.diff(edges, axis=1)


class Counter:
    """Counts of the indexed features of a text; remembers the features of words, up to a bound."""

    def __init__(self, index: dict[str, int]):
        self.index, self.seen = index, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        seen, hits = self.seen, []
        for word in _WORD.findall((text or "").lower()):
            found = seen.get(word)
            if found is None:
                if len(seen) >= CACHE_WORDS:
                    seen.clear()
                found = seen[word] = tuple(self.index[f] for f in features_of(word) if f in self.index)
            if found:
                hits += found
        ids, counts = np.unique(np.array(hits, dtype=np.int64), return_counts=True)
        return ids, counts


def fit_ordinal(
    x: np.ndarray, grade: np.ndarray, times: np.ndarray | None = None, ridge: float = 0.2, rounds: int = 1500, rate: float = 0.1
) -> tuple[np.ndarray, np.ndarray]:
    """Weights shared by all thresholds, and ordered thresholds, by penalised maximum likelihood (Adam, falling rate).

    ``times``: how often each row stands.
    """
    times = np.ones(len(grade)) if times is None else times.astype(float)
    n, top = times.sum(), max(int(grade.max(initial=0)), 1)
    share = np.cumsum(np.bincount(grade, times, minlength=top + 1))[:-1] / max(n, 1)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    # Thresholds are a first value and positive steps, which keeps them in order.
    p = np.concatenate((np.zeros(x.shape[1]), first[:1], np.log(np.maximum(np.diff(first), 1e-2))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    d = x.shape[1]
    for step in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate((p[d : d + 1], np.exp(p[d + 1 :]))))
        z = x @ p[:d]
        low = np.concatenate(([-np.inf], cuts))[grade]
        high = np.concatenate((cuts, [np.inf]))[grade]
        s_high, s_low = sig(high - z), sig(low - z)
        share_of = np.maximum(s_high - s_low, 1e-12)
        g_high, g_low = times * s_high * (1 - s_high) / share_of, times * s_low * (1 - s_low) / share_of
        by_cut = np.array([g_high[grade == k].sum() - g_low[grade == k + 1].sum() for k in range(top)])
        tail = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate((x.T @ (g_low - g_high) - ridge * p[:d], tail[:1], tail[1:] * np.exp(p[d + 1 :]))) / max(n, 1)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p + rate * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:d], np.cumsum(np.concatenate((p[d : d + 1], np.exp(p[d + 1 :]))))


def _choose_features(sample: DataFrame) -> dict[str, float]:
    """Feature and z-score of those whose documents are toxic most beyond the usual rate."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, marks = [], []
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                own = {f for w in set(_WORD.findall((text or "").lower())) for f in features_of(w)}
                features += sorted(own)
                marks += [int(toxic)] * len(own)
                if len(features) >= FEATURE_ROWS:
                    yield packed(features, marks)
                    features, marks = [], []
        yield packed(features, marks)

    def packed(features: list[str], marks: list[int]) -> pa.RecordBatch:
        return pa.record_batch({"feature": pa.array(features, pa.string()), "toxic": pa.array(marks, pa.int32())})

    total = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = total["n"], total["t"] or 0
    if not 0 < t < n:
        return {}
    rate, spread = t / n, math.sqrt(t / n * (1 - t / n))
    docs = sample.mapInArrow(task, "feature string, toxic int").groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    z = (F.col("t") - F.col("n") * rate) / (F.sqrt("n") * spread)
    best = docs.where(F.col("n") >= MIN_DOCS).withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.col("z").desc(), "feature").limit(FEATURES)
    return {r["feature"]: r["z"] for r in best.collect()}


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", toxic: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """The model from at most ``fit_rows`` labelled documents (those first by a hash of their id).

    The labels say only toxic or not. A toxic text gets grade 1, 2 or 3 by how many of its words are
    tied to toxicity; others grade 0. Null labels and ids are left out, of repeated labels the
    highest counts, of repeated documents the one with the smallest text hash. With one class only, the model finds nothing toxic.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(toxic).isNotNull())
        .groupBy(F.col(id_col).alias("_label_id"))
        .agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("_label_id"), "_label_id")
        .limit(fit_rows)
    )
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text).alias("text"))
    met = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_label_id"))
    one = F.min_by("text", text_tie(F.col("text"))).alias("text")
    sample = cut_lineage(met.groupBy("_label_id").agg(one, F.first("toxic").alias("toxic")).select("text", "toxic"))
    scores = _choose_features(sample)
    index = {f: i for i, f in enumerate(sorted(scores))}
    if not index:
        return Model({}, np.zeros(0), np.array([20.0, 21.0, 22.0]))
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = Counter(index)
        for frame in frames:
            found = [count(t) for t in frame["text"]]
            tied = [c.sum() / (1 + len(PREFIXES)) for _, c in found]
            yield pd.DataFrame({
                "ids": [i.tolist() for i, _ in found], "counts": [c.tolist() for _, c in found],
                "grade": [int(t and 1 + sum(n >= g for g in GRADE_WORDS)) for t, n in zip(frame["toxic"], tied)],
            })

    # At most fit_rows rows, and of each the chosen features alone.
    held = sample.mapInPandas(rows, "ids array<long>, counts array<long>, grade int").toPandas()
    # Most rows have no feature at all; rows that are alike become one.
    alike = Tally((tuple(i), tuple(c), g) for i, c, g in zip(held["ids"], held["counts"], held["grade"]))
    x = np.zeros((len(alike), len(index)), dtype=np.float32)
    rows_of = sorted(alike)
    for r, (ids, counts, _) in enumerate(rows_of):
        x[r, list(ids)] = np.log1p(counts)
    weights, cuts = fit_ordinal(x, np.array([g for _, _, g in rows_of], dtype=np.int64), np.array([alike[k] for k in rows_of]))
    return Model(index, weights, cuts)


def _judge(model: Model):
    @F.pandas_udf("severity double, p_toxic double, grade int, toxic boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = Counter(model.index)
        for texts in batches:
            z = np.zeros(len(texts))
            for r, t in enumerate(texts):
                ids, counts = count(t)
                if len(ids):
                    z[r] = model.weights[ids] @ np.log1p(counts)
            p = model.probabilities(z)
            p_toxic = 1 - p[:, 0]
            yield pd.DataFrame({
                "severity": p @ np.arange(p.shape[1]), "p_toxic": p_toxic, "grade": p.argmax(axis=1).astype(np.int32), "toxic": p_toxic >= REJECT_AT,
            })

    return judged


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with severity (expected grade), p_toxic (of grade 1 or more), grade (likeliest) and toxic.

    Null and empty texts are scored as texts without features. Repeated rows score alike. Columns of
    these names are replaced.
    """
    new = ("severity", "p_toxic", "grade", "toxic")
    judged = free_name(documents, "_judged")
    others = [c for c in documents.columns if c.lower() not in new]
    return documents.withColumn(judged, _judge(model)(F.col(text))).select(*others, *[F.col(f"{judged}.{c}").alias(c) for c in new])


def without_toxic(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``documents`` that the model does not find toxic, with all their columns."""
    judged = free_name(documents, "_judged")
    return documents.withColumn(judged, _judge(model)(F.col(text))).where(~F.col(f"{judged}.toxic")).select(*documents.columns)
