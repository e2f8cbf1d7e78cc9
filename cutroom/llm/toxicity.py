"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models; each later model has the probabilities of
the categories before it among its features. In training those probabilities are out of fold: for each
fold, the earlier model, its choice of words included, was fitted on the other folds, so later models see
them as they will be.

Features are the presence of words (hashed to 2**20): all those that, in the rows a model is fitted on,
tell a category's documents from the others by SIGNAL standard errors or more. Training uses at most
`sample` labelled documents, those with the smallest hash of doc_id (a documented bound); every document is
scored, over its whole text. A category holds from the threshold on at which the out-of-fold probabilities
of the sample did best (largest F1).

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A null or empty text has no feature
and gets the models' base rates. A null label leaves the row out of training; of repeated labels for one
doc_id the largest counts, of repeated documents the text with the smallest hash is learnt from, and each is
scored. Without labelled documents, or without any of a category, it has probability 0. No documents give
no rows. A very long text is one row of one task. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, Words, pieces

#: The chain in order, as SQL over the labels: later categories lean on earlier ones.
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("severe", "toxic = 1 AND quality = 0"))
SAMPLE = 8192
FOLDS = 5
BUCKETS = 1 << 20
SIGNAL = 5.0


@dataclass
class Link:
    """One model of the chain: sorted buckets, a weight for each, one for each earlier category, and the intercept last; threshold: from where on the category holds."""

    name: str
    buckets: np.ndarray
    weights: np.ndarray
    threshold: float = 0.5

    def predict(self, present: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """present: documents x buckets; earlier: documents x earlier categories."""
        x = np.hstack([present, earlier, np.ones((len(present), 1))])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))


def buckets(words: Words) -> np.ndarray:
    return (words.hashes >> np.uint64(44)).astype(np.int64)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Newton's method; the last column, the intercept, has next to no penalty."""
    if not len(y) or not y.any():
        return np.concatenate([np.zeros(x.shape[1] - 1), [-500.0]])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _telling(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets whose share of documents differs between y and not y by SIGNAL standard errors or more."""
    n1, n0 = max(1, int(y.sum())), max(1, int((~y).sum()))
    c1 = np.bincount(np.concatenate([*(d for d, t in zip(docs, y, strict=True) if t), np.zeros(0, np.int64)]), minlength=BUCKETS)
    c0 = np.bincount(np.concatenate([*(d for d, t in zip(docs, y, strict=True) if not t), np.zeros(0, np.int64)]), minlength=BUCKETS)
    p = (c1 + c0 + 0.5) / (n1 + n0 + 1)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    return np.flatnonzero(z >= SIGNAL)


def _presence(docs: list[np.ndarray], which: np.ndarray) -> np.ndarray:
    out = np.zeros((len(docs), len(which)))
    for i, d in enumerate(docs):
        at = np.searchsorted(which, d)
        hit = at < len(which)
        out[i, at[hit][which[at[hit]] == d[hit]]] = 1.0
    return out


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Halfway between the lowest probability that counts at the largest F1 and the next one below; 0.5 if no row has the category."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    last = np.concatenate([np.diff(p[order]) < 0, [True]])  # equal probabilities count together
    best = int(np.argmax(np.where(last, f1, -1.0)))
    below = p[order][best + 1] if best + 1 < len(p) else 0.0
    return float((p[order][best] + below) / 2)


def _fitted(docs: list[np.ndarray], y: np.ndarray, earlier: np.ndarray) -> Link:
    """A link on some documents, with the words that tell there."""
    which = _telling(docs, y)
    x = np.hstack([_presence(docs, which), earlier, np.ones((len(docs), 1))])
    return Link("", which, _logistic(x, y.astype(float)))


def fit_chain(docs: list[np.ndarray], labels: dict[str, np.ndarray], folds: int = FOLDS) -> list[Link]:
    """docs: the distinct buckets of each document, sorted; labels: category -> booleans, in chain order."""
    chain: list[Link] = []
    earlier = np.zeros((len(docs), 0))
    fold = np.arange(len(docs)) % folds
    for name, y in labels.items():
        whole = _fitted(docs, y, earlier)
        held = np.zeros(len(docs))
        for f in range(folds):
            inside, part = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            link = _fitted([docs[i] for i in inside], y[inside], earlier[inside])
            held[part] = link.predict(_presence([docs[i] for i in part], link.buckets), earlier[part])
        chain.append(Link(name, whole.buckets, whole.weights, _best_threshold(held, y)))
        earlier = np.hstack([earlier, held[:, None]])
    return chain


def _distinct_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, text in pieces(batch.column(1)):
            words = text.words(ALNUM, lower=True)
            b = buckets(words).astype(np.int32)
            lists = [np.unique(b[i:j]) for i, j in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
            rest = [batch.column(i).slice(lo, hi - lo) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lists, pa.list_(pa.int32())), *rest], names=["doc_id", "buckets", *batch.schema.names[2:]])


def fit(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, str], ...] = CHAIN, sample: int = SAMPLE) -> list[Link]:
    """The chain, fitted on at most `sample` labelled documents, whose word buckets the driver gets."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = named.select("doc_id", *(F.expr(sql).alias(name) for name, sql in chain)).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    names = [name for name, _ in chain]
    one = texts.groupBy("doc_id").agg(F.min_by(F.struct("text", *names), F.struct(F.md5("text"))).alias("row")).select("doc_id", "row.*")
    rows = one.mapInArrow(_distinct_buckets, f"doc_id {kind}, buckets array<int>, " + ", ".join(f"{name} boolean" for name in names))
    got = rows.limit(sample).toArrow().sort_by("doc_id")
    found = [np.asarray(x.values, np.int64) for x in got["buckets"]]
    return fit_chain(found, {name: got[name].to_numpy(zero_copy_only=False).astype(bool) for name, _ in chain})


def predict(docs: DataFrame, chain: list[Link], threshold: float | None = None, category: str = "toxic") -> DataFrame:
    """doc_id, n_words, p_<category> of each link, and is_toxic: p_<category> reaches the threshold, that of its link if none is given. No shuffle."""
    every = np.unique(np.concatenate([*(link.buckets for link in chain), np.zeros(0, np.int64)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, text in pieces(batch.column(1)):
                words = text.words(ALNUM, lower=True)
                present = np.zeros((hi - lo, len(every)))
                if len(every):
                    b = buckets(words)
                    at = np.minimum(np.searchsorted(every, b), len(every) - 1)
                    hit = np.flatnonzero(every[at] == b)
                    present[np.searchsorted(words.bounds, hit, side="right") - 1, at[hit]] = 1.0
                earlier = np.zeros((hi - lo, 0))
                for link in chain:
                    p = link.predict(present[:, np.searchsorted(every, link.buckets)], earlier)
                    earlier = np.hstack([earlier, p[:, None]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(words.counts().astype(np.int64)), *(pa.array(np.ascontiguousarray(earlier[:, i])) for i in range(len(chain)))],
                    names=["doc_id", "n_words", *(f"p_{link.name}" for link in chain)],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, " + ", ".join(f"p_{link.name} double" for link in chain))
    own = next(link.threshold for link in chain if link.name == category)
    return rows.withColumn("is_toxic", F.col(f"p_{category}") >= (own if threshold is None else threshold))
