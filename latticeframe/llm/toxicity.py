"""Toxicity by a classifier chain.

The categories are predicted in order by logistic models over words and their beginnings; each later model also gets the earlier
categories' probabilities, which in training are out-of-fold predictions, so that it sees them as wrong as they will
be. Words that speak for a category are chosen by their counts over the training sample.

Training takes a bounded sample of the labelled documents: those of the smallest id hashes, `most_labelled` at most.
Null and empty texts have no words and get the models' base rates. A null label or id leaves its row out of training. A
label given twice trains once; of documents that share an id the one with the least words' digest trains, so that no more
is gathered than the sample has. Texts are read whole. Extra columns are ignored. An empty table gives no rows; without
training rows of both kinds a category's probability is its rate (0 where there is none).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeframe.llm.common import Sink, rows_of

WORD = re.compile(r"[^\W\d_]+")
FOLDS, MOST_WORDS, LEAST_TEXTS, STEMS = 3, 512, 4, (3, 4, 5, 6)


def word_hashes(text: str | None) -> np.ndarray:
    """Distinct words of a lower-cased text and their beginnings, which inflected forms share, as sorted 32-bit hashes."""
    words = set(WORD.findall((text or "").lower()))
    for k in STEMS:
        words |= {w[:k] + "-" for w in words if len(w) > k and w[-1] != "-"}
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words)))


@dataclass
class Link:
    """A model of the chain: weights of its words, of the earlier probabilities, and the base."""

    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    base: float

    def probability(self, present: np.ndarray, before: list[float]) -> float:
        at = np.searchsorted(self.words, present)
        at = at[(at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == present)] if len(self.words) else at[:0]
        return float(1 / (1 + np.exp(-(self.base + self.weights[at].sum() + self.earlier @ np.array(before)))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Weights (the last for the constant) by Newton steps; the constant is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def choose_words(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The words whose presence goes most with the label, by chi-square; sorted."""
    flat = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
    words, at = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    n = np.bincount(at, minlength=len(words))
    a = np.bincount(at, weights=y[owner], minlength=len(words))
    rate = y.mean()
    chi = (a - n * rate) ** 2 / np.maximum(n * rate * (1 - rate), 1e-9)
    chi[n < LEAST_TEXTS] = 0
    top = np.argsort(-chi, kind="stable")[:MOST_WORDS]
    return np.sort(words[top[chi[top] > 6.6]])


def matrix(texts: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    x = np.zeros((len(texts), len(words)), np.float32)
    for i, t in enumerate(texts):
        x[i] = np.isin(words, t, assume_unique=True)
    return x


def fit_link(texts: list[np.ndarray], y: np.ndarray, before: np.ndarray) -> Link:
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return Link(np.zeros(0, np.uint32), np.zeros(0), np.zeros(before.shape[1]), float(np.log((rate + 1e-9) / (1 - rate + 1e-9))))
    words = choose_words(texts, y)
    w = logistic(np.hstack([matrix(texts, words), before]), y)
    return Link(words, w[: len(words)], w[len(words) : -1], float(w[-1]))


def fit_chain(texts: list[np.ndarray], labels: np.ndarray) -> list[Link]:
    """labels: one column per category, in the order of the chain."""
    before, chain = np.zeros((len(texts), 0)), []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(np.float64)
        chain.append(fit_link(texts, y, before))
        if c + 1 < labels.shape[1]:
            out = np.zeros(len(texts))
            for fold in range(FOLDS):
                test = np.arange(len(texts)) % FOLDS == fold
                link = fit_link([t for t, x in zip(texts, test, strict=True) if not x], y[~test], before[~test])
                out[test] = [link.probability(texts[i], list(before[i])) for i in np.flatnonzero(test)]
            before = np.hstack([before, out[:, None]])
    return chain


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most_labelled: int = 8_000, id_col: str = "doc_id", text_col: str = "text") -> list[Link]:
    """categories: name to a 0/1 column of labels, in the order of the chain."""
    names = list(categories)
    own = labels.select(F.col(id_col).alias("id"), *(c.cast("int").alias(name) for name, c in categories.items())).dropna().distinct()
    sample = own.orderBy(F.xxhash64("id"), "id").limit(most_labelled)  # the documented bound on training rows
    schema = pa.schema([("id", pa.int64()), *((name, pa.int32()) for name in names), ("words", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sink(schema)
        for *known, text in rows_of(batches, "id", *names, "text"):
            words = word_hashes(text).tobytes()
            out.add((*known, words), len(words))
            if out.full():
                yield out.take()
        yield from out.rest()

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # most_labelled rows of a few numbers
    rows = texts.select("id", *names, "text").mapInArrow(work, "id long, " + ", ".join(f"{name} int" for name in names) + ", words binary")
    rows = rows.groupBy("id", *names).agg(F.min("words").alias("words")).collect()  # most_labelled rows
    rows = sorted(rows, key=lambda r: (xxhash.xxh64_intdigest(str(r[0])), r[0], bytes(r[-1])))
    return fit_chain([np.frombuffer(bytes(r[-1]), np.uint32) for r in rows], np.array([list(r[1:-1]) for r in rows]).reshape(len(rows), len(names)))


def score_chain(docs: DataFrame, chain: list[Link], names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<name> for each category of the chain)."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"p_{name}", pa.float64()) for name in names)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sink(schema)
        for doc, text in rows_of(batches, "doc_id", "text"):
            words, found = word_hashes(text), []
            for link in chain:
                found.append(link.probability(words, found))
            out.add((doc, *found))
            if out.full():
                yield out.take()
        yield from out.rest()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, " + ", ".join(f"p_{name} double" for name in names))
