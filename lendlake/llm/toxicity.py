"""Toxicity by bags of subwords: averaged embeddings under a linear softmax.

A word is the mean of the embeddings of its byte n-grams and of itself, hashed into buckets, so a
misspelling shares most of its vector with the word. A passage is the mean of its words, and a
softmax over two classes reads it. Embeddings and softmax are trained jointly, in numpy, by
stochastic gradients with a step for each row. Labels are for documents, so a document is as
toxic as its most toxic passage: after a first round on passages of all kinds, each round trains
on the passage of a document that scores highest, and on others of clean documents.

The model is fitted on a bounded sample of labelled rows, of whose texts every passage is read: tasks
choose the passages of a round, so the driver holds two of a document. As the model is linear, a trained one is one
number for each bucket; a worker remembers the numbers of a bounded count of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlake.llm.encoding import ENCODERS
from lendlake.llm.shared import some_of_each, stored, text_of

# The top 18 bits of a hash.
BUCKETS = 1 << 18
WORDS = re.compile(r"\w+")
REMEMBERED_WORDS = 400_000
CHARS_AT_ONCE = 500_000
WORDS_AT_ONCE = 20_000


@dataclass(frozen=True)
class Fit:
    """``sample``: labelled documents of each class. ``words``: words of a passage."""

    sample: int = 4000
    words: int = 32
    size: int = 8
    rounds: int = 10
    rate: float = 0.5
    seed: int = 11


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # difference of the two logits for each bucket
    bias: float
    slope: float  # of the final scale, fitted on whole documents
    shift: float
    words: int


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the n-grams of 3 to 5 bytes of each word between marks, and of the word;
    and where each word's begin (one more bound at the end)."""
    ids, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for at in range(0, len(words), WORDS_AT_ONCE):
        found, n = _subwords(words[at:at + WORDS_AT_ONCE])
        ids.append(found)
        sizes.append(n)
    return np.concatenate(ids), np.cumsum(np.concatenate(sizes))


def _subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers, and how many each word has."""
    marked = [b"<%b>" % w.encode() for w in words]
    size = np.array([len(x) for x in marked], dtype=np.int64)
    data = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(begin + size, size) - np.arange(len(data))
    ids, owners = [], []
    with np.errstate(over="ignore"):
        hashed = data + np.uint64(1)
        for n in range(2, 6):
            hashed = hashed[:-1] * np.uint64(0x100000001B3) + data[n - 1:] + np.uint64(1)
            if n > 2:
                whole = left[:len(hashed)] >= n
                ids.append(hashed[whole] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46))
                owners.append(owner[:len(hashed)][whole])
        place = np.arange(len(data)) - np.repeat(begin, size)
        powers = np.multiply.accumulate(np.full(int(size.max(initial=1)), 0x100000001B3, dtype=np.uint64))
        sums = np.add.reduceat((data + np.uint64(1)) * powers[place], begin)
        ids.append(sums * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(46))
        owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(ids)[order].astype(np.int32), np.bincount(owner, minlength=len(words))


def _starts(n: int, words: int) -> np.ndarray:
    """Where passages start; the last one is as long as the others and may overlap."""
    starts = np.arange(0, max(1, n - words + 1), words)
    return starts if n <= words or starts[-1] == n - words else np.append(starts, n - words)


def drawn(rows: DataFrame, label: str, fit: Fit) -> tuple[DataFrame, float]:
    """``fit.sample`` rows of each label (all, if fewer), and the share of label 1."""
    sizes = dict(rows.groupBy(label).count().collect())
    return some_of_each(rows, label, fit.sample, fit.seed), sizes.get(1, 0) / max(1, sum(sizes.values()))


def _chosen(rows: DataFrame, model: Model, round_: int, seed: int) -> pd.DataFrame:
    """tie, label, top, other and logit of each of ``rows`` with a word: its highest passage, a
    random one, and the logit of the highest. All passages are read, in the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(shared.value)
        for batch in batches:
            out = []
            for tie, label, text in zip(batch["tie"], batch["label"], batch["text"]):
                [(words, starts, means)] = reader.passages([text])
                if words:
                    random = np.random.default_rng([seed, round_, tie % (1 << 63)])
                    places = int(starts[means.argmax()]), int(starts[random.integers(len(starts))])
                    out.append((tie, label, *(" ".join(words[i:i + reader.words]) for i in places),
                                float(means.max()) + shared.value.bias))
            yield pd.DataFrame(out, columns=["tie", "label", "top", "other", "logit"])

    found = rows.select("tie", "label", "text").mapInPandas(
        choose, "tie bigint, label int, top string, other string, logit double").toPandas()
    shared.unpersist()
    return found.sort_values(["label", "tie"], ignore_index=True)


def train(docs: DataFrame, learns: Column, label: Column, fit: Fit = Fit(),
          text_col: str = "text", share: float | None = None) -> Model:
    """A model of the rows for which ``learns`` holds, with label 0 or 1 and a text with words.

    ``share`` is the share of label 1 to expect, that of the labelled rows if it is not given. Rows
    with a null label or text teach nothing. Without rows of both classes every text gets
    the share of label 1 among those there are, or 0.5. Depends on the rows, not their order.
    """
    rows = docs.where(F.coalesce(learns, F.lit(False)) & label.isin(0, 1)
                      & F.col(text_col).isNotNull()).select(
        label.cast("int").alias("label"), F.lower(F.col(text_col)).alias("text"))
    rows, seen_share = drawn(rows, "label", fit)
    share = seen_share if share is None else share
    rows = stored(rows.withColumn("tie", F.xxhash64("text")), "toxicity-sample")
    random = np.random.default_rng(fit.seed)
    vectors = random.uniform(-0.1, 0.1, (BUCKETS, fit.size)).astype(np.float32) / fit.size
    softmax = np.zeros((fit.size + 1, 2), dtype=np.float32)  # the last row is the bias
    seen, seen_softmax = np.full(BUCKETS, 1e-6, dtype=np.float32), np.full_like(softmax, 1e-6)

    def current() -> Model:
        direction = softmax[:-1, 1] - softmax[:-1, 0]
        return Model((vectors @ direction).astype(np.float64),
                     float(softmax[-1, 1] - softmax[-1, 0]), 1.0, 0.0, fit.words)

    chosen = _chosen(rows, current(), 0, fit.seed)
    labels = chosen["label"].to_numpy()
    if len(set(labels)) < 2:
        shift = float(np.where(labels.mean() > 0.5, 5.0, -5.0)) if len(labels) else 0.0
        return Model(np.zeros(BUCKETS), 0.0, 1.0, shift, fit.words)
    def spelled(ids: np.ndarray, bounds: np.ndarray, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of the passages, the passage each belongs to, and its weight there."""
        flat, lengths = np.concatenate(passages), np.diff(bounds)
        sizes = np.array([len(p) for p in passages])
        n = lengths[flat]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return (ids[np.repeat(bounds[flat], n) + within],
                np.repeat(np.repeat(np.arange(len(passages)), sizes), n),
                np.repeat(1.0 / (np.repeat(sizes, sizes) * n), n).astype(np.float32))

    def step(ids: np.ndarray, bounds: np.ndarray, passages: list[np.ndarray], y: np.ndarray,
             rate: float) -> None:
        bucket, owner, weight = spelled(ids, bounds, passages)
        rows_, inverse = np.unique(bucket, return_inverse=True)
        bag = np.zeros((len(passages), len(rows_)), dtype=np.float32)
        np.add.at(bag, (owner, inverse), weight)
        mean = np.concatenate([bag @ vectors[rows_], np.ones((len(y), 1), np.float32)], axis=1)
        logits = mean @ softmax
        logits -= logits.max(axis=1, keepdims=True)
        wrong = np.exp(logits)
        wrong /= wrong.sum(axis=1, keepdims=True)
        wrong[np.arange(len(y)), y] -= 1
        wrong /= len(y)
        down = bag.T @ (wrong @ softmax[:-1].T)
        up = mean.T @ wrong
        seen[rows_] += (down * down).mean(axis=1)
        vectors[rows_] -= rate * down / np.sqrt(seen[rows_])[:, None]
        seen_softmax[:] += up * up
        softmax[:] -= rate * up / np.sqrt(seen_softmax)

    classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    for round_ in range(fit.rounds):
        if round_:
            chosen = _chosen(rows, current(), round_, fit.seed)
        known: dict[str, int] = {}
        tops, others = ([np.array([known.setdefault(w, len(known)) for w in p.split(" ")], np.int32)
                         for p in chosen[side]] for side in ("top", "other"))
        ids, bounds = subwords(list(known))
        pool: list[tuple[np.ndarray, int]] = []
        for c, members in enumerate(classes):
            for i in random.permutation(members):
                pool.append((tops[i] if round_ else others[i], c))
                if not c:
                    pool.append((others[i], 0))
        order = random.permutation(len(pool))
        for at in range(0, len(order), 32):
            part = [pool[k] for k in order[at:at + 32]]
            step(ids, bounds, [p for p, _ in part], np.array([y for _, y in part]),
                 fit.rate * (1 - round_ / fit.rounds))
    vectors[seen <= 1e-6] = 0  # what training never met says nothing
    model = current()
    slope, shift = _scaled(_chosen(rows, model, fit.rounds, fit.seed)["logit"].to_numpy(), labels, share)
    return Model(model.buckets, model.bias, slope, shift, fit.words)


def _scaled(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Logistic slope and shift of labels on the highest logits, by Newton's method with a little
    shrinkage, classes weighed as among all labelled rows."""
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    centre, width = x.mean(), x.std() + 1e-9
    design = np.stack([(x - centre) / width, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 1e-4 * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        beta -= np.linalg.solve(curve, gradient)
    slope = float(beta[0] / width)
    return slope, float(beta[1] - slope * centre)


class _Reader:
    """Scores texts in a worker."""

    def __init__(self, model: Model) -> None:
        ENCODERS.clear()  # the worker may have kept them since an earlier job
        self._model = model
        self._known: dict[str, float] = {}

    @property
    def words(self) -> int:
        return self._model.words

    def passages(self, texts: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """The words of each text, where its passages start, and the mean of each passage."""
        model, known = self._model, self._known
        found = [WORDS.findall(t) for t in texts]
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        new = list(set().union(*found).difference(known)) if found else []
        if new:
            ids, bounds = subwords(new)
            known.update(zip(new, (np.add.reduceat(model.buckets[ids], bounds[:-1])
                                   / np.diff(bounds)).tolist(), strict=True))
        out = []
        for words in found:
            n = len(words)
            sums = np.concatenate([[0.0], np.cumsum(np.fromiter(
                map(known.__getitem__, words), dtype=np.float64, count=n))])
            starts = _starts(n, model.words)
            ends = np.minimum(starts + model.words, n)
            out.append((words, starts, (sums[ends] - sums[starts]) / np.maximum(ends - starts, 1)))
        return out

    def logits(self, texts: list[str]) -> list[float]:
        return [float(means.max()) + self._model.bias for _, _, means in self.passages(texts)]


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with toxicity (0 to 1, higher: label 1 likelier).

    Whole texts are read. A null or empty text, or one without words, has the score of the bias
    alone. Columns named like the added one are replaced; other columns have no influence. An empty
    table gives an empty one.
    """
    docs = docs.drop("toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 numbers

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        reader = _Reader(model)
        for batch in batches:
            out: list[float] = []
            part: list[str] = []
            held = 0
            for text in batch:
                part.append(text)
                held += len(text)
                if held > CHARS_AT_ONCE:
                    out += reader.logits(part)
                    part, held = [], 0
            out += reader.logits(part)
            scale = np.clip(np.array(out) * model.slope + model.shift, -40, 40)
            yield pd.Series(1 / (1 + np.exp(-scale)))

    return docs.withColumn("toxicity", scored(F.lower(text_of(text_col))))
