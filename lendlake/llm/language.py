"""Language identification by nearest centroids of TF-IDF vectors of byte n-grams.

A text is its lower-cased UTF-8 bytes with every run of ASCII characters other than letters as one
blank. Runs of two and three bytes are counted into a fixed number of hashed features; counts
become 1 + log, times the feature's inverse document frequency, scaled to length 1. Each language
has several centroids, from spherical k-means over its training texts, and a text gets the language
of the centroid with the highest cosine. A text farther from its centroid than nearly all training
texts of that language are from theirs is rejected.

Document frequencies are counted over all training rows. Centroids are fitted on a bounded sample of
vectors: ``sample`` texts a language, so the number of languages alone sets the driver's share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlake.llm.shared import prefix, some_of_each, text_of

FEATURES = 1 << 14
ROWS_AT_ONCE = 256
UNKNOWN = "und"
_KEPT = np.full(256, 32, dtype=np.uint32)
_KEPT[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


@dataclass(frozen=True)
class Fit:
    """``sample``: training texts a language that centroids are fitted on. ``rejected``:
    share of those that the bound on distance leaves out."""

    sample: int = 600
    centroids: int = 4
    rounds: int = 12
    rejected: float = 0.001
    seed: int = 5


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # inverse document frequencies
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # language number of each centroid
    farthest: np.ndarray  # largest accepted distance (1 - cosine) of each language


def counts(texts: list[bytes]) -> np.ndarray:
    """Feature counts of lower-cased UTF-8 texts, one row each. Long texts are counted whole, in
    pieces that overlap by the length of an n-gram."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    piece = 1 << 20
    for i, text in enumerate(texts):
        text = b" " + text + b" "
        for at in range(0, max(1, len(text) - 2), piece):
            b = _KEPT[np.frombuffer(text[at:at + piece + 2], dtype=np.uint8)]
            b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
            two = (b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(7)
            three = ((b[:-2] * np.uint32(0xC2B2AE35) + b[1:-1] * np.uint32(0x27D4EB2F)
                      + b[2:] * np.uint32(0x165667B1)) >> np.uint32(9))
            out[i] += np.bincount(np.concatenate([two, three]) & np.uint32(FEATURES - 1),
                                  minlength=FEATURES)
    return out


def vectors(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.log1p(found) * weights
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(size > 0, size, 1)


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each feature, over all rows (text); one row a partition is summed."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = counts(_texts(batch.column(0).slice(at, ROWS_AT_ONCE)))
                total += (part > 0).sum(axis=0)
                n += len(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*range(FEATURES), -1], type=pa.int32()), pa.array([*total, n])],
            ["feature", "n"])

    sums = rows.mapInArrow(counted, "feature int, n bigint").groupBy("feature").agg(F.sum("n")).collect()
    out = np.zeros(FEATURES + 1, dtype=np.int64)
    for feature, n in sums:
        out[feature] = n
    return out[:-1], int(out[-1])


def _clustered(found: np.ndarray, fit: Fit) -> np.ndarray:
    """Centroids of spherical k-means; the first texts are chosen far from each other."""
    random = np.random.default_rng(fit.seed)
    chosen = [int(random.integers(len(found)))]
    while len(chosen) < min(fit.centroids, len(found)):
        chosen.append(int(np.argmin((found @ found[chosen].T).max(axis=1))))
    centres = found[chosen]
    for _ in range(fit.rounds):
        nearest = np.argmax(found @ centres.T, axis=1)
        sums = np.stack([found[nearest == c].sum(axis=0) if (nearest == c).any() else centres[c]
                         for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def train(docs: DataFrame, learns: Column, fit: Fit = Fit(), text_col: str = "text",
          lang_col: str = "lang") -> Model:
    """A model of the rows for which ``learns`` holds, whose language is known and whose text has a
    letter. Without such rows the model knows no language. Depends on the rows, not their order."""
    rows = docs.where(F.coalesce(learns, F.lit(False)) & F.col(lang_col).isNotNull()
                      & F.col(text_col).rlike(r"\p{L}")).select(
        F.lower(F.col(text_col)).alias("text"), F.col(lang_col).alias("lang"))
    sizes = dict(rows.groupBy("lang").count().collect())
    if not sizes:
        return Model([], np.zeros(FEATURES, np.float32), np.zeros((0, FEATURES), np.float32),
                     np.zeros(0, np.int64), np.zeros(0))
    frequency, total = _document_frequencies(rows.select("text"))
    weights = np.log((1 + total) / (1 + frequency)).astype(np.float32) + np.float32(1)
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                found = counts(_texts(part.column(0)))
                at_, value = zip(*((np.flatnonzero(x), x[x > 0]) for x in found), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array([x.astype(np.uint16).tobytes() for x in at_]),
                     pa.array([x.astype(np.float32).tobytes() for x in value])],
                    ["lang", "at", "value"])

    drawn = some_of_each(rows.select("text", "lang"), "lang", fit.sample, fit.seed).mapInArrow(
        sampled, "lang string, at binary, value binary").toPandas()
    drawn = drawn.sort_values(["lang", "at", "value"])
    languages, centroids, owner, farthest = sorted(sizes), [], [], []
    for number, lang in enumerate(languages):
        mine = drawn[drawn["lang"] == lang]
        found = np.zeros((max(1, len(mine)), FEATURES), dtype=np.float32)
        for i, (at, value) in enumerate(zip(mine["at"], mine["value"])):
            found[i, np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
        found = vectors(found, weights)
        centres = _clustered(found, fit)
        centroids.append(centres)
        owner += [number] * len(centres)
        away = 1 - (found @ centres.T).max(axis=1)
        farthest.append(float(np.quantile(away, 1 - fit.rejected)) + 0.05)
    return Model(languages, weights, np.concatenate(centroids), np.array(owner), np.array(farthest))


def identify(docs: DataFrame, model: Model, text_col: str = "text", reject: bool = True) -> DataFrame:
    """Every row of ``docs`` with lang_pred, lang_score (cosine, 0 to 1) and lang_rejected.

    ``lang_pred`` is "und" with score 0 for a null text, one without a letter, or a model without
    languages; with ``reject`` also for a text that is too far from every centroid of its language.
    Whole texts are read. Columns named like the added ones are replaced; other columns have no
    influence. An empty table gives an empty one.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    p = prefix(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by the languages

    @F.pandas_udf("lang_pred string, lang_score double, lang_rejected boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            some = batch.notna().to_numpy() & bool(model.languages)
            pred, score = np.full(len(some), UNKNOWN, dtype=object), np.zeros(len(some))
            far = np.zeros(len(some), dtype=bool)
            rows = np.flatnonzero(some)
            for at in range(0, len(rows), ROWS_AT_ONCE):
                here = rows[at:at + ROWS_AT_ONCE]
                texts = [x.encode() for x in batch.iloc[here]]
                near = vectors(counts(texts), model.weights) @ model.centroids.T
                best = near.argmax(axis=1)
                cosine = near[np.arange(len(best)), best]
                number = model.owner[best]
                score[here], far[here] = np.clip(cosine, 0, 1), 1 - cosine > model.farthest[number]
                pred[here] = np.array(model.languages, dtype=object)[number]
            if reject:
                pred[far] = UNKNOWN
            yield pd.DataFrame({"lang_pred": pred, "lang_score": score, "lang_rejected": far})

    letters = F.when(F.col(text_col).rlike(r"\p{L}"), F.lower(text_of(text_col)))
    return docs.withColumn(f"{p}found", predicted(letters)).select(
        *docs.columns, *(F.col(f"{p}found")[c].alias(c) for c in (
            "lang_pred", "lang_score", "lang_rejected")))
