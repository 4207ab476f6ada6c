"""Document quality from random-indexing word vectors and a two-layer network with calibrated probabilities.

A text is a sequence of units: words (case ignored) and runs of symbols. Beside each stands a mark of its shape: how
it is capitalised, whether it holds digits, whether it repeats the word before. Every unit and mark has a sparse random
index vector; a unit's vector is the sum of the index vectors of the units around it and of its own mark, gathered
over all texts, labelled or not. A text is pooled to the mean of its units' vectors, the mean of its marks' vectors and
its length. The network is trained on the driver with numpy, on a sample of pooled texts that is bounded exactly (the
labelled ids of smallest hash, one text each), and its logits are divided by a temperature that a held-back part of the
sample chooses; labels count as slightly uncertain there, so that a few texts that are all right don't sharpen it.

Edge cases: null counts as the empty text; a text without units is pooled to zeros and scored like any other. Without
any label, or with labels of one kind alone, every score is the share of that label (0.5 for none). A document that
carries several labels counts as good if one of them is 1; of several texts with one id the fit takes that of the
smallest hash. Very long texts are read whole. Rows are judged one by one, so repeated rows get equal
results and other columns play no part; no rows give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.llm import tokens
from lociflow.llm.common import fingerprint, sampled, vector_sums, written

#: Labelled documents that a fit uses, at most.
FIT_DOCUMENTS = 8000
THRESHOLD = 0.7
WORDS, SYMBOLS, MARKS = 1 << 14, 1 << 10, 16
UNITS = WORDS + SYMBOLS + MARKS
DIMENSIONS, NONZERO, AROUND = 64, 4, 2
HIDDEN = 32
#: Temperatures that are tried: below 1 for a network that is too unsure, above for one that is too sure.
TEMPERATURES = np.geomspace(1 / 8, 8, 121)
#: Characters of texts whose contexts are gathered together.
BLOCK = 1_000_000


@functools.cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 white space, 1 word, 2 symbol; bits: 1 upper case, 2 lower case, 4 digit."""
    kind = tokens.by_character(lambda c: 1 if c.isalnum() else 0 if c.isspace() else 2, np.int8)
    return kind, tokens.by_character(lambda c: c.isupper() + 2 * c.islower() + 4 * c.isdigit(), np.int8)


@functools.cache
def _index() -> np.ndarray:
    """Sparse random index vectors: a few entries of 1 or -1 each."""
    rng, out = np.random.default_rng(5), np.zeros((UNITS, DIMENSIONS), np.float32)
    for row in out:
        row[rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


@functools.cache
def _entries() -> tuple[np.ndarray, np.ndarray]:
    """Where the index vectors' entries stand, and their signs."""
    at = np.argsort(_index() == 0, axis=1, kind="stable")[:, :NONZERO]
    return at, np.take_along_axis(_index(), at, 1).astype(np.float64)


def _blocks(texts: Sequence[str | None], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """Of each block of texts: units, their marks, where each text's begin, and the texts' numbers of characters."""
    kinds, bits = _kinds()
    numbers = tokens._characters()[1]
    for a, b in tokens.blocks(texts, limit):
        some = [t or "" for t in texts[a:b]]
        points = np.frombuffer("\n".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in some])))
        kind = kinds[points]
        starts = np.flatnonzero(np.diff(kind, prepend=0))
        starts = starts[kind[starts] > 0]
        if not len(starts):
            yield np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(some) + 1, np.int64), list(map(len, some))
            continue
        ends = np.flatnonzero(np.diff(kind, append=0)) + 1
        ends = ends[kind[ends - 1] > 0]
        size = ends - starts
        cover = kind > 0
        head = np.concatenate(([0], np.cumsum(size)[:-1]))
        offset = np.arange(size.sum()) - np.repeat(head, size)
        value = tokens.mix(np.add.reduceat(numbers[points[cover]] * tokens._PLACES[offset % len(tokens._PLACES)], head))
        case = np.bitwise_or.reduceat(bits[points[cover]], head)
        word = kind[starts] == 1
        unit = np.where(word, value % np.uint64(WORDS), np.uint64(WORDS) + value % np.uint64(SYMBOLS)).astype(np.int64)
        first_upper = bits[points[starts]] & 1
        bound = np.searchsorted(starts, begins)
        owner = np.repeat(np.arange(len(some)), np.diff(bound))
        again = np.zeros(len(starts), bool)
        at = np.flatnonzero(word)
        again[at[1:]] = (value[at[1:]] == value[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])
        # 0..7 by what cases and digits a word has (capitalised words look like lower case ones but for their first letter)
        shape = np.where((case == 3) & (first_upper == 1), 7, case & 7)
        mark = WORDS + SYMBOLS + np.where(again, 8, np.where(word, shape, 9 + np.minimum(size - 1, 3)))
        yield unit, mark, bound, list(map(len, some))


def units(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of each text: its units, their marks and its number of characters."""
    for unit, mark, bound, sizes in _blocks(texts, tokens.BLOCK_CHARS):
        for i, n in enumerate(sizes):
            yield unit[bound[i] : bound[i + 1]], mark[bound[i] : bound[i + 1]], n


def contexts(texts: Sequence[str | None]) -> np.ndarray:
    """Sums of the index vectors around each unit, UNITS x DIMENSIONS, flat."""
    total, (at, sign) = np.zeros(UNITS * DIMENSIONS), _entries()
    for unit, mark, bound, _ in _blocks(texts, BLOCK):
        owner = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
        meets = [(unit, mark), (mark, unit)]
        for k in range(1, AROUND + 1):
            same = owner[k:] == owner[:-k]
            left, right = unit[:-k][same], unit[k:][same]
            meets += [(left, right), (right, left)]
        for to, what in meets:
            if len(to):
                total += np.bincount((to[:, None] * DIMENSIONS + at[what]).ravel(), sign[what].ravel(), len(total))
    return total


def pooled(texts: Sequence[str | None], vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), 2 * DIMENSIONS + 1), np.float32)
    for i, (unit, mark, size) in enumerate(units(texts)):
        out[i, -1] = np.log1p(size)
        if len(unit):
            out[i, :DIMENSIONS] = vectors[unit].mean(0)
            out[i, DIMENSIONS:-1] = np.bincount(mark - WORDS - SYMBOLS, minlength=MARKS) @ vectors[WORDS + SYMBOLS :] / len(mark)
    return out


@dataclass
class Network:
    """Two layers over standardised features; ``share`` alone speaks where there was nothing to learn."""

    mean: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None
    temperature: float
    share: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((features - self.mean) / self.spread @ w1 + b1, 0) @ w2 + b2

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(features), self.share)
        # One by one: in a product of many rows the last digit depends on a row's place, and equal texts score alike.
        logits = np.array([self.logits(row)[0] for row in features[:, None]])
        return 1 / (1 + np.exp(-np.clip(logits / self.temperature, -40, 40)))


def calibrated(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature at which logits predict labels best. Labels are uncertain by as much as their number leaves open."""
    y = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    losses = [np.mean(np.logaddexp(0, -logits / t) * y + np.logaddexp(0, logits / t) * (1 - y)) for t in TEMPERATURES]
    return float(TEMPERATURES[int(np.argmin(losses))])


def train(features: np.ndarray, labels: np.ndarray, held: np.ndarray, epochs: int = 60, batch: int = 256) -> Network:
    """Fit on the rows that aren't held; choose the temperature on those that are."""
    mean, spread = features.mean(0) if len(features) else np.zeros(1), features.std(0) + 1e-3 if len(features) else np.ones(1)
    share = float(labels.mean()) if len(labels) else 0.5
    fit = np.flatnonzero(~held)
    if len(np.unique(labels[fit])) < 2:
        return Network(mean, spread, None, 1.0, share)
    rng = np.random.default_rng(3)
    x, y = (features[fit] - mean) / spread, labels[fit].astype(float)
    w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            hidden = np.maximum(x[rows] @ w[0] + w[1], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, w[2]) * (hidden > 0)
            t += 1
            for i, g in enumerate((x[rows].T @ back + 1e-4 * w[0], back.sum(0), hidden.T @ error + 1e-4 * w[2], np.array([error.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, spread, (w[0], w[1], w[2], float(w[3][0])), 1.0, share)
    judge = np.flatnonzero(held)
    if len(judge):
        net.temperature = calibrated(net.logits(features[judge]), labels[judge])
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", documents: int = FIT_DOCUMENTS) -> Model:
    """Learn from the documents that have a label, from ``documents`` of them at most."""
    named = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.lit(0).alias("all"), F.col(key).alias("id"), F.col(label).alias("label"))
    # The sample's bound is a parameter, so its ids and labels may go to every task.
    chosen = sampled(named, "all", "id", documents, label=F.max("label")).drop("all")
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    sample = slim.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("label").alias("label"), F.min(F.struct(fingerprint(F.col("text")), "text"))["text"].alias("text"))
    sample = written(sample.withColumn("held", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0))

    def count(batches: Iterator[pd.DataFrame]) -> dict[str, np.ndarray]:
        total = np.zeros(UNITS * DIMENSIONS)
        for pdf in batches:
            total += contexts(pdf["text"].tolist())
        return {"": total}

    sums = vector_sums(slim.select("text"), count, UNITS * DIMENSIONS).get("", np.zeros(UNITS * DIMENSIONS)).reshape(UNITS, DIMENSIONS)
    vectors = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"].astype(str), "pooled": list(pooled(pdf["text"].tolist(), shared.value)), "label": pdf["label"].astype("int32"), "held": pdf["held"]})

    rows = sample.mapInPandas(pool, "id string, pooled array<float>, label int, held boolean").toPandas().sort_values("id", kind="stable")
    features = np.array(rows["pooled"].tolist(), np.float64).reshape(len(rows), 2 * DIMENSIONS + 1)
    return Model(vectors, train(features, (rows["label"].to_numpy() == 1).astype(int), rows["held"].to_numpy(bool)))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of the input: its key and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.network.score(pooled(texts.tolist(), shared.value.vectors)), dtype=float)

    return docs.select(F.col(key), F.col(text).alias("_text")).select(key, judge("_text").alias("score"))
