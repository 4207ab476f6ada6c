"""Whitening of embeddings by principal components, fitted by hierarchical SVD merging.

Each task turns the vectors that it meets into a state: their number, mean, singular values and right singular vectors,
all of them (none is cut off). Two states merge without loss: the scaled singular vectors of both, and one row that
corrects for the difference of their means, are decomposed again. Tasks merge their batches as they come; then states meet
in groups of FAN until one is left, which is the state of all vectors. Its squared singular values over the number are
the eigenvalues of the covariance. No covariance matrix is ever formed, so small eigenvalues keep their digits.

On Spark: the fit list is the distinct vectors (a shuffle, combined before it, so a vector that many rows share is no hot
key), written. A state holds d x d numbers for d dimensions, whatever the number of vectors; a task holds FAN of them. The
last state alone comes to the driver and goes to the tasks that project the rows. The covariance of the
result is measured over the fit list by Spark's own centred aggregates.

Edge cases: rows whose vector is null, or holds null or non-finite entries, are dropped. Vectors shorter than the longest
count as filled up with zeros. A row without an id keeps its null; repeated rows give their rows each, and the fit takes
their vector once. Components are at most as many as dimensions. A component without variance (a table of one distinct
vector, dimensions that repeat others) is whitened to 0 and explains 0, and takes no part in the identity error, which
is 0 where no component has variance. A deviation that does not fit a long is null. Empty table: no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import written
from lociflow.llm.topk_search import usable

SCALE = 256
COMPONENTS = 4
#: States that one task merges.
FAN = 16
#: Singular values at or below this share of the largest, times the dimensions, are rounding errors.
ROUNDING = 1e-14


@dataclass
class State:
    """What a set of vectors comes to: ``total`` holds exact sums, ``vectors`` rows that go with the singular ``values``."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> State:
        exact = x if len(x) * float(np.abs(x).max(initial=0)) < 2**62 else x.astype(object)
        total = [int(t) for t in exact.sum(0)]
        return cls(len(x), total, *_svd(x - _mean(total, len(x))))

    @property
    def mean(self) -> np.ndarray:
        return _mean(self.total, self.n)

    def merged(self, other: State) -> State:
        n = self.n + other.n
        # What the vectors' scatter around their own means lacks of that around the common one.
        between = np.sqrt(self.n) * np.sqrt(other.n / n) * (self.mean - other.mean)
        stacked = np.vstack([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, between])
        return State(n, [a + b for a, b in zip(self.total, other.total, strict=True)], *_svd(stacked))


def _mean(total: list[int], n: int) -> np.ndarray:
    return np.array([t / n for t in total])


def _svd(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


def _all(states: Iterator[State]) -> State | None:
    out = None
    for state in states:
        out = out.merged(state) if out else state
    return out


STATE = "place long, n long, total array<decimal(38,0)>, size array<double>, direction array<double>"


def _packed(place: int, state: State) -> pd.DataFrame:
    return pd.DataFrame({"place": [place], "n": [state.n], "total": [[Decimal(t) for t in state.total]], "size": [state.values], "direction": [state.vectors.ravel()]})


def _unpacked(row: object) -> State:
    return State(int(row.n), [int(t) for t in row.total], np.array(row.size), np.array(row.direction, float).reshape(len(row.size), len(row.total)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def fit(vectors: DataFrame) -> State | None:
    """The state of all rows of (x), vectors of one length; None where there are none."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _all(State.of(_matrix(b)) for b in batches if b.num_rows)
        if state:
            types = [pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64())]
            pdf = _packed(TaskContext.get().partitionId(), state)
            yield pa.record_batch([pa.array(pdf[n].tolist(), t) for n, t in zip(pdf, types, strict=True)], list(pdf))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("place").itertuples()
        return _packed(int(pdf["place"].min()), _all(_unpacked(r) for r in rows))

    states = written(vectors.mapInArrow(begin, STATE))
    last, fan = states.agg(F.max("place")).first()[0] or 0, 1
    while fan <= last:
        fan *= FAN
        states = written(states.groupBy(F.floor(F.col("place") / fan)).applyInPandas(merge, STATE))
    row = states.first()
    return _unpacked(row) if row else None


def components(state: State, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of the k largest eigenvalues; 0 for those that are rounding errors."""
    d = len(state.total)
    values, vectors = np.zeros(d), np.zeros((d, d))
    values[: len(state.values)], vectors[: len(state.values)] = state.values, state.vectors
    values[values <= values.max(initial=0) * d * ROUNDING] = 0
    return values[:k] ** 2 / state.n, vectors[:k]


def _projected(x: np.ndarray, state: State, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    scale = np.divide(1, np.sqrt(values), out=np.zeros_like(values), where=values > 0)
    return (x - state.mean) @ (vectors * scale[:, None]).T


def _deviations(x: np.ndarray, state: State) -> list[int | None]:
    """Squared distances from the mean, times the squared number of vectors, exact."""
    n, total = state.n, np.array(state.total, dtype=object)
    if (n * int(np.abs(x).max(initial=0)) + max(map(abs, state.total), default=0)) ** 2 * x.shape[1] < 1 << 63:
        return ((n * x - total.astype(np.int64)) ** 2).sum(1).tolist()
    exact = ((n * x.astype(object) - total) ** 2).sum(1)
    return [v if v < 1 << 63 else None for v in exact]


def whitened(vectors: DataFrame, state: State, k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, deviation, whitened) for the rows of (vec_id, x), a row for each component."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    values, directions = components(state, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, c = _matrix(batch), len(values)
                rows = pa.array(np.repeat(np.arange(len(x)), c))
                found = pa.array(_projected(x, state, values, directions).ravel())
                deviation = pa.array(_deviations(x, state), pa.int64()).take(rows)
                yield pa.record_batch([batch.column("vec_id").take(rows), pa.array(np.tile(np.arange(1, c + 1), len(x)), pa.int32()), deviation, found], ["vec_id", "component", "deviation", "whitened"])

    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, deviation long, whitened double")


def identity_error(vectors: DataFrame, state: State, k: int = COMPONENTS) -> float:
    """The largest entry, in size, of the whitened vectors' covariance less the identity, over the rows of (x)."""
    values, directions = components(state, k)
    values, directions = values[values > 0], directions[values > 0]
    if not len(values):
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _projected(_matrix(batch), state, values, directions)
                yield pa.record_batch([pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(values))], [f"w{i}" for i in range(len(values))])

    pairs = list(combinations_with_replacement(range(len(values)), 2))
    rows = vectors.select("x").mapInArrow(run, ", ".join(f"w{i} double" for i in range(len(values))))
    found = rows.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))


def _filled(x: Column, width: int) -> Column:
    return F.when(F.size(x) < width, F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))).otherwise(x)


def whiten(rows: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n (distinct vectors), deviation, whitened, explained
    (the component's share of all variance) and identity_error (of the whole result)."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    kept = rows.where(usable(F.col(vector))).select("vec_id", x.alias("x"))
    width = kept.agg(F.max(F.size("x"))).first()[0]
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not width:  # no vectors, or none with an entry: no components
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    kept = kept.select("vec_id", _filled(F.col("x"), width).alias("x"))
    once = written(kept.select("x").distinct())
    state = fit(once)
    values, _ = components(state, k)
    every = float((state.values**2).sum()) / state.n
    shares = F.array(*[F.lit(float(v / every) if every else 0.0) for v in values])
    error = identity_error(once, state, k)
    found = whitened(kept, state, k)
    return found.select("vec_id", "component", F.lit(state.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"))
