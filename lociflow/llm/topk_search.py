"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors are turned into integers. Candidates are dealt into blocks, and each block is indexed by the task that gets it,
once; queries stream past the index. The index holds, for every dimension, posting segments of the candidates whose
component has the same quantised impact. A query takes the segments of all dimensions in descending order of impact and adds each segment's
bound to its candidates. At any time a candidate's score is at most what it has gathered plus, for each dimension not
met yet, the impact of the next segment; and at least what it has gathered less the quantisation error. Only
candidates whose upper bound is below the k-th best lower bound are given up. When few others are left, or no segment
is, those are scored exactly. Each query meets one block first; its k-th best score there is the bound that candidates
of all other blocks must reach. All blocks' best then meet in one ranking per query.

Edge cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part. A
query's own rows (with its id) are no candidates for it. Rows that repeat an id are candidates each; queries that
share an id share one ranking. A shorter vector counts as filled up with zeros. Ties go to the smaller id. Scores
must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lociflow.llm.common import written

SCALE = 1024
K = 10
CANDIDATE_BLOCK = 8192
#: Distinct impacts of a dimension, about.
LEVELS = 12
#: Share of all postings that a query takes between two looks at the bounds.
STEP = 1 / 12


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


class Index:
    """Posting segments of a block of candidates."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        m, d = vectors.shape
        order = np.argsort(vectors, axis=0, kind="stable")
        ranked = np.take_along_axis(vectors, order, 0)
        self.low, self.high = ranked[0], ranked[-1]
        width = np.maximum((self.high - self.low) // LEVELS + 1, 1)
        level = (ranked - self.low) // width
        self.dimension, self.begin, self.end, self.least, self.most = [], [], [], [], []
        for j in range(d):
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(level[:, j])) + 1, [m]))
            self.dimension += [j] * (len(cuts) - 1)
            self.begin += (cuts[:-1] + j * m).tolist()
            self.end += (cuts[1:] + j * m).tolist()
            self.least += ranked[cuts[:-1], j].tolist()
            self.most += ranked[cuts[1:] - 1, j].tolist()
        self.postings = np.ascontiguousarray(order.T).ravel()
        self.dimension, self.begin, self.end = np.array(self.dimension), np.array(self.begin), np.array(self.end)
        self.least, self.most = np.array(self.least), np.array(self.most)

    def possible(self, query: np.ndarray, k: int, bound: float = -np.inf) -> np.ndarray:
        """Positions of candidates that no bound keeps from the best k, nor from scores of ``bound`` and more."""
        m, d = self.vectors.shape
        if m <= 4 * k:
            return np.arange(m)
        weight = query[self.dimension]
        floor = np.minimum(query * self.low, query * self.high)
        upper = np.maximum(weight * self.least, weight * self.most) - floor[self.dimension]
        error = np.abs(weight) * (self.most - self.least)
        slack = float(_largest(self.dimension, error, d).sum())
        base = float(floor.sum())  # what every candidate has besides what is gathered
        order = np.argsort(-upper, kind="stable")
        gathered, met = np.zeros(m), np.zeros(m)
        sizes = (self.end - self.begin)[order]
        after = np.cumsum(sizes)
        at, step = 0, m * d * STEP
        left = np.arange(m)
        while at < len(order):
            to = min(len(order), int(np.searchsorted(after, (after[at - 1] if at else 0) + step)) + 1)
            part = order[at:to]
            who = np.concatenate([self.postings[a:b] for a, b in zip(self.begin[part], self.end[part], strict=True)])
            gathered += np.bincount(who, np.repeat(upper[part], sizes[at:to]).astype(float), m)
            met += np.bincount(who, minlength=m)
            at = to
            coming = float(upper[order[at]]) if at < len(order) else 0.0
            sure = max(np.partition(gathered, m - k)[m - k] - slack, bound - base)
            best = gathered + coming * (d - met)
            left = np.flatnonzero(best + np.abs(best) * 1e-9 + abs(base) * 1e-9 + 1e-6 >= sure)
            if len(left) <= 8 * k:
                break
        return left


def _largest(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, groups, values)
    return out


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v[:width]
    return out


FOUND = {"query_id": "int64", "vec_id": "int64", "score": "int64"}


def _best(names: np.ndarray, times: pd.Series, index: Index, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best of a block for each query, of those that reach its bound (not a number for none)."""
    out = [[np.zeros(0, np.int64)] * 3]
    for name, query, bound in zip(queries["vec_id"].to_numpy(), _matrix(queries["vector"], index.vectors.shape[1]), queries["bound"].to_numpy(float), strict=True):
        least = -np.inf if np.isnan(bound) else bound
        left = index.possible(query, min(k + int(times.get(name, 0)), len(names)), least)
        score = index.vectors[left] @ query
        keep = (names[left] != name) & (score >= least)
        left, score = names[left][keep], score[keep]
        top = np.lexsort((left, -score))[:k]
        out.append([np.full(len(top), name), left[top], score[top]])
    return pd.DataFrame(dict(zip(FOUND, map(np.concatenate, zip(*out, strict=True)), strict=True))).astype(FOUND)


def _met(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): what the blocks of candidates have for the queries that are dealt to them.

    A block's rows come together, candidates first: they are indexed once, then the queries stream past the index.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, index = None, [], None
        for pdf in batches:
            key = pdf[["block", "query"]].to_numpy(np.int64)
            cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(pdf)])) if len(pdf) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = pdf.iloc[a:b]
                if key[a, 0] != block:
                    block, held, index = key[a, 0], [], None
                if not key[a, 1]:
                    held.append(part)
                elif held:
                    if index is None:
                        every = pd.concat(held)
                        index = every["vec_id"].to_numpy(), every["vec_id"].value_counts(), Index(_matrix(every["vector"], max(1, every["vector"].str.len().max())))
                    yield _best(*index, part, k)

    columns = ["block", "query", "vec_id", "vector", "bound"]
    both = candidates.withColumn("bound", F.lit(None).cast("double")).withColumn("query", F.lit(False)).select(*columns)
    both = both.union(queries.withColumn("query", F.lit(True)).select(*columns))
    return both.repartition("block").sortWithinPartitions("block", "query").mapInPandas(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """The k best other rows for every row that is a query: query_id, rank (from 1), vec_id, score."""
    named = rows.where(F.col(key).isNotNull() & usable(F.col(vector)))
    named = named.select(F.col(key).cast("long").alias("vec_id"), integers(F.col(vector)).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # Written once, so that a row's block stays the same whatever is lost and computed again.
    named = written(named.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())))
    blocks = max(1, -(-named.count() // CANDIDATE_BLOCK))
    candidates = named.withColumn("block", F.pmod("deal", F.lit(blocks)))
    # Every query meets one block first; its k-th best there is the bound for all other blocks.
    first = candidates.where("asks").select("vec_id", "vector", "block").withColumn("bound", F.lit(None).cast("double"))
    seed = written(_ranked(_met(candidates, first, k), k))
    if blocks == 1:
        return seed
    bounds = written(seed.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound")))
    rest = first.drop("bound").join(bounds, "vec_id", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rest = rest.where("other != block").drop("block").withColumnRenamed("other", "block")
    return _ranked(_met(candidates, rest, k).union(seed.select(*FOUND)), k)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vector, c.vector)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
