"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed, a run of ``LEAST`` words, are compared by greedy string tiling: the
longest common runs of words that are not yet marked are found by running Karp-Rabin matching at falling search
lengths and marked, until no common run of ``LEAST`` words is left. The share of the item's words that the tiles cover
does not depend on their order, so passages that were cut up and reordered are caught. A document is contaminated if
it covers at least ``COVERAGE`` of an item.

A benchmark of up to ``HELD_WORDS`` words is held by every task, and documents are judged where they are read, without
a shuffle. A larger one is joined with the documents by seed; both ways give the same rows. The join looks an item up
by its rarest seeds only: a text that covers the asked share of an item has so many of its seeds that one of those
must be among them, so a phrase that many texts share makes no candidates. Whole texts are fetched for candidates alone.

Edge cases: words are as in ``tokens``; an item of fewer than LEAST words must occur whole; items without words match
nothing; null or empty texts are clean with coverage 0; items that are covered less than asked are not named. Of several
items the best covered is named, then the smallest id (null last), then the smallest text. Rows are judged one by one,
so repeated rows get equal results. Repeated items count once. An empty benchmark finds nothing, no documents give no
rows. Very long texts are read whole. Other columns, of whatever name, pass through ``clean`` untouched.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociflow.llm import tokens
from lociflow.llm.common import fingerprint, unused, vector_sums, written

LEAST = 5
COVERAGE = 0.5
#: Benchmark words that a task may hold, 8 bytes each and as much again for their seeds.
HELD_WORDS = 2_000_000
_FILTER = 1 << 22
#: Bits of the sieve for a benchmark that is not held.
_SIEVE = 1 << 26
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _windows(prefix: np.ndarray, powers: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of a size."""
    return prefix[size:] - prefix[:-size] * powers[size]


def _prefix(words: np.ndarray, powers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) + 1, np.uint64)
    # h[i] = sum of words[j] * base^(i - 1 - j), from sums of words times falling powers
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    falling = np.ones(len(words) + 1, np.uint64)
    falling[1:] = np.cumprod(np.full(len(words), inverse, np.uint64))
    out[1:] = np.cumsum(words * falling[1:]) * powers[1 : len(words) + 1]
    return out


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Whether each window of a size has no marked word."""
    total = np.concatenate(([0], np.cumsum(marked)))
    return total[size:] == total[:-size]


def tiles(text: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (start in text, start in item, words), none overlapping another."""
    least = max(1, min(least, len(item)))
    powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(len(text), len(item)), _BASE, np.uint64))))
    heads = _prefix(text, powers), _prefix(item, powers)
    used = np.zeros(len(text), bool), np.zeros(len(item), bool)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(32, len(item)))
    while True:
        found: list[tuple[int, int, int]] = []
        if size <= min(len(text), len(item)):
            free = _free(used[0], size), _free(used[1], size)
            at: dict[int, list[int]] = defaultdict(list)
            own = _windows(heads[1], powers, size)
            for j in np.flatnonzero(free[1]):
                at[int(own[j])].append(int(j))
            hashes = _windows(heads[0], powers, size)
            for i in np.flatnonzero(free[0] & np.isin(hashes, np.fromiter(at, np.uint64, len(at)))):
                for j in at[int(hashes[i])]:
                    if i and j and not used[0][i - 1] and not used[1][j - 1] and text[i - 1] == item[j - 1]:
                        continue  # part of the match one word earlier
                    n = 0
                    while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and not used[0][i + n] and not used[1][j + n]:
                        n += 1
                    if n >= size:
                        found.append((int(i), j, n))
        longest = max((n for _, _, n in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        marked = False
        for i, j, n in sorted(found, key=lambda m: (-m[2], m[0], m[1])):
            if not used[0][i : i + n].any() and not used[1][j : j + n].any():
                used[0][i : i + n] = used[1][j : j + n] = True
                out.append((i, j, n))
                marked = True
        if marked:
            continue  # what was only partly covered may still hold a run of this size
        if size == least:
            return out
        size = max(least, size // 2)


@dataclass
class Benchmark:
    """Items as word hashes, and for each width the seeds in ascending order with the items that have them."""

    items: list[tuple[object, np.ndarray]]
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # seed, index of item
    sieve: dict[int, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        found: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for k, (_, words) in enumerate(self.items):
            if len(words):
                width = min(LEAST, len(words))
                found[width].append((np.unique(tokens.shingles(words, width)), k))
        for width, parts in found.items():
            seeds = np.concatenate([s for s, _ in parts])
            owner = np.repeat([k for _, k in parts], [len(s) for s, _ in parts])
            order = np.argsort(seeds, kind="stable")
            self.seeds[width] = seeds[order], owner[order]
            self.sieve[width] = np.zeros(_FILTER, bool)
            self.sieve[width][(seeds & np.uint64(_FILTER - 1)).astype(np.int64)] = True

    def near(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """By item: whether each word of the text lies in a seed that it shares with the item."""
        out: dict[int, np.ndarray] = {}
        for width, (seeds, owner) in self.seeds.items():
            if len(words) < width:
                continue
            shingles = tokens.shingles(words, width)
            for at in np.flatnonzero(self.sieve[width][(shingles & np.uint64(_FILTER - 1)).astype(np.int64)]):
                a, b = np.searchsorted(seeds, shingles[at], "left"), np.searchsorted(seeds, shingles[at], "right")
                for k in owner[a:b]:
                    out.setdefault(int(k), np.zeros(len(words), bool))[at : at + width] = True
        return out

    def judge(self, words: np.ndarray, least: float) -> tuple[object, float, int]:
        """The best covered item, its covered share and the number of tiles; nothing if that share is below ``least``."""
        best: tuple[object, float, int] = (None, 0.0, 0)
        for k, inside in sorted(self.near(words).items()):
            name, item = self.items[k]
            if inside.sum() < least * len(item):
                continue  # tiles lie inside shared seeds
            share, number = coverage(words, item, inside)
            if share > best[1] and share >= least:
                best = (name, share, number)
        return best


def coverage(words: np.ndarray, item: np.ndarray, inside: np.ndarray | None = None) -> tuple[float, int]:
    """Share of the item's words that tiles cover, and their number. Words outside shared seeds cannot be in a tile."""
    if not len(item):
        return 0.0, 0
    if inside is not None:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        gap = tokens.randoms(99, len(edges) // 2)
        words = np.concatenate([np.append(words[a:b], g) for a, b, g in zip(edges[::2], edges[1::2], gap, strict=True)])
    found = tiles(words, item)
    return sum(n for _, _, n in found) / len(item), len(found)


def _hashed(texts: Sequence[str | None]) -> list[np.ndarray]:
    return [h for _, h, _, _ in tokens.each(texts)]


def positions(words: int, least: float) -> int:
    """How many seeds, at different places of an item of so many words, a text at least has that covers ``least`` of it."""
    width = min(LEAST, words)
    covered = max(width, math.ceil(least * words - 1e-9))
    return covered - covered // width * (width - 1)  # as many tiles as there can be, each a seed and more


def leaks(docs: DataFrame, benchmark: DataFrame, name: str, text: str = "text", item: str = "item_id", item_text: str = "text", least: float = COVERAGE, held_words: int = HELD_WORDS) -> DataFrame:
    """docs with one more column ``name``: struct of item (best covered, at least so much), coverage and tiles."""
    kind = benchmark.schema[item].dataType.simpleString()
    items = benchmark.select(F.col(item).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > 2 * held_words:  # a word and what separates it take two characters at least
        return _joined(docs, items, name, text, kind, least)
    rows = items.orderBy(F.asc_nulls_last("item"), "text").collect()
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark(list(zip([r[0] for r in rows], _hashed([r[1] for r in rows]), strict=True))))

    @F.pandas_udf(f"item {kind}, coverage double, tiles int")
    def judge(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.judge(words, least) for words in _hashed(texts.tolist())]
        return pd.DataFrame({"item": pd.Series([f[0] for f in found], dtype=object), "coverage": [f[1] for f in found], "tiles": [f[2] for f in found]})

    return docs.withColumn(name, judge(F.col(text)))


def _joined(docs: DataFrame, items: DataFrame, name: str, text: str, kind: str, least: float) -> DataFrame:
    # Items have a key of their own: ids may be null or repeated.
    known = written(items.withColumn("item_key", F.md5(F.to_json(F.struct("item", "text")))).where("text != ''"))

    def item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, words in zip(pdf["item_key"], _hashed(pdf["text"].tolist()), strict=True):
                if len(words):
                    width = min(LEAST, len(words))
                    seeds, times = np.unique(tokens.shingles(words, width), return_counts=True)
                    spare = len(words) - width + 1 - positions(len(words), least)
                    yield pd.DataFrame({"item_key": [key] * len(seeds), "width": np.int32(width), "seed": seeds.view(np.int64), "times": times, "spare": spare})

    theirs = written(known.mapInPandas(item_seeds, "item_key string, width int, seed bigint, times bigint, spare bigint"))

    def sieve(batches: Iterator[pd.DataFrame]) -> dict[str, np.ndarray]:
        bits = np.zeros(_SIEVE // 8, np.uint8)
        for pdf in batches:
            at = pdf["seed"].to_numpy().view(np.uint64) & np.uint64(_SIEVE - 1)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return {"": bits}

    # Of fixed size: it spares the shuffle most seeds that no item has.
    bits = docs.sparkSession.sparkContext.broadcast(vector_sums(theirs, sieve, _SIEVE // 8, np.uint8, np.bitwise_or).get("", np.zeros(_SIEVE // 8, np.uint8)))

    def seeds_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, words in zip(pdf["fp"], _hashed(pdf["text"].tolist()), strict=True):
                for width in range(1, min(LEAST, len(words)) + 1):
                    seeds = np.unique(tokens.shingles(words, width))
                    at = seeds & np.uint64(_SIEVE - 1)
                    seeds = seeds[(bits.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                    if len(seeds):
                        yield pd.DataFrame({"fp": [key] * len(seeds), "width": np.int32(width), "seed": seeds.view(np.int64)})

    texts = written(docs.select(fingerprint(F.col(text)).alias("fp"), F.col(text).alias("text")).groupBy("fp").agg(F.first("text").alias("text")))
    mine = written(texts.mapInPandas(seeds_of, "fp binary, width int, seed bigint"))
    # Of each item the rarest seeds among texts, as many as no text can do without that covers ``least`` of it.
    often = written(mine.groupBy("width", "seed").agg(F.count(F.lit(1)).alias("often")))
    order = W.partitionBy("item_key").orderBy("often", "seed").rowsBetween(W.unboundedPreceding, -1)
    ranked = theirs.join(often, ["width", "seed"], "left").withColumn("before", F.coalesce(F.sum("times").over(order), F.lit(0)))
    looked_up = written(ranked.where("before <= spare and often is not null").select("item_key", "width", "seed"))
    pairs = written(mine.join(looked_up, ["width", "seed"]).select("fp", "item_key").distinct())
    both = pairs.join(texts, "fp").join(known.select("item_key", "item", F.col("text").alias("item_text")), "item_key")

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [Benchmark([(None, b)]).judge(a, least) for a, b in zip(_hashed(pdf["text"].tolist()), _hashed(pdf["item_text"].tolist()), strict=True)]
            yield pdf[["fp", "item", "item_text"]].assign(coverage=[f[1] for f in found], tiles=[f[2] for f in found])

    judged = both.mapInPandas(tile, f"fp binary, item {kind}, item_text string, coverage double, tiles int")
    best = judged.where("coverage > 0").groupBy("fp").agg(F.min(F.struct((-F.col("coverage")).alias("c"), F.col("item").isNull().alias("none"), "item", "item_text", "coverage", "tiles")).alias("b"))
    (key,) = unused(docs, "leak_key")
    best = written(best.select(F.col("fp").alias(key), F.struct("b.item", "b.coverage", "b.tiles").alias(name)))
    none = F.struct(F.lit(None).cast(kind).alias("item"), F.lit(0.0).alias("coverage"), F.lit(0).alias("tiles"))
    out = docs.join(best, fingerprint(F.col(text)) == F.col(key), "left")
    return out.withColumn(name, F.coalesce(name, none)).drop(key)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", least: float = COVERAGE) -> DataFrame:
    """One row per row of the input: its key, contaminated, item_id, coverage and tiles (of an item covered at least so much)."""
    found = leaks(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), benchmark, "_leak", "_text", least=least)
    return found.select(F.col("_key").alias(key), (F.col("_leak.coverage") >= COVERAGE).alias("contaminated"), F.col("_leak.item").alias("item_id"), F.col("_leak.coverage").alias("coverage"), F.col("_leak.tiles").alias("tiles"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated."""
    (name,) = unused(docs, "leak")
    return leaks(docs, benchmark, name, text).where(F.col(name)["coverage"] < COVERAGE).select(*docs.columns)
