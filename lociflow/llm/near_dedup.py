"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF word shingles.

1. Each five-word shingle of a document has the weight tf * idf. Its document frequency counts families, not rows: texts
   whose smallest shingle hash is the same, as copies and most near-copies have, count once, so that a large group of
   copies does not make its own shingles look common. Families are counted over all documents by small sketches
   (HyperLogLog) in a hashed table of fixed size.
2. Improved consistent weighted sampling draws ``SAMPLES`` (shingle, level) pairs per document; two documents agree
   on a draw with the probability of their weighted Jaccard similarity. Runs of ``ROWS`` draws make the bands.
3. Documents that share a band are candidates. In each bucket the most supported document meets all others, and
   connected components of the verified links give first classes. In buckets whose other members are still of
   different classes, the members outside the largest class meet all others, in blocks of bounded size. Members of one
   class never meet again, so no link between texts of one bucket is lost and pairs become rows only if they join classes.
4. Verification compares the whole texts: weighted Jaccard similarity of at least ``SIMILARITY``. Connected components
   of all verified links are the classes.

Equal texts are one node throughout, so copies are never paired. Edge cases: null counts as the empty text; texts
without a word are near-duplicates only of equal texts; texts of fewer than five words have one shingle, all their
words; rows without an id take part, and a class's id is its smallest id, null if no member has one. Very long texts are read
whole: a task holds the shingles of the two texts that it compares. No rows give no rows; other columns, of whatever
name, pass through ``one_of_each`` untouched.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import tokens
from lociflow.llm.common import fingerprint, unused, vector_sums, written
from lociflow.llm.components import components

SIMILARITY = 0.8
ROWS, BANDS = 4, 10
SAMPLES = ROWS * BANDS
#: Entries of the table of frequencies. Shingles that share an entry add to its count by about one part in a thousand of
#: the families, at any size of the corpus; that is far below SMOOTHING.
FREQUENCIES = 1 << 20
#: Registers of the sketch in an entry, and of the one that counts all families.
REGISTERS, ALL = 8, 1 << 12
#: Share of all families that smooths the frequencies: rarer shingles than this weigh about the same.
SMOOTHING = 0.02
#: Texts in a block of a bucket; two blocks are compared at once.
BLOCK = 128
_LEVELS = 4096
_SLICE = 1 << 13


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(FREQUENCIES - 1)).astype(np.int64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(values)
    at = np.flatnonzero(np.concatenate(([True] * (len(ordered) > 0), ordered[1:] != ordered[:-1])))
    return ordered[at], np.diff(np.concatenate((at, [len(ordered)])))


def _ranked(key: int, registers: int) -> tuple[int, int]:
    """Where a hash goes in a sketch of so many registers: the register, and the rank that it has at least."""
    rest = key // registers
    return key % registers, (rest & -rest).bit_length() if rest else 64


def _estimates(sketches: np.ndarray) -> np.ndarray:
    """Numbers of different hashes that sketches (by row) have seen, with the correction for small numbers."""
    m = sketches.shape[1]
    raw = (0.7213 / (1 + 1.079 / m)) * m * m / np.ldexp(1.0, -sketches.astype(int)).sum(1)
    empty = (sketches == 0).sum(1)
    return np.where((raw <= 2.5 * m) & (empty > 0), m * np.log(m / np.maximum(empty, 1)), raw)


def frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Inverse frequencies over the families of all documents, one per table entry."""
    size = FREQUENCIES * REGISTERS + ALL

    def count(batches: Iterator[pd.DataFrame]) -> dict[str, np.ndarray]:
        seen = np.zeros(size, np.uint8)
        table, total = seen[:-ALL].reshape(FREQUENCIES, REGISTERS), seen[-ALL:]
        for pdf in batches:
            for _, hashes, _, _ in tokens.each(pdf["_text"].tolist()):
                if len(found := tokens.shingles(hashes)):
                    family = int(tokens.mix(found.min(keepdims=True))[0])
                    at, rank = _ranked(family, ALL)
                    total[at] = max(total[at], rank)
                    at, rank = _ranked(family, REGISTERS)
                    slots = _slots(found)
                    table[slots, at] = np.maximum(table[slots, at], rank)
        return {"df": seen}

    seen = vector_sums(docs.select(F.col(text).alias("_text")), count, size, np.uint8, np.maximum).get("df", np.zeros(size, np.uint8))
    total = max(float(_estimates(seen[-ALL:][None, :])[0]), 1)
    table = seen[:-ALL].reshape(FREQUENCIES, REGISTERS)
    held = np.concatenate([_estimates(part) for part in np.array_split(table, 16)])
    return np.log1p(total / (np.minimum(held, total) + SMOOTHING * total + 1)).astype(np.float32)


def weighted(hashes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's distinct shingles, ascending, and their weights."""
    return _weights(tokens.shingles(hashes), idf)


@functools.cache
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), and the fixed numbers that pick among them for each sample."""
    p = (np.arange(_LEVELS) + 0.5) / _LEVELS
    low, high = np.zeros(_LEVELS), np.full(_LEVELS, 60.0)
    for _ in range(80):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    gamma = ((low + high) / 2).astype(np.float32)
    return gamma, np.log(gamma), tokens.randoms(11, SAMPLES) | np.uint64(1)


def samples(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SAMPLES consistent samples of a weighted set, each as one 64-bit number."""
    gamma, log_gamma, factors = _draws()
    inverse = 1 / gamma
    best, what = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
    logs = np.log(weights)
    for begin in range(0, len(found), _SLICE):
        x = found[None, begin : begin + _SLICE] * factors[:, None]
        r = (x >> np.uint64(52)).astype(np.int32)
        c = ((x >> np.uint64(40)) & np.uint64(_LEVELS - 1)).astype(np.int32)
        beta = ((x >> np.uint64(20)) & np.uint64((1 << 20) - 1)).astype(np.float32) * np.float32(2**-20)
        level = np.floor(logs[None, begin : begin + _SLICE] * inverse[r] + beta)
        score = log_gamma[c] - gamma[r] * (level + 1 - beta)
        at = score.argmin(1)
        rows = np.arange(SAMPLES)
        least = score[rows, at]
        better = least < best
        best[better] = least[better]
        drawn = tokens.mix(found[begin + at] ^ level[rows, at].astype(np.int64).view(np.uint64))
        what[better] = drawn[better]
    return what


def bands(drawn: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band."""
    grid = drawn.reshape(BANDS, ROWS) * (tokens.randoms(12, ROWS) | np.uint64(1))
    return tokens.mix(grid.sum(1) + tokens.randoms(13, BANDS)).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; 0 if either set is empty."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum()) + float(b[1].sum()) - both
    return both / total if total > 0 else 0.0


def _banded(docs: DataFrame, idf: Broadcast) -> DataFrame:
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[np.ndarray | None] = [None] * len(pdf)
            for i, hashes, _, _ in tokens.each(pdf["_text"].tolist()):
                if len(hashes):
                    out[i] = bands(samples(*weighted(hashes, idf.value)))
            yield pd.DataFrame({"id": pdf["id"], "fp": pdf["fp"], "bands": out})

    kind = f"id {docs.schema['id'].dataType.simpleString()}, fp binary, bands array<bigint>"
    return docs.mapInPandas(draw, kind)


def _sets(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """(fp, grams) for the needed texts: all their shingles, ascending, repeats included, as 64-bit numbers."""

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            grams = [np.sort(tokens.shingles(h)).tobytes() for _, h, _, _ in tokens.each(pdf["text"].tolist())]
            yield pd.DataFrame({"fp": pdf["fp"], "grams": grams})

    # Joined by id as well, so that copies of one text do not meet in a task: each text's smallest id is needed alone.
    same = (texts["fp"] == needed["fp"]) & texts["id"].eqNullSafe(needed["id"])
    one = texts.join(needed, same, "left_semi").groupBy("fp").agg(F.first("text").alias("text"))
    return one.mapInPandas(shingled, "fp binary, grams binary")


def _weights(grams: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, times = _distinct(grams)
    return found, times.astype(np.float32) * idf[_slots(found)]


def _read(grams: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _weights(np.frombuffer(grams, np.uint64), idf)


def _verified(pairs: DataFrame, sets: DataFrame, idf: Broadcast) -> DataFrame:
    """The pairs (fp, rep) whose texts are similar enough."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, rep = None, None
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for i, (other, grams, rep_grams) in enumerate(zip(pdf["rep"], pdf["grams"], pdf["rep_grams"], strict=True)):
                if other != name:
                    name, rep = other, _read(rep_grams, idf.value)
                keep[i] = similarity(_read(grams, idf.value), rep) >= SIMILARITY
            yield pdf.loc[keep, ["fp", "rep"]]

    both = pairs.join(sets, "fp").join(sets.select(F.col("fp").alias("rep"), F.col("grams").alias("rep_grams")), "rep")
    return both.mapInPandas(verify, "fp binary, rep binary")


def overlaps(grams: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of every two of the multisets, which are ascending arrays of shingles."""
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    what = np.concatenate(grams)
    new = np.concatenate(([True], (what[1:] != what[:-1]) | (owner[1:] != owner[:-1])))
    turn = np.arange(len(what)) - np.maximum.accumulate(np.where(new, np.arange(len(what)), 0))
    weight = idf[_slots(what)].astype(np.float64)
    total = np.bincount(owner, weight, len(grams))
    # The k-th occurrence of a shingle is an element of its own, so that common elements add up to the smaller count.
    element = np.where(turn > 0, tokens.mix(what + turn.astype(np.uint64)), what)
    order = np.argsort(element, kind="stable")
    element, owner, weight = element[order], owner[order], weight[order]
    first = np.concatenate(([True], element[1:] != element[:-1]))
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    owner, weight, column = owner[shared], weight[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(grams), len(grams)))
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, _SLICE):
        part = (column >= begin) & (column < begin + _SLICE)
        grid = np.zeros((len(grams), _SLICE), np.float32)
        grid[owner[part], column[part] - begin] = np.sqrt(weight[part])
        common += grid @ grid.T
    return common / np.maximum(total[:, None] + total[None, :] - common, 1e-9)


def _crossing(left: DataFrame, sets: DataFrame, idf: Broadcast) -> DataFrame:
    """Links (fp, rep) between members (band, fp, class) of one bucket that are of different classes, a few for each joined class.

    Members outside a bucket's largest class meet all of its members, in blocks of about BLOCK each.
    """
    sizes = left.groupBy("band", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max(F.struct("n", "class")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"))
    parts = lambda c: F.ceil(c / BLOCK).cast("int")
    sizes = sizes.where("classes > 1").select("band", F.col("most.class").alias("largest"), parts(F.col("n")).alias("all_parts"), parts(F.col("n") - F.col("most.n")).alias("some_parts"))
    dealt = left.join(written(sizes), "band").withColumn("own", F.xxhash64("fp", "band")).withColumn("some", F.col("class") != F.col("largest"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod("own", c).cast("int")
    some = dealt.where("some").select("band", own("some_parts").alias("row"), every("all_parts").alias("col"), F.lit(True).alias("some"), "fp", "class")
    rest = dealt.select("band", every("some_parts").alias("row"), own("all_parts").alias("col"), F.lit(False).alias("some"), "fp", "class")
    dealt = written(some.union(rest)).join(sets, "fp")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = [np.frombuffer(g, np.uint64) for g in pdf["grams"]]
        near = overlaps(grams, idf.value) >= SIMILARITY - 1e-3
        kind, first = pd.factorize(pdf["class"])[0], pdf["some"].to_numpy(bool)
        boss = np.arange(kind.max() + 1)
        links = []
        for i, j in zip(*np.nonzero(near & first[:, None] & ~first[None, :] & (kind[:, None] != kind[None, :])), strict=True):
            a, b = boss[kind[i]], boss[kind[j]]
            if a != b and similarity(_weights(grams[i], idf.value), _weights(grams[j], idf.value)) >= SIMILARITY:
                boss[boss == b] = a
                links.append((pdf["fp"].iloc[i], pdf["fp"].iloc[j]))
        return pd.DataFrame(links, columns=["fp", "rep"])

    return dealt.groupBy("band", "row", "col").applyInPandas(compare, "fp binary, rep binary")


def _roots(links: DataFrame) -> DataFrame:
    return written(components(links, "fp", "rep"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of the input: its key, fp (of its text), class (the fp that stands for it), class_id (smallest key),
    class_rows and texts (different ones in its class)."""
    spark: SparkSession = docs.sparkSession
    slim = docs.select(F.col(key).alias("id"), fingerprint(F.col(text)).alias("fp"), F.col(text).alias("_text"))
    idf = spark.sparkContext.broadcast(frequencies(slim, "_text"))
    # Every aggregate that is joined on its own key is written first, so that Spark can split a hot key of the other side.
    rows = written(_banded(slim, idf))
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands")))
    buckets = nodes.select("fp", "id", F.explode("bands").alias("band"))
    sizes = written(buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = written(buckets.join(sizes, "band"))
    sets = written(_sets(slim.select("fp", "id", F.col("_text").alias("text")), members.select("fp", "id").distinct()))
    # Each bucket's most supported text meets all others.
    support = members.groupBy("fp").agg(F.sum("n").alias("support"))
    ranked = members.join(support, "fp")  # a text is in BANDS buckets at most
    star = ranked.groupBy("band").agg(F.max(F.struct("support", "fp")).alias("r")).select("band", F.col("r.fp").alias("rep"))
    met = written(members.join(written(star), "band").where("fp != rep").select("band", "fp", "rep"))
    links = written(_verified(met.select("fp", "rep").distinct(), sets, idf))
    roots = _roots(links)
    # Its others meet each other where they are still of different classes.
    left = written(met.join(roots, met["fp"] == roots["node"], "left").select("band", "fp", F.coalesce("root", "fp").alias("class")))
    more = written(_crossing(left, sets, idf))
    if not more.isEmpty():
        roots = _roots(links.union(more))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "id", "rows")
    named = written(named)
    summed = written(named.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("rows").alias("class_rows"), F.count(F.lit(1)).alias("texts")))
    by_text = written(named.select("fp", "root").join(summed, "root").withColumnRenamed("root", "class"))
    return rows.select(F.col("id").alias(key), "fp").join(by_text, "fp").select(key, "fp", "class", "class_id", "class_rows", "texts")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, one of each class: that with the smallest key (nulls last), and of its equals the first."""
    found = written(classes(docs, key, text))
    best = found.groupBy("class").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "fp")).alias("best"))
    fp, best_key, best_fp = unused(docs, "fp", "best_key", "best_fp")
    best = best.select(F.col("best.key").alias(best_key), F.col("best.fp").alias(best_fp))
    marked = docs.withColumn(fp, fingerprint(F.col(text)))
    kept = written(marked.join(best, (F.col(fp) == F.col(best_fp)) & F.col(key).eqNullSafe(F.col(best_key)), "left_semi"))
    return kept.dropDuplicates([fp, key]).select(*docs.columns)
