"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of the code splits the languages in two, and one binary character n-gram
classifier predicts that bit. Decoding sums, over the bits, an exponential loss of the classifier's margin against
each codeword, weighted by the bit's reliability, and takes the nearest codeword. A bit's reliability is how often its
classifier, fitted without them, is right on texts held back from the sample. A text whose two nearest codewords are
about as near is flagged ambiguous.

The sample of a fit is bounded exactly: of each language the texts of smallest hash, every text once, however many copies
it has and however many rows there are.

Edge cases: a null text, or one without a letter, is ``und`` with score 0. Without any labelled row every text is
``und``. Very long texts are read whole, in time in line with their length. Rows are judged one by one, so repeated
rows get equal results; other columns, of whatever name, play no part; no rows give no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.common import fingerprint, sampled, vector_sums, written
from lociflow.llm.tokens import by_character

UNKNOWN = "und"
#: Different labelled texts per language that a fit uses, at most.
FIT_ROWS_PER_LANGUAGE = 4000
#: Columns of the n-gram table, a power of two.
BUCKETS = 1 << 16
#: N-gram lengths.
ORDERS = (1, 2, 3)
#: Probabilities closer than this make a text ambiguous.
AMBIGUOUS = 0.2
#: Share of the sample (one in so many texts) that is held back to measure the bits' reliability, and the least that a bit gets.
HELD, LEAST_TRUST = 5, 0.05
#: Characters of texts that are looked at together, and n-grams of one long text.
BLOCK = 1 << 16

RESULT = "lang_pred string, score double, ambiguous boolean, runner_up string"


@functools.cache
def _lower() -> np.ndarray:
    """Lower-case code point of every code point; 0 for what is not a letter."""
    return by_character(lambda c: (ord(x) if len(x := c.lower()) == 1 else ord(c)) if c.isalpha() else 0, np.uint32)


def _blocks(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK characters; a longer text is alone, so that its sums do not depend on others."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "") + 2
        if held and held + size > BLOCK:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)


def grams(texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """By block of texts: its first text, which of its texts hold letters and, for every order, the hashed letter n-grams
    of all its texts with the place where each text's begin. Runs of anything but letters count as one blank."""
    for a, b in _blocks(texts):
        some = [f"\n{t or ''}\n" for t in texts[a:b]]
        points = _lower()[np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(b - a), list(map(len, some)))
        letters = np.bincount(owner, points > 0, b - a) > 0
        keep = (points[1:] != 0) | (points[:-1] != 0) | (owner[1:] != owner[:-1])
        keep = np.concatenate(([True], keep))
        points, owner = points[keep].astype(np.uint64), owner[keep]
        found = []
        for n in ORDERS:
            size = len(points) - n + 1
            code = np.zeros(max(size, 0), np.uint16)
            for at in range(0, size, 1 << 20):
                part = np.full(min(1 << 20, size - at), n, np.uint64)
                for k in range(n):
                    part = (part ^ points[at + k : at + k + len(part)]) * np.uint64(0x9E3779B97F4A7C15)
                code[at : at + len(part)] = part >> np.uint64(48)
            whole = owner[n - 1 :] == owner[: max(size, 0)]
            found.append((code[whole], np.searchsorted(owner[: max(size, 0)][whole], np.arange(b - a + 1))))
        yield a, letters, found


def _summed(table: np.ndarray, code: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """By text: the sum of its n-grams' rows of the table."""
    out = np.zeros((len(begin) - 1, table.shape[1]))
    if len(out) == 1:
        for at in range(0, len(code), BLOCK):
            out[0] += table[code[at : at + BLOCK]].sum(0, dtype=np.float64)
    else:
        some = np.flatnonzero(begin[1:] > begin[:-1])
        if len(some):
            out[some] = np.add.reduceat(table[code], begin[some], axis=0, dtype=np.float64)
    return out


def code_matrix(n: int) -> np.ndarray:
    """Codewords of n languages as rows of -1 and 1: every split for up to 6 languages, else the best of seeded random codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 6:
        columns = [[1 if i == 0 or not (split >> (i - 1)) & 1 else -1 for i in range(n)] for split in range(1, 1 << (n - 1))]
        return np.array(columns, float).T
    bits = math.ceil(10 * math.log2(n))
    rng, best, distance = np.random.default_rng(7), None, -1.0
    for _ in range(200):
        code = np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0)
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if (np.abs(code.sum(0)) < n).all() and apart.min() > distance:
            best, distance = code, apart.min()
    return best if best is not None else np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: log odds of an n-gram for the bit
    scale: np.ndarray  # by bit: what turns a mean log odds into a margin of about 1
    trust: np.ndarray  # by bit: weight in decoding, adding up to 1
    sharpness: float = 4.0

    def margins(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, whether it holds letters, and the margin of every bit."""
        letters, out = np.zeros(len(texts), bool), np.zeros((len(texts), self.code.shape[1]))
        for a, some, found in grams(texts):
            total = sum(_summed(self.weights, code, begin) for code, begin in found)
            number = sum(np.diff(begin) for _, begin in found)
            letters[a : a + len(some)] = some
            out[a : a + len(some)] = total / np.maximum(number, 1)[:, None] / self.scale
        return letters, out

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        """Of each language, by text: from the losses of the bits' margins against its codeword."""
        loss = np.einsum("tlb,b->tl", np.exp(-np.clip(margins, -3, 3)[:, None, :] * self.code[None]), self.trust)
        odds = np.exp(-self.sharpness * (loss - loss.min(1, keepdims=True)))
        return odds / odds.sum(1, keepdims=True)

    def decide(self, texts: Sequence[str | None]) -> list[tuple[str, float, bool, str | None]]:
        nothing = (UNKNOWN, 0.0, False, None)
        if not self.languages or not len(texts):
            return [nothing] * len(texts)
        letters, margins = self.margins(texts)
        out = []
        for held, p in zip(letters, self.probabilities(margins), strict=True):
            order = np.argsort(-p, kind="stable")
            second = self.languages[order[1]] if len(order) > 1 else None
            near = len(order) > 1 and p[order[0]] - p[order[1]] < AMBIGUOUS
            out.append((self.languages[order[0]], float(p[order[0]]), bool(near), second) if held else nothing)
        return out


def fit(rows: DataFrame, text: str = "text", language: str = "lang", per_language: int = FIT_ROWS_PER_LANGUAGE) -> Model:
    """Learn from rows that have a language, from ``per_language`` different texts of each at most."""
    labelled = rows.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(language).alias("lang")).withColumn("fp", fingerprint(F.col("text")))
    sample = written(sampled(labelled, "lang", "fp", per_language, text=F.first("text")).withColumn("held", F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(HELD)) == 0))

    def count(batches: Iterator[pd.DataFrame]) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for pdf in batches:
            keys = ("01"[int(h)] + x for h, x in zip(pdf["held"], pdf["lang"], strict=True))
            keys = np.array(list(keys), object)
            for a, letters, found in grams(pdf["text"].tolist()):
                number = sum(np.diff(begin) for _, begin in found)
                for i in np.flatnonzero(letters):
                    into = out.setdefault(keys[a + i], np.zeros(BUCKETS + 1))
                    into[-1] += 1
                    for code, begin in found:  # each text counts alike, however long
                        np.add.at(into, code[begin[i] : begin[i + 1]], 1 / number[i])
        return out

    sums = vector_sums(sample, count, BUCKETS + 1)
    languages = {k[1:] for k in sums}
    by_part = [{x: sums.get(f"{part}{x}", np.zeros(BUCKETS + 1)) for x in languages} for part in "01"]
    model = from_counts({x: by_part[0][x] + by_part[1][x] for x in languages})
    if languages:
        trial = from_counts(by_part[0])
        shared = rows.sparkSession.sparkContext.broadcast(trial)

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                letters, margins = shared.value.margins(pdf["text"].tolist())
                pdf, margins = pdf[letters], margins[letters]
                want = shared.value.code[[shared.value.languages.index(x) for x in pdf["lang"]]]
                yield pd.DataFrame({"bit": np.arange(want.shape[1]), "right": (margins * want > 0).sum(0), "n": len(pdf)})

        judged = sample.where("held").mapInPandas(judge, "bit int, right bigint, n bigint").groupBy("bit").agg(F.sum("right").alias("right"), F.sum("n").alias("n"))
        model.trust = reliability({r["bit"]: (r["right"], r["n"]) for r in judged.collect()}, model.code.shape[1])
    return model


def reliability(judged: dict[int, tuple[int, int]], bits: int) -> np.ndarray:
    """Weights of the bits, adding up to 1, from how many of how many texts each was right on: in proportion to what it
    is right beyond chance."""
    right, n = (np.array([judged.get(b, (0, 0))[i] for b in range(bits)], float) for i in (0, 1))
    trust = np.maximum(2 * (right + 1) / (n + 2) - 1, LEAST_TRUST)
    return trust / trust.sum()


def from_counts(sums: dict[str, np.ndarray]) -> Model:
    """The bit classifiers from each language's summed n-gram shares (and, last, its number of texts)."""
    languages = sorted(sums)
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.ones(1), np.ones(1))
    shares = np.array([sums[x][:-1] / max(sums[x][-1], 1) for x in languages]) + 1e-6
    shares /= shares.sum(1, keepdims=True)
    code = code_matrix(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]))
    for bit in range(code.shape[1]):
        yes, no = (shares[code[:, bit] == side] for side in (1, -1))
        if len(yes) and len(no):
            weights[:, bit] = np.log(yes.mean(0)) - np.log(no.mean(0))
    # The mean margin of each language's own n-grams tells how far a bit separates the languages.
    scale = np.maximum(np.abs(shares @ weights).mean(0), 1e-9)
    return Model(languages, code, weights.astype(np.float32), scale, np.full(code.shape[1], 1 / code.shape[1]))


def predicted(model: Model, text: Column) -> Column:
    """The prediction for a text, as a struct of RESULT. The model's size is fixed by its parameters, not by the data."""
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.decide(texts.tolist()), columns=["lang_pred", "score", "ambiguous", "runner_up"])

    return judge(text)


def kept(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text has a language: those without a letter go. If nothing was learned, a letter alone decides."""
    if not model.languages:
        return rows.where(F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}"))
    return rows.where(predicted(model, F.col(text))["lang_pred"] != UNKNOWN)


def predict(rows: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of the input: its key and the columns of RESULT."""
    slim = rows.select(F.col(key), F.col(text).alias("_text"))
    return slim.select(F.col(key), predicted(model, F.col("_text")).alias("_p")).select(key, "_p.*")
