"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes its texts a block at a time, cuts them into pieces by the tokenizer's pattern and encodes the block's
distinct pieces together: all their bytes lie in one sequence, an inverted index leads from each merge (the rank of
the token that two neighbours make) to the positions where it applies, and merges are replayed in rank order over the
whole block. A merge updates only the neighbours it touches and files the pairs it makes under their own ranks. The
result of every piece is that of merging its lowest-ranked pair, leftmost first, until none is left.

Pieces that a task has seen are remembered up to a bound, so frequent ones are encoded about once per task. Nothing is
shuffled; the vocabulary, of fixed size, is read by the driver and sent to the tasks once.

Edge cases: a null text counts as empty and has no tokens. There are no special tokens: their strings are ordinary
text. Very long texts are encoded whole, in blocks of their pieces. Rows are judged one by one; repeated rows get equal
results, other columns play no part, no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a block whose distinct pieces are encoded together.
BLOCK_CHARS = 4_000_000
#: Pieces that a task remembers.
REMEMBERED = 500_000
_NONE = np.iinfo(np.int32).max


@dataclass
class Vocabulary:
    """Token bytes by rank, and the rank that each pair of neighbouring tokens makes."""

    tokens: dict[int, bytes]
    pattern: str
    bytes_to_id: np.ndarray = field(init=False)
    pairs: np.ndarray = field(init=False)  # ascending: left << 32 | right
    makes: np.ndarray = field(init=False)
    backward: np.ndarray = field(init=False)  # tokens that may take part in a merge of lower rank than their own

    def __post_init__(self) -> None:
        rank = {t: r for r, t in self.tokens.items()}
        self.bytes_to_id = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, r in rank.items():
            for cut in range(1, len(token)):
                if (a := rank.get(token[:cut])) is not None and (b := rank.get(token[cut:])) is not None:
                    pairs[a << 32 | b] = r
        self.pairs = np.array(sorted(pairs), np.int64)
        self.makes = np.array([pairs[k] for k in self.pairs.tolist()], np.int32)
        self.backward = np.zeros(max(self.tokens) + 1, bool)
        for side in (self.pairs >> 32, self.pairs & 0xFFFFFFFF):
            self.backward[side[self.makes < side]] = True

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(len(left), _NONE, np.int32)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.makes[at], _NONE)


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """A rank file: on each line a token's bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return Vocabulary({int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}, pattern)


def _leftmost(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of ascending positions whose pairs may overlap the next, those that merging from the left takes."""
    chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
    number = np.arange(len(at))
    head = np.maximum.accumulate(np.where(chained, 0, number))
    return at[(number - head) % 2 == 0]


def _ascending(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def replay(pieces: Sequence[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, one after another, and each piece's number of them; no piece may be empty."""
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    symbol = vocab.bytes_to_id[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(symbol)
    piece = np.repeat(np.arange(len(pieces)), sizes)
    # Place n stands for "no neighbour"; the index of a piece's first and last byte leads there.
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1] = n
    before[ends - sizes] = n
    rank = np.full(n + 1, _NONE, np.int32)
    inner = np.flatnonzero(after[:n] < n)
    rank[inner] = vocab.ranks(symbol[inner], symbol[inner + 1])
    index: dict[int, list[np.ndarray]] = defaultdict(list)
    queue: list[int] = []

    def file(at: np.ndarray) -> None:
        at = at[rank[at] != _NONE]
        if not len(at):
            return
        at = at[np.argsort(rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[at])) + 1
        for part in np.split(at, cuts) if len(cuts) else [at]:
            r = int(rank[part[0]])
            if r not in index:
                heapq.heappush(queue, r)
            index[r].append(part)

    file(inner)
    while queue:
        r = heapq.heappop(queue)
        waiting = index.pop(r)
        at = waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
        at = at[rank[at] == r]  # the others have been merged meanwhile
        if not len(at):
            continue
        at = _ascending(at)
        if vocab.backward[r]:
            # The new token may open a merge of lower rank, so each piece takes one step and then lines up again.
            first = np.concatenate(([True], piece[at[1:]] != piece[at[:-1]]))
            later, at = at[~first], at[first]
        else:
            later, at = at[:0], _leftmost(at, after)
        gone = after[at]
        symbol[at] = r
        rank[gone] = _NONE
        follow = after[gone]
        after[at] = follow
        before[follow[follow < n]] = at[follow < n]
        lead = before[at]
        touched = _ascending(np.concatenate((lead[lead < n], at)))
        follow = after[touched]
        open_ = follow < n
        rank[touched[~open_]] = _NONE
        rank[touched[open_]] = vocab.ranks(symbol[touched[open_]], symbol[follow[open_]])
        file(touched[open_])
        if len(later):
            file(np.setdiff1d(later, touched, assume_unique=True))
    # A place lives on as a token if the start of its piece leads to it.
    alive = np.zeros(n, bool)
    live = ends - sizes
    while len(live):
        alive[live] = True
        live = after[live]
        live = live[live < n]
    return symbol[alive], np.bincount(piece[alive], minlength=len(pieces))


class Encoder:
    """Encodes blocks of texts, remembering pieces."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.cut = vocab, regex.compile(vocab.pattern).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.sizes = (np.zeros(0, np.int64) for _ in range(3))

    def learn(self, cut: list[list[str]]) -> None:
        new = set().union(*cut)
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
        fresh = sorted(new - self.known.keys())
        ids, sizes = replay([p.encode() for p in fresh], self.vocab)
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """The token ids of each text."""
        cut = [self.cut(t or "") for t in texts]
        self.learn(cut)
        for pieces in cut:
            number = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
            sizes = self.sizes[number]
            shift = self.starts[number] - np.cumsum(sizes) + sizes
            yield self.ids[np.repeat(shift, sizes) + np.arange(sizes.sum())]


def decode(ids: Sequence[int], vocab: Vocabulary) -> bytes:
    return b"".join(map(vocab.tokens.__getitem__, ids))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of about BLOCK_CHARS characters at a time, however large the batches are."""
    held, size = [], 0
    for pdf in batches:
        begin = 0
        for i, text in enumerate(pdf["text"]):
            size += len(text or "")
            if size >= BLOCK_CHARS:
                yield pd.concat([*held, pdf.iloc[begin : i + 1]], ignore_index=True)
                held, size, begin = [], 0, i + 1
        if begin < len(pdf):
            held.append(pdf.iloc[begin:])
    if held:
        yield pd.concat(held, ignore_index=True)


def encoded(docs: DataFrame, vocab: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of the input: its key, ids (array of int) and decoded (binary, from those ids)."""
    return _mapped(docs, vocab, key, text, "ids array<int>, decoded binary", lambda ids, back: (ids, back))


def digests(docs: DataFrame, vocab: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of the input: its key, n_tokens, ids_sha256 (of decimal ids joined by a space) and decoded_sha256."""

    def digest(ids: np.ndarray, back: bytes) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(str(ids.tolist())[1:-1].replace(",", "").encode()).hexdigest(), hashlib.sha256(back).hexdigest()

    return _mapped(docs, vocab, key, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest)


def _mapped(docs: DataFrame, vocab: Vocabulary, key: str, text: str, kind: str, make) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    names = [x.split()[0] for x in kind.split(", ")]
    slim = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = shared.value
        encoder = Encoder(vocab)
        for pdf in _blocks(batches):
            rows = [make(ids, decode(ids.tolist(), vocab)) for ids in encoder.encode(pdf["text"].tolist())]
            yield pd.concat([pdf[["id"]], pd.DataFrame(rows, columns=names)], axis=1)

    return slim.mapInPandas(run, f"id {docs.schema[key].dataType.simpleString()}, {kind}").withColumnRenamed("id", key)
