"""Near-duplicate passages by compact windows.

1. A text is a sequence of five-word shingles. For each of ``HASHES`` hash functions its passages of ``LENGTH`` shingles
   fall into compact windows (l, c, r): all those that begin at l or later, hold shingle c and end at r or before have
   the hash of c as their minimum. The windows are the nodes of the Cartesian tree over the hashes, as far as passages
   of that length see them: a node reaches to the nearest smaller hash on each side, LENGTH - 1 shingles at most.
2. Windows of different texts that share a signature (hash function and minimum) form a group. In every group the text
   with the smallest id stands for it and meets all others, which gives n - 1 rectangles (a window here, a window
   there) for n windows. The rectangles of two texts are joined over the hash functions: where those of ``ENOUGH``
   functions meet, in one cell of a grid over both texts, the stretches that they cover are compared.
3. What those comparisons leave open is compared in full: in every group, each other text whose window there is not
   all within known spans meets all others of the group, in blocks of bounded size. So two texts that agree on ``ENOUGH``
   functions meet: in step 2 if the one stands for so many of their groups, else here. A block first drops all passages of whose shingles too few occur in any other of its texts.
4. Verification: a passage of LENGTH shingles (fifty words) is a near-duplicate if any passage of the same length
   in the other text shares so many of its shingles that their Jaccard similarity, as multisets, is at least
   ``SIMILARITY``; each text's passages are looked for in the other.
   Verified passages of a text are merged to spans.

Equal texts are one node, known by 128 bits: a text of fifty words or more that several rows have is a repeated passage
as a whole. Candidates carry 64 of those bits; texts that share them are told apart before they are compared, so a
collision can only hide what the two colliding texts have in common with each other alone.
Every verbatim passage of fifty words that two texts share agrees on all hash functions, so its texts meet, by step 2 or
by step 3. Passages of similarity 0.8 become candidates with probability 0.993 at least. Edge cases: null counts as
the empty text; texts of under fifty words have no spans; repeats within one text alone do not count; words are as in
``tokens``; rows without an id take part; other columns play no part. Very long texts are read whole; only stretches
of them are compared. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociflow.llm import tokens
from lociflow.llm.common import fingerprint, swept, written

WORDS = 50
LENGTH = WORDS - tokens.WIDTH + 1
#: Two passages of similarity J agree on ENOUGH of the hash functions with probability 1 - (1-J)^5 - 5 J (1-J)^4: 0.993
#: at 0.8. Parts that passages beside them share add to that.
HASHES = 5
ENOUGH = 2
SIMILARITY = 0.8
#: Common shingles that two passages of LENGTH need.
COMMON = int(np.ceil(2 * LENGTH * SIMILARITY / (1 + SIMILARITY)))
#: Texts in a block of a signature group, and of those that look for others at once.
BLOCK, ROUND = 4096, 64
#: Alignments of two texts that are tried first, and passages that are counted out at once.
ALIGNMENTS = 8
_STEPS = 512
#: Characters of a cell in which windows of two texts meet.
CELL = 1 << 14
#: Shingles of a text that are looked at together; places among them take the low bits of their hashes.
_SLICE = 1 << 25
_FUNCTION = np.uint64(7)
_FACTORS = tokens.randoms(21, HASHES) | np.uint64(1)
SPANS = "array<struct<begin:bigint,end:bigint>>"
_PLACE = np.uint64((1 << 26) - 1)


def sliding_minima(hashes: np.ndarray, length: int) -> np.ndarray:
    """Of every passage of ``length``, its least hash, with the place in its low bits. Of equal ones the leftmost counts."""
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= length:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (length - width)], least[length - width :]) if width < length else least


def _windows(hashes: np.ndarray, valid: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the compact windows of many texts that stand one after another; ``valid`` marks where a passage may begin."""
    left, centre, right = [], [], []
    for base in range(0, len(valid), _SLICE):  # places take the low bits of the hashes
        here = np.flatnonzero(valid[base : base + _SLICE])
        if not len(here):
            continue
        least = sliding_minima(hashes[base : base + _SLICE + LENGTH - 1], LENGTH)[here]
        new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (owner[base + here[1:]] != owner[base + here[:-1]]))))
        left.append(base + here[new])
        centre.append(base + (least[new] & _PLACE).astype(np.int64))
        right.append(base + here[np.concatenate((new[1:], [len(here)])) - 1] + LENGTH - 1)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, centre, right))


def signatures(texts: Sequence[str], wanted: Sequence[bool]) -> Iterator[tuple[int, int, int, np.ndarray | None, np.ndarray | None]]:
    """Of each text: its number of words, where they begin and end (for texts of WORDS or more), and, if wanted, its
    signatures, whose last bits name the hash function, and the stretch of characters of each one's window, as
    begin << 32 | end. Windows of one signature that begin in the same CELL are one."""
    for a, b in tokens.blocks(texts):
        block = tokens.words(texts[a:b])
        size = np.diff(block.first)
        long = size >= WORDS
        some = long & np.array(wanted[a:b], bool)
        places = range(b - a)
        what = where = bounds = None
        if some.any():
            every = tokens.shingles(block.hashes)
            owner = np.repeat(np.arange(b - a), size)[: len(every)]
            # No passage reaches from one text into the next.
            valid = (some[owner] & (np.arange(len(every)) + WORDS <= block.first[owner + 1]))[: len(every) - LENGTH + 1]
            found = []
            for k in range(HASHES):
                hashes = tokens.mix(every * _FACTORS[k])
                left, centre, right = _windows(hashes, valid, owner)
                name = (tokens.mix(hashes[centre]) & ~_FUNCTION) | np.uint64(k)
                found.append((owner[left], name, block.starts[left], block.ends[right + tokens.WIDTH - 1]))
            who, what, begin, end = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((begin, what, who))
            who, what, begin, end = who[order], what[order], begin[order], end[order]
            at = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (what[1:] != what[:-1]) | (begin[1:] // CELL != begin[:-1] // CELL))))
            who, what, where = who[at], what[at].view(np.int64), begin[at] << 32 | np.maximum.reduceat(end, at)
            bounds = np.searchsorted(who, np.arange(b - a + 1))
        for i in places:
            x, y = block.first[i], block.first[i + 1]
            part = slice(bounds[i], bounds[i + 1]) if some[i] else None
            yield int(size[i]), int(block.starts[x]) if long[i] else 0, int(block.ends[y - 1]) if long[i] else 0, *((what[part], where[part]) if part else (None, None))


def _enough(held: np.ndarray) -> np.ndarray:
    """By row: for each passage, whether COMMON of its shingles are marked."""
    total = np.zeros((held.shape[0], held.shape[1] + 1), np.int32)
    np.cumsum(held, axis=1, out=total[:, 1:])
    return total[:, LENGTH:] - total[:, :-LENGTH] >= COMMON


def passages(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Beginnings of the passages of LENGTH shingles of a that share COMMON shingles, as multisets, with one of b.

    Most are found by counts that cannot be too large: equal shingles at one alignment, and shingles that both texts
    hold once, around a common one. What is left of passages with enough shingles anywhere in b is counted out.
    """
    if min(len(a), len(b)) < LENGTH:
        return np.zeros(0, np.int64)
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    low, high = np.searchsorted(ordered, a, "left"), np.searchsorted(ordered, a, "right")
    hit = high > low
    left = _enough(hit[None, :])[0]
    if not left.any():
        return np.zeros(0, np.int64)
    likely = left.copy()
    p = np.flatnonzero(hit)
    shifts, times = np.unique(np.concatenate((order[low[hit]] - p, order[high[hit] - 1] - p)), return_counts=True)
    for shift in shifts[np.argsort(-times, kind="stable")[:ALIGNMENTS]]:
        x, y = max(0, -shift), min(len(a), len(b) - shift)
        if y - x >= LENGTH:
            left[x : y - LENGTH + 1] &= ~_enough((a[x:y] == b[x + shift : y + shift])[None, :])[0]
    ordered = np.sort(a)
    once = hit & (high - low == 1) & (np.searchsorted(ordered, a, "right") - np.searchsorted(ordered, a, "left") == 1)
    p = np.flatnonzero(once)
    q = order[low[p]]
    total = np.concatenate(([0], np.cumsum(once)))
    begin = np.flatnonzero(left & _enough(once[None, :])[0])
    for some in np.array_split(begin, max(1, len(begin) // 4096)) if len(begin) else ():
        first, last = total[some], total[some + LENGTH]
        index = first[:, None] + np.arange(LENGTH)[None, :]
        inside = index < last[:, None]
        other = q[np.minimum(index, len(q) - 1)]
        for anchor in (first, (first + last) // 2, last - 1):
            there = np.clip(some + q[anchor] - p[anchor], 0, len(b) - LENGTH)
            common = (inside & (other >= there[:, None]) & (other < there[:, None] + LENGTH)).sum(1)
            left[some[common >= COMMON]] = False
    begin = np.flatnonzero(left)
    for some in np.split(begin, np.flatnonzero((np.diff(begin) > LENGTH) | (np.diff(begin // _STEPS) > 0)) + 1):
        if len(some):
            left[some[_counted(a, b, some)]] = False
    return np.flatnonzero(likely & ~left)


def _counted(a: np.ndarray, b: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether the passages of a at ``begin``, which lie close together, share COMMON shingles with any passage of b."""
    base = begin[0]
    what, mine = np.unique(a[base : begin[-1] + LENGTH], return_inverse=True)
    at = np.minimum(np.searchsorted(what, b), len(what) - 1)
    theirs = np.where(what[at] == b, at, -1)
    # held[s, i]: how often passage i of a holds shingle s.
    total = np.zeros((len(what), len(mine) + 1), np.int32)
    total[mine, np.arange(len(mine)) + 1] = 1
    np.cumsum(total, axis=1, out=total)
    held = total[:, begin - base + LENGTH] - total[:, begin - base]
    found = np.zeros(len(begin), bool)
    places = np.flatnonzero(_enough((theirs >= 0)[None, :])[0])
    last = None
    for j in places.tolist():
        if last is None or j != last + 1:
            now = np.bincount(theirs[j : j + LENGTH][theirs[j : j + LENGTH] >= 0], minlength=len(what))
            common = np.minimum(held, now[:, None]).sum(0)
        else:  # one shingle leaves b's passage, one enters
            out, new = theirs[j - 1], theirs[j + LENGTH - 1]
            if out != new:
                if out >= 0:
                    common = common - (held[out] >= now[out])
                    now[out] -= 1
                if new >= 0:
                    now[new] += 1
                    common = common + (held[new] >= now[new])
        last = j
        found |= common >= COMMON
        if found.all():
            break
    return found


def _spans(begin: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> Iterator[tuple[int, int]]:
    """Merged character spans of passages."""
    begin = np.unique(begin)
    cuts = np.flatnonzero(np.diff(begin) > LENGTH) + 1
    for part in np.split(begin, cuts):
        if len(part):
            yield base + int(starts[part[0]]), base + int(ends[part[-1] + WORDS - 1])


def _windowed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # one number for each text of this partition
        for pdf in batches:
            names = pdf["text_id"].tolist()
            wanted = []
            for x in names:
                wanted.append(x not in seen)
                seen.add(x)
            found = pd.DataFrame(signatures(pdf["text"].tolist(), wanted), columns=["words", "begin", "end", "what", "where"])
            yield pd.concat([pdf.drop(columns="text"), found], axis=1)

    kind = f"id {docs.schema['id'].dataType.simpleString()}, fp binary, text_id bigint, words bigint, begin bigint, end bigint, what array<bigint>, where array<bigint>"
    return docs.mapInPandas(run, kind)


def _compared(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, others, begins, rep_begins = (pdf[c].tolist() for c in ("fp", "rep_fp", "begin", "rep_begin"))
            mine = tokens.each_shingled(pdf["text"].tolist(), WORDS)
            theirs = tokens.each_shingled(pdf["rep_text"].tolist(), WORDS)
            out = []
            for (i, a, a_starts, a_ends), (_, b, b_starts, b_ends) in zip(mine, theirs, strict=True):
                if len(a) and len(b):
                    out += [(names[i], *s) for s in _spans(passages(a, b), a_starts, a_ends, begins[i])]
                    out += [(others[i], *s) for s in _spans(passages(b, a), b_starts, b_ends, rep_begins[i])]
            yield pd.DataFrame(out, columns=["fp", "begin", "end"])

    return pairs.mapInPandas(run, "fp binary, begin bigint, end bigint")


def _outside(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: int, spans: Iterable) -> np.ndarray:
    """Of each passage of a stretch of a text, whether it lies outside the spans that are known."""
    first, last = begin + starts[: len(shingles) - LENGTH + 1], begin + ends[WORDS - 1 :]
    out = np.ones(len(first), bool)
    for s in spans:
        out &= (first < s["begin"]) | (last > s["end"])
    return out


def crossing(names: list[int], mine: list[np.ndarray], outside: list[np.ndarray], others: list[int], theirs: list[np.ndarray]) -> list[np.ndarray]:
    """Of each stretch in ``mine``, the beginnings of passages outside known spans that near-duplicate one in ``theirs``.

    Every two stretches of different texts are held against each other unless the one has no passage left of which
    enough shingles are in the other.
    """
    none = np.zeros(0, np.int64)
    found = [none] * len(mine)
    place = {name: k for k, name in enumerate(others)}
    size = np.array([len(b) for b in theirs], np.int64)
    if not size.sum():
        return found
    every, owner = np.concatenate(theirs), np.repeat(np.arange(len(theirs)), size)
    for begin in range(0, len(mine), ROUND):
        some = range(begin, min(begin + ROUND, len(mine)))
        what = np.unique(np.concatenate([mine[i] for i in some]))
        at = np.minimum(np.searchsorted(what, every), len(what) - 1)
        known = what[at] == every
        held = np.zeros((len(theirs), len(what)), bool)
        held[owner[known], at[known]] = True
        for i in some:
            open_ = np.flatnonzero(outside[i])
            if not len(open_):
                continue
            low, high = open_[0], open_[-1] + 1  # what lies around need not be looked at
            part, left = mine[i][low : high + LENGTH - 1], outside[i][low:high].copy()
            likely = _enough(held[:, np.searchsorted(what, part)])
            if names[i] in place:
                likely[place[names[i]]] = False
            for k in np.flatnonzero((likely & left).any(1)):
                if (likely[k] & left).any():
                    here = passages(part, theirs[k])
                    found[i] = np.union1d(found[i], low + here)
                    left[here] = False
    return found


def alive(grams: list[np.ndarray], groups: np.ndarray, names: np.ndarray, outside: list[np.ndarray | None], theirs: np.ndarray) -> list[np.ndarray | None]:
    """Of each stretch with an ``outside``, which of its passages there have enough shingles in other texts of its group; none for no passage.

    ``names`` number the texts, ``theirs`` marks the stretches that count as others. All groups are looked at at once.
    """
    size = np.array([len(g) for g in grams])
    out: list[np.ndarray | None] = [None] * len(grams)
    if not size.sum():
        return out
    element = np.concatenate(grams) ^ np.repeat(tokens.mix(groups.astype(np.uint64) + np.uint64(1)), size)
    owner = np.repeat(names, size)
    order = np.lexsort((owner, element))
    order = order[np.repeat(theirs, size)[order]]
    if not len(order):
        return out
    what, who = element[order], owner[order]
    new = np.concatenate(([True], what[1:] != what[:-1]))
    at = np.flatnonzero(new)
    several = np.maximum.reduceat(who, at) != who[at]  # who ascends within an element
    what, first = what[at], who[at]
    place = np.minimum(np.searchsorted(what, element), len(what) - 1)
    shared = (what[place] == element) & (several[place] | (first[place] != owner))
    total = np.concatenate(([0], np.cumsum(shared)))
    begin = np.cumsum(size) - size
    for i, free in enumerate(outside):
        if free is not None and size[i] >= LENGTH:
            part = total[begin[i] : begin[i] + size[i] + 1]
            held = free & (part[LENGTH:] - part[:-LENGTH] >= COMMON)
            out[i] = held if held.any() else None
    return out


def _dealt(members: DataFrame, spans: DataFrame) -> DataFrame:
    """Stretches of the groups in which a comparison with the group's representative left something open, in blocks.

    Where two blocks meet, those marked left are looked for in those marked right.
    """
    # Two texts that agree on ENOUGH functions have met before if the one stands for ENOUGH of those groups. Else, in some
    # group, of any of the functions, neither does.
    others = members.where("n > 2 and text_id != least").select("what", "text_id", "begin", "end")
    others = others.join(spans.select("text_id", "spans"), "text_id", "left")
    others = others.withColumn("spans", F.filter("spans", lambda s: (s["begin"] < F.col("end")) & (s["end"] > F.col("begin"))))
    others = others.withColumn("open", ~F.coalesce(F.exists("spans", lambda s: (s["begin"] <= F.col("begin")) & (s["end"] >= F.col("end"))), F.lit(False)))
    others = written(others)
    parts = lambda c: F.ceil(c / BLOCK).cast("int")
    sizes = others.groupBy("what").agg(parts(F.count(F.lit(1))).alias("all_parts"), parts(F.count_if("open")).alias("open_parts"), F.min("text_id").alias("a"), F.max("text_id").alias("b"))
    sizes = written(sizes.where("open_parts > 0 and a != b").drop("a", "b"))
    dealt = others.join(sizes, "what").withColumn("own", F.xxhash64("text_id", "what"))
    # Each block of open texts (left) meets each block of all texts; a group of one block is sent once.
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    own = lambda parts: F.pmod("own", parts).cast("int")
    once = F.col("all_parts") == 1
    place = ["text_id", "begin", "end", "spans"]
    left = dealt.where(F.col("open") & ~once).select("what", own("open_parts").alias("row"), every("all_parts").alias("col"), F.lit(True).alias("left"), F.lit(False).alias("right"), *place)
    right = dealt.select("what", every("open_parts").alias("row"), own("all_parts").alias("col"), (F.col("open") & once).alias("left"), F.lit(True).alias("right"), *place)
    return left.union(right)


def _crossed(dealt: DataFrame) -> DataFrame:
    """Spans that texts other than the one that stands for a signature give each other."""

    def compare(pdf: pd.DataFrame) -> list[tuple[bytes, int, int]]:
        """Spans of the open stretches of whole groups."""
        rows = [r[1:] for r in tokens.each_shingled(pdf["text"].tolist(), WORDS)]
        grams = [r[0] for r in rows]
        left, right, begins, spans, names = (pdf[c].tolist() for c in ("left", "right", "begin", "spans", "fp"))
        number = pd.factorize(pdf["text_id"])[0]
        groups = pd.factorize(pd.MultiIndex.from_frame(pdf[["what", "row", "col"]]))[0]
        outside = [_outside(*r, b, s if s is not None else ()) if f and len(r[0]) else None for r, b, s, f in zip(rows, begins, spans, left, strict=True)]
        outside = alive(grams, groups, number, outside, np.array(right, bool))
        mine = np.array([x is not None for x in outside], bool)
        out = []
        bounds = np.searchsorted(groups, np.arange(groups.max() + 2 if len(groups) else 1))
        for g in np.unique(groups[mine]).tolist():
            inside = range(bounds[g], bounds[g + 1])
            ours, theirs = [i for i in inside if mine[i]], [i for i in inside if right[i]]
            found = crossing([number[i] for i in ours], [grams[i] for i in ours], [outside[i] for i in ours], [number[i] for i in theirs], [grams[i] for i in theirs])
            out += [(names[i], *s) for i, here in zip(ours, found, strict=True) if len(here) for s in _spans(here, *rows[i][1:], begins[i])]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted; the last group of a batch may go on in the next.
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf[["what", "row", "col"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            whole = int(cuts[-1]) if len(cuts) else 0
            rest = pdf.iloc[whole:]
            if whole:
                yield pd.DataFrame(compare(pdf.iloc[:whole]), columns=["fp", "begin", "end"])
        if rest is not None and len(rest):
            yield pd.DataFrame(compare(rest), columns=["fp", "begin", "end"])

    sorted_ = dealt.repartition("what", "row", "col").sortWithinPartitions("what", "row", "col")
    return sorted_.select("what", "row", "col", "left", "right", "text_id", "fp", "begin", "spans", "text").mapInPandas(run, "fp binary, begin bigint, end bigint")


def _merged(spans: DataFrame) -> DataFrame:
    """Per text, its spans ascending and apart. A text has at most so many spans as beginnings of words."""
    spans = spans.groupBy("fp", "begin").agg(F.max("end").alias("end"))
    order = W.partitionBy("fp").orderBy("begin")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(before >= F.col("begin"), 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    spans = spans.groupBy("fp", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return spans.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def _cells(begin: str, end: str) -> Column:
    """The cells of the grid that a stretch of characters touches."""
    cell = lambda c: F.floor(F.col(c) / CELL)
    return F.explode(F.sequence(cell(begin), cell(end)))


def _met(members: DataFrame) -> DataFrame:
    """Stretches of two texts to be compared: those of windows of ENOUGH hash functions that meet in one cell of both."""
    reps = members.where("text_id = least").select("what", F.col("text_id").alias("rep"), F.col("begin").alias("rep_begin"), F.col("end").alias("rep_end"))
    met = members.where("text_id != least").select("what", "text_id", "begin", "end").join(reps, "what")
    met = met.withColumn("here", _cells("begin", "end")).withColumn("there", _cells("rep_begin", "rep_end"))
    function = F.expr(f"shiftleft(1, cast(what & {int(_FUNCTION)} as int))")
    sides = [F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("rep_begin").alias("rep_begin"), F.max("rep_end").alias("rep_end")]
    met = met.groupBy("text_id", "rep", "here", "there").agg(F.bit_count(F.bit_or(function)).alias("functions"), *sides)
    return met.where(F.col("functions") >= ENOUGH).drop("functions", "here", "there").distinct()


def _cut(slim: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (text_id, begin, end and more) with each stretch's text and the fp of the whole text.

    Only stretches leave the scan of the texts. A text is fetched by its smallest row id as well, so that copies do not
    meet in a task.
    """
    asked = wanted.groupBy("text_id").agg(F.collect_list(F.struct(*wanted.columns)).alias("asked"))
    asked = written(texts.select("fp", "text_id", "id").join(asked, "text_id").drop("text_id"))
    (fp, number) = (asked["fp"], asked["id"])
    found = slim.select("fp", "id", "text").join(asked.select(fp.alias("asked_fp"), number.alias("asked_id"), "asked"), (F.col("fp") == F.col("asked_fp")) & F.col("id").eqNullSafe(F.col("asked_id")))
    if not texts.where("again").isEmpty():
        found = written(found).dropDuplicates(["fp"])  # rows that repeat an id and its text
    found = found.select("fp", "text", F.explode("asked").alias("asked")).select("fp", "text", "asked.*")
    return found.withColumn("text", F.substring("text", F.col("begin").cast("int") + 1, (F.col("end") - F.col("begin")).cast("int")))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of the input: key, n_words, class_rows (rows with an equal text), n_spans, and spans: array of
    struct(begin, end) of characters, ascending and apart, of passages that near-duplicate one in another row."""
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = slim.select("id", fingerprint(F.col("text")).alias("fp"), "text").withColumn("text_id", F.xxhash64("fp")).select("id", "fp", "text_id", "text")
    with swept(spark):  # windows take much room and are needed no longer than it takes to find groups
        every = written(_windowed(slim))
        rows = written(every.drop("what", "where"), lasting=True)
        windows = every.where("what is not null").select("text_id", F.explode(F.arrays_zip("what", "where")).alias("w")).select("text_id", "w.what", "w.where")
        groups = windows.groupBy("what").agg(F.min("text_id").alias("least"), F.max("text_id").alias("most"), F.count(F.lit(1)).alias("n"))
        groups = written(groups.where("least != most").drop("most"))
        # Copies of a text in several partitions give equal windows.
        members = windows.join(groups, "what").distinct()
        members = members.select("what", "text_id", F.shiftright("where", 32).alias("begin"), F.col("where").bitwiseAND(0xFFFFFFFF).alias("end"), "least", "n")
        members = written(members, lasting=True)
    by_id = rows.groupBy("fp", "text_id", "id").agg(F.count(F.lit(1)).alias("n"), F.max("begin").alias("begin"), F.max("end").alias("end"))
    texts = written(by_id.groupBy("fp", "text_id").agg(F.min("id").alias("id"), F.sum("n").alias("class_rows"), (F.max("n") > 1).alias("again"), F.max("begin").alias("begin"), F.max("end").alias("end")))
    met = written(_met(members))
    sides = met.select("text_id", "begin", "end").union(met.select("rep", "rep_begin", "rep_end")).distinct()
    pieces = written(_cut(slim, texts, sides))
    place = [F.col("text_id").alias("rep"), F.col("begin").alias("rep_begin"), F.col("end").alias("rep_end")]
    pairs = met.join(pieces, ["text_id", "begin", "end"]).join(pieces.select(*place, F.col("fp").alias("rep_fp"), F.col("text").alias("rep_text")), ["rep", "rep_begin", "rep_end"])
    spans = _compared(pairs.select("fp", "begin", "text", "rep_fp", "rep_begin", "rep_text"))
    spans = spans.union(texts.where("class_rows > 1 and end > begin").select("fp", "begin", "end"))
    spans = written(_merged(spans).withColumn("text_id", F.xxhash64("fp")))
    crossed = _crossed(_cut(slim, texts, _dealt(members, spans)))
    spans = _merged(spans.select("fp", F.inline("spans")).union(crossed))
    none = F.array().cast(SPANS)
    per_text = written(texts.select("fp", "class_rows").join(spans, "fp", "left"))
    out = rows.select(F.col("id").alias(key), "fp", F.col("words").alias("n_words")).join(per_text, "fp")
    return out.select(key, "n_words", "class_rows", F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"), F.coalesce("spans", none).alias("spans"))
