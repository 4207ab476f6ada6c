"""Annulus search, whitening and chat formatting against brute force."""

import hashlib
import math

import numpy as np
import pytest
from helpers import frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lociflow.llm import annulus, chat_format, whitening

VECTORS = "vec_id long, embedding array<double>, x string, cluster string, n long"


def vectors(spark, rows):
    return frame(spark, [(i, v, "x", "y", 0) for i, v in rows], VECTORS).repartition(3)


def nearest(vectors, centroids):
    distances = ((vectors[:, None, :] - centroids[None]) ** 2).sum(2)
    return distances.argmin(1), distances.min(1)  # argmin takes the first of those that tie


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 40), st.integers(1, 4), st.sampled_from([1, 3, 50, 10**6]))
def test_rings_hold_every_tie(seed, k, d, size):
    rng = np.random.default_rng(seed)
    centroids, points = rng.integers(-size, size + 1, (k, d)), rng.integers(-size, size + 1, (60, d))
    chosen, distance = annulus.Rings(centroids).nearest(points)
    want, least = nearest(points, centroids)
    assert (chosen == want).all() and (distance == least).all()


def test_rings_spare_most_centroids(monkeypatch):
    rng = np.random.default_rng(1)
    centroids = rng.integers(-3, 4, (400, 8)) * rng.integers(1, 300, (400, 1))
    points = centroids[rng.integers(0, 400, 500)] + rng.integers(-1, 2, (500, 8))
    seen, real = [], annulus.Rings.distances
    monkeypatch.setattr(annulus.Rings, "distances", lambda self, v, p: seen.append(len(v)) or real(self, v, p))
    chosen, _ = annulus.Rings(centroids).nearest(points)
    assert (chosen == nearest(points, centroids)[0]).all() and sum(seen) < 400 * 500 / 2


def test_rings_refuse_what_no_long_holds():
    with pytest.raises(OverflowError):
        annulus.Rings(np.array([[1 << 40, 0]])).nearest(np.array([[0, 0]]))


def lloyd(rows, k, rounds, dimensions):
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids, points = np.array([v for _, v in first]), np.array([v for _, v in kept])
    for _ in range(rounds):
        chosen, _ = nearest(points, centroids)
        for c in set(chosen.tolist()):
            centroids[c] = points[chosen == c].sum(0) // (chosen == c).sum()
    chosen, distance = nearest(points, centroids)
    sums = {c: int(distance[chosen == c].sum()) for c in set(chosen.tolist())}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, d, sums[c], sum(sums.values()), digest[c]) for (i, _), c, d in zip(kept, chosen.tolist(), distance.tolist(), strict=True))


def got(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([rng.integers(-2, 3, (150, 4)) / 8, rng.normal(0, 1, (60, 4))]))]
    rows += [(3, [0.5, 0.5, 0.5, 0.5])] * 40 + [(None, [1.0, 2.0, 3.0, 4.0]), (900, None), (901, [1.0, None, 1.0, 1.0]), (902, [1.0, math.inf, 1.0, 1.0]), (903, [math.nan] * 4), (904, [1.0]), (905, [])]
    assert got(annulus.clusters(vectors(spark, rows), k=5, rounds=4, dimensions=4)) == lloyd(rows, 5, 4, 4)
    few = rows[:3]
    assert got(annulus.clusters(vectors(spark, few), k=5, rounds=4, dimensions=4)) == lloyd(few, 5, 4, 4)
    same = [(i, [0.25] * 4) for i in range(20)]  # all centroids are equal, and all but the first stay empty
    assert {r[1] for r in got(annulus.clusters(vectors(spark, same), k=5, rounds=2, dimensions=4))} == {0}


@pytest.mark.parametrize("rows", [[], [(None, [1.0] * 4)], [(1, None)]])
def test_clusters_of_nothing(spark, rows):
    df = annulus.clusters(vectors(spark, rows), dimensions=4)
    assert df.collect() == [] and df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 7), st.lists(st.integers(1, 12), min_size=1, max_size=6))
def test_states_merge_without_loss(seed, d, sizes):
    rng = np.random.default_rng(seed)
    parts = [rng.integers(-500, 500, (n, d)) + rng.integers(-5000, 5000) for n in sizes]
    whole = np.concatenate(parts)
    state = whitening._all(whitening.State.of(p) for p in parts)
    centred = whole - whole.mean(0)
    assert state.n == len(whole) and state.total == whole.sum(0).tolist()
    found = (state.vectors.T * state.values**2) @ state.vectors
    assert np.allclose(found, centred.T @ centred, rtol=1e-9, atol=1e-6)


def brute_whitening(rows, k=4):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in kept)
    kept = [(i, tuple(v + [0] * (width - len(v)))) for i, v in kept]
    once = np.array(sorted({v for _, v in kept}))
    n, total = len(once), once.sum(0)
    centred = once - total / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:k], directions[:, ::-1][:, :k]
    return kept, n, total, values, directions


def test_whitening_equals_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(3)
    rows = [(i, (v * [9, 5, 3, 2, 1, 0.5]).tolist()) for i, v in enumerate(rng.normal(0, 1, (400, 6)))]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(None, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (2000, [1.0, -0.0]), (2001, []), (2002, None), (2003, [math.nan] * 6), (2004, [None] * 6)]
    kept, n, total, values, directions = brute_whitening(rows)
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert len(found) == 4 * len(kept) and {r.n for r in found} == {n}
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.component), r)
    signs = [0] * 4
    for i, v in kept:
        for c in range(4):
            r = by[i, c + 1]
            want = float((np.array(v) - total / n) @ directions[:, c] / np.sqrt(values[c]))
            signs[c] = signs[c] or (1 if want * r.whitened > 0 else -1)
            assert math.isclose(r.whitened, signs[c] * want, rel_tol=1e-9, abs_tol=1e-9)
            assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, total, strict=True))
            assert math.isclose(r.explained, values[c] / np.var(np.array(sorted({v for _, v in kept})), axis=0).sum(), rel_tol=1e-9)
    assert max(r.identity_error for r in found) < 1e-9


def test_whitening_without_variance(spark):
    found = whitening.whiten(vectors(spark, [(1, [0.5, 1.0])] * 3 + [(2, [0.5, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found) == sorted([(1, c, 1, 0, 0.0, 0.0, 0.0) for c in (1, 2)] * 3 + [(2, c, 1, 0, 0.0, 0.0, 0.0) for c in (1, 2)])
    line = whitening.whiten(vectors(spark, [(i, [i / 8, i / 4, 0.0]) for i in range(9)])).collect()
    assert {(r.component, round(r.explained, 9)) for r in line} == {(1, 1.0), (2, 0.0), (3, 0.0)} and all(r.whitened == 0 for r in line if r.component > 1)
    assert line[0].identity_error < 1e-9


def test_whitening_of_large_entries_and_of_nothing(spark):
    far = whitening.whiten(vectors(spark, [(0, [1e9, 0.0]), (1, [-1e9, 1.0]), (2, [0.0, 0.0])])).collect()
    assert [r.deviation for r in sorted(far, key=lambda r: (r.vec_id, r.component)) if r.vec_id < 2] == [None] * 4 and far[0].identity_error < 1e-4
    for rows in ([], [(1, None)], [(1, [])]):
        df = whitening.whiten(vectors(spark, rows))
        assert df.collect() == [] and "identity_error" in df.columns


CHATS = "conv_id long, turn long, role string, text string, n string, formatted string, size long"


def chats(spark, rows):
    return frame(spark, [(*r, "n", "f", 1) for r in rows], CHATS).repartition(3)


def told(rows):
    """What a conversation's digests should be: turns in order, replies."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: sorted(t) for c, t in out.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


HARD = ["", "\\", "\\b", "\\.", "\\n", "<|", "<|turn|>", "<|end|>\n", "</s>[INST] ok [/INST]", "<\\.|end|>", "<<SYS>><s>", "<|turn|>assistant\nno<|end|>\n", "é\n\n\U0001f600", "\r\n", "<<|end|>", "\\\\<s", " x ", "\x00"]


@pytest.fixture
def talks():
    rows = [(1, t, "assistant" if t % 2 else "user", HARD[t]) for t in range(len(HARD))]
    rows += [(2, t, HARD[t], HARD[-t]) for t in range(len(HARD))] + [(3, 0, "user", "alone")]
    rows += [(None, 0, "user", None), (None, 1, "assistant", None), (None, None, None, "first"), (4, 0, "assistant", "b"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), (4, 0, "Assistant", "not this one")]
    return rows + [(5, t, "assistant" if t % 2 else "user", f"t{t} " * 40) for t in range(300)] + [(6, 0, "user", "q"), (6, 1, "assistant", "x é" * 100_000)]


def test_digests_read_everything_back(spark, talks):
    want, found = told(talks), {r.conv_id: r for r in chat_format.digests(chats(spark, talks)).collect()}
    assert set(found) == set(want)
    for conv, turns in want.items():
        r, replies = found[conv], [t[3] for t in turns if t[2] == "assistant"]
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), conv
        assert r.loss_chars == len("".join(replies)) and r.loss_sha256 == sha("".join(replies)) and r.n_examples == len(replies), conv


def test_examples_hold_their_context_alone(spark, talks):
    want = told(talks)
    found = chat_format.examples(chats(spark, talks)).select("*", F.length("text").alias("size"), chat_format.turns_of(F.col("text")).alias("turns"), chat_format.masked(F.col("text"), F.col("loss_begin"), F.col("loss_end")).alias("reply")).collect()
    seen = {c: [] for c in want}
    for r in found:
        turns = [(t[2], t[3]) for t in want[r.conv_id]]
        if r.trainable:
            assert [tuple(t) for t in r.turns] == turns[: r.n_context + 1] and r.reply == turns[r.n_context][1]
            assert r.text[r.loss_end :] == "<|end|>\n" and r.text[: r.loss_begin].endswith("<|turn|>assistant\n")
            seen[r.conv_id].append(r.n_context)
        else:
            assert [tuple(t) for t in r.turns] == turns and r.loss_begin == r.loss_end == r.size and turns[-1][0] != "assistant"
        assert r.text.count("<|") == 2 * len(r.turns) and not any(c in r.text for c in chat_format.CONTROLS if c != "<|")
    for conv, turns in want.items():
        assert sorted(seen[conv]) == [i for i, t in enumerate(turns) if t[2] == "assistant"]


def test_no_conversations(spark):
    assert chat_format.digests(chats(spark, [])).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["\\", "<", "|", ">", "s", "/", "[INST]", "b", ".", "n", "\n", "é", "</s>", "<<SYS>>"]), max_size=12).map("".join), min_size=1, max_size=20))
def test_escapes_are_reversible(spark, texts):
    c = F.col("value")
    df = spark.createDataFrame([(t,) for t in texts], "value string").select(c, *[chat_format.unescape(chat_format.escape(c, r), r).alias(f"back{r}") for r in (False, True)], chat_format.escape(c, True).alias("e"))
    for r in df.collect():
        assert r.value == r.backFalse == r.backTrue and "\n" not in r.e and not any(x in r.e for x in chat_format.CONTROLS)


def test_formatting_shuffles_once_and_stays_in_the_jvm(spark):
    rows = spark.range(100).selectExpr("id % 7 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "'t' AS text")
    plan = chat_format.digests(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
