"""Language identification, decontamination, byte-level BPE, quality: against labels, brute force and round trips."""

import base64
import math
import random
from collections import Counter

import numpy as np
import pytest
import tiktoken
from helpers import docs, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lociflow.llm import byte_bpe, decontaminate, language_id, quality, tokens
from lociflow.llm.registry import vocabulary

ODD = [None, "", " \n\t ", "!!! ??? 123", "x" * 300_000, "word " * 40_000, "🤦🏼‍♂️ ́", "one two"]


def alphabet_text(rng, letters):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(60))


def test_language_id_held_out_accuracy_and_edges(spark):
    rng = random.Random(1)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop", "dd": "mnopabqr", "ee": "uvwxyzäö", "ff": "stuvqrßé", "gg": "aeioubcd"}
    texts = [(i, alphabet_text(rng, alphabets[k]), k, "s", 0) for i, k in enumerate(rng.choice(list(alphabets)) for _ in range(400))]
    rows = frame(spark, texts)
    model = language_id.fit(rows.where("doc_id % 5 != 0"))
    assert model.languages == sorted(alphabets)
    found = {r.doc_id: r for r in language_id.predict(rows, model).collect()}
    held = [t for t in texts if t[0] % 5 == 0]
    assert sum(found[t[0]].lang_pred == t[2] for t in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())
    odd = language_id.predict(docs(spark, [*ODD, ODD[-1]]).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("x")), model).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in odd] == [not any(c.isalpha() for c in t or "") for t in [*ODD, ODD[-1]]]
    assert odd[-1][1:] == odd[-2][1:] and odd[0].score == 0
    assert language_id.predict(rows.limit(0), model).count() == 0


def test_language_id_mixed_text_is_ambiguous_and_nothing_learned_is_und(spark):
    rng = random.Random(2)
    rows = frame(spark, [(i, alphabet_text(rng, a), k, "s", 0) for i in range(80) for k, a in (("aa", "abcdef"), ("bb", "uvwxyz"))])
    model = language_id.fit(rows)
    mixed = alphabet_text(rng, "abcdef") + " " + alphabet_text(rng, "uvwxyz")
    assert language_id.predict(docs(spark, [mixed]), model).first().ambiguous
    none = language_id.fit(rows.limit(0))
    assert language_id.predict(docs(spark, ["text"]), none).first().lang_pred == "und"


def plain_grams(text):
    """Counts of hashed letter n-grams, letter by letter."""
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    letters = " " + " ".join(letters.split()) + (" " if letters.split() else "")
    counts = Counter()
    for n in language_id.ORDERS:
        for i in range(len(letters) - n + 1):
            code = n
            for c in letters[i : i + n]:
                code = ((code ^ (0 if c == " " else ord(c))) * 0x9E3779B97F4A7C15) % 2**64
            counts[code >> 48] += 1
    return counts


def plain_model(rows, code):
    """Bit classifiers from rows of (text, language), with dictionaries."""
    languages = sorted({lang for _, lang in rows})
    shares = {}
    for lang in languages:
        texts = [plain_grams(t) for t, own in rows if own == lang and any(c.isalpha() for c in t)]
        total = Counter()
        for t in texts:
            for k, v in t.items():
                total[k] += v / t.total() / len(texts)
        floor = 1 + 1e-6 * language_id.BUCKETS
        shares[lang] = [(total[k] + 1e-6) / floor for k in range(language_id.BUCKETS)]
    weights = []
    for bit in range(code.shape[1]):
        sides = [[shares[x] for i, x in enumerate(languages) if code[i, bit] == side] for side in (1, -1)]
        weights.append([math.log(sum(a) / len(a)) - math.log(sum(b) / len(b)) for a, b in zip(zip(*sides[0], strict=True), zip(*sides[1], strict=True), strict=True)])
    scale = [sum(abs(sum(s * w for s, w in zip(shares[x], ws, strict=True))) for x in languages) / len(languages) for ws in weights]
    return languages, weights, scale


def test_language_id_equals_brute_force(spark):
    rng = random.Random(5)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklÉéß", "dd": "mnopİab"}
    texts = [alphabet_text(rng, alphabets[k]) + rng.choice([".", " 12 ", "", "!\n"]) for k in alphabets for _ in range(12)]
    langs = [k for k in alphabets for _ in range(12)]
    rows = frame(spark, [(i, t, k, "s", 0) for i, (t, k) in enumerate(zip(texts, langs, strict=True))] + [(99, texts[0], "aa", "s", 0)] * 3)  # copies count once
    model = language_id.fit(rows)
    languages, weights, scale = plain_model(list(zip(texts, langs, strict=True)), model.code)
    assert model.languages == languages and np.allclose(model.weights.T, weights, atol=1e-4) and np.allclose(model.scale, scale, rtol=1e-4)
    assert model.trust.sum() == pytest.approx(1) and (model.trust > 0).all()
    odd = [*texts[:20], texts[0][:100] + texts[30], "a", "é!", "x" * 200_000, "", None, "12", "İİ ß", "ab " * 70_000]
    for text, (lang, score, ambiguous, second) in zip(odd, model.decide(odd), strict=True):
        counts = plain_grams(text or "")
        if not any(c.isalpha() for c in text or ""):
            assert (lang, score, second) == ("und", 0.0, None)
            continue
        margin = [sum(v * w[k] for k, v in counts.items()) / counts.total() / s for w, s in zip(weights, scale, strict=True)]
        loss = [sum(t * math.exp(-max(-3, min(3, m)) * model.code[i, b]) for b, (m, t) in enumerate(zip(margin, model.trust, strict=True))) for i in range(len(languages))]
        odds = [math.exp(-model.sharpness * (x - min(loss))) for x in loss]
        p = sorted(((o / sum(odds), x) for o, x in zip(odds, languages, strict=True)), reverse=True)
        assert lang == p[0][1] and score == pytest.approx(p[0][0], abs=1e-3) and second == p[1][1]
        assert ambiguous == (p[0][0] - p[1][0] < language_id.AMBIGUOUS) or abs(p[0][0] - p[1][0] - language_id.AMBIGUOUS) < 1e-3
    assert model.decide([texts[3]])[0] == model.decide(["x" * 90_000, *odd, texts[3]])[-1]  # whatever stands beside it


def test_bits_that_are_often_wrong_count_little():
    trust = language_id.reliability({0: (100, 100), 1: (75, 100), 2: (40, 100)}, 4)
    assert trust[0] > 1.9 * trust[1] > trust[2] and trust[2] == trust[3] and trust.sum() == pytest.approx(1)


def test_nothing_learned_keeps_texts_with_letters(spark):
    rows = docs(spark, ["text", "é", "12 !", None, ""])
    none = language_id.fit(rows)
    assert sorted(r.doc_id for r in language_id.kept(rows, none).collect()) == [0, 1]


def test_output_code_keeps_codewords_apart():
    for n in (2, 4, 6, 12):
        code = language_id.code_matrix(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert min(apart[i, j] for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)


def brute_tiles(a, b, least):
    """Greedy string tiling by looking at every pair of positions."""
    used_a, used_b, out = [False] * len(a), [False] * len(b), 0
    while True:
        best, found = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in found:
            if not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                used_a[i : i + best] = used_b[j : j + best] = [True] * best
                out += best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=25))
def test_tiling_is_valid_and_maximal(a, b):
    x, y = (tokens.mix(np.array(v, np.uint64)) for v in (a, b))
    found = decontaminate.tiles(x, y, 3) if len(b) >= 3 else []
    used_a, used_b = set(), set()
    for i, j, n in found:
        assert a[i : i + n] == b[j : j + n] and n >= 3
        assert not used_a & set(range(i, i + n)) and not used_b & set(range(j, j + n))
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
    rest_a = [None if i in used_a else v for i, v in enumerate(a)]
    rest_b = [-1 if j in used_b else v for j, v in enumerate(b)]
    if len(b) >= 3:
        assert not any(rest_a[i : i + 3] == rest_b[j : j + 3] for i in range(len(a) - 2) for j in range(len(b) - 2))


def test_tiling_of_distinct_runs_matches_brute_force():
    rng = random.Random(4)
    for _ in range(20):
        item = [rng.randrange(500) for _ in range(50)]
        pieces = [item[i : i + rng.randrange(3, 15)] for i in rng.sample(range(40), 5)]
        text = [x for p in pieces for x in [*p, rng.randrange(1000, 2000)]]
        x, y = (tokens.mix(np.array(v, np.uint64)) for v in (text, item))
        assert abs(sum(n for _, _, n in decontaminate.tiles(x, y, 5)) - brute_tiles(text, item, 5)) <= 4


def test_contamination_reordered_short_items_and_both_paths(spark):
    items = [prose(k, 40) for k in range(5)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(5, "only three words"), (6, None), (7, "")], "item_id long, text string")
    turned = items[1][20:] + prose(77, 30) + items[1][:20]
    texts = ["lead " + " ".join(items[0]) + " tail", " ".join(turned).upper(), " ".join(prose(88, 200)), " ".join(items[2][:15]), "so Only, three; WORDS here", *ODD]
    rows = docs(spark, texts).withColumn("item_id", F.lit(0)).withColumn("coverage", F.lit(0))
    for held in (decontaminate.HELD_WORDS, 0):
        found = decontaminate.leaks(rows, bench, "leak", least=0.0, held_words=held).select("doc_id", "leak.*").orderBy("doc_id").collect()
        assert [r.coverage for r in found[:5]] == [1.0, 1.0, 0.0, 0.375, 1.0] and [r["item"] for r in found[:5]] == [0, 1, None, 2, 5]
        assert all(r.coverage == 0 for r in found[5:]) and len(found) == len(texts)
    got = decontaminate.contaminated(rows, bench).where("contaminated").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 4]
    assert decontaminate.clean(rows, bench).columns == rows.columns and decontaminate.clean(rows, bench).count() == len(texts) - 3
    assert decontaminate.clean(rows, bench.limit(0)).count() == len(texts)


def test_contamination_by_items_without_an_id(spark):
    words = [" ".join(prose(950 + k, 30)) for k in range(3)]
    items = spark.createDataFrame([(None, words[0]), (None, words[1]), (7, words[1]), (7, words[2])], "item_id long, text string")
    rows = docs(spark, [*words, "nothing of them"])
    held, joined = (sorted(map(tuple, decontaminate.leaks(rows, items, "leak", held_words=n).select("doc_id", "leak.item", "leak.coverage", "leak.tiles").collect())) for n in (decontaminate.HELD_WORDS, 0))
    assert joined == held == [(0, None, 1.0, 1), (1, 7, 1.0, 1), (2, 7, 1.0, 1), (3, None, 0.0, 0)]


@pytest.mark.parametrize("least", [0.0, decontaminate.COVERAGE])
def test_both_paths_equal_brute_force(spark, least):
    """Items that share phrases, repeat, are short, empty or have no id; texts that hold pieces of them in any order."""
    rng = random.Random(31)
    phrases = [prose(1300 + k, rng.randrange(2, 9), 60) for k in range(12)]
    draw = lambda n: [w for _ in range(n) for w in rng.choice(phrases)]
    items = [(rng.choice([None, k % 9, k]), " ".join(draw(rng.randrange(5)))) for k in range(30)] + [(1, None), (None, None), (2, "!"), (3, "w1"), (3, "w1")]
    texts = [" ".join(draw(rng.randrange(9)) + prose(k, rng.randrange(6), 60)) for k in range(60)] + [None, "", "W1", items[0][1], items[0][1]]
    bench, rows = spark.createDataFrame(items, "item_id int, text string"), docs(spark, texts)
    held, joined = ({r[0]: tuple(r)[1:] for r in decontaminate.leaks(rows, bench, "leak", least=least, held_words=n).select("doc_id", "leak.item", "leak.coverage", "leak.tiles").collect()} for n in (decontaminate.HELD_WORDS, 0))
    assert held == joined and len(held) == len(texts) and len({v for v in held.values()}) > 5
    words = lambda t: [h for _, h, _, _ in tokens.each([t])][0]
    known = sorted({(i is None, i or 0, t or "") for i, t in items})
    for k, text in enumerate(texts):
        best = (None, 0.0)
        for none, i, t in known:
            share = decontaminate.coverage(words(text), words(t))[0]
            if share > best[1] and share >= least:
                best = (None if none else i, share)
        assert held[k][:2] == best, k


def test_a_text_that_covers_an_item_has_enough_of_its_seeds():
    for n in range(1, 60):
        for least in (0.0, 0.3, 0.5, 1.0):
            width, covered = min(decontaminate.LEAST, n), max(min(decontaminate.LEAST, n), int(np.ceil(least * n)))
            fewest = min(covered - m * (width - 1) for m in range(1, covered // width + 1))
            assert decontaminate.positions(n, least) == fewest


@pytest.fixture(scope="module")
def vocab():
    return vocabulary()


@pytest.fixture(scope="module")
def reference(vocab):
    return tiktoken.Encoding("own", pat_str=vocab.pattern, mergeable_ranks={t: i for i, t in vocab.tokens.items()}, special_tokens={})


@settings(max_examples=80, deadline=None)
@given(texts=st.lists(st.text(max_size=60) | st.text("abeinrst ", max_size=80) | st.text("a", max_size=300), max_size=6))
def test_bpe_equals_the_library(vocab, reference, texts):
    for text, ids in zip(texts, byte_bpe.Encoder(vocab).encode(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert byte_bpe.decode(ids.tolist(), vocab).decode() == text


def test_bpe_backward_merges():
    """A vocabulary in which a merge opens one of lower rank, which then goes first."""
    parts = [bytes([b]) for b in range(256)] + [b"bcd", b"ab", b"aab", b"cd", b"abab", b"bc", b"dd", b"aa"]
    vocab = byte_bpe.Vocabulary(dict(enumerate(parts)), r"\S+|\s+")
    library = tiktoken.Encoding("tiny", pat_str=r"\S+|\s+", mergeable_ranks={t: i for i, t in enumerate(parts)}, special_tokens={})
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    assert vocab.backward.any()
    for text, ids in zip(texts, byte_bpe.Encoder(vocab).encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)


def test_bpe_over_a_table(spark, vocab, reference):
    rows = docs(spark, [*ODD, ODD[-1], "<|endoftext|>"]).withColumn("n_tokens", F.lit("x")).withColumn("id", F.lit(1))
    for r in byte_bpe.encoded(rows, vocab).collect():
        text = [*ODD, ODD[-1], "<|endoftext|>"][r.doc_id] or ""
        assert list(r.ids) == reference.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert byte_bpe.digests(rows, vocab).where("n_tokens = 0").count() == 2
    assert byte_bpe.digests(rows.limit(0), vocab).count() == 0


def test_bpe_blocks_cut_batches(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 10)
    texts = ["abc", None, "", "x" * 25, "abcdef", "abcdef", "a", "b"]
    for cuts in ([8], [3, 5], [1] * 8):
        begins = np.cumsum([0, *cuts])
        batches = [pd.DataFrame({"id": range(a, b), "text": texts[a:b]}) for a, b in zip(begins[:-1], begins[1:], strict=True)]
        blocks = list(byte_bpe._blocks(iter(batches)))
        assert [b["id"].tolist() for b in blocks] == [[0, 1, 2, 3], [4, 5], [6, 7]]


def test_vocabulary_file(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(bytes([b])) + f" {b}\n".encode() for b in range(256)))
    assert [i.tolist() for i in byte_bpe.Encoder(byte_bpe.read_vocabulary(str(path), r"\w+|\W")).encode(["abc!"])] == [[97, 98, 99, 33]]


def test_quality_held_out_accuracy_and_edges(spark):
    rng = random.Random(3)
    good = lambda: " ".join(prose(rng.random(), 60)) + "."
    bad = lambda: rng.choice([" ### ".join(prose(rng.random(), 50)), " ".join(["Spam"] * 60), " ".join(prose(rng.random(), 50)).upper() + "!!"])
    label = {i: int(rng.random() < 0.6) for i in range(400)}
    rows = docs(spark, [good() if label[i] else bad() for i in range(400)])
    labels = spark.createDataFrame([(i, v, 0) for i, v in label.items() if i % 4] + [(1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(rows, labels)
    found = {r.doc_id: r.score for r in quality.scored(rows, model).collect()}
    held = [i for i in label if i % 4 == 0]
    assert sum((found[i] >= quality.THRESHOLD) == label[i] for i in held) >= 0.9 * len(held)
    odd = quality.scored(docs(spark, [*ODD, ODD[-1]]).withColumn("score", F.lit("x")), model).orderBy("doc_id").collect()
    assert all(0 <= r.score <= 1 for r in odd) and odd[-1].score == odd[-2].score and odd[0].score == odd[1].score
    none = quality.fit(rows, labels.limit(0))
    assert {r.score for r in quality.scored(rows, none).collect()} == {0.5}
    assert quality.scored(rows.limit(0), model).count() == 0


def plain_units(text):
    """Units and marks of a text, word by word."""
    out, last, i = [], None, 0
    kind = lambda c: 1 if c.isalnum() else 0 if c.isspace() else 2
    while i < len(text):
        j = i
        while j < len(text) and kind(text[j]) == kind(text[i]):
            j += 1
        part = text[i:j]
        if kind(text[i]) == 1:
            number = int(tokens.mix(np.array([sum(int(tokens._characters()[1][ord(c)]) * int(tokens._PLACES[k]) for k, c in enumerate(part)) % 2**64], np.uint64))[0])
            upper, lower, digit = (any(getattr(c, f)() for c in part) for f in ("isupper", "islower", "isdigit"))
            shape = 7 if upper and lower and not digit and part[0].isupper() else upper + 2 * lower + 4 * digit
            out.append((number % quality.WORDS, quality.WORDS + quality.SYMBOLS + (8 if number == last else shape)))
            last = number
        elif kind(text[i]) == 2:
            number = int(tokens.mix(np.array([sum(int(tokens._characters()[1][ord(c)]) * int(tokens._PLACES[k]) for k, c in enumerate(part)) % 2**64], np.uint64))[0])
            out.append((quality.WORDS + number % quality.SYMBOLS, quality.WORDS + quality.SYMBOLS + 9 + min(len(part) - 1, 3)))
        i = j
    return out


def test_contexts_and_pooling_equal_brute_force():
    texts = ["The the cat, sat on THE mat... 12 a1", None, "", "  ", "...", "word", "one two one two three?!", "Ünï cödé x" * 3]
    index, total = quality._index().astype(float), np.zeros((quality.UNITS, quality.DIMENSIONS))
    for text in texts:
        every = plain_units(text or "")
        for i, (unit, mark) in enumerate(every):
            total[unit] += index[mark] + sum(index[every[j][0]] for j in range(max(0, i - quality.AROUND), min(len(every), i + quality.AROUND + 1)) if j != i)
            total[mark] += index[unit]
    found = quality.contexts(texts).reshape(quality.UNITS, quality.DIMENSIONS)
    assert np.allclose(found, total)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=total.shape).astype(np.float32)
    for text, row in zip(texts, quality.pooled(texts, vectors), strict=True):
        every = plain_units(text or "")
        assert row[-1] == pytest.approx(math.log1p(len(text or "")))
        for at, which in ((0, 0), (quality.DIMENSIONS, 1)):
            want = sum(vectors[u[which]] for u in every) / len(every) if every else np.zeros(quality.DIMENSIONS)
            assert np.allclose(row[at : at + quality.DIMENSIONS], want, atol=1e-5)
    assert (quality.pooled([texts[0]] * 2, vectors)[0] == quality.pooled(["cat The", texts[0]], vectors)[1]).all()


@pytest.mark.parametrize("noise", [0.0, 0.15, 0.3])
def test_scores_are_calibrated(noise):
    """Labels that are wrong with a known share: scores say so, however large the network's logits are."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(16_000, 3))
    truth = x[:, 0] + 0.5 * x[:, 1] > 0
    labels = np.where(rng.random(len(x)) < noise, ~truth, truth).astype(int)
    net = quality.train(x[:12_000], labels[:12_000], np.arange(12_000) % 5 == 0)
    score, y = net.score(x[12_000:]), labels[12_000:]
    bins = [p for low in np.arange(0, 1, 0.1) for p in [(score >= low) & (score < low + 0.1)] if p.any()]
    assert sum(abs(score[p].mean() - y[p].mean()) * p.sum() for p in bins) / len(y) < 0.05
    z = net.logits(x[12_000:])
    own = quality.calibrated(z, y)
    assert quality.calibrated(z * 0.3, y) == pytest.approx(0.3 * own, rel=0.1) and quality.calibrated(z * 3, y) == pytest.approx(3 * own, rel=0.1)
    few = np.array([9.0, -9.0, 8.0])
    assert quality.calibrated(few, np.array([1, 0, 1])) > 1  # all right, but too few to be so sure


def test_quality_fit_takes_one_text_of_a_repeated_id(spark, monkeypatch):
    rows = docs(spark, [" ".join(prose(k, 30)) + ("." if k % 2 else " ###") for k in range(80)])
    rows = rows.union(rows.where("doc_id = 1").crossJoin(spark.range(500).select(F.lit(1).alias("one"))).drop("one"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    seen = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda features, *a: seen.append(len(features)) or train(features, *a))
    quality.fit(rows, labels)
    quality.fit(rows, labels, documents=20)
    assert seen == [80, 20]
