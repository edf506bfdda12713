"""Language model, quality classifier and language identification."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.llm import op4, op7, op10


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


# Language model


def brute_chance(ngrams, corpus, word, history):
    """The chance of a word by its definition, from plain counts."""
    if not history:
        return corpus.word_chance(ngrams[word,])
    prior = op4.PRIOR[len(history) - 1]
    shorter = brute_chance(ngrams, corpus, word, history[1:])
    return (ngrams[(*history, word)] + prior * shorter) / (ngrams[history] + prior)


def brute_model(texts):
    ngrams: Counter = Counter()
    for text in texts:
        words = [b"^", *op4.words_of(text)]
        for n in (1, 2, 3):
            ngrams.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    single = {g: n for g, n in ngrams.items() if len(g) == 1 and g != (b"^",)}
    return ngrams, op4.Corpus(sum(single.values()), len(single))


def small_corpus():
    rng = random.Random(4)
    words = ["the", "cat", "sat", "on", "a", "mat", "Dog"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(60)]


TESTS = ["the cat sat", "unknown the cat", "mat mat mat zebra", "", None, "dog Dog on a"]


@pytest.mark.parametrize("parts, range_bytes", [(1, 1 << 20), (7, 1 << 20), (5, 300)])
def test_scores_are_the_definitions(spark, monkeypatch, parts, range_bytes):
    """However the texts are cut into chunks and the n-grams into ranges."""
    monkeypatch.setattr(op4, "RANGE_BYTES", range_bytes)
    texts = small_corpus()
    ngrams, corpus = brute_model(texts)
    rows = [(i, t, True) for i, t in enumerate(texts)]
    rows += [(100 + i, t, None if i % 2 else False) for i, t in enumerate(TESTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(parts)
    got = {r.doc_id: r for r in op4.score(docs, F.col("train")).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        words = [b"^", *op4.words_of(text)]
        want = sum(
            math.log10(brute_chance(ngrams, corpus, w, tuple(words[max(0, n - 2) : n])))
            for n, w in enumerate(words)
            if n
        )
        assert got[i].score == pytest.approx(want, abs=1e-9)
        base = sum(math.log10(corpus.base_chance(ngrams[w,])) for w in words[1:])
        assert got[i].base_score == pytest.approx(base, abs=1e-9)
        assert got[i].train_tokens == corpus.tokens
        assert got[i].n_known == sum(ngrams[w,] > 0 for w in words[1:])


def small_automaton(texts, others=()):
    """The automaton of a single chunk, and the places of its words."""
    local = {op4.BEGIN: 0}
    split = [op4.words_of(t) for t in (*texts, *others)]
    places = [local.setdefault(w, len(local)) for words in split for w in words]
    grams = op4.Grams(
        np.array([op4.hash_of(w) for w in local], np.int64),
        np.array([len(w) for w in split]),
        np.array(places),
        np.array([1] * len(texts) + [0] * len(others)),
    )
    _, corpus = brute_model(texts)
    return op4.Automaton(grams, grams.counts[grams.order], corpus), local, corpus


def test_chances_sum_to_one():
    """After every kind of state: over all words of the corpus, and one never seen."""
    others = ["zebra", "a a zebra", "cat sat"]
    own, local, corpus = small_automaton(small_corpus(), others)
    for history in ([], ["the"], ["cat", "sat"], ["a", "a"], ["zebra"], ["a", "zebra"]):
        _, state = own.walk([local[w.encode()] for w in history])
        words = [i for i in local.values() if i and own.known[i]]
        assert len(words) == corpus.distinct
        # Arcs are those of n-grams of the chunk, so the rest is what failure arcs lead to.
        unseen = own.walk([local[b"zebra"]], state)[0]
        total = sum(10 ** own.walk([w], state)[0] for w in words) + 10**unseen
        assert total == pytest.approx(1)


def test_failure_arcs_lead_to_shorter_histories():
    own, local, corpus = small_automaton(["a b c", "a b d", "b e"], ["a b e", "a b q e"])
    a, b, c, e, q = (local[w] for w in (b"a", b"b", b"c", b"e", b"q"))
    _, pair = own.walk([a, b])
    assert pair > own.width and own.shorter[pair] == b + 1 and own.shorter[b + 1] == 0
    # A triple seen is one arc; the state behind it is the pair it ends in.
    assert pair * own.width + c in own.arcs
    assert own.shorter[own.walk([c], pair)[1]] == c + 1
    # "a b e" is not held but "b e" is: one failure arc, then the arc of "b".
    assert pair * own.width + e not in own.arcs
    arc = own.arcs[(b + 1) * own.width + e]
    total, state = own.walk([e], pair)
    assert total == pytest.approx(own.lost[pair] + own.weight[arc])
    assert state == own.target[arc] and own.shorter[state] == e + 1
    # A word never seen: both failure arcs, then the root, where it leads back to.
    total, state = own.walk([q], pair)
    assert state == 0
    unseen = math.log10(corpus.word_chance(0))
    assert total == pytest.approx(own.lost[pair] + own.lost[b + 1] + unseen)


@settings(max_examples=100, deadline=None)
@given(*[st.lists(st.text("abcd ", max_size=30), max_size=5)] * 2)
def test_texts_side_by_side_take_the_same_arcs(texts, others):
    own, local, _ = small_automaton(texts, [*others, ""])
    split = [op4.words_of(t) for t in (*texts, *others, "")]
    want = [own.walk([local[w] for w in words])[0] for words in split]
    assert own.walk_texts().tolist() == want


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1))
def test_runs_round_trip(keys):
    values = np.array(keys, np.uint64)
    assert op4.unpacked(op4.packed(values)).tolist() == keys
    assert op4.unpacked_run(op4.packed_run(np.sort(values))).tolist() == sorted(keys)


def test_language_model_query(spark, sf):
    """Counts and the base are exact; the model is better."""
    plain = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i for i in plain if fold(i, 5) == 1}
    got = {r.doc_id: r for r in op4.query(spark, sf).collect()}
    counts = Counter(w for i, t in plain.items() if i not in held for w in op4.words_of(t))
    n = sum(counts.values())
    z = n + 0.5 * (len(counts) + 1)
    for i, text in plain.items():
        words = op4.words_of(text)
        assert got[i].held_out == (i in held)
        assert got[i].n_tokens == len(words) and got[i].train_tokens == n
        assert got[i].n_known == sum(w in counts for w in words)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / z) for w in words))
    assert sum(got[i].score - got[i].base_score for i in held) > 0


def test_language_model_of_hard_rows(spark, hard, hard_rows, nothing):
    rows = op4.score(hard, F.lit(True)).collect()
    assert len(rows) == len(hard_rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (4, 5, 6)} == {1}
    assert op4.score(nothing, F.lit(True)).count() == 0
    rows = op4.score(hard, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.score, r.base_score) for r in rows} == {(0, 0, 0.0, 0.0)}


# Quality


def test_quality_separates_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op7.query(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if fold(r.doc_id, 3) == 1}
    known = [r for r in held if r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in known)
    assert right / len(known) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_of_hard_rows(spark, hard, hard_rows, nothing):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (4, None), (9, 1), (11, 0), (13, 0), (None, 1), (99, 1), (7, 5)],
        "doc_id long, quality int",
    )
    rows = op7.score_quality(hard, labels).collect()
    assert len(rows) == len(hard_rows) and all(0 <= r.score <= 1 for r in rows)
    empties = {r.score for r in rows if r.doc_id in (4, 5)}
    assert len(empties) == 1
    assert op7.score_quality(nothing, labels).count() == 0
    unlabelled = op7.score_quality(hard, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}
    kept = op7.keep_good(hard, op7.learn(hard, labels.limit(0)), 0.4)
    assert kept.columns == hard.columns and kept.count() == len(hard_rows)


def test_quality_fits_a_bounded_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    stats = op7.document_statistics(docs)
    model = op7.fit(stats, labels, fit_rows=150)
    assert model.weights.any()


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    model = op7.Model(
        np.zeros(op7.NUMBER), np.ones(op7.NUMBER),
        rng.standard_normal((op7.NUMBER, op7.FEATURES)) / math.sqrt(op7.NUMBER),
        rng.uniform(0, 2 * math.pi, op7.FEATURES), np.zeros(1), np.zeros(1), np.zeros(1),
    )
    x = rng.standard_normal((30, op7.NUMBER))
    z = model.cosines(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * op7.NUMBER))
    assert np.abs(z @ z.T - kernel).mean() < 0.06


def test_isotonic_pools_violators():
    knots, levels = op7.isotonic(np.array([1, 1, 2, 1]), np.array([0, 1, 0, 1]), np.arange(4.0))
    assert levels.tolist() == [0, 1 / 3, 1] and knots.tolist() == [0, 5 / 3, 3]


# Language


def brute_phrases(sample, text):
    """Longest matches from left to right; an unknown letter is a phrase by itself."""
    count, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        count, at = count + 1, at + size
    return count


def test_phrases_meet_brute_force(monkeypatch):
    rng = random.Random(2)
    samples = tuple("".join(rng.choice("abcd ") for _ in range(300)) for _ in range(3))
    own = op10.Reader(samples)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(200))) for _ in range(40)]
    coded = [own.encode(t) for t in texts]
    got = own.phrases(coded)
    for text, counts in zip(coded, got.tolist(), strict=True):
        data = bytes(text.tolist())
        assert counts == [brute_phrases(bytes(own.encode(s).tolist()), data) for s in samples]
    # Strips cost at most one phrase each.
    monkeypatch.setattr(op10, "STRIP", 16)
    more = own.phrases(coded) - got
    strips = np.array([-(-len(t) // 16) for t in coded])
    assert (more >= 0).all() and (more <= strips[:, None]).all()


def test_language_query(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10.query(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(fold(r.doc_id, 5) == 0 for r in held)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_hard_rows(hard, hard_rows, nothing):
    learnt = op10.learn(hard)
    assert set(learnt) == {"en"}
    rows = op10.identify(hard, learnt).collect()
    assert len(rows) == len(hard_rows)
    unknown = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert unknown == {None, 4, 5, 6, 13, 15, 16}  # no letters
    assert {r.score for r in rows} == {0.0, 1.0}
    kept = op10.keep_identified(hard, learnt)
    assert kept.columns == hard.columns and kept.count() == len(hard_rows) - 9
    assert op10.learn(nothing) == {}
    assert {r.lang_pred for r in op10.identify(hard, {}).collect()} == {"und"}
    assert op10.identify(nothing, learnt).count() == 0


def test_language_sample_is_of_distinct_texts(spark):
    """However many copies there are, a language of few texts is learned from all of them."""
    rows = [("xx", f"wort{chr(97 + i)} {chr(97 + i) * 9}") for i in range(10) for _ in range(300)]
    rows += [("yy", f"text number {'i' * i} of many") for i in range(500)]
    rows += [("yy", "a hot text " * 40)] * 3000 + [("zz", "123 !"), (None, "no language")]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    learnt = op10.learn(frame)
    assert set(learnt) == {"xx", "yy"}
    assert all(learnt["xx"].count(f"wort{chr(97 + i)}") == 1 for i in range(10))
    assert 30 < learnt["yy"].count("text number") < 100
    assert learnt["yy"].count("a hot text") <= 40


def test_language_sample_has_a_part_of_every_text(spark):
    """Equal parts, from the beginning to the end of a text, within the bound."""
    rows = [("xx", "boilerplate, again! " * 300 + f"{chr(97 + i) * 3} " * 3000) for i in range(20)]
    rows += [("xx", "tiny one"), ("yy", "short"), ("ww", "a1b22c " * 20_000)]
    learnt = op10.learn(spark.createDataFrame(rows, "lang string, text string"))
    parts = [learnt["xx"].count(chr(97 + i) * 3) for i in range(20)]
    assert min(parts) > 0 and max(parts) <= min(parts) + 30
    assert "boilerplate again" in learnt["xx"] and "tiny one" in learnt["xx"]
    assert 19_000 < len(learnt["xx"]) <= op10.SAMPLE_LETTERS
    assert 19_000 < len(learnt["ww"]) <= op10.SAMPLE_LETTERS and learnt["yy"] == "short"


def test_pieces_are_spread():
    text = "".join(chr(0x4E00 + i) for i in range(5000))
    for size in (1, 50, 100, 101, 202, 999, 4999, 5000):
        got = op10.spread(text, size)
        assert 0.9 * size <= len(got) <= size
        if size >= 202:
            assert got[0] == text[0] and text[-2] in got
    assert op10.equal_parts(["abc", "d" * 50, "e" * 50], 44) == "abc " + "d" * 19 + " " + "e" * 19


@pytest.mark.parametrize("alphabet", [op10.ALPHABET, 3, 0])
def test_every_letter_of_a_sample_is_its_own(monkeypatch, alphabet):
    """Phrases of large alphabets are those of the letters themselves."""
    monkeypatch.setattr(op10, "ALPHABET", alphabet)
    monkeypatch.setattr(op10, "LANES", 7, raising=False)
    rng = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(900)] + list("abcd")
    lines = ["".join(rng.choice(letters) for _ in range(12)) for _ in range(150)]
    samples = (" ".join(lines[:70]), " ".join(lines[70:140]), "abcd " * 20)
    own = op10.Reader(samples)
    texts = ["".join(rng.choice([*lines, "一丁", "ж", "abcda", " "]) for _ in range(30)) for _ in range(40)]
    coded = [own.encode(t) for t in [*texts, ""]]
    got = own.phrases(coded).tolist()
    plain = [[s.tolist() for s in map(own.encode, samples)], [t.tolist() for t in coded]]
    text_of = lambda symbols: "".join(chr(0x4E00 + c) for c in symbols)
    for text, counts in zip(plain[1], got, strict=True):
        assert counts == [brute_phrases(text_of(s), text_of(text)) for s in plain[0]]
    # Letters that no sample holds share a symbol; all others differ.
    assert len({int(own.encode(c)[0]) for c in set("".join(samples)) - {" "}}) == len(
        set("".join(samples)) - {" "}
    )
    assert own.encode("ж")[0] == own.encode("ю")[0] == 1


def test_large_alphabets_are_told_apart():
    """Texts of rare letters alone; the samples' 250 most frequent letters are shared."""
    common = "".join(chr(0x1200 + i) for i in range(600) if chr(0x1200 + i).isalpha())[:250] * 3
    rare = {x: "".join(chr(at + i) for i in range(1500)) for x, at in (("ko", 0xAC00), ("zh", 0x4E00))}
    samples = {x: common + letters for x, letters in rare.items()}
    texts = [rare[x][i * 25 : i * 25 + 30] for i in range(50) for x in ("zh", "ko")]
    names, _ = op10.answers(texts, samples)
    assert names == ["zh", "ko"] * 50
