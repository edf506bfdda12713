"""Encoding, counting and packing against the tokenizers library itself."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelens.llm import op2, op5, op9, op10, shared, tokens
from pagelens.llm.tokens import (
    Memo,
    default_path,
    ids_of,
    library,
    packed_ids,
    packed_ids_of_many,
    token_counts,
)

BYTE, WORD, PIECE = map(
    default_path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")
)
PARTS = st.sampled_from(
    [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "​", "a", "B", "é"]
    + ["É", "1", "23", "!", "'s", "'LL", " '", "Don't", "<|endoftext|>", "<|EndOfText|>"]
    + ["word", "Été,", " Ü;", "ÿ", "×", " x--", "a_b", "µ", "😀", "中文", "ß", "İ", "ﬁ", "½"]
    + ["ſ", "'ſ", "\x00", "Σ", "ΑΣ"]
)
texts = st.lists(PARTS, max_size=12).map("".join) | st.text(max_size=30)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_packed_ids_are_the_librarys(text):
    for path in (BYTE, WORD):
        want = library(path).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed_ids(path)(text), "<u4").tolist() == want
        assert token_counts(path)([text]) == [len(want)]


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, max_size=6))
def test_packed_ids_of_many_are_those_of_each(given):
    for path in (BYTE, WORD):
        assert packed_ids_of_many(path)(given) == list(map(packed_ids(path), given))


@settings(max_examples=400, deadline=None)
@given(texts)
def test_codec_is_the_librarys(text):
    own, lib = op2.codec(BYTE), library(BYTE)
    want = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    decoded = lib.decode(want, skip_special_tokens=False)
    assert own.decode(want) == decoded
    count, decimals, data = own.spell(text)
    assert (count, decimals.decode()) == (len(want), ",".join(map(str, want)))
    assert data.decode("utf-8", "replace") == decoded


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_codec_decodes_any_ids(ids):
    assert op2.codec(BYTE).decode(ids) == library(BYTE).decode(ids, skip_special_tokens=False)


def test_piece_counts_are_the_librarys():
    given = ["", "a  b", "\n one\ttwo ", "😀"]
    assert token_counts(PIECE)(given) == [len(ids_of(PIECE, t)) for t in given]


def test_memo_stays_bounded():
    made = []
    memo = Memo(lambda k: made.append(k) or k + 1, 3)
    for i in range(10):
        assert (memo[0], memo[i]) == (1, i + 1)
        assert len(memo) <= 3 and len(memo.old) <= 3
    assert made.count(0) == 1  # met again and again, so kept


def test_codec_over_hard_rows(hard, hard_rows, nothing):
    rows = op2.decode(op2.encode(hard)).collect()
    want = Counter((i, text or "") for i, text, _ in hard_rows)
    assert Counter((r.doc_id, r.text) for r in rows) == want
    assert all(r.ids == ids_of(BYTE, r.text) for r in rows)
    assert op2.encode(nothing).count() == 0


def test_encoding_query_is_the_librarys(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2.query(spark, sf).collect()
    assert len(rows) == len(docs)
    for row in rows:
        ids = ids_of(BYTE, docs[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()


def test_counts_and_cache(spark, hard, hard_rows, nothing, tmp_path):
    path = str(tmp_path / "cache")
    rows = op5.count_tokens(hard, path).collect()
    want = Counter(
        (i, len((t or "").encode()), len(ids_of(BYTE, t or "")), len(ids_of(BYTE, t or "")) > 512)
        for i, t, _ in hard_rows
    )
    assert Counter(tuple(r) for r in rows) == want
    distinct = len({t or "" for _, t, _ in hard_rows})
    cache = op5.read_cache(spark, path)
    assert cache.count() == distinct
    # Known texts are not encoded again; another tokenizer has entries of its own.
    op5.count_tokens(hard.where("doc_id < 5"), path).collect()
    assert cache.count() == distinct
    others = op5.count_tokens(hard, path, tokenizer=WORD).collect()
    assert op5.read_cache(spark, path).count() == 2 * distinct
    assert {r.n_tokens for r in others if r.doc_id == 7} == {len(ids_of(WORD, "one two"))}
    assert op5.count_tokens(nothing, str(tmp_path / "none")).count() == 0


def test_cached_counts_are_used(spark, tmp_path):
    """A count planted in the cache comes back, so the text was not encoded."""
    docs = spark.createDataFrame([(1, "planted"), (2, "fresh")], "doc_id long, text string")
    path = str(tmp_path / "cache")
    digest = hashlib.sha256(b"planted").digest()
    row = (bytearray(digest), bytearray(op5.tokenizer_digest(BYTE)), 777)
    spark.createDataFrame([row], op5.CACHE).write.parquet(path)
    got = {r.doc_id: r.n_tokens for r in op5.count_tokens(docs, path).collect()}
    assert got[1] == 777 and got[2] == len(ids_of(BYTE, "fresh"))


def check_packing(rows, docs, window):
    """Every id is in one piece, pieces are the texts', sequences have no gaps."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= window
    for doc_id, texts in docs.items():
        own = sorted(pieces[doc_id], key=lambda r: r.start)
        want = [[*ids_of(WORD, t or ""), op9.END_ID] for t in texts]
        assert sum(r.length for r in own) == sum(map(len, want))
        if len(texts) == 1:
            found = np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist()
            assert found == want[0] and {r.doc_tokens for r in own} == {len(want[0])}
    return sum(r.length for r in rows) / (window * len(sequences))


@pytest.mark.parametrize("window, quantum", [(2048, 8), (64, 8), (16, 1)])
def test_packing_of_hard_rows(hard, hard_rows, nothing, window, quantum):
    docs = defaultdict(list)
    for i, text, _ in hard_rows:
        docs[i].append(text)
    check_packing(op9.pack(hard, window=window, quantum=quantum).collect(), docs, window)
    assert op9.pack(nothing).count() == 0


def test_packing_of_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(op9, "GROUP", 20)  # so that there are several greedy groups
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: [r.text] for r in frame.collect()}
    used = check_packing(op9.pack(frame.repartition(4)).collect(), docs, op9.WINDOW)
    assert used > 0.9


def test_combinations_fill_the_window():
    found = op9.combinations(24)
    assert (found.sum(axis=1) == 24).all()
    assert len({tuple(sorted(c)) for c in found.tolist()}) == len(found)
    want = {
        tuple(sorted(x for x in (a, b, 24 - a - b) if x))
        for a in range(25)
        for b in range(25 - a)
    }
    assert {tuple(sorted(x for x in c if x)) for c in found.tolist()} == want


def test_counts_solve_least_squares():
    """A histogram made of combinations is used up, and counts are never negative."""
    rng = np.random.default_rng(0)
    combos = op9.combinations(32)
    truth = np.zeros(len(combos))
    truth[rng.choice(len(combos), 12, replace=False)] = rng.integers(100, 1000, 12)
    real = combos > 0
    histogram = np.bincount(combos.ravel(), (real * truth[:, None]).ravel(), 33)
    x = op9.solve_counts(combos, histogram)
    assert (x >= 0).all()
    made = np.bincount(combos.ravel(), (real * x[:, None]).ravel(), 33)
    assert np.abs(made - histogram).sum() < 0.01 * histogram.sum()
    ranges, sequences = op9.allot(histogram)
    left = sum(histogram[b] - own[0][-1] for b, own in ranges.items())
    assert sequences and left < 0.05 * histogram.sum()


def test_best_fit_is_tight():
    numbers = op9.best_fit([5, 5, 3, 7, 2, 8], 10)
    filled = Counter()
    for length, number in zip([5, 5, 3, 7, 2, 8], numbers, strict=True):
        filled[number] += length
    assert sorted(filled.values()) == [10, 10, 10]


def test_a_worker_keeps_the_memos_of_one_operator():
    """Else a stage would run beside what the stages before it have kept."""
    shared.begin_task("op9")
    packed_ids_of_many(WORD)(["some words"])
    kept = [tokens.library, tokens._chunk_encoder, tokens._chunk_memo, tokens._word_memo]
    sizes = [f.cache_info().currsize for f in kept]
    assert all(sizes)
    shared.begin_task("op9")
    assert [f.cache_info().currsize for f in kept] == sizes
    list(op10.answers(["some words"], {"en": "words", "fr": "mots"}))
    shared.begin_task("op10")
    assert not any(f.cache_info().currsize for f in (*kept, op10.reader))
