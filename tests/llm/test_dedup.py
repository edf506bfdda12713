"""Exact copies, near copies and near vectors against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from pagelens.llm import op1, op3, op8
from pagelens.llm.shared import connected_components, fold

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("size, digest_bytes", [(4096, 32), (64, 32), (64, 1), (7, 2)])
def test_exact_copies(spark, hard, hard_rows, size, digest_bytes):
    got = op1.exact_copies(hard, size=size, digest_bytes=digest_bytes).collect()
    assert len(got) == len(hard_rows)
    groups: dict = {}
    for i, text, _ in hard_rows:
        groups.setdefault((text or "").translate(LOWER), []).append(i)
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        sha = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, max(known) if known else None, len(ids), sha) for i in ids]
        members = [r for r in got if r.text_sha256 == sha]
        assert sum(r.kept for r in members) == 1
        assert all(r.doc_id == r.keep_id for r in members if r.kept)
    assert sorted(map(repr, want)) == sorted(
        repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got
    )


def test_exact_copies_of_nothing(nothing):
    assert op1.exact_copies(nothing).count() == 0
    assert op1.drop_copies(nothing).count() == 0


def test_drop_copies_keeps_all_columns(hard, hard_rows):
    """Of each text the row with the largest doc_id, a null being the smallest."""
    kept = op1.drop_copies(hard)
    assert kept.columns == hard.columns
    rows = kept.collect()
    assert all(r[c] == c for r in rows for c in hard.columns[3:])
    want: dict = {}
    for i, text, _ in hard_rows:
        key = (text or "").translate(LOWER)
        want[key] = max(want.get(key, -1), -1 if i is None else i)
    got = [((r.text or "").translate(LOWER), -1 if r.doc_id is None else r.doc_id) for r in rows]
    assert sorted(got) == sorted(want.items())


def test_drop_near_copies_keeps_all_columns(hard, hard_rows):
    """One row of each component, and all rows without words that differ."""
    kept = op3.drop_near_copies(hard)
    assert kept.columns == hard.columns
    rows = kept.collect()
    assert all(r[c] == c for r in rows for c in hard.columns[3:])
    different = list(dict.fromkeys((i, t) for i, t, _ in hard_rows))
    sets, component = near_brute(list(enumerate(t for _, t in different)))
    order = lambda i: (i is None, i or 0)
    want = []
    for root in set(component.values()):
        members = [different[n] for n in component if component[n] == root]
        want.append(min(members, key=lambda x: order(x[0])))
    assert sorted(map(repr, ((r.doc_id, r.text) for r in rows))) == sorted(map(repr, want))


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near_brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = []
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= 75 * len(sets[a] | sets[b]):
                links.append((a, b))
    return sets, roots(ids, links)


def check_near(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets, component = near_brute(rows)
    got = {r.doc_id: r for r in op3.near_copies(docs, **options).collect()}
    assert {i: r.component_id for i, r in got.items()} == component
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def copies(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("options", [{}, {"short": 2}, {"short": 1000}, {"k": 16, "short": 4}])
def test_near_copies_meet_brute_force(spark, options):
    """Groups of several tightness, a passage in many documents, short and equal texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for group in range(12):
        base = " ".join(word() for _ in range(rng.choice([6, 20, 80, 300])))
        rows += [copies(rng, base, rng.randrange(group + 1)) for _ in range(8)]
    passage = " ".join(word() for _ in range(60))
    for n in range(90):
        rows.append(" ".join([passage, *(word() for _ in range(rng.choice([10, 25, 60])))]))
    rows += ["a b c", "A b  c", "a b c d", "", " ", "a b c d e f"]
    check_near(spark, list(enumerate(rows)), **options)


def test_near_copies_of_hard_rows(hard, hard_rows, nothing):
    got = op3.near_copies(hard).collect()
    assert len(got) == len(hard_rows)
    component = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert component[3, 196] == 1 and component[2, 196] == 1
    assert [r.component_id for r in got if r.doc_id == 10] == [9]
    assert [r.component_id for r in got if r.doc_id == 8] == [7]
    assert all(r.kept and r.component_id == r.doc_id for r in got if r.n_shingles == 0)
    assert sorted(r.kept for r in got if r.doc_id is None) == [False, *[True] * 4]
    assert op3.near_copies(nothing).count() == 0 and op3.drop_near_copies(nothing).count() == 0


def test_needed_values_never_miss():
    """Draws of linked pairs at the limit share at least as many values as asked for."""
    rng = np.random.default_rng(0)
    for size in (5, 40, 64, 90, 300, 5000):
        union = size * 100 // 75
        for _ in range(200):
            order = rng.permutation(union)
            a = set(order[:size].tolist())
            common = -(-75 * union // 100)
            b = set(order[size - common :].tolist())
            x, y = sorted(a)[:64], sorted(b)[:64]
            need = max(op3.needed(len(a)), op3.needed(len(b)))
            assert len(set(x) & set(y)) >= need


@pytest.mark.parametrize("seed", range(4))
def test_components_meet_brute_force(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(1, 30))]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == roots(nodes, [x for x in links if x[0] != x[1]])


def test_long_chain_is_one_component(spark):
    frame = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    rows = connected_components(frame).collect()
    assert len(rows) == 301 and {r.component for r in rows} == {0}


def vector_rows(seed):
    rng = np.random.default_rng(seed)
    rows, label = [], 0
    for label in (0, 1, 2):
        for _ in range(25):
            centre = rng.standard_normal(64)
            for size in rng.choice([0.0, 0.05, 0.12, 0.17, 0.2, 0.22], rng.integers(1, 9)):
                rows.append((centre + size * rng.standard_normal(64), label))
    rows += [(rows[0][0], 0), (rows[0][0] * 3, 0), (rows[0][0], 1), (rows[0][0], None)]
    out = [(i, [float(np.float32(x)) for x in v], k) for i, (v, k) in enumerate(rows)]
    n = len(out)
    bad = [None, [], [0.0] * 64, [float("nan"), *[1.0] * 63], [float("inf")] * 64, [None, 1.0]]
    out += [(n + i, v, 0) for i, v in enumerate(bad)]
    out += [(n + 10, [1.0, 0.0], 0), (n + 11, [2.0, 0.0], 0), (n + 12, [1.0], 0), (n + 13, [-1.0], 0)]
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_near_vectors_meet_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(op8, "BLOCK", block)
    rows = vector_rows(3)
    good = {
        i: (np.array(v, float), k)
        for i, v, k in rows
        if v and k is not None and None not in v and np.isfinite(v).all() and any(v)
    }
    links = []
    for a, (x, k) in good.items():
        for b, (y, m) in good.items():
            if a < b and k == m and len(x) == len(y):
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    links.append((a, b))
    assert len(links) > 60
    component = roots([r[0] for r in rows], links)
    number = {i: sum(i in pair for pair in links) for i in component}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in op8.near_vectors(frame.repartition(3)).collect()}
    assert {i: r.component_id for i, r in got.items()} == component
    assert {i: r.n_links for i, r in got.items()} == number
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert op8.near_vectors(frame.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    """Over rotations, the mean estimate is the product, and the bound holds."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal(32)
    y = x + 0.15 * rng.standard_normal(32)
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    estimates = []
    for _ in range(400):
        turn = np.linalg.qr(rng.standard_normal((32, 32)))[0]
        a, b = x @ turn, y @ turn
        factor = np.abs(a).sum() / np.sqrt(32)
        estimates.append(np.where(a >= 0, b, -b).sum() / np.sqrt(32) / factor)
        assert op8.undecided((a >= 0)[None], np.array([factor]), b[None], x @ y)[0]
    assert abs(np.mean(estimates) - x @ y) < 0.01


def test_folds_take_null_keys(spark):
    frame = spark.createDataFrame([(None,), (7,)], "k long")
    assert all(0 <= r[0] < 5 for r in frame.select(fold(frame.k, 5)).collect())
