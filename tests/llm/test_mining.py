"""Hard negatives, URL rules and the divergence audit against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pagelens.llm import blooms, op11, op12, op13


def clashing(frame, *names):
    from pyspark.sql import functions as F

    return frame.select("*", *[F.lit("x").alias(n) for n in names if n not in frame.columns])


# Bloom filter


@pytest.mark.parametrize("most", [1 << 20, 64])
def test_a_filter_never_misses(spark, most):
    keys = [f"key {i}".encode() for i in range(5000)]
    frame = spark.createDataFrame([(k,) for k in keys], "k binary").repartition(3)
    found = blooms.build(frame, len(keys), most)
    assert found.words.nbytes <= max(most, 32)
    assert found.may_hold(keys).all()
    strangers = found.may_hold(f"other {i}".encode() for i in range(5000)).mean()
    assert strangers < 0.005 if most > 64 else strangers > 0.9


def test_a_filter_of_nothing(spark):
    found = blooms.build(spark.createDataFrame([], "k binary"), 0)
    assert not found.may_hold([b"", b"x"]).any() and len(found.may_hold([])) == 0


# Hard negatives


@pytest.mark.parametrize("size, bits", [(2, 3), (3, 2), (4, 2)])
def test_the_hilbert_curve_visits_neighbours(size, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * size, indexing="ij"), -1)
    cells = cells.reshape(-1, size)
    places = [x.tobytes() for x in op11.hilbert(cells, bits)]
    assert len(set(places)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=places.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(1)
    rows = rng.integers(-9, 9, (50, 6))
    anchors = rng.integers(-9, 9, (7, 6))
    low, high = rows.min(axis=0)[None], rows.max(axis=0)[None]
    least, most = op11.bounds(anchors, low, high)
    scores = anchors @ rows.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= most[:, 0]).all()


def test_large_numbers_multiply_exactly():
    big = np.array([[2**30, 3]])
    assert op11._product(big, big)[0, 0] == 2**60 + 9


def mined(rows, positives, negatives, low=30, high=90):
    """By definition, over ``(vec_id, vector, label)``."""
    usable = []
    for place, (i, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.append((np.inf if i is None else i, place, label, [int(np.floor(256 * x)) for x in v]))
    out = []
    for i, place, label, v in usable:
        if i % 100:
            continue
        scored = [
            (-sum(a * b for a, b in zip(v, w, strict=True)), j, at, other)
            for j, at, other, w in usable
            if at != place and len(w) == len(v)
        ]
        for p in sorted(x for x in scored if x[3] == label)[:positives]:
            score = -p[0]
            fit = [x for x in sorted(scored) if x[3] != label]
            fit = [x for x in fit if low * score <= -100 * x[0] <= high * score][:negatives]
            out += [(i, p[1], r, n[1], score, -n[0]) for r, n in enumerate(fit, 1)]
    none = lambda x: None if x == np.inf else x
    return sorted(repr((none(a), none(b), c, none(d), e, f)) for a, b, c, d, e, f in out)


def hard_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(5).tolist(), int(rng.integers(3))) for i in range(420)]
    rows += [(i, [1.0, 0.5, 0.0, 0.0, -0.0], 1) for i in range(420, 501)]  # ties
    rows += [(200, rng.standard_normal(5).tolist(), 2)] * 2  # repeated anchors
    rows += [
        (None, [0.5] * 5, 1),
        (600, None, 1),
        (700, [1.0] * 5, None),
        (800, [1.0, None, 0.0, 0.0, 0.0], 1),
        (900, [1.0, float("nan"), 0.0, 0.0, 0.0], 1),
        (1000, [float("inf")] * 5, 2),
        (1100, [], 1),
        (1101, [], 1),
        (1102, [], 2),
        (1200, [1.0, 2.0], 1),
        (1201, [1.0, 3.0], 1),
        (1202, [1.0, 1.0], 2),
        (1300, [-1.0] * 5, 4),  # alone in its label
    ]
    return rows


@pytest.mark.parametrize("block, group", [(1024, 256), (16, 2), (1, 1)])
def test_hard_negatives(spark, block, group):
    rows = hard_vectors()
    if block == 1:
        rows = rows[::4]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    frame = clashing(frame.repartition(5), "rid", "id", "size", "place", "block", "group", "from")
    found, _ = op11.mine(frame, "vec_id % 100 = 0", 5, 10, block=block, group=group)
    got = sorted(map(repr, map(tuple, found.collect())))
    assert got == mined(rows, 5, 10)


def test_hard_negatives_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert op11.mine(frame, "vec_id % 100 = 0")[0].count() == 0
    frame = spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], frame.schema)
    assert op11.mine(frame, "vec_id % 100 = 0")[0].count() == 0


def test_zone_maps_leave_blocks_out(spark):
    """Of clusters that lie apart, an anchor's windows meet few; the result is the same."""
    rng = np.random.default_rng(2)
    centres = 3 * rng.standard_normal((40, 8))
    rows = [
        (i, (centres[i % 40] + 0.02 * rng.standard_normal(8)).tolist(), i % 2) for i in range(2000)
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found, read = op11.mine(frame, "vec_id % 100 = 0", 3, 4, block=25, group=1)
    assert sorted(map(repr, map(tuple, found.collect()))) == mined(rows, 3, 4)
    # 20 anchors; of the other label, each could meet 40 blocks.
    assert 20 <= read.count() < 0.4 * 20 * 40


def test_components_beyond_the_range_are_held():
    held = op11._whole(np.array([[1e300, -1e300, 0.1]]), 256)[0]
    limit = int(held[0])
    assert held.tolist() == [limit, -limit, 25] and 100 * 3 * limit * limit < 2**63


# URL rules

RULES = [
    ("net", "/", "block"),
    ("Example.NET", "/en/", "allow"),
    ("a.example.net", "/en/private", "block"),
    ("org", None, "block"),
    ("org", "/fr/", "allow"),
    ("twice.com", "/", "allow"),
    ("twice.com", "/", "block"),
    ("", "/", "block"),
    (None, "/", "block"),
]
URLS = [
    None,
    "",
    "no scheme",
    "http://net/",
    "http://net",
    "http://x.net?q=/",
    "https://EXAMPLE.net/en/",
    "https://a.example.net/en/private/1#/x",
    "https://b.a.example.net/en/pri",
    "https://notexample.net/en/1",
    "https://x.org",
    "https://x.org/fr/1",
    "https://org./fr/1",
    "ftp://twice.com/",
    "http://sub.twice.com:80/",
    "http://É.net/É",
    "a://b://net/",
    "http:///path",
    "http://" + "a." * 20_000 + "net/" + "x" * 100_000,
    "http://net./",
    "http://x.net/\n/y",
]


def judged(url, rules):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1].translate(op12.LOWERED), found[2]) if found else ("", "")
    hits = []
    for rule, start, action in rules:
        own = (rule or "").translate(op12.LOWERED)
        if own and (host == own or host.endswith("." + own)) and path.startswith(start or ""):
            hits.append((len(own + (start or "")), len(own), action == "block", own + (start or "")))
    if not hits:
        return host, path, None, "allow"
    best = max(hits)
    return host, path, best[3], "block" if best[2] else "allow"


def test_url_rules(spark):
    rng = random.Random(3)
    part = lambda n: "".join(rng.choice("ab./") for _ in range(rng.randrange(n)))
    rules = RULES + [
        (part(5).replace("/", "") + "b", "/" + part(4), rng.choice(["allow", "block"]))
        for _ in range(200)
    ]
    urls = URLS + [f"h://{part(9)}b/{part(9)}" for _ in range(600)]
    pages = spark.createDataFrame(
        [(None if i == 5 else i, u) for i, u in enumerate(urls)] + [(5, "http://net/")] * 2,
        "page_id long, url string",
    )
    pages = clashing(pages.repartition(3), "rid", "host", "rule", "possible", "action", "hit")
    listed = clashing(
        spark.createDataFrame(rules, "host string, path string, action string"), "rid", "rule", "key"
    )
    got = sorted(map(repr, map(tuple, op12.judge(pages, listed).collect())))
    want = [(None if i == 5 else i, *judged(u, rules)) for i, u in enumerate(urls)]
    want += [(5, *judged("http://net/", rules))] * 2
    assert got == sorted(map(repr, want))


def test_url_rules_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://net/"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    assert op12.judge(pages.limit(0), rules).count() == 0
    found = op12.judge(pages, rules.limit(0), "block").collect()
    assert [(r.rule, r.verdict) for r in found] == [(None, "block")] * 2


def test_blocked_pages_go(spark):
    rows = [(1, "http://net/", "x"), (1, "http://net/", "x"), (2, None, None), (3, "h://b/", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    kept = op12.drop_blocked(pages, rules)
    assert kept.columns == pages.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, rows[2:]))


# Divergence audit


def audited(rows, least, top):
    """By definition, over ``(text, lang, source)``."""
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [t.translate(op12.LOWERED) for t in pattern.findall(text or "")]
        groups[lang].add(source)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def share(held, kept=kept):
            total = sum(held[t] for t in kept)
            return {t: 1 + 10**9 * (held[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            gap = lambda x, y: (x - y) ** 2 // y
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [
                (-gap(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]
            ]
            order = lambda x: (x[0], x[1].encode())
            out += [(lang, s, "pair", o, -v, r) for r, (v, o) in enumerate(sorted(pairs, key=order), 1)]
            out += [
                (lang, s, "term", t, -v, r)
                for r, (v, t) in enumerate(sorted(terms, key=order)[:top], 1)
            ]
    return sorted(map(repr, out))


def audit_rows():
    rng = random.Random(7)
    stems = ["a", "ab", "abc", "abcd", "abcde", "Zoë", "中文", "x" * 50, "x" * 49 + "y", "😀", "é"]
    rows = []
    for i in range(300):
        words = [rng.choice(stems) + rng.choice(["", "s", "ing", "ß"]) for _ in range(rng.randrange(30))]
        rows.append((rng.choice(" 1\n-").join(words), rng.choice(["en", "de"]), f"s{rng.randrange(5)}"))
        if i % 9 == 0:
            rows.append((rows[-1][0], None, None if i % 2 else "s1"))
    rows += [(None, "en", "s9"), ("", "en", "s9"), ("only here", "xx", "s1"), ("", "xx", "s2")]
    rows += [("long " * 30_000 + "tail", "de", "s1")] * 3
    rows += [("y" * 30_000, "de", "s2")] * 3
    return rows


@pytest.mark.parametrize("least, top, bounds", [(3, 200, ()), (2, 4, (400, 2, 3))])
def test_audit(spark, least, top, bounds):
    rows = audit_rows()
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    frame = clashing(frame, "doc_id", "term", "prefix", "at", "kinds", "n", "docs", "value", "rank")
    got = sorted(map(repr, map(tuple, op13.audit(frame, least, top, *bounds).collect())))
    assert got == audited(rows, least, top)


def test_audit_with_a_full_filter(spark, monkeypatch):
    """Prefixes that pass a filter by chance change nothing."""
    build = blooms.build
    monkeypatch.setattr(op13.blooms, "build", lambda keys, n, most=32: build(keys, n, 32))
    rows = audit_rows()[:80]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(repr, map(tuple, op13.audit(frame).collect()))) == audited(rows, 3, 200)


def test_chunks_of_a_task_are_added_up_before_they_are_sent(spark):
    """Each bounded run of chunks sends a language's prefix or cell once."""
    frame = spark.createDataFrame(audit_rows(), "text string, lang string, source string").coalesce(1)
    bags = op13._bags(frame.fillna(""), 400).cache()
    assert bags.count() > 40
    kept = op13._refined(bags, 3).cache()
    sent = []
    for together in (op13.TOGETHER, 60, 1):
        cells = sorted(map(tuple, op13._cells(bags, kept, together).collect()))
        level = sorted(map(tuple, op13._level(bags, 4, 0, None, together).collect()))
        sent.append((cells, level))
    assert sent[0] == sent[1] == sent[2]
    parts = [("en", 2, "x"), ("de", 1, "y"), ("en", 1, "z"), ("en", 1, "w")]
    batch = lambda lang, own: pa.RecordBatch.from_pydict({"at": [lang + "".join(own)]})
    for limit, want in ((9, ["dey", "enxzw"]), (3, ["dey", "enx", "enzw"]), (1, ["enx", "dey", "enz", "enw"])):
        assert [b["at"][0].as_py() for b in op13._added(iter(parts), batch, limit)] == want


def test_hashes_of_arrays_by_definition(monkeypatch):
    """Values cut by the steps, longer than them or empty; the same with and without offsets."""

    def plain(value, seed):
        total = seed
        for place, byte in enumerate(value, 1):
            x = (place << 8 | byte) * int(blooms.MIXER) % 2**64
            x = (x ^ x >> 32) * int(blooms.STIRRER) % 2**64
            total += x ^ x >> 29
        total %= 2**64
        total = (total ^ total >> 32) * int(blooms.STIRRER) % 2**64
        return total ^ total >> 29

    rng = random.Random(3)
    values = [b"", b"", b"\0", b"a", b"\0a", b"a\0", "Zoë".encode(), b"", b"ab" * 40, b"ba" * 40, b""]
    values += [rng.randbytes(rng.randrange(20)) for _ in range(200)]
    seeds = np.array([rng.randrange(2**64) for _ in values], np.uint64)
    want = [plain(v, int(s)) for v, s in zip(values, seeds)]
    for step in (blooms.STEP, 64, 7, 1):
        monkeypatch.setattr(blooms, "STEP", step)
        for kind in (pa.binary(), pa.large_binary()):
            for low, high in ((0, len(values)), (1, 60), (9, 10), (5, 5)):
                part = pa.array(values, kind)[low:high]
                assert blooms.hashes_of_array(part, seeds[low:high]).tolist() == want[low:high]
    same = blooms.hashes_of_array(pa.array(values, pa.binary()), seeds[:1]).tolist()
    assert len(set(same)) == len(set(values))


def test_prefixes_of_a_chunk_are_hashed_together(spark, monkeypatch):
    """One look at the language, none at each prefix; the filter knows all its keys."""
    keys = [(lang, b"%d" % i) for lang in ("en", "", "Zoë") for i in range(2000)]
    frame = spark.createDataFrame([(x, bytearray(p)) for x, p in keys], "lang string, prefix binary")
    known = op13._filter(frame.repartition(3), "prefix", len(keys))
    calls = []
    digest = blooms.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(blooms.xxhash, "xxh3_64_intdigest", lambda x: calls.append(x) or digest(x))
    for lang in ("en", "", "Zoë"):
        parts = pa.array([p for x, p in keys if x == lang], pa.binary())
        assert known.may_hold_hashes(blooms.hashes_of_parts(lang, parts)).all()
    strangers = [("de", pa.array([p for _, p in keys], pa.binary()))]
    strangers += [("en", pa.array([b"%d" % i for i in range(2000, 8000)], pa.binary()))]
    passed = [known.may_hold_hashes(blooms.hashes_of_parts(*s)).mean() for s in strangers]
    assert max(passed) < 0.01
    assert len(calls) == 5


def test_numbers_of_a_bag_take_few_bytes(spark):
    for largest, width in ((0, 1), (255, 1), (256, 2), (65535, 2), (65536, 4), (2**32 - 1, 4)):
        numbers = np.array([0, largest, 3], np.int64)
        packed = op13._packed(numbers)
        assert len(packed) == 3 * width
        assert op13._unpacked(packed, 3).tolist() == numbers.tolist()
    assert op13._unpacked(op13._packed(numbers[:0]), 0).tolist() == []
    rows = [("a " * 300 + "b", "en", "x")] + [(f"w{chr(97 + i % 26)}" * (i + 1), "en", "x") for i in range(300)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    bag = op13._bags(frame).first()
    assert bag["terms"].endswith(b"\0")
    # 302 pairs of a document and a term; a text holds "a" 300 times.
    assert (len(bag["term"]), len(bag["times"])) == (604, 604)


def test_audit_of_nothing(spark):
    frame = spark.createDataFrame([], "text string, lang string, source string")
    assert op13.audit(frame).count() == 0
    frame = spark.createDataFrame([("a", "en", "x"), (None, "en", "y")], frame.schema)
    found = op13.audit(frame).collect()
    assert sorted((r.source, r.item, r.value, r.rank) for r in found) == [("x", "y", 0, 1), ("y", "x", 0, 1)]
