"""How sources of a language differ: terms by iceberg prefix refinement, exact divergences.

A term is kept if enough documents of its language hold it. Most terms are not, so they are
never counted whole: level by level, prefixes of the terms' bytes are counted by distinct
documents, and only prefixes that reach the threshold are extended. A term ends in a byte
that no term holds, so a prefix with that byte is a complete term; one that reaches the
threshold is kept. No term has more documents than its prefixes, so none is lost.

Tasks learn which prefixes go on from a Bloom filter of bounded size. A discarded prefix
that passes it costs work and nothing else, as each level's counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.llm import blooms
from pagelens.llm.shared import store, table
from pagelens.llm.tokens import word_codes

#: Documents of a language that a kept term is in, at least.
LEAST = 3
#: Ranks of a group's terms.
TOP = 200
#: Bytes of the first level's prefixes; each level doubles them.
FIRST = 4
SCALE = 1_000_000_000
#: Bytes of text whose terms are numbered together.
CHUNK_BYTES = 8 << 20
#: Counts that a task holds before it adds up those of different chunks and sends them.
TOGETHER = 1 << 21
#: Rows that are sent at once.
ROWS = 1 << 16
#: Sources of a language, and about how many terms, that meet in one group.
SOURCES, TERMS = 64, 4096
#: Bytes of terms: A-Z as a-z, those of other letters as they are, all else as a space.
BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Behind a term; no term holds it, and no byte is smaller.
STOP = b"\0"


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0, each in as few bytes as the largest asks for."""
    return numbers.astype(np.min_scalar_type(numbers.max(initial=0))).tobytes()


def _unpacked(packed: bytes, number: int) -> np.ndarray:
    """The ``number`` numbers, as long as they are packed."""
    return np.frombuffer(packed, f"u{len(packed) // number}" if number else np.uint8)


class _Chunk:
    """Documents of one language."""

    def __init__(self):
        self.texts, self.sources = [], []

    def add(self, source: str, text: bytes | None) -> None:
        self.texts.append(text or b"")
        self.sources.append(source)

    def row(self, lang: str) -> pa.RecordBatch:
        """The terms in order, and by document which of them it holds how often."""
        terms, docs = word_codes(self.texts, BYTES)
        order = pc.array_sort_indices(terms.dictionary)  # a space stands before all letters
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        width = max(1, len(order))
        code = docs * width + rank[terms.indices.to_numpy()]
        pair, times = np.unique(code, return_counts=True)
        ends, names = blooms.flat(terms.dictionary.take(order))
        names = names[: ends[-1]].tobytes().replace(b" ", STOP)
        # Packed, so that a row is a few long values for Spark. No text has 2^31 terms.
        sizes = np.bincount(pair // width, minlength=len(self.texts)).astype(np.int32)
        packed = (names, sizes.tobytes(), _packed(pair % width), _packed(times))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([lang], pa.string()),
                pa.array([self.sources], pa.list_(pa.string())),
                *(pa.array([x], pa.binary()) for x in packed),
            ],
            ["lang", "sources", *PACKED],
        )


#: Of a bag: the terms, each with ``STOP`` behind it, how many of them each document holds,
#: which, and how often.
PACKED = ("terms", "sizes", "term", "times")


def _bags(docs: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Documents as bags of terms: a row for each language of some documents of a task."""

    def run(batches):
        chunks: dict[str, _Chunk] = {}
        held = 0
        for batch in batches:
            langs, sources = (batch.column(i).to_pylist() for i in (0, 1))
            for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
                text = text.as_buffer()
                text = text and text.to_pybytes()
                chunks.setdefault(lang, _Chunk()).add(source, text)
                held += len(text or b"") + 1
                if held >= chunk:
                    yield from (chunks[x].row(x) for x in sorted(chunks))
                    chunks, held = {}, 0
                    pa.default_memory_pool().release_unused()
        yield from (chunks[x].row(x) for x in sorted(chunks))

    schema = "lang string, sources array<string>, " + ", ".join(f"{c} binary" for c in PACKED)
    return docs.select("lang", "source", "text").mapInArrow(run, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(lang, terms, doc, term, rest)`` of each row of ``lang, terms, sizes, term`` and more.

    ``terms`` end in ``STOP``. ``doc`` and ``term`` are parallel arrays, in order; ``rest``
    are the other columns' values.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            lang, terms, sizes, term, *rest = (c[i] for c in batch.columns)
            names = terms.as_buffer()
            stops = np.flatnonzero(np.frombuffer(names, np.uint8) == STOP[0])
            ends = pa.py_buffer(np.append(0, stops + 1).astype(np.int32))
            terms = pa.Array.from_buffers(pa.binary(), len(stops), [None, ends, names])
            sizes = np.frombuffer(sizes.as_py(), np.int32)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            yield lang.as_py(), terms, doc, _unpacked(term.as_py(), len(doc)), rest
        pa.default_memory_pool().release_unused()


def _prefixes(terms: pa.Array, length: int) -> pa.Array:
    return pc.binary_slice(terms, 0, length)


def _numbered(arrays: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values of all the arrays, and for each array which of them it holds."""
    whole = pa.concat_arrays(arrays).dictionary_encode()
    ends = np.cumsum([len(a) for a in arrays])
    return whole.dictionary, np.split(whole.indices.to_numpy().astype(np.int64), ends[:-1])


def _added(found: Iterator[tuple], add, limit: int) -> Iterator[pa.RecordBatch]:
    """``add(lang, parts)`` for the parts of each language of ``found``, which gives
    ``(lang, number of counts, part)``; about ``limit`` counts are held."""
    parts: dict[str, list] = {}
    held = 0
    for lang, number, part in found:
        parts.setdefault(lang, []).append(part)
        held += number
        if held >= limit:
            yield from _sliced(add, parts)
            parts, held = {}, 0
    yield from _sliced(add, parts)


def _sliced(add, parts: dict[str, list]) -> Iterator[pa.RecordBatch]:
    for lang in sorted(parts):
        batch = add(lang, parts.pop(lang))
        for low in range(0, batch.num_rows, ROWS):
            yield batch.slice(low, ROWS)


def _complete(part: str) -> Column:
    return F.expr(f"substring({part}, -1, 1) = X'00'")


def _level(
    bags: DataFrame, length: int, before: int, going: blooms.Blocked | None, together: int = TOGETHER
) -> DataFrame:
    """``(lang, prefix, docs)``: distinct documents of the prefixes that may still be kept.

    ``going`` holds the prefixes of ``before`` bytes that are extended; none at first.
    """

    def found_in(batches):
        for lang, terms, doc, term, _ in _rows(batches):
            if going is not None and len(terms):
                # The others were complete before, so decided.
                wanted = pc.binary_length(terms).to_numpy(False) > before
                last = _prefixes(terms.filter(pa.array(wanted)), before)
                wanted[wanted] = going.may_hold_hashes(blooms.hashes_of_parts(lang, last))
                # Ranks of the terms that go on, which stay in order.
                rank = np.cumsum(wanted) - 1
                stays = wanted[term]
                doc, term = doc[stays], rank[term[stays]]
                terms = terms.filter(pa.array(wanted))
            if not len(terms):
                continue
            prefix = _prefixes(terms, length)
            new = np.append(True, pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(False))
            code = (np.cumsum(new) - 1)[term]
            # Terms of a document are in order, so equal prefixes are neighbours.
            first = np.ones(len(doc), bool)
            first[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
            counts = np.bincount(code[first], minlength=int(new.sum()))
            yield lang, len(counts), (prefix.filter(pa.array(new)), counts)

    def add(lang, parts):
        prefixes, at = _numbered([p for p, _ in parts])
        total = np.zeros(len(prefixes), np.int64)
        for own, (_, counts) in zip(at, parts, strict=True):
            total[own] += counts  # a part's prefixes are distinct
        return pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([lang] * len(total), pa.string()),
                "prefix": prefixes,
                "docs": pa.array(total, pa.int64()),
            }
        )

    def run(batches):
        yield from _added(found_in(batches), add, together)

    # A document is in one row, so the rows' counts add up to distinct documents.
    read = bags.select("lang", "terms", "sizes", "term")
    found = read.mapInArrow(run, "lang string, prefix binary, docs long")
    return found.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs"))


def _filter(frame: DataFrame, part: str, number: int) -> blooms.Blocked:
    return blooms.build(frame.select("lang", F.expr(part).alias("part")), number)


def _refined(bags: DataFrame, least: int, together: int = TOGETHER) -> DataFrame:
    """``(lang, term, docs)`` of the kept terms; ``term`` is binary."""
    length, before, going = FIRST, 0, None
    kept = None
    while True:
        counted = _level(bags, length, before, going, together).where(F.col("docs") >= least)
        counted = store(counted, f"prefixes-{length}")
        whole = counted.where(_complete("prefix")).select(
            "lang", F.expr("substring(prefix, 1, length(prefix) - 1)").alias("term"), "docs"
        )
        kept = whole if kept is None else kept.union(whole)
        rest = counted.where(~_complete("prefix"))
        number = rest.count()
        if not number:
            return kept
        going = _filter(rest, "prefix", number)
        length, before = 2 * length, length


def _cells(bags: DataFrame, kept: DataFrame, together: int = TOGETHER) -> DataFrame:
    """``(lang, term, source, n, whole)``: occurrences of kept terms, by group and in all.

    Groups that do not hold a term have no row.
    """
    wanted = _filter(kept, "concat(term, X'00')", kept.count())

    def found_in(batches):
        for lang, terms, doc, term, (times, sources) in _rows(batches):
            if not len(terms):
                continue
            times = _unpacked(times.as_py(), len(term)).astype(np.int64)
            may = wanted.may_hold_hashes(blooms.hashes_of_parts(lang, terms))
            stays = may[term]
            if not stays.any():
                continue
            named = sources.values.dictionary_encode()
            source = named.indices.to_numpy()[doc[stays]].astype(np.int64)
            code = source * len(terms) + term[stays]
            order = np.argsort(code, kind="stable")
            code = code[order]
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            code, total = code[starts], np.add.reduceat(times[stays][order], starts)
            used, at = np.unique(code % len(terms), return_inverse=True)
            owner = (code // len(terms)).astype(np.int32)
            own = (named.dictionary, owner, terms.take(pa.array(used)), at.astype(np.int32), total)
            yield lang, len(code), own

    def add(lang, parts):
        names, name_at = _numbered([p[0] for p in parts])
        terms, term_at = _numbered([p[2] for p in parts])
        width = len(terms)
        terms = pc.binary_slice(terms, 0, -1)  # without its end
        code = np.concatenate(
            [n[p[1]] * width + t[p[3]] for p, n, t in zip(parts, name_at, term_at, strict=True)]
        )
        total = np.concatenate([p[4] for p in parts])
        if len(parts) > 1:
            order = np.argsort(code, kind="stable")
            code = code[order]
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            code, total = code[starts], np.add.reduceat(total[order], starts)
        return pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([lang] * len(code), pa.string()),
                "source": names.take(pa.array(code // width)),
                "term": terms.take(pa.array(code % width)),
                "n": pa.array(total, pa.int64()),
            }
        )

    def run(batches):
        yield from _added(found_in(batches), add, together)

    read = bags.select("lang", "terms", "sizes", "term", "times", "sources")
    found = read.mapInArrow(run, "lang string, source string, term binary, n long")
    # Chunks are summed already. A term's groups meet in one place for all that follows.
    found = found.repartition("lang", "term")
    found = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    # The filter lets some strangers pass.
    found = found.join(kept.select("lang", "term"), ["lang", "term"], "left_semi")
    whole = F.sum("n").over(Window.partitionBy("lang", "term"))
    return found.withColumn("whole", whole)


def _share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kinds)), in exact arithmetic."""
    above, below = count + 1, F.greatest(total + kinds, F.lit(1))
    divided = lambda kind: F.call_function(
        "div", F.lit(SCALE).cast(kind) * above.cast(kind), below.cast(kind)
    )
    # The product fits a long if the divisor, which is not smaller, is below 2^33.
    return F.when(below < 1 << 33, divided("long")).otherwise(divided("decimal(19,0)")) + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _unit(key: tuple, rows: pa.Table, width: int) -> pa.Table:
    """Sums of divergences over the terms here, for the pairs of two blocks of ``width`` sources.

    The rows without a term give each source's share of a term that it does not hold.
    """
    _, lang, low, high = (k.as_py() for k in key)
    names = rows["term"].combine_chunks().dictionary_encode()
    term, at = names.indices.to_numpy(), rows["at"].to_numpy()
    p = rows["p"].to_numpy()
    blank = names.dictionary.index(b"").as_py()
    head = term == blank
    owners, first = np.unique(at[head], return_index=True)
    none = p[head][first]
    row = term - (term > blank)
    shares = np.tile(none, (len(names.dictionary) - 1, 1))
    shares[row[~head], np.searchsorted(owners, at[~head])] = p[~head]
    out: dict[str, list] = {"at": [], "other": [], "value": []}
    block = owners // width
    sides = ((low, high),) if low == high else ((low, high), (high, low))
    for mine, theirs in sides:
        theirs = np.flatnonzero(block == theirs)
        q = shares[:, theirs]
        for i in np.flatnonzero(block == mine).tolist():
            gap = shares[:, i : i + 1] - q
            sums = (gap * gap // q).sum(axis=0)
            other = theirs != i
            out["at"].append(np.full(other.sum(), owners[i]))
            out["other"].append(owners[theirs[other]])
            out["value"].append(sums[other])
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out.values()]
    return pa.table(
        {
            "lang": pa.array([lang] * len(columns[0]), pa.string()),
            **{n: pa.array(c, pa.int64()) for n, c in zip(out, columns, strict=True)},
            "seen": pa.array(np.full(len(columns[0]), len(shares)), pa.int64()),
        }
    )


def _pairs(groups: DataFrame, cells: DataFrame, width: int, terms: int) -> DataFrame:
    """``(lang, source, item, value)`` for each ordered pair of a language's sources."""
    kinds = groups.agg(F.max("kinds").alias("k")).first()["k"] or 0
    parts = max(1, -(-kinds // terms))
    # A language's sources meet block by block, a bounded number of terms at a time.
    heads = groups.where("kinds > 0").select(
        "lang", "at", "blocks", F.lit(b"").alias("term"), F.col("none").alias("p"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    )
    rows = cells.select(
        "lang", "at", "blocks", "term", "p",
        F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"),
    ).unionByName(heads)
    own = F.floor(F.col("at") / width).cast("int")
    rows = rows.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "lang", F.least(own, "partner").alias("low"), F.greatest(own, "partner").alias("high"),
        "part", "term", "at", "p",
    )
    units = rows.groupBy("part", "lang", "low", "high").applyInArrow(
        lambda key, unit: _unit(key, unit, width),
        "lang string, at long, other long, value long, seen long",
    )
    sums = units.groupBy("lang", "at", "other").agg(
        F.sum("value").alias("value"), F.sum("seen").alias("seen")
    )
    one = groups.select("lang", "source", "at", "kinds", F.col("none").alias("p"))
    other = groups.select(
        "lang", F.col("source").alias("item"), F.col("at").alias("other"), F.col("none").alias("q")
    )
    # Each pair is a row of the result.
    pairs = one.join(other, "lang").where("at != other")
    pairs = pairs.join(store(sums, "pair-sums"), ["lang", "at", "other"], "left")
    # Terms that neither source holds have the same value.
    unseen = (F.col("kinds") - F.col("seen")) * _divergence(F.col("p"), F.col("q"))
    return pairs.select(
        "lang", "source", "item", F.coalesce(F.col("value") + unseen, F.lit(0)).alias("value")
    )


def audit(
    docs: DataFrame,
    least: int = LEAST,
    top: int = TOP,
    chunk: int = CHUNK_BYTES,
    width: int = SOURCES,
    terms: int = TERMS,
    together: int = TOGETHER,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of the groups of ``docs(text, lang, source)``.

    A term is a run of letters (A-Z, lowered, and all characters beyond ASCII); a language
    keeps the terms that at least ``least`` of its documents hold. A group (lang, source),
    and the whole language, gives each kept term the smoothed share p = 1 + floor(1e9 *
    (occurrences + 1) / (all + kept terms)). The divergence of a term is floor((p - q)^2 / q).

    * ``part`` 'pair': the group against each other source of its language (``item``, whose
      shares are q), summed over all kept terms; all ranks.
    * ``part`` 'term': terms that the group holds and whose share is above the language's,
      q; ranks to ``top``.
    * Ranks go by value, descending, then by the item's UTF-8 bytes.

    ``chunk``, ``width``, ``terms`` and ``together`` bound what a task holds and change no result.

    A null text, lang or source counts as empty. Each row is a document, repeated ones and
    null doc_ids too. A language without kept terms has pairs of value 0 and no terms.
    Texts are read whole. An empty table gives no rows; other columns are ignored.
    """
    named = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        "text",
    )
    bags = store(_bags(named, chunk), "bags")
    kept = store(_refined(bags, least, together), "kept-terms")
    cells = store(_cells(bags, kept, together), "cells")

    kinds = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = Window.partitionBy("lang")
    groups = named.select("lang", "source").distinct()
    groups = groups.join(kinds, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select(
        "lang", "source",
        F.coalesce("kinds", F.lit(0)).alias("kinds"),
        F.coalesce("total", F.lit(0)).alias("total"),
        F.sum(F.coalesce("total", F.lit(0))).over(of_lang).alias("all"),
        (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long").alias("at"),
        F.ceil(F.count(F.lit(1)).over(of_lang) / width).cast("int").alias("blocks"),
    )
    none = _share(F.lit(0), F.col("total"), F.col("kinds")).alias("none")
    groups = store(groups.select("*", none), "groups")

    found = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "at", "blocks", "term",
        _share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"),
        _share(F.col("whole"), F.col("all"), F.col("kinds")).alias("q"),
    )
    found = store(found, "shares")
    apart = found.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"),
        _divergence(F.col("p"), F.col("q")).alias("value"),
    )
    pairs = _pairs(groups, found, width, terms).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value"
    )
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda frame: frame.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).union(ranked(apart).where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT rid, lang, source,
         unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT x.lang, x.source, coalesce(v.v, 0)::HUGEINT AS v, coalesce(n.n, 0)::HUGEINT AS n,
         coalesce(l.n, 0)::HUGEINT AS ln
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v ON v.lang = x.lang
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM cells GROUP BY ALL) n
    ON n.lang = x.lang AND n.source = x.source
  LEFT JOIN (SELECT lang, sum(n) AS n FROM cells GROUP BY ALL) l ON l.lang = x.lang
), whole AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS held,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS p,
         1 + (1000000000::HUGEINT * (whole.n + 1)) // (g.ln + g.v) AS q
  FROM g JOIN kept ON kept.lang = g.lang
  JOIN whole ON whole.lang = kept.lang AND whole.term = kept.term
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), found AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(p.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pairs p ON p.lang = x.lang AND p.source = x.source AND p.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares
  WHERE held > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part
                               ORDER BY value DESC, encode(item)) AS rank FROM found
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""
