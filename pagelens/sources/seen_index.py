"""The URLs ever seen, dealt into buckets with a Bloom filter each.

A batch of new URLs first meets the filters of their buckets, and then reads the URLs of those
buckets alone that may hold one of them. So its cost follows the batch and not all URLs ever
seen. Below the index's path are ``urls`` and ``filters``, in folders by segment (the URLs of
some runs) and bucket; ``commits``, a row for each complete segment; and ``layout``, the number
of buckets and the filter's bits a URL. A folder without its commit is the rest of a failure:
it is not read, and written anew.

A filter is rows ``(width, word, bits)``: the URLs of a segment and bucket set ``PROBES`` bits
of one of ``width`` words of 64. It is built and asked by grouping and joining on the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.sources import queue_log
from pagelens.sources.tables import store

BUCKETS, BITS = 256, 16
#: Bits that a URL sets in its word. At 16 bits a URL about one in 200 others passes.
PROBES = 4

LAYOUT = "buckets int, bits int"
COMMIT = "segment long, base long, width long"
URL = "url string, segment long, bucket int"
FILTER = "width long, word long, bits long, segment long, bucket int"


def create_index(
    spark: SparkSession,
    path: str,
    buckets: int = BUCKETS,
    bits: int = BITS,
    if_missing: bool = False,
) -> None:
    """An empty index. A bucket's URLs are written by one task, so deal large ones into more.

    With ``if_missing`` an index that is there already stays as it is.
    """
    if buckets < 1 or bits < 1:
        raise ValueError("an index needs at least one bucket and one bit a URL")
    layout = spark.createDataFrame([(buckets, bits)], LAYOUT).coalesce(1)
    none = spark.createDataFrame([], COMMIT)
    if if_missing:
        layout.write.mode("ignore").parquet(f"{path}/layout")
        none.write.mode("ignore").parquet(f"{path}/commits")
    else:
        layout.write.mode("errorifexists").parquet(f"{path}/layout")
        none.write.mode("overwrite").parquet(f"{path}/commits")


def _layout(spark: SparkSession, path: str) -> tuple[int, int]:
    row = spark.read.schema(LAYOUT).parquet(f"{path}/layout").first()
    return row["buckets"], row["bits"]


def _segments(spark: SparkSession, path: str) -> dict[int, int]:
    """The segments to read and their filters' widths, from one small row a segment.

    A segment replaces those from its ``base`` up to itself.
    """
    rows = spark.read.schema(COMMIT).parquet(f"{path}/commits").collect()
    newest = {}
    for r in sorted(rows, key=lambda r: (r["segment"], -r["base"])):
        newest = {s: w for s, w in newest.items() if s < r["base"]}
        newest[r["segment"]] = r["width"]
    return newest


def last_segment(spark: SparkSession, path: str) -> int:
    """The number of the newest segment; -1 for an empty index."""
    return max(_segments(spark, path), default=-1)


def _bucket(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def _position(url: Column) -> Column:
    return F.xxhash64(url, F.lit(1))


def _mask() -> Column:
    """The ``PROBES`` bits of column ``url`` in its word."""
    bits = [
        f"shiftleft(1L, cast(shiftright(xxhash64(url, 2), {6 * i}) & 63 AS int))"
        for i in range(PROBES)
    ]
    return F.expr(" | ".join(bits))


def add_segment(urls: DataFrame, path: str, segment: int, base: int | None = None) -> None:
    """Add distinct ``urls(url)`` as a segment behind all others.

    With ``base`` it takes the place of the segments from there on. Adding it again after a
    failure changes nothing.
    """
    spark = urls.sparkSession
    if base is None:
        base = segment
        if segment <= last_segment(spark, path):
            raise ValueError(f"segment {segment} is not behind the others")
    buckets, bits = _layout(spark, path)
    # A folder is named by what it replaces too, so that no folder in use is overwritten.
    name = f"segment={segment}/base={base}"
    dealt = urls.select("url", _bucket(F.col("url"), buckets).alias("bucket"))
    dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
        f"{path}/urls/{name}"
    )
    written = spark.read.schema("url string, bucket int").parquet(f"{path}/urls/{name}")
    # Buckets are dealt evenly by a hash, so one width serves them all. Powers of two, so that
    # segments share widths and a URL is looked up once for several.
    words = max(1, -(-written.count() * bits // (64 * buckets)))
    width = 1 << (words - 1).bit_length()
    word = F.pmod(_position(F.col("url")), F.lit(width))
    filters = written.groupBy("bucket", word.alias("word")).agg(F.bit_or(_mask()).alias("bits"))
    filters.select(F.lit(width).cast("long").alias("width"), "word", "bits", "bucket").repartition(
        "bucket"
    ).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/filters/{name}")
    commit = spark.createDataFrame([(segment, base, width)], COMMIT).coalesce(1)
    commit.write.mode("append").parquet(f"{path}/commits")


def _read(spark: SparkSession, path: str, part: str, schema: str, buckets: list[int]) -> DataFrame:
    """Rows of the committed segments in some buckets; folders of others are not opened."""
    rows = spark.read.schema(f"{schema}, base long").parquet(f"{path}/{part}")
    commits = spark.read.schema(COMMIT).parquet(f"{path}/commits").collect()
    used = _segments(spark, path)
    base = {}
    for r in commits:
        base[r["segment"]] = min(r["base"], base.get(r["segment"], r["base"]))
    chosen = F.lit(False)
    for segment in used:
        chosen = chosen | ((F.col("segment") == segment) & (F.col("base") == base[segment]))
    return rows.where(chosen & F.col("bucket").isin(buckets)).drop("base")


def _numbers(frame: DataFrame) -> list[int]:
    """The distinct buckets of a table: at most as many numbers as there are buckets."""
    return sorted(r["bucket"] for r in frame.select("bucket").distinct().collect())


def possible(urls: DataFrame, path: str) -> DataFrame:
    """Those of distinct ``urls(url)`` that pass a filter, as ``(url, bucket)``.

    All URLs of the index are among them, and about one in 200 of the others for each segment.
    """
    spark = urls.sparkSession
    widths = sorted(set(_segments(spark, path).values()))
    buckets, _ = _layout(spark, path)
    asked = store(urls.select("url", _bucket(F.col("url"), buckets).alias("bucket")), "asked")
    if not widths:
        return asked.limit(0)
    each = asked.withColumn("width", F.explode(F.array(*[F.lit(w).cast("long") for w in widths])))
    each = each.withColumn("word", F.expr("pmod(xxhash64(url, 1), width)")).withColumn("mask", _mask())
    filters = _read(spark, path, "filters", FILTER, _numbers(asked))
    met = each.join(filters.drop("segment"), ["bucket", "width", "word"])
    return met.where(F.expr("bits & mask = mask")).select("url", "bucket").distinct()


def unseen(urls: DataFrame, path: str) -> DataFrame:
    """The rows of distinct ``urls(url, ...)`` whose URL is not in the index.

    What passes the filters is compared with the URLs of its buckets, so the answer is exact.
    """
    spark = urls.sparkSession
    candidates = store(possible(urls, path), "candidates")
    buckets = _numbers(candidates)
    if not buckets:
        return urls
    held = _read(spark, path, "urls", URL, buckets).select("bucket", "url")
    # The candidates are the side to broadcast, if they are few, and not the buckets.
    known = held.join(candidates, ["bucket", "url"], "left_semi").select("url")
    return urls.join(known, "url", "left_anti")


def buckets_read(urls: DataFrame, path: str) -> list[int]:
    """The buckets whose URLs ``unseen`` reads for ``urls(url)``."""
    return _numbers(possible(urls, path))


def _merge(spark: SparkSession, path: str, first: int, last: int) -> None:
    buckets, _ = _layout(spark, path)
    rows = _read(spark, path, "urls", URL, list(range(buckets)))
    rows = rows.where(F.col("segment") >= first)
    add_segment(rows.select("url").distinct(), path, last, base=first)


def compact(spark: SparkSession, path: str) -> None:
    """Make the segments one. Folders of the others are not read any more and may be deleted."""
    used = _segments(spark, path)
    if len(used) > 1:
        _merge(spark, path, min(used), max(used))


def tidy(spark: SparkSession, path: str) -> None:
    """Merge the newest segments with those before them that are no larger.

    Done after each new segment, the number of segments grows as the logarithm of the URLs,
    and a URL is written that many times at most, not once for each segment.
    """
    used = sorted(_segments(spark, path).items())
    first, total = len(used) - 1, used[-1][1] if used else 0
    while first > 0 and used[first - 1][1] <= total:
        first -= 1
        total += used[first][1]
    if used and first < len(used) - 1:
        _merge(spark, path, used[first][0], used[-1][0])


def follow(spark: SparkSession, path: str, log: str) -> None:
    """Bring the index up to the queue log's last run, by the changes it does not have yet.

    Since the index is made from the log, a run that fails between the two loses nothing: the
    next one follows first.
    """
    last, _ = queue_log.last_runs(spark, log)
    have = last_segment(spark, path)
    if have < last:
        urls = queue_log.joined_since(spark, log, "seen", have)
        add_segment(urls.select("url").distinct(), path, last)
