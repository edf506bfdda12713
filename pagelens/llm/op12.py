"""URL rules: a blocked Bloom filter passes possible hits to an exact join.

A rule is a host and the beginning of a path; it fits the URLs of that host and of its
subdomains whose path begins so. Listed are the rules' canonical URLs, host and path
together. A URL can only be under a listed one that is an ending of its host followed by a
beginning of its path. These are tried against the filter, which every task holds: first
the host's endings, then, behind those that may be listed, the path's beginnings of the
lengths that rules have. What passes is joined with the rules on the whole string, which
removes false positives; the longest rule that remains decides.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import blooms
from pagelens.llm.shared import store, table
from pagelens.llm.tokens import Memo

ALLOW, BLOCK = "allow", "block"
#: Host and path of a URL: behind the first ``://``, up to a query or fragment.
PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = str.maketrans(UPPER, LOWER)


def parts_of(url: str | None) -> tuple[str, str]:
    """Host, A-Z lowered, and path; both empty for a null or a text without ``://``."""
    found = PARTS.search(url or "")
    return (found[1].translate(LOWERED), found[2]) if found else ("", "")


def endings(host: str, longest: int) -> list[str]:
    """The host and its parent domains, of at most ``longest`` characters."""
    found = [host] if len(host) <= longest else []
    at = host.find(".", max(0, len(host) - longest - 1))
    while 0 <= at < len(host) - 1:
        found.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return found


def listed(rules: DataFrame) -> DataFrame:
    """``(rule, host, path, action)``, one row per canonical URL of ``rules(host, path, action)``.

    A-Z of the host is lowered, a null path is empty, and a rule without a host goes. Of
    rules with the same host and path but different actions, blocking wins.
    """
    host = F.translate("host", UPPER, LOWER)
    rows = rules.where("host != ''").select(
        host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action"
    )
    blocks = F.max(F.col("action") == BLOCK)
    rows = rows.groupBy("host", "path").agg(
        F.when(blocks, BLOCK).otherwise(F.max("action")).alias("action")
    )
    return rows.select(F.concat("host", "path").alias("rule"), "host", "path", "action")


def _possible(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``(rid, page_id, host, path, possible)``: listed URLs that a page may be under."""
    bounds = rules.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.length("host")).alias("host"),
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),
    ).first()  # numbers only: the lengths of paths
    longest, lengths = bounds["host"] or 0, bounds["lengths"]
    keys = rules.select(F.explode(F.array("host", "rule")).alias("key")).distinct()
    filled = blooms.build(keys.select(F.encode("key", "utf-8")), 2 * bounds["n"])
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        def near(host: str) -> list[str]:
            found = endings(host, longest)
            passed = filled.may_hold(x.encode() for x in found)
            return [x for x, yes in zip(found, passed, strict=True) if yes]

        known = Memo(near)
        for batch in batches:
            hosts, paths, tried, owners = [], [], [], []
            for i, url in enumerate(batch.column(2).to_pylist()):
                host, path = parts_of(url)
                hosts.append(host)
                paths.append(path)
                for ending in known[host]:
                    for size in lengths:
                        if size > len(path):
                            break
                        tried.append(ending + path[:size])
                        owners.append(i)
            possible: list[list[str]] = [[] for _ in hosts]
            passed = filled.may_hold(x.encode() for x in tried)
            for i, key, yes in zip(owners, tried, passed, strict=True):
                if yes:
                    possible[i].append(key)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(hosts, pa.string()),
                    pa.array(paths, pa.string()),
                    pa.array(possible, pa.list_(pa.string())),
                ],
                ["rid", "page_id", "host", "path", "possible"],
            )

    return rows.mapInArrow(
        run, f"rid long, page_id {kind}, host string, path string, possible array<string>"
    )


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = ALLOW) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages(page_id, url)``.

    ``rules(host, path, action)`` may be a table of any size. The longest rule that fits
    decides, counted over host and path; of equally long ones that with the longer host.
    Where none fits, ``rule`` is null and the verdict is ``otherwise``: a URL that is
    not listed is not blocked.

    * A null url, and one without ``://``, has an empty host and path; no rule fits.
    * A host is taken as it stands, port and user included; a path is compared as it is.
    * A null or repeated page_id is a row like any other; repeated rows are judged each.
    * Very long hosts are tried only as far as the longest listed host. Empty tables are
      fine: no pages give no rows, no rules leave ``otherwise`` for all.
    * Other columns of either table are ignored, whatever their names.
    """
    rules = store(listed(rules), "rules")
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", "url")
    found = store(_possible(rows, rules), "possible")
    shown = ["page_id", "host", "path"]
    none = found.where(F.size("possible") == 0).select(
        *shown, F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict")
    )
    some = found.where(F.size("possible") > 0)
    # Keys can be hot, rules cannot: both sides are files, so Spark splits a hot key.
    tried = some.select("rid", *shown, F.explode("possible").alias("rule"))
    lengths = F.struct(F.length("rule").alias("size"), F.length("listed").alias("own"), "rule", "action")
    hits = tried.join(
        rules.select("rule", F.col("host").alias("listed"), "action"), "rule", "left"
    ).withColumn("hit", F.when(F.col("action").isNotNull(), lengths))
    best = hits.groupBy("rid").agg(
        *[F.first(c).alias(c) for c in shown], F.max("hit").alias("best")
    )
    best = best.select(
        *shown,
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(otherwise)).alias("verdict"),
    )
    return none.union(best)


def drop_blocked(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``pages`` whose ``url`` is not blocked, with all their columns."""
    urls = pages.select(F.col("url").alias("page_id"), "url").distinct()
    blocked = judge(urls, rules).where(F.col("verdict") == BLOCK)
    gone = store(blocked.select(F.col("page_id").alias("url")), "blocked")
    return pages.join(gone, "url", "left_anti").select(*[F.col(f"`{c}`") for c in pages.columns])


#: Host, path and action of the query's rules.
RULES = [
    ("net", "/", BLOCK),
    ("example.net", "/en/", ALLOW),
    ("example.com", "/de/", BLOCK),
    ("org", "/fr/", ALLOW),
]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge(table(spark, sf_dir, "pages"), rules)


ORACLE = r"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(host, path, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), hits AS (
  SELECT p.rid, r.host || r.path AS rule, r.action,
         row_number() OVER (PARTITION BY p.rid
                            ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host))
               AND starts_with(p.path, r.path)
)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.action, 'allow') AS verdict
FROM p LEFT JOIN hits h ON h.rid = p.rid AND h.place = 1
"""
