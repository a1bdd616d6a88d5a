"""Which requests may be made and what the answers are: gates, challenges, spacing, caching."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import native as N
from pageloom.functions import patterns as P


def url_gate(url: Column, deny: list[str] | None = None, schemes: tuple[str, ...] = ("http", "https")) -> Column:
    """The code of what forbids the URL; null where it may be fetched."""
    h = N.host(url)
    denied = F.lit(False)
    for d in deny or []:
        denied = denied | (h == d.lower()) | F.endswith(h, F.lit("." + d.lower()))
    return F.when(~F.lower(N.url_part(url, "scheme")).isin(*schemes), "URL_SCHEME_DENIED").when(h == "", "URL_INVALID").when(denied, "HOST_DENIED")


def source_gate(url: Column, html: Column) -> Column:
    """Exactly one of url and html makes a source."""
    u, h = F.coalesce(url, F.lit("")) != "", html.isNotNull()
    return F.when(u & h, "SOURCE_AMBIGUOUS").when(~u & ~h, "SOURCE_REQUIRED")


# Fixed value: what does not show.
_VISIBLE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]+>"


def visible_chars(html: Column) -> Column:
    """Characters that remain without tags, scripts and styles, blanks collapsed."""
    return F.length(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), _VISIBLE, " "), f"{P.UNI_WS}+", " ")))


def challenge(status: Column, html: Column) -> Column:
    """The reason to call a response a challenge or a block; null for a page that can be read."""
    text = F.coalesce(html, F.lit(""))
    odd, thin = F.coalesce(status.isin(*P.CHALLENGE_STATUSES), F.lit(False)), visible_chars(text) < P.THIN_CHARS
    one = lambda words: F.lower(F.regexp_extract(text, "(?iu)" + "|".join(map(re.escape, words)), 0))
    technical, phrase = one(P.TECHNICAL_MARKERS), one(P.PHRASE_MARKERS)
    return (
        F.when(status == 429, "RATE_LIMITED").when((technical != "") & (odd | thin), F.concat(F.lit("CHALLENGE:"), technical)).when((phrase != "") & odd & thin, F.concat(F.lit("CHALLENGE:"), phrase))
        .when(status.isin(401, 403), F.concat(F.lit("HTTP_"), status.cast("string")))
    )


def http_error(status: Column) -> Column:
    """struct(code, recoverable) of an HTTP error; null below 400."""
    return F.when(status >= 400, F.struct(F.lit("HTTP_ERROR").alias("code"), (status >= 500).alias("recoverable")))


def throttle(requests: DataFrame, host: str, at: str, order: list[str], interval: float) -> DataFrame:
    """Adds `start`, when each request of a host may begin: start = max(arrival, last start + interval).

    In closed form a running maximum of arrival - n * interval, so a window does
    it and nothing is looped."""
    w = Window.partitionBy(host).orderBy(at, *order)
    n = F.row_number().over(w).cast("double") * interval
    ahead = F.max(F.col(at) - F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return requests.withColumn("_n", n).withColumn("start", ahead + F.col("_n")).drop("_n")


def cache_hits(requests: DataFrame, key: list[str], at: str, order: list[str], ttl: float, carry: list[str]) -> DataFrame:
    """Adds `hit`: whether a request is served by a fetch less than ttl before; hits do not renew the entry.

    The entry moves only at a fetch, so the rows of a key are walked in order in
    chunks of `ttl`-long buckets first: a key is cut where a gap of ttl or more
    lies between two requests (there a fetch is certain), and each piece is
    walked alone.  A hot key is as many pieces as it has such gaps."""
    w = Window.partitionBy(*key).orderBy(at, *order)
    gap = (F.col(at) - F.lag(at).over(w)) >= ttl
    pieces = requests.select(*key, at, *order, *carry).withColumn("_gap", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("_piece", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")
    kept = pieces.drop("_piece").columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.drop("_piece").schema) + ", hit boolean"
    width = max(requests.sparkSession.sparkContext.defaultParallelism, int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = pieces.repartition(width, *key, "_piece").sortWithinPartitions(*key, "_piece", at, *order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted; all that is held is the entry of the piece at hand.
        now, fetched = None, None
        for b in batches:
            hits = []
            for *k, t in zip(*(b.column(c).to_pylist() for c in [*key, "_piece", at]), strict=True):
                if k != now:
                    now, fetched = k, None
                hits.append(fetched is not None and t - fetched < ttl)
                if not hits[-1]:
                    fetched = t
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(hits, pa.bool_())], [*kept, "hit"])

    return ordered.mapInArrow(walk, ddl)


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Adds `allowed`.  robots(root, status, body): 401 and 403 forbid all, other errors and a missing row allow all."""
    from urllib.robotparser import RobotFileParser

    root = F.concat(F.lower(N.url_part(F.col("url"), "scheme")), F.lit("://"), F.lower(N.url_part(F.col("url"), "netloc")))
    joined = urls.withColumn("_root", root).join(robots.select(F.col("root").alias("_root"), F.col("status").alias("_status"), F.col("body").alias("_body")), "_root", "left")

    @F.pandas_udf("boolean")
    def ask(url: pd.Series, body: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}

        def one(u, text):
            if not isinstance(text, str):
                return True
            if text not in parsers:
                parsers[text] = RobotFileParser()
                parsers[text].parse(text.splitlines())
            return parsers[text].can_fetch(agent, u)

        return pd.Series([one(u, t) for u, t in zip(url, body, strict=True)], dtype="boolean")

    verdict = F.when(F.col("_status").isin(401, 403), F.lit(False)).when(F.col("_status") >= 400, F.lit(True)).otherwise(ask("url", "_body"))
    return joined.withColumn("allowed", verdict).drop("_root", "_status", "_body")
