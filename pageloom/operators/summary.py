"""A bounded overview of each page, from arrays of its graph alone; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_chars() -> Column:
    return F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.length(b.text))


def shell_score() -> Column:
    """How much the page looks like an empty root for scripts, 0 to 1."""
    part = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    s = part(text_chars() < 400, 0.45) + part(F.col("app_root"), 0.30) + part(F.col("script_count") >= 5, 0.15) - part(F.col("embedded_count") > 0, 0.20) - part(F.col("jsonld_count") > 0, 0.10)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(s, 2)))


def summarize(graph: DataFrame, outline: int = 40, top_links: int = 25) -> DataFrame:
    """Counts, outline, first headings, top links and whether the page needs rendering."""
    count = lambda arr, f: F.size(F.filter(arr, f))
    heads = F.filter("blocks", lambda b: b.heading_level.isNotNull())
    named = F.filter("links", lambda k: k.internal & (k.text != ""))
    # Of several links to one address the first stands.
    first = F.filter(named, lambda k: F.array_position(F.transform(named, lambda x: x.href), k.href) == F.array_position(F.transform(named, lambda x: x.pos), k.pos))
    og = F.array_sort(F.filter(F.map_keys("meta"), lambda k: k.startswith("og:")))
    score = shell_score()
    return graph.select(
        "page_id", "url", "title", "lang", "canonical",
        F.size("blocks").alias("blocks"), text_chars().alias("text_chars"), count(F.col("links"), lambda k: k.internal).alias("links_internal"), count(F.col("links"), lambda k: ~k.internal).alias("links_external"),
        count(F.col("links"), lambda k: k.nofollow).alias("links_nofollow"), "images", "images_missing_alt", "script_count", "jsonld_count", "embedded_count", "itemprop_count",
        F.slice(og, 1, 20).alias("og_keys"), F.slice("feeds", 1, 10).alias("feeds"),
        F.slice(F.transform(F.filter("blocks", lambda b: b.heading_level == 1), lambda b: b.text), 1, 5).alias("h1"),
        F.slice(F.transform(heads, lambda b: F.struct(b.heading_level.alias("level"), b.text.alias("text"))), 1, outline).alias("outline"),
        F.slice(F.transform(first, lambda k: F.struct(k.href.alias("href"), k.text.alias("text"))), 1, top_links).alias("top_links"),
        (F.size(heads) > outline).alias("outline_truncated"), (F.size(first) > top_links).alias("links_truncated"), score.alias("js_shell_score"), (score >= 0.6).alias("needs_render"),
    )


def bounded(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)
