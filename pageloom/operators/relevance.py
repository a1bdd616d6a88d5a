"""Search in the blocks of pages by weighted term statistics, and a bounded answer.

Statistics and scores come from the arrays of a page's own row (a page is a
corpus of its own), so nothing is shuffled; rows that are exploded to be ranked
are ranked within their page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import native as N
from pageloom.operators.summary import bounded

# Fixed values of the ranking.
K1, B, EMPHASIS, SECTION, TITLE = 1.2, 0.75, 1.0, 0.6, 0.15 * 5.0


#: Between the headings of a block while they are folded; no page text holds it.
_BETWEEN = "\x01"


def score_blocks(graph: DataFrame, query: str) -> DataFrame:
    """(page_id, block_id, text, section, score, matched) of blocks with a positive score.  A query without tokens finds nothing.

    Each block is folded once and its terms are counted in place; what follows
    reads the counts."""
    import re

    plain = query.lower().translate(str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}))
    terms = list(dict.fromkeys(re.findall("[a-z0-9]+", plain)))
    word = lambda t: rf"(?<![a-z0-9]){t}(?![a-z0-9])"
    count = lambda text, t: F.when(text.contains(t), F.regexp_count(text, F.lit(word(t)))).otherwise(0)
    some = lambda xs, kind: F.array(*xs) if xs else F.array().cast(f"array<{kind}>")
    folded = graph.select("page_id", N.fold(F.col("title")).alias("title"), F.transform("blocks", lambda b: F.struct(
        b.block_id.alias("block_id"), b.text.alias("text"), b.section.alias("section"), b.weight.alias("weight"), N.fold(b.text).alias("folded"),
        N.fold(F.array_join(b.emphasis, " ")).alias("strong"), F.when(F.size(b.section) > 0, F.split(N.fold(F.array_join(b.section, _BETWEEN)), _BETWEEN)).otherwise(F.array().cast("array<string>")).alias("heads"),
    )).alias("docs"))

    def nearness(heads, t):
        at = F.transform(heads, lambda h, i: F.when(h.contains(t) & h.rlike(word(t)), 0.5 + 0.5 * (i + 1) / F.size(heads)).otherwise(0.0))
        return F.coalesce(F.array_max(at), F.lit(0.0))

    g = folded.select("page_id", some([count(F.col("title"), t) > 0 for t in terms], "boolean").alias("titled"), F.transform("docs", lambda d: F.struct(
        d.block_id.alias("block_id"), d.text.alias("text"), d.section.alias("section"), d.weight.alias("weight"), F.regexp_count(d.folded, F.lit("[a-z0-9]+")).alias("n"),
        some([count(d.folded, t) for t in terms], "int").alias("tf"), some([count(d.strong, t) > 0 for t in terms], "boolean").alias("strong"), some([nearness(d.heads, t) for t in terms], "double").alias("near"),
    )).alias("docs"))
    n, total = F.size("docs"), F.aggregate("docs", F.lit(0), lambda a, d: a + d.n)
    with_term = lambda i: lambda a, d: a + (d.tf[i] > 0).cast("int")
    df = [F.aggregate("docs", F.lit(0), with_term(i)) for i in range(len(terms))]
    g = g.select("page_id", "titled", F.when(total == 0, 1.0).otherwise(total / n).alias("avg"), some([F.log(1 + (n - x + 0.5) / (x + 0.5)) for x in df], "double").alias("idf"), "docs")
    rows = g.select("page_id", "titled", "avg", "idf", F.explode("docs").alias("d")).where("d.n > 0")
    if terms:
        rows = rows.where(F.exists("d.tf", lambda x: x > 0) | F.exists("d.near", lambda x: x > 0))
    norm = 1 - B + B * F.col("d.n") / F.col("avg")
    score, hit = F.lit(0.0), []
    for i, t in enumerate(terms):
        tf, near, idf = F.col("d.tf")[i], F.col("d.near")[i], F.col("idf")[i]
        there = tf > 0
        part = F.when(there, idf * (tf * (K1 + 1) / (tf + K1 * norm)) * F.col("d.weight") + F.when(F.col("d.strong")[i], idf * EMPHASIS).otherwise(0.0)).otherwise(0.0)
        score = score + part + idf * SECTION * near + F.when(there & F.col("titled")[i], idf * TITLE).otherwise(0.0)
        hit.append(F.when(there | (near > 0), F.lit(t)))
    matched = F.array_sort(F.array_compact(F.array(*hit))) if terms else F.array().cast("array<string>")
    scored = rows.select("page_id", "d.block_id", "d.text", "d.section", score.alias("raw"), matched.alias("matched"))
    return scored.where("raw > 0").select("page_id", "block_id", "text", "section", (F.col("raw") * (0.5 + 0.5 * F.size("matched") / max(1, len(terms)))).alias("score"), "matched")


def locate(graph: DataFrame, query: str, results: int = 8, block_chars: int = 400, context: int = 4000, neighbors: bool = True) -> DataFrame:
    """The best blocks of each page within a budget of characters, each with its first links and, for label-like hits, the next block."""
    ranked = score_blocks(graph, query).withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "block_id")))
    ranked = ranked.withColumn("candidates", F.count("*").over(Window.partitionBy("page_id"))).where(F.col("rank") <= results)
    with_page = ranked.join(graph.select("page_id", "blocks", "links"), "page_id")
    nxt = F.get(F.filter("blocks", lambda b: b.block_id == F.col("block_id") + 1), F.lit(0))
    use = F.lit(neighbors) & nxt.isNotNull() & (nxt.section == F.col("section")) & (F.length("text") < 80)
    hits = with_page.select(
        "page_id", "rank", "block_id", bounded(F.col("text"), block_chars).alias("text"), F.round("score", 4).alias("score"), "matched", "candidates",
        F.slice(F.transform(F.filter("links", lambda k: k.block_id == F.col("block_id")), lambda k: k.href), 1, 5).alias("hrefs"), F.when(use, bounded(nxt.text, block_chars // 2)).alias("next_text"),
    )
    order = Window.partitionBy("page_id").orderBy("rank")
    used = F.sum(F.length("text") + F.length(F.coalesce("next_text", F.lit("")))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # The first hit always stays; the rest stop at the first that goes beyond the budget.
    kept = hits.withColumn("used", used).withColumn("over", F.max((F.col("used") > context).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.where((F.col("over") == 0) | (F.col("rank") == 1)).drop("over")
