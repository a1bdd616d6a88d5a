"""Exhausting a source level by level: listings lead to listings, pages to pages, and details are what comes out.

The order of a first-in-first-out queue is the order of levels, and within a
level that of (parent, position), so a level is one join and one window, and the budgets are
cuts in discovery order.  Every level is cut to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import cut


def _place(late: int, group, at):
    """Where a link stands on its page: links of groups by group and position, then pages of the pagination."""
    return F.struct(F.lit(late).alias("late"), group.cast("long").alias("group"), at.cast("long").alias("at"))


def _unseen(found: DataFrame, seen: DataFrame) -> DataFrame:
    first = found.groupBy("url").agg(F.min(F.struct("parent", "pos", "depth")).alias("k")).select("url", "k.*")
    return first.join(seen.select("url"), "url", "left_anti")


def expand(frontier: DataFrame, seeds: DataFrame, max_pages: int = 5000, max_urls: int = 100_000, max_depth: int = 3, max_levels: int = 10_000) -> dict[str, DataFrame | str | bool | None]:
    """frontier(url, pagination, groups) stands for fetching; seeds(url, pos).

    Gives pages(url, n, depth, fetched), details(url, n, parent: the number of the
    page that showed it first), limited_by (max_pages, max_urls, max_levels) and
    exhausted; `report` sums up.  A url that frontier has no row for was not
    fetched: it counts as an error."""
    start = seeds.where("trim(url) <> ''").select(F.trim("url").alias("url"), F.lit(0).cast("long").alias("parent"), _place(0, F.lit(0), F.col("pos")).alias("pos"), F.lit(0).alias("depth"))
    first = start.groupBy("url").agg(F.min(F.struct("parent", "pos", "depth")).alias("k")).select("url", "k.*")
    numbered = lambda df, base: df.withColumn("n", F.row_number().over(Window.orderBy("parent", "pos")) + base)
    limited_by: str | None = None
    # Numbers are given to at most max_pages rows a level, after a distributed top-k.
    level = cut(numbered(first.orderBy("parent", "pos").limit(max_pages), 0).select("url", "depth", "n"))
    if first.count() > max_pages:
        limited_by = "max_pages"
    pages, details, n_pages, n_details = level, None, level.count(), 0
    one = frontier.groupBy("url").agg(F.first("pagination").alias("pagination"), F.first("groups").alias("groups"))
    for _ in range(max_levels):
        met = cut(level.join(one, "url"))
        if met.isEmpty():
            break
        groups = met.select("n", "depth", F.posexplode("groups").alias("gi", "g")).select("n", "depth", "gi", F.col("g.kind").alias("kind"), F.posexplode("g.items").alias("ui", "item")).select("n", "depth", "kind", _place(0, F.col("gi"), F.col("ui")).alias("pos"), F.col("item.url").alias("url"))
        new = groups.where("kind = 'detail_candidates'").groupBy("url").agg(F.min(F.struct("n", "pos")).alias("k"))
        if details is not None:
            new = new.join(details.select("url"), "url", "left_anti")
        new = new.select("url", F.col("k.n").alias("parent"), F.col("k.pos").alias("pos"))
        room = max_urls - n_details
        fresh = cut(numbered(new.orderBy("parent", "pos").limit(room), n_details).select("url", "n", "parent"))
        got = fresh.count()
        over = new.limit(room + 1).count() > room
        details = fresh if details is None else cut(details.unionByName(fresh))
        n_details += got
        if over:
            limited_by = limited_by or "max_urls"
        kids = groups.where((F.col("kind") == "child_candidates") & (F.col("depth") < max_depth)).select("url", F.col("n").alias("parent"), "pos", (F.col("depth") + 1).alias("depth"))
        p = F.col("pagination")
        bounded = p.template.isNotNull() & p.last_page.isNotNull() & p.template.contains("{page}")
        turned = met.where(bounded).select(F.col("n").alias("parent"), "depth", p.template.alias("t"), F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.least(p.last_page, F.lit(max_pages).cast("long"))))).alias("i"), p.last_page.alias("last")).where("i <= last").select(
            F.expr("replace(t, '{page}', cast(i as string))").alias("url"), "parent", _place(1, F.lit(0), F.col("i")).alias("pos"), "depth"
        )
        step = met.where(~F.coalesce(bounded, F.lit(False)) & p.next_url.isNotNull()).select(p.next_url.alias("url"), F.col("n").alias("parent"), _place(1, F.lit(0), F.lit(0)).alias("pos"), "depth")
        if not met.where(bounded & (p.last_page > max_pages)).isEmpty():
            limited_by = limited_by or "max_pages"
        found = _unseen(kids.unionByName(turned.select("url", "parent", "pos", "depth")).unionByName(step.select("url", "parent", "pos", "depth")), pages)
        if limited_by == "max_urls":
            break
        room = max_pages - n_pages
        if room <= 0:
            if not found.isEmpty():
                limited_by = limited_by or "max_pages"
            break
        level = cut(numbered(found.orderBy("parent", "pos").limit(room), n_pages).select("url", "depth", "n"))
        if found.limit(room + 1).count() > room:
            limited_by = limited_by or "max_pages"
        n = level.count()
        if not n:
            break
        n_pages += n
        pages = cut(pages.unionByName(level))
    else:
        limited_by = limited_by or "max_levels"
    known = one.select("url", F.lit(True).alias("fetched"))
    return {"pages": pages.join(known, "url", "left").fillna({"fetched": False}), "details": details if details is not None else pages.limit(0).select("url", "n", F.col("n").alias("parent")), "limited_by": limited_by, "exhausted": limited_by is None}


def report(got: dict, seeds: DataFrame) -> dict:
    """Counts of an expansion, with details for each fetched page and depth; small aggregates come to the driver."""
    pages, details = got["pages"], got["details"]
    per_page = pages.join(details.groupBy(F.col("parent").alias("n")).agg(F.count("*").alias("detail_urls")), "n", "left").fillna({"detail_urls": 0})
    levels = per_page.groupBy("depth").agg(F.count_if("fetched").alias("fetched"), F.count_if(~F.col("fetched")).alias("errors"), F.sum("detail_urls").alias("detail_urls"), F.max("detail_urls").alias("most")).orderBy("depth").collect()
    fetched, found = sum(r["fetched"] for r in levels), details.count()
    return {
        "seed_urls": seeds.where("trim(url) <> ''").select(F.trim("url")).distinct().count(), "source_pages_fetched": fetched, "detail_count": found, "error_count": sum(r["errors"] for r in levels), "frontier_exhausted": got["exhausted"], "limited_by": got["limited_by"],
        "fanout_per_source_page": round(found / fetched, 3) if fetched else 0.0, "levels": [r.asDict() for r in levels],
    }
