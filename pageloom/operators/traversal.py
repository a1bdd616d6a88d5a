"""Pagination, repeated groups of links, and what of a source is still open, from the links of each page.

A page's links are one array in its row: no shuffle, and a page with very many
links costs only itself."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import spread

_PAGINATION = (
    "struct<detected:boolean,kind:string,current_page:bigint,current_offset:bigint,last_page:bigint,last_offset:bigint,highest_visible_page:bigint,highest_visible_offset:bigint,next_url:string,prev_url:string,first_url:string,"
    "last_url:string,last_evidence:string,bounded:boolean,has_next:boolean,remaining_pages:bigint,template:string,visible_page_numbers:array<bigint>>"
)
_FRONTIER = f"page_id long, url string, pagination {_PAGINATION}, groups array<struct<scope:string,kind:string,count:int,items:array<struct<url:string,text:string>>>>"


def frontier(graph: DataFrame) -> DataFrame:
    """(page_id, url, pagination, groups): all groups with all their addresses.  A page without links has an empty pagination."""
    from pageloom.operators.pagegraph import arrow_schema

    schema = arrow_schema(_FRONTIER)
    flat = graph.select("page_id", "url", "canonical", F.transform("links", lambda k: F.struct(k.href, k.text, k.internal, k.rel)).alias("ks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pageloom.functions.paging import paging

        for b in batches:
            rows = []
            for r in b.to_pylist():
                p, g = paging(r["url"] or "", r["canonical"], [tuple(k.values()) for k in r["ks"] or []])
                rows.append({"page_id": r["page_id"], "url": r["url"], "pagination": p, "groups": g})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spread(flat).mapInArrow(run, _FRONTIER)


def pagination(graph: DataFrame) -> DataFrame:
    return frontier(graph).select("page_id", "url", "pagination")


def traversal(graph: DataFrame, max_groups: int = 8, samples: int = 5) -> DataFrame:
    """Coverage of each page: never complete, for one page cannot prove it."""
    shown, p = F.slice("groups", 1, max_groups), F.col("pagination")
    signals = F.array_compact(F.array(
        F.when(p.has_next, "PAGINATION_OPEN").when(p.detected & ~p.bounded, "PAGINATION_UNBOUNDED"), F.when(F.size("groups") > 0, "CHILD_LEVEL_CANDIDATES"),
    ))
    known = F.aggregate(shown, F.lit(0).cast("long"), lambda a, x: a + x["count"]) + F.when(p.remaining_pages.isNotNull(), p.remaining_pages).when(p.has_next, 1).otherwise(0)
    return frontier(graph).select(
        "page_id", "url", F.when(F.size(signals) > 0, "INCOMPLETE").otherwise("UNKNOWN").alias("coverage_status"), F.lit(False).alias("claim_complete"), signals.alias("signals"), known.alias("known_open_urls"), "pagination",
        F.transform(shown, lambda x: F.struct(x.scope.alias("scope"), x.kind.alias("kind"), x["count"].alias("count"), F.slice(x.getField("items"), 1, samples).alias("sample"))).alias("child_collections"),
    )
