"""HTML to blocks, links and structured data: one Arrow pass, parsed once, everything after it is native."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions import candidates as C
from pageloom.functions import scalars as S
from pageloom.functions.markup import HEADING_WEIGHT, REGION_FACTOR, parse
from pageloom.session import col_or_null, spread

BLOCK = "struct<block_id:int,kind:string,text:string,section:array<string>,region:string,weight:double,emphasis:array<string>,table_row:int,heading_level:int,ancestry:array<int>>"
LINK = "struct<pos:int,href:string,text:string,internal:boolean,nofollow:boolean,block_id:int,rel:array<string>>"
TRIPLE = "struct<pos:int,source_kind:string,source_index:int,path:string,value:string>"
GRAPH = (
    "page_id long, url string, title string, lang string, meta map<string,string>, canonical string, feeds array<string>, "
    f"blocks array<{BLOCK}>, links array<{LINK}>, triples array<{TRIPLE}>, images int, images_missing_alt int, script_count int, jsonld_count int, embedded_count int, itemprop_count int, app_root boolean"
)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string; needs a running session, so it is made on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def graph_row(page_id: int | None, url: str, html: str | None) -> dict:
    page = parse(html, url or "")
    flat = C.triples(page)
    blocks = [
        {
            "block_id": i, "kind": b.kind, "text": b.text, "section": b.section, "region": b.region, "weight": (HEADING_WEIGHT[b.level] if b.level else 1.0) * REGION_FACTOR[b.region],
            "emphasis": b.emphasis, "table_row": b.row, "heading_level": b.level, "ancestry": b.ancestry,
        }
        for i, b in enumerate(page.blocks)
    ]
    links = [dict(zip(("pos", "href", "text", "internal", "nofollow", "block_id", "rel"), (i, *k), strict=True)) for i, k in enumerate(page.links)]
    found = []
    for i, (source, path, value) in enumerate(flat):
        kind, _, index = source.partition("[")
        found.append({"pos": i, "source_kind": kind, "source_index": int(index[:-1]) if index else None, "path": path, "value": S.normalize(value)})
    kinds = [k for k, _, _ in page.scripts]
    return {
        "page_id": page_id, "url": url, "title": page.title, "lang": page.lang, "meta": list(page.meta.items()), "canonical": page.canonical or None, "feeds": page.feeds, "blocks": blocks, "links": links, "triples": found,
        "images": page.images, "images_missing_alt": page.images_missing_alt, "script_count": page.script_count, "jsonld_count": kinds.count("jsonld"), "embedded_count": kinds.count("embedded_json"), "itemprop_count": len(page.itemprops), "app_root": page.app_root,
    }


def page_graph(pages: DataFrame) -> DataFrame:
    """A row a page with its graph.  Null or empty html gives an empty graph; broken html what can be read of it.

    Needs page_id and html; links resolve against final_url, else url, where
    there is one.  Keep the result (cut or persist) where several operators
    use it: the pass is Python, and Spark would run it again for each."""
    url = F.coalesce(col_or_null(pages, "final_url", "string"), col_or_null(pages, "url", "string"), F.lit(""))
    flat = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"))

    schema = arrow_schema(GRAPH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Few pages at a time: a graph is several times its page.
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                rows = [graph_row(*r) for r in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spread(flat).mapInArrow(run, GRAPH)


def blocks(graph: DataFrame) -> DataFrame:
    return graph.select("page_id", "url", F.explode("blocks").alias("b")).select("page_id", "url", "b.*")


def links(graph: DataFrame) -> DataFrame:
    return graph.select("page_id", "url", F.explode("links").alias("k")).select("page_id", F.col("url").alias("page_url"), "k.*")


def triples(graph: DataFrame) -> DataFrame:
    return graph.select("page_id", F.explode("triples").alias("t")).select("page_id", "t.*")
