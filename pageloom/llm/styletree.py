"""The main body of pages by a site style tree.

The DOMs of one host are merged into a tree.  Its nodes are the styled elements
(tag and class); the path of a node is the one that most pages of the site have
it on.  A page that forgets to close a tag nests its nodes elsewhere, and the
site's other pages put them back.  Each node has

* content importance: 1 - H, with H the entropy of a text over the site's
  pages, weighted by how often the texts occur; a text that every page repeats
  counts 0, one that a single page has counts 1;
* presentation importance, from the same entropy over how the node begins: a
  node that always starts in one of a few ways is a template;
* how much of its text lies in anchors, holds words, is a heading, a cell.

A branch is a node with all below it, and its importance the mean of its nodes'
content importance by the characters they have.  The main branch is the one
over the pages' titles with the most important text.  Branches outside it, and
low-importance branches and nodes inside it, are removed from each page; a page
keeps what stands in place of a body.

Scale: pages are parsed where they are read, html is never shuffled.  What is
shuffled are numbers for each page and node; all aggregations are partial
first, so a host with a third of all pages is no larger to a task than others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import cut, spread

_CELLS = frozenset(("dt", "dd", "th", "td"))
_NODES = pa.schema([
    ("host", pa.string()), ("page_id", pa.int64()), ("page_blocks", pa.int32()), ("chain", pa.string()), ("node", pa.string()),
    ("block_ids", pa.list_(pa.int32())), ("texts", pa.list_(pa.int64())), ("opening", pa.int64()), ("chars", pa.int32()), ("letters", pa.int32()),
    ("linked", pa.int32()), ("titles", pa.int32()), ("cells", pa.int32()),
])
_NODES_DDL = "host string, page_id long, page_blocks int, chain string, node string, block_ids array<int>, texts array<long>, opening long, chars int, letters int, linked int, titles int, cells int"


_WORD = re.compile(r"[^\W\d_]{4}").search


def nodes_of(outline, blocks: list, digest, mask: int, texts: bool = True) -> list[tuple[tuple[str, ...], list]]:
    """(chain, [block ids, text digests, digest of the opening, characters, of these in texts with words, in anchors, titles, cells]) by node."""
    nodes: dict[int, list] = {}
    for i, (chain, kind, text, linked) in enumerate(blocks):
        n = nodes.get(chain)
        if n is None:
            n = nodes[chain] = [[], [], digest(" ".join(text.split(" ", 2)[:2])) & mask, 0, 0, 0, 0, 0]
        n[0].append(i)
        if texts:
            n[1].append(digest(text) & mask)
        n[3] += len(text)
        n[4] += len(text) if _WORD(text) else 0
        n[5] += linked
        n[6] += kind == "h1"
        n[7] += kind in _CELLS
    return [(outline.chains[chain], n) for chain, n in nodes.items()]


def page_nodes(pages: DataFrame) -> DataFrame:
    """A row for each page and style node with text of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        from pageloom.functions.outline import Outliner

        outline, digest, mask = Outliner(), xxhash.xxh3_64_intdigest, (1 << 63) - 1
        for b in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            rows = []
            for page_id, host, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                blocks = outline.blocks(html)
                rows += [(host, page_id, len(blocks), "\x1f".join(names), names[-1] if names else "", *n) for names, n in nodes_of(outline, blocks, digest, mask)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODES, strict=True)], schema=_NODES)

    flat = pages.where("html is not null and html <> '' and page_id is not null").select(F.col("page_id").cast("long"), F.coalesce(F.col("host"), F.lit("")).alias("host"), "html")
    return spread(flat).mapInArrow(run, _NODES_DDL)


def _importance(counted: DataFrame, out: str) -> DataFrame:
    """counted(host, node, n): mean of 1 - ln n / ln pages over the occurrences."""
    one = 1 - F.log(F.col("n")) / F.log(F.greatest("pages", F.lit(2)))
    return counted.groupBy("host", "node").agg((F.sum(F.col("n") * one) / F.sum("n")).alias(out))


def node_verdicts(nodes: DataFrame, low: float = 0.4, template: float = 0.8, link: float = 0.8) -> DataFrame:
    """(host, node, noise, why) for each style node of each host."""
    pages = nodes.groupBy("host").agg(F.count_distinct("page_id").alias("pages"))
    texts = nodes.select("host", "node", F.explode(F.array_distinct("texts")).alias("t")).groupBy("host", "node", "t").agg(F.count("*").alias("n"))
    content = _importance(texts.join(pages, "host"), "content")
    openings = nodes.groupBy("host", "node", "opening").agg(F.count("*").alias("n"))
    # Relative to the node's own pages: how few ways it begins in.
    begin = openings.groupBy("host", "node").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nl")).select(
        "host", "node", F.when(F.col("m") > 1, 1 - F.col("nl") / (F.col("m") * F.log("m"))).otherwise(1.0).alias("begin")
    )
    # Chains of a host are few; everything from here on has one row a chain or node.
    chains = nodes.groupBy("host", "node", "chain").agg(
        F.count("*").alias("m"), *[F.sum(c).alias(c) for c in ("chars", "letters", "linked", "titles", "cells")], F.sum(F.size("block_ids")).alias("blocks")
    )
    sums = ("m", "chars", "letters", "linked", "titles", "cells", "blocks")
    tree = chains.groupBy("host", "node").agg(F.max_by("chain", F.struct("m", "chain")).alias("chain"), *[F.sum(c).alias(c) for c in sums]).join(content, ["host", "node"])
    # One row a node of a site; all that is large has been summed up in it, once.
    tree = cut(tree.withColumn("path", F.array_except(F.split("chain", "\x1f"), F.array(F.lit("body"), F.lit("")))))
    worth = F.col("content") * F.col("chars")
    branches = tree.select("host", F.explode("path").alias("branch"), "titles", "chars", worth.alias("worth"), (worth * (1 - F.least(F.lit(1.0), F.col("linked") / F.greatest("chars", F.lit(1))))).alias("told")).groupBy("host", "branch").agg(
        F.sum("titles").alias("titles"), F.sum("told").alias("told"), (F.sum("worth") / F.greatest(F.sum("chars"), F.lit(1))).alias("importance")
    )
    most = branches.groupBy("host").agg(F.max("titles").alias("most"))
    # Of the branches that hold most titles, the one with the most worthy text; the outermost has at least that of its parts.
    main = branches.join(most, "host").where("titles >= 0.4 * most or most = 0").groupBy("host").agg(F.max_by("branch", F.struct("told", "branch")).alias("main"))
    # The least important branch that a node is in, of those below the main one.
    poor = tree.select("host", "node", F.posexplode("path").alias("at", "branch")).join(branches.select("host", "branch", "importance", F.col("titles").alias("over")), ["host", "branch"]).join(main, "host", "left")
    below = poor.groupBy("host", "node").agg(F.max(F.when(F.col("branch") == F.col("main"), F.col("at"))).alias("depth"), F.array_agg(F.when(F.col("over") == 0, F.struct("at", "importance"))).alias("branches"))
    below = below.select("host", "node", F.col("depth").isNotNull().alias("inside"), F.array_min(F.transform(F.filter("branches", lambda x: x.at > F.coalesce("depth", F.lit(-1))), lambda x: x.importance)).alias("branch"))
    f = tree.drop("path").join(below, ["host", "node"], "left").join(main, "host", "left").join(begin, ["host", "node"]).join(pages, "host").withColumn("inside", F.coalesce("inside", F.col("main").isNull() | (F.col("node") == F.col("main"))))
    linked, per = F.col("linked") / F.greatest("chars", F.lit(1)), F.col("blocks") / F.col("m")
    why = (
        F.when((F.col("node") == F.col("main")) | (F.col("titles") >= 0.5 * F.col("m")), F.lit(None))
        .when(~F.col("inside"), F.lit("outside"))
        .when((F.col("cells") >= 0.5 * F.col("blocks")), F.lit(None))
        .when((linked >= link) | ((linked > 0.2) & (F.col("letters") < 0.5 * F.col("chars"))), F.lit("links"))
        .when((F.col("content") < low) | (F.col("branch") < low), F.lit("repeated"))
        .when((per <= 1.5) & (F.col("chars") / F.col("blocks") < 150) & (linked < 0.2) & ((F.col("begin") < template) | (F.col("content") < template)), F.lit("template"))
    )
    return f.select("host", "node", why.alias("why"), "chain", "main", "content", "branch", "begin", linked.alias("link"), "inside", "m", "pages", per.alias("per"), "titles")


def _gone(pages: DataFrame) -> DataFrame:
    """(page_id, page_blocks, gone): how many blocks each page has, and the numbers of those that are not of its main body."""
    once = pages.select("page_id", "host", "html")
    nodes = cut(page_nodes(once))
    verdicts = node_verdicts(nodes).select("host", "node", "why")
    marked = nodes.select("host", "node", "page_id", "page_blocks", "block_ids", "chars").join(verdicts, ["host", "node"], "left")
    # A page keeps what is left of its body: where every branch inside the main one went, the text that is no link stays.
    return marked.groupBy("page_id").agg(
        F.max("page_blocks").alias("page_blocks"),
        F.max(F.col("why").isNull().cast("int")).alias("has_body"),
        F.flatten(F.collect_set(F.when(F.col("why").isNotNull() & (F.col("why") != "template"), F.col("block_ids")))).alias("gone"),
        F.flatten(F.collect_set(F.when(F.col("why") == "template", F.col("block_ids")))).alias("maybe"),
    ).select("page_id", "page_blocks", F.when(F.col("has_body") == 1, F.array_union("gone", "maybe")).otherwise(F.array_distinct("gone")).alias("gone"))


def noise_blocks(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, block_id) of the blocks that are not of their page's main body.

    Pages without html or without blocks give no rows.  A page whose html does
    not number as many blocks as `blocks` has (there it was parsed from other
    html) is judged by the region of its blocks alone; `body_blocks` tells which
    pages these are.  Repeated rows of a page count once; further columns are
    not read."""
    per_page = _gone(pages)
    counts = blocks.where("page_id is not null").groupBy("page_id").agg(F.count_distinct("block_id").alias("n"))
    fit = per_page.join(counts, "page_id")
    found = fit.where("n = page_blocks").select("page_id", F.explode("gone").alias("block_id"))
    odd = counts.join(per_page.select("page_id", "page_blocks"), "page_id", "left").where("page_blocks is null or page_blocks <> n").select("page_id")
    rest = blocks.join(odd, "page_id", "left_semi").where("region <> 'main'").select("page_id", F.col("block_id").cast("int").alias("block_id")).distinct()
    return found.unionByName(rest)


def body_blocks(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, block_id, text, judged_by) of the blocks of each page's main body.

    judged_by is `tree`, or `region` where the page's html does not number as
    many blocks as `blocks` has, so that the tree has no say; a null region
    counts as main.  Repeated rows of a block stay repeated."""
    own = blocks.where("page_id is not null").select("page_id", F.col("block_id").cast("int").alias("block_id"), "text", "region")
    counts = own.groupBy("page_id").agg(F.count_distinct("block_id").alias("n"))
    known = counts.join(_gone(pages), "page_id", "left").select("page_id", F.coalesce(F.col("n") == F.col("page_blocks"), F.lit(False)).alias("tree"), "gone")
    judged = own.join(known, "page_id")
    keep = F.when(F.col("tree"), ~F.array_contains("gone", F.col("block_id"))).otherwise(F.coalesce("region", F.lit("main")) == "main")
    return judged.where(keep).select("page_id", "block_id", "text", F.when(F.col("tree"), "tree").otherwise("region").alias("judged_by"))
