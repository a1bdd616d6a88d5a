"""Queries on pages and files that are made from the tables, so that their answers follow from the tables alone."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pageloom.functions import native as N
from pageloom.operators import batch, batchrun, expansion, extraction, pagegraph, policy, rulebook, summary, traversal
from pageloom.plans import sql as Q
from pageloom.plans.pages import _KIDS, _SRC, _graph
from pageloom.plans.portfolio import _OK, _RULES, _STREAK, _money, _rules, _tree
from pageloom.session import shared_dir, table
from pageloom.sources import files
from pageloom.streaming import state

_text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _customers(spark, sf):
    """Customers with their place within the nation, a scope each."""
    from pyspark.sql import Window

    c = table(spark, sf, "customer")
    return c.withColumn("n", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).withColumn("scope", _text("n", F.col("c_nationkey").cast("string")))


def _pages(c, html):
    return c.select(F.col("c_custkey").alias("page_id"), _text("https://c.example/k/", F.col("c_custkey").cast("string")).alias("url"), "scope", html.alias("html"))


BALANCE = {"name": "balance", "type": "price", "aliases": ["Kontostand"]}


def e_redesign(spark, sf):
    """From the sixth page of a scope on the layout is another: the new rule takes over when the old one has failed twice."""
    c = _customers(spark, sf)
    old = _text("<h1>Kunde</h1><dl><dt>Kontostand</dt><dd>", _money(F.abs("c_acctbal")), "</dd></dl>")
    new = _text("<h1>Kunde</h1><div>Kontostand: <b>", _money(F.abs("c_acctbal")), "</b></div>")
    res, _ = extraction.extract(_pages(c, F.when(F.col("n") <= 5, old).otherwise(new)), [BALANCE], scope=F.col("scope"))
    return res.select("page_id", "stage", F.round("number", 2).alias("balance"), F.array_contains("signals", "RECIPE_FALLBACK").alias("fallback"), F.exists("attempts", lambda a: a.endswith("promoted")).alias("promoted"), "rule_role")


def e_resumed(spark, sf):
    """The same pages in two runs, the second from the states of the first: no page learns anew."""
    c = _customers(spark, sf)
    pages = _pages(c, _text("<dl><dt>Kontostand</dt><dd>", _money(F.abs("c_acctbal")), "</dd></dl>")).join(c.select(F.col("c_custkey").alias("page_id"), "n"), "page_id")
    first, states = extraction.extract(pages.where("n <= 3"), [BALANCE], scope=F.col("scope"))
    later, _ = extraction.extract(pages.where("n > 3"), [BALANCE], scope=F.col("scope"), start=states)
    return first.unionByName(later).select("page_id", "stage", F.round("number", 2).alias("balance"), "compiled")


def e_taught(spark, sf):
    """A value that someone names is taken where the page holds it, and only there."""
    c = _customers(spark, sf)
    res, _ = extraction.extract(_pages(c, _text("<h1>Kunde</h1><p>", F.col("c_mktsegment"), "</p>")), [{"name": "segment", "teach": "BUILDING"}], scope=F.col("url"))
    return res.select("page_id", "status", "stage", "reason", "value", "provenance")


def e_rendered(spark, sf):
    """Empty roots of applications are read as rendered; other pages without the field are not."""
    c = _customers(spark, sf)
    shell = F.lit('<div id="root"></div>' + "<script></script>" * 5)
    full = _text("<dl><dt>Kontostand</dt><dd>", _money(F.abs("c_acctbal")), "</dd></dl>")
    pages = _pages(c, F.when(F.col("c_custkey") % 2 == 1, shell).otherwise(F.lit("<p>Ohne Angabe</p>"))).join(c.select(F.col("c_custkey").alias("page_id"), full.alias("rendered")), "page_id")
    res, _ = extraction.extract(pages, [BALANCE], scope=F.col("url"))
    return res.select("page_id", "status", "page_stage", "stage", F.round("number", 2).alias("balance"), F.exists("attempts", lambda a: a == "render:SKIP:PAGE_NOT_JS_SHELL").alias("skipped"), F.array_contains("attempts", "agent:NEEDS_AGENT").alias("handed_over"))


def e_finished(spark, sf):
    """Status of whole pages: two fields, of which some pages lack one or both."""
    c = _customers(spark, sf)
    k = F.col("c_custkey") % 3
    html = _text("<dl>", F.when(k > 0, _text("<dt>Kontostand</dt><dd>", _money(F.abs("c_acctbal")), "</dd>")).otherwise(""), F.when(k > 1, "<dt>E-Mail</dt><dd>post@c.example</dd>").otherwise(""), "</dl>")
    res, _ = extraction.extract(_pages(c, html), [BALANCE, {"name": "mail", "type": "email", "aliases": ["E-Mail"]}], scope=F.col("url"))
    return extraction.calls(res).select("page_id", "found", "total", "status")


def b_run(spark, sf):
    """A batch over customers' pages, some with an error status, some refused, some never fetched."""
    c = _customers(spark, sf)
    k = F.col("c_custkey") % 10
    html = F.when(k == 1, F.lit("<p>Ohne Angabe</p>")).otherwise(_text("<dl><dt>Kontostand</dt><dd>", _money(F.abs("c_acctbal")), "</dd></dl>"))
    pages = _pages(c, html).join(c.select(F.col("c_custkey").alias("page_id"), F.when(k == 2, 500).when(k == 3, 404).when(k == 4, 429).when(k == 5, 403).otherwise(200).alias("status")), "page_id").where("page_id % 10 <> 6").drop("scope")
    urls = c.select(_text("https://c.example/k/", F.col("c_custkey").cast("string")).alias("url"), F.col("c_custkey").alias("pos"))
    rows = batchrun.run(pages, urls, [BALANCE], go_on=True)["rows"]
    return rows.select("url", "ok", "status", F.col("error.code").alias("code"), F.col("error.recoverable").alias("recoverable"), F.round(F.get("fields", F.lit(0)).number, 2).alias("balance"))


def b_states(spark, sf):
    """Counts of the statuses of fields, as for stages and signals."""
    r = table(spark, sf, "result_rows").where("fields is not null").select(F.transform("fields", lambda f: f.status).alias("codes"))
    return batch.exploded_counts(r, "codes", "UNKNOWN")


def b_alarms(spark, sf):
    """What looks unusual in the rows of one status."""
    return batch.advisories(table(spark, sf, "result_rows").withColumn("status", F.coalesce("status", F.lit("?"))), ["status"]).select("status", "code", "value", F.array_join("fields", "+").alias("fields"), "omitted")


def b_review(spark, sf):
    """Early check of two halves; one begins with its failures."""
    r = table(spark, sf, "result_rows").withColumn("part", F.col("delivery_id") % 2).withColumn("lead", F.when(F.col("part") == 1, F.coalesce("ok", F.lit(False))).otherwise(True))
    return batch.preflight(r, ["lead", "received_at", "delivery_id"], ["part"])


def g_heads(spark, sf):
    """Title, language and images of each page."""
    return _graph(spark, sf).select("page_id", N.normalize(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("lang", F.lit("")).alias("lang"), "images")


def g_tops(spark, sf):
    """First headings and links of each page."""
    s = summary.summarize(_graph(spark, sf))
    return s.select("page_id", F.array_join(F.transform(F.coalesce("h1", F.array().cast("array<string>")), lambda t: N.normalize(t)), "|").alias("h1"), F.coalesce(F.size("top_links"), F.lit(0)).alias("links"), F.coalesce(F.get("top_links", F.lit(0)).href, F.lit("")).alias("first"))


def g_triples(spark, sf):
    """Nested JSON, microdata and meta as paths."""
    p = table(spark, sf, "part")
    s = lambda c: F.col(c).cast("string")
    html = _text('<html><head><meta name="brand" content="', F.col("p_brand"), '"><script type="application/ld+json">{"@graph":[{"name":"', F.col("p_name"), '","offers":{"price":', s("p_retailprice"), ',"sizes":[', s("p_size"), ',', (F.col("p_size") + 1).cast("string"), '],"sold":false,"note":null}}]}</script></head><body><p><span itemprop="kind">', F.col("p_type"), "</span></p></body></html>")
    t = pagegraph.triples(pagegraph.page_graph(p.select(F.col("p_partkey").alias("page_id"), F.lit("https://s.example/").alias("url"), html.alias("html"))))
    return t.select("page_id", "pos", "source_kind", "path", "value")


def v_bounded(spark, sf):
    """How many groups of links a page shows, and how many addresses are open."""
    t = traversal.traversal(_graph(spark, sf)).where("not pagination.detected")
    return t.select("page_id", F.size("child_collections").alias("groups"), F.col("known_open_urls").cast("long").alias("open"))


def v_bars(spark, sf):
    """Bars of numbered pages with a gap before the last, in the path, as page and as offset of the query."""
    s = table(spark, sf, "supplier")
    k, last = F.col("s_suppkey") % 3, F.col("s_nationkey") + 9
    at = lambda n: F.when(k == 0, _text("https://l.example/list/page/", n)).when(k == 1, _text("https://l.example/list?page=", n)).otherwise(_text("https://l.example/list?offset=", n))
    a = lambda n: _text('<a href="', at(n.cast("string")), '">', n.cast("string"), "</a> ")
    html = _text("<main><p>", a(F.lit(1)), a(F.lit(2)), a(F.lit(3)), "… ", a(last), "</p></main>")
    g = pagegraph.page_graph(s.select(F.col("s_suppkey").alias("page_id"), at(F.lit("2")).alias("url"), html.alias("html")))
    p = traversal.pagination(g)
    return p.select("page_id", *[F.col(f"pagination.{c}").alias(c) for c in ("kind", "current_page", "current_offset", "last_page", "last_evidence", "highest_visible_offset", "bounded", "has_next", "remaining_pages", "template")])


def q_markers(spark, sf):
    """Pages and offsets in URLs of several forms."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 97 + 1).cast("string").alias("n"), (F.col("o_orderkey") % 6).alias("k"))
    url = F.when(F.col("k") == 0, _text("https://m.example/a/page/", F.col("n"))).when(F.col("k") == 1, _text("https://m.example/a/seite-", F.col("n"), "/x")).when(F.col("k") == 2, _text("https://m.example/a?sort=up&p=", F.col("n"))).when(F.col("k") == 3, _text("https://m.example/a?offset=", F.col("n"), "&sort=up")).when(F.col("k") == 4, _text("https://m.example/a?startIndex=", F.col("n"))).otherwise(_text("https://m.example/a?id=", F.col("n")))
    m = N.marker(F.col("url"))
    return o.withColumn("url", url).select("o_orderkey", m.kind.alias("kind"), m.value.alias("value"), N.template(F.col("url"), m).alias("template"))


def q_reasons(spark, sf):
    """Every reason for which a value is refused."""
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 8).alias("k"), F.col("o_orderkey").cast("string").alias("n"))
    raw = F.when(F.col("k") == 0, "").when(F.col("k") == 1, F.repeat(F.lit("9"), 40)).when(F.col("k") == 2, "X 12").when(F.col("k") == 3, "A keine").when(F.col("k") == 4, "A 0").when(F.col("k") == 5, "A 999999").otherwise(F.concat(F.lit("A "), (F.col("k") + 100).cast("string")))
    v = N.validate(raw, "integer", 1, 5000, "^A", 20)
    unknown = N.validate(raw, "colour", pattern="^A", max_chars=20)
    return o.select(v.reason.alias("reason"), v.number.alias("number"), unknown.reason.alias("unknown")).groupBy("reason", "unknown").agg(F.count("*").alias("n"), F.sum("number").alias("total"))


def q_hosts(spark, sf):
    """Links to the host of their page, and their texts within forty characters."""
    k = table(spark, sf, "links").join(table(spark, sf, "fetch_results").select("page_id", F.coalesce("final_url", "url").alias("here")), "page_id")
    return k.select("page_id", "pos", N.same_host(F.col("href"), F.col("here")).alias("same"), summary.bounded(F.col("text"), 12).alias("short"))


def d_robots(spark, sf):
    """Robots rules: some hosts forbid a folder, some all, some have an error, some have none."""
    n = table(spark, sf, "nation")
    root = _text("https://n", F.col("n_nationkey").cast("string"), ".example")
    k = F.col("n_nationkey") % 4
    robots = n.where(k < 3).select(root.alias("root"), F.when(k == 0, 200).when(k == 1, 403).otherwise(500).alias("status"), F.lit("User-agent: *\nDisallow: /private\n").alias("body"))
    c = table(spark, sf, "customer")
    urls = c.select("c_custkey", _text("https://N", F.col("c_nationkey").cast("string"), ".example/", F.when(F.col("c_custkey") % 2 == 0, "private/").otherwise("open/"), F.col("c_custkey").cast("string")).alias("url"))
    return policy.robots_allowed(urls, robots, "pageloom").select("c_custkey", "allowed")


def d_sources(spark, sf):
    """Exactly one of url and html makes a source."""
    f = table(spark, sf, "fetch_results")
    url, html = F.when(F.col("page_id") % 2 == 0, F.col("url")), F.when(F.col("page_id") % 3 == 0, F.coalesce("html", F.lit("")))
    return f.select("page_id", policy.source_gate(url, html).alias("gate"))


def w_listing(spark, sf):
    """Rules with score and status, as a listing shows them."""
    return rulebook.listing(_rules(spark, sf)).select("scope", "id", F.bround("score", 4).alias("score"), "status")


def w_forgotten(spark, sf):
    """What stays after a scope is forgotten, and how many went."""
    stays, gone = rulebook.forget(_rules(spark, sf), "7")
    return stays.groupBy("scope").agg(F.count("*").alias("n")).unionByName(gone.select(F.lit("forgotten").alias("scope"), F.col("removed").alias("n")))


def w_full(spark, sf):
    """Scopes that keep more retired rules than they may."""
    r = _rules(spark, sf).withColumn("scope", (F.col("scope").cast("int") % 5).cast("string")).withColumn("role", F.when(F.col("hits") >= F.col("total_misses"), "retired").otherwise("candidate"))
    return rulebook.over_full(r).select("scope", "retired")


def x_capped(spark, sf):
    """The tree of x_expand with a cap on details and on depth, entered at two places, one of them twice."""
    seeds = spark.createDataFrame([("https://tree.example/region/2", 0), ("https://tree.example/region/1", 1), ("https://tree.example/region/2", 2)], "url string, pos long")
    got = expansion.expand(_tree(spark, sf), seeds, max_urls=20, max_depth=1)
    return got["details"].select("url", F.col("n").cast("long").alias("n")).withColumn("limited_by", F.lit(got["limited_by"]))


def x_paged(spark, sf):
    """Listings of nations that go over pages: every page is fetched once, every supplier is found once."""
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    base = _text("https://paged.example/nation/", F.col("k").cast("string"))
    # Ten suppliers a page, and one from the page before again.
    rows = s.select(F.col("s_nationkey").alias("k"), F.posexplode(F.array(F.lit(0), F.lit(1))).alias("twice", "again"), "s_suppkey").withColumn("page", F.floor(F.col("s_suppkey") / 40).cast("long") + 1 + F.col("twice")).where("twice = 0 or s_suppkey % 40 = 39")
    last = s.groupBy(F.col("s_nationkey").alias("k")).agg((F.max(F.floor(F.col("s_suppkey") / 40)).cast("long") + 2).alias("last"))
    items = rows.groupBy("k", "page").agg(F.array_sort(F.collect_list(F.struct("s_suppkey"))).alias("i"))
    shown = last.select("k", "last", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))).alias("page")).join(items, ["k", "page"], "left")
    p = "struct<template:string,last_page:bigint,next_url:string>"
    g = F.array(F.struct(F.lit("detail_candidates").alias("kind"), F.transform(F.coalesce("i", F.array().cast("array<struct<s_suppkey:bigint>>")), lambda x: F.struct(_text("https://paged.example/s/", x.s_suppkey.cast("string")).alias("url"), F.lit("").alias("text"))).alias("items")))
    pages = shown.select(_text(base, "?page=", F.col("page").cast("string")).alias("url"), F.struct(_text(base, "?page={page}").alias("template"), F.col("last").alias("last_page"), F.lit(None).cast("string").alias("next_url")).cast(p).alias("pagination"), g.alias("groups"))
    seeds = n.join(last.withColumnRenamed("k", "n_nationkey"), "n_nationkey").select(_text("https://paged.example/nation/", F.col("n_nationkey").cast("string"), "?page=1").alias("url"), F.col("n_nationkey").cast("long").alias("pos"))
    got = expansion.expand(pages, seeds, max_depth=0)
    return got["pages"].select(F.lit("page").alias("what"), "url").unionByName(got["details"].select(F.lit("detail").alias("what"), "url")).groupBy("what", "url").agg(F.count("*").alias("n"))


def _folder(spark):
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def u_urls(spark, sf):
    """URLs of links as a list with comments and repetitions, written, read, and read back as an ordered list."""
    at = _folder(spark)
    k = table(spark, sf, "links")
    # Files in order, of some MB each; compressed ones are read by one task each.
    inorder = k.select((F.col("page_id") * 100_000 + F.col("pos")).alias("o"), "href").repartitionByRange("o").sortWithinPartitions("o")
    inorder.select(F.explode(F.array(F.col("href"), F.lit("# a note"), F.lit("  "))).alias("value")).write.option("compression", "gzip").text(at + "/in")
    urls = files.url_set(spark, at + "/in")
    files.write_url_list(urls, at + "/out", "pos", "gzip")
    return spark.read.text(at + "/out").groupBy(F.col("value").alias("url")).agg(F.count("*").alias("n"))


def u_log(spark, sf):
    """Result rows as JSON lines with torn ones among them, read back; the last row of each url counts."""
    at = _folder(spark)
    r = table(spark, sf, "result_rows").where("url is not null").select("url", "ok", "status", "error", "delivery_id")
    files.write_jsonl(r, at)
    r.limit(5).select(F.lit('{"url": "https://torn.example/", "ok": tr').alias("value")).write.mode("append").text(at)
    log = files.result_log(spark, at, "url string, ok boolean, status string, delivery_id long, error struct<code:string,message:string,recoverable:boolean>")
    return batch.latest(log.select("url", "delivery_id", "ok", "status"), "url", ["delivery_id"]).groupBy("ok", "status").agg(F.count("*").alias("n"))


def s_cache(spark, sf):
    """d_cache over a stream with keyed state."""
    e = table(spark, sf, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf}/event[s].parquet").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    at = _folder(spark)
    state.drain(state.cache_hits(stream, "user_id", "event_id", "at", 86400.0 * 3), at + "/out", at + "/ckpt")
    return spark.read.parquet(at + "/out").select("user_id", "event_id", "hit")


def s_restarted(spark, sf):
    """w_streaks over a stream in two runs: the second starts where the first ended, nothing comes twice."""
    at = _folder(spark)
    e = table(spark, sf, "events").select("user_id", "event_id", F.floor("value").cast("string").alias("v"), "event_type")
    half = e.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    for part in (F.col("event_id") <= half, F.col("event_id") > half):
        e.where(part).write.mode("append").parquet(at + "/in")
        state.drain(state.streaks(spark.readStream.schema(e.schema).parquet(at + "/in"), "user_id", "event_id", "event_type", "v"), at + "/out", at + "/ckpt")
    return spark.read.parquet(at + "/out").select("user_id", "event_id", "streak")


QUERIES = {
    f.__name__: f
    for f in (
        e_redesign, e_resumed, e_taught, e_rendered, e_finished, b_run, b_states, b_alarms, b_review, g_heads, g_tops, g_triples, v_bounded, v_bars, q_markers, q_reasons, q_hosts, d_robots, d_sources,
        w_listing, w_forgotten, w_full, x_capped, x_paged, u_urls, u_log, s_cache, s_restarted,
    )
}

_CUST = "c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, round(abs(c_acctbal), 2) AS bal FROM customer)"
_SIX = "list_filter(fields, lambda f: f.status = 'NEEDS_AGENT')"
CACHE = """WITH RECURSIVE a AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS came, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 w AS (SELECT user_id, event_id, n, came AS fetched, false AS hit FROM a WHERE n = 1 UNION ALL
 SELECT a.user_id, a.event_id, a.n, CASE WHEN a.came - w.fetched < 259200 THEN w.fetched ELSE a.came END, a.came - w.fetched < 259200 FROM w JOIN a ON a.user_id = w.user_id AND a.n = w.n + 1)
 SELECT user_id, event_id, hit FROM w"""
ORACLE = {
    "d_cache": CACHE,
    "s_cache": CACHE,
    "s_restarted": _STREAK,
    "e_redesign": f"""WITH {_CUST} SELECT c_custkey AS page_id, CASE WHEN n IN (1, 6) THEN 'label' ELSE 'recipe' END AS stage, bal AS balance, n = 7 AS fallback, n = 7 AS promoted,
 CASE WHEN n = 6 THEN 'candidate' ELSE 'primary' END AS rule_role FROM c""",
    "e_resumed": f"WITH {_CUST} SELECT c_custkey AS page_id, CASE WHEN n = 1 THEN 'label' ELSE 'recipe' END AS stage, bal AS balance, n = 1 AS compiled FROM c",
    "e_taught": """SELECT c_custkey AS page_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'FOUND' ELSE 'NOT_GROUNDED' END AS status, 'taught' AS stage, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'VALUE_NOT_IN_PAGE' END AS reason,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' END AS value, CASE WHEN c_mktsegment = 'BUILDING' THEN 'AGENT_TAUGHT' END AS provenance FROM customer""",
    "e_rendered": """SELECT c_custkey AS page_id, CASE WHEN c_custkey % 2 = 1 THEN 'FOUND' ELSE 'NEEDS_AGENT' END AS status, CASE WHEN c_custkey % 2 = 1 THEN 'render' ELSE 'first' END AS page_stage, CASE WHEN c_custkey % 2 = 1 THEN 'label' END AS stage,
 CASE WHEN c_custkey % 2 = 1 THEN round(abs(c_acctbal), 2) END AS balance, c_custkey % 2 = 0 AS skipped, c_custkey % 2 = 0 AS handed_over FROM customer""",
    "e_finished": "SELECT c_custkey AS page_id, c_custkey % 3 AS found, CAST(2 AS BIGINT) AS total, CASE c_custkey % 3 WHEN 0 THEN 'INCOMPLETE' WHEN 1 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM customer",
    "b_run": """WITH k AS (SELECT *, c_custkey % 10 AS k FROM customer) SELECT 'https://c.example/k/' || c_custkey AS url, k NOT IN (2, 3, 4, 5, 6) AS ok, CASE WHEN k IN (2, 3, 4, 5, 6) THEN 'ERROR' WHEN k = 1 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status,
 CASE WHEN k IN (2, 3) THEN 'HTTP_ERROR' WHEN k IN (4, 5) THEN 'BLOCKED' WHEN k = 6 THEN 'FETCH_FAILED' END AS code, CASE WHEN k = 3 THEN false WHEN k IN (2, 4, 5, 6) THEN true END AS recoverable,
 CASE WHEN k NOT IN (1, 2, 3, 4, 5, 6) THEN round(abs(c_acctbal), 2) END AS balance FROM k""",
    "b_states": "SELECT coalesce(f.status, 'UNKNOWN') AS code, count(*) AS n FROM (SELECT unnest(fields) AS f FROM result_rows) GROUP BY 1",
    "b_alarms": f"""WITH r AS (SELECT *, coalesce(status, '?') AS s FROM result_rows), c AS (SELECT s, count(*) AS n, count(*) FILTER ({_OK} AND status IN ('COMPLETE', 'PARTIAL')) AS usable, sum(CASE WHEN {_OK} THEN len(fields) END) AS seen, sum(CASE WHEN {_OK} THEN len({_SIX}) END) AS agent FROM r GROUP BY 1),
 f AS (SELECT s, coalesce(f.name, 'UNKNOWN') AS name, count(*) AS n, count(*) FILTER (f.status = 'FOUND') AS found FROM (SELECT s, unnest(fields) AS f FROM r WHERE {_OK}) GROUP BY 1, 2), g AS (SELECT s, list_sort(list(name)) AS names FROM f WHERE n >= 10 AND found = 0 GROUP BY 1)
 SELECT s AS status, 'LOW_BATCH_YIELD' AS code, round_even(usable / n, 4) AS value, CAST(NULL AS VARCHAR) AS fields, CAST(NULL AS INTEGER) AS omitted FROM c WHERE n >= 10 AND usable / n <= 0.10 UNION ALL SELECT s, 'HIGH_AGENT_ESCALATION', round_even(agent / seen, 4), NULL, NULL FROM c WHERE seen >= 10 AND agent / seen >= 0.80
 UNION ALL SELECT s, 'SYSTEMATIC_FIELD_GAPS', CAST(len(names) AS DOUBLE), array_to_string(names[1:5], '+'), CAST(greatest(0, len(names) - 5) AS INTEGER) FROM g""",
    "b_review": f"""WITH r AS (SELECT *, delivery_id % 2 AS part, CASE WHEN delivery_id % 2 = 1 THEN {_OK} ELSE true END AS lead FROM result_rows), k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY lead, received_at NULLS FIRST, delivery_id) AS k FROM r),
 f AS (SELECT part, count(*) AS n, count(*) FILTER ({_OK} AND status IN ('COMPLETE', 'PARTIAL')) AS usable, sum(CASE WHEN {_OK} THEN len(fields) END) AS seen, sum(CASE WHEN {_OK} THEN len({_SIX}) END) AS agent FROM k WHERE k <= 10 GROUP BY 1)
 SELECT part, pending, coalesce(usable / n <= 0.10, false) OR coalesce(seen >= 10 AND agent / seen >= 0.80, false) AS stop FROM (SELECT part, count(*) AS pending FROM r GROUP BY 1) JOIN f USING (part) WHERE pending >= 1000""",
    "b_preflight": f"""WITH r AS (SELECT *, delivery_id % 2 AS part FROM result_rows), k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY received_at NULLS FIRST, delivery_id) AS k FROM r),
 f AS (SELECT part, count(*) AS n, count(*) FILTER ({_OK} AND status IN ('COMPLETE', 'PARTIAL')) AS usable, sum(CASE WHEN {_OK} THEN len(fields) END) AS seen, sum(CASE WHEN {_OK} THEN len({_SIX}) END) AS agent FROM k WHERE k <= 10 GROUP BY 1)
 SELECT part, pending, coalesce(usable / n <= 0.10, false) OR coalesce(seen >= 10 AND agent / seen >= 0.80, false) AS stop FROM (SELECT part, count(*) AS pending FROM r GROUP BY 1) JOIN f USING (part) WHERE pending >= 1000""",
    "g_heads": f"""SELECT page_id, {Q.norm("regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)")} AS title, regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1) AS lang, CAST(len(regexp_extract_all(html, '<img')) AS INTEGER) AS images FROM fetch_results WHERE html <> ''""",
    "g_tops": f"""WITH {_SRC}, h AS (SELECT page_id, array_to_string(list({Q.norm("text")} ORDER BY block_id)[1:5], '|') AS h1 FROM bl WHERE heading_level = 1 GROUP BY 1), u AS (SELECT page_id, href, min(pos) AS p FROM lk WHERE internal AND text <> '' GROUP BY 1, 2),
 t AS (SELECT page_id, least(count(*), 25) AS links, arg_min(href, p) AS first FROM u GROUP BY 1) SELECT s.page_id, coalesce(h1, '') AS h1, CAST(coalesce(links, 0) AS INTEGER) AS links, coalesce(first, '') AS first FROM src s LEFT JOIN h ON h.page_id = s.page_id LEFT JOIN t ON t.page_id = s.page_id""",
    "g_triples": """SELECT p_partkey AS page_id, CAST(i AS INTEGER) AS pos, ['jsonld', 'jsonld', 'jsonld', 'jsonld', 'microdata', 'meta'][i + 1] AS source_kind, ['name', 'offers.price', 'offers.sizes', 'offers.sizes', 'kind', 'brand'][i + 1] AS path,
 CASE i WHEN 0 THEN p_name WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN CAST(p_size + 1 AS VARCHAR) WHEN 4 THEN p_type WHEN 5 THEN p_brand ELSE CAST(p_retailprice AS VARCHAR) END AS value FROM part, range(6) AS r(i)""",
    "v_bounded": f"""WITH {_KIDS}, r AS (SELECT page_id, n, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, scope) AS k FROM g)
 SELECT s.page_id, CAST(count(r.k) AS INTEGER) AS groups, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS open FROM src s LEFT JOIN r ON r.page_id = s.page_id AND k <= 8 WHERE s.page_id NOT IN (SELECT page_id FROM pu) GROUP BY 1""",
    "v_bars": """WITH s AS (SELECT s_suppkey AS page_id, s_suppkey % 3 AS k, s_nationkey + 9 AS last FROM supplier) SELECT page_id, CASE WHEN k = 2 THEN 'offset' ELSE 'page' END AS kind, CAST(CASE WHEN k < 2 THEN 2 END AS BIGINT) AS current_page, CAST(CASE WHEN k = 2 THEN 2 END AS BIGINT) AS current_offset,
 CAST(CASE WHEN k < 2 THEN last END AS BIGINT) AS last_page, CASE WHEN k < 2 THEN 'terminal-page-gap' END AS last_evidence, CAST(CASE WHEN k = 2 THEN last END AS BIGINT) AS highest_visible_offset, k < 2 AS bounded, k < 2 AS has_next, CAST(CASE WHEN k < 2 THEN last - 2 END AS BIGINT) AS remaining_pages,
 CASE k WHEN 0 THEN 'https://l.example/list/page/{page}' WHEN 1 THEN 'https://l.example/list?page={page}' ELSE 'https://l.example/list?offset={offset}' END AS template FROM s""",
    "q_markers": """WITH o AS (SELECT o_orderkey, o_orderkey % 97 + 1 AS n, o_orderkey % 6 AS k FROM orders) SELECT o_orderkey, CASE WHEN k < 3 THEN 'page' WHEN k < 5 THEN 'offset' END AS kind, CASE WHEN k < 5 THEN n END AS value,
 ['https://m.example/a/page/{page}', 'https://m.example/a/seite-{page}/x', 'https://m.example/a?sort=up&p={page}', 'https://m.example/a?offset={offset}&sort=up', 'https://m.example/a?startIndex={offset}', NULL][k + 1] AS template FROM o""",
    "q_reasons": """WITH o AS (SELECT o_orderkey % 8 AS k FROM orders), r AS (SELECT ['EMPTY', 'TOO_LONG', 'PATTERN_MISMATCH', 'TYPE_MISMATCH', 'BELOW_MIN', 'ABOVE_MAX', 'OK', 'OK'][k + 1] AS reason, ['EMPTY', 'TOO_LONG', 'PATTERN_MISMATCH', 'UNKNOWN_TYPE', 'UNKNOWN_TYPE', 'UNKNOWN_TYPE', 'UNKNOWN_TYPE', 'UNKNOWN_TYPE'][k + 1] AS unknown, CASE WHEN k > 5 THEN CAST(k + 100 AS DOUBLE) END AS number FROM o)
 SELECT reason, unknown, count(*) AS n, sum(number) AS total FROM r GROUP BY 1, 2""",
    "q_hosts": f"""SELECT page_id, pos, {Q.host("href")} = {Q.host("here")} AS same, CASE WHEN length(text) > 12 THEN left(text, 12) || '…' ELSE text END AS short FROM links JOIN (SELECT page_id, coalesce(final_url, url) AS here FROM fetch_results) USING (page_id)""",
    "d_robots": "SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN c_custkey % 2 = 1 WHEN 1 THEN false ELSE true END AS allowed FROM customer",
    "d_sources": "SELECT page_id, CASE WHEN (page_id % 2 = 0 AND coalesce(url, '') <> '') AND page_id % 3 = 0 THEN 'SOURCE_AMBIGUOUS' WHEN NOT (page_id % 2 = 0 AND coalesce(url, '') <> '') AND page_id % 3 <> 0 THEN 'SOURCE_REQUIRED' END AS gate FROM fetch_results",
    "w_listing": f"WITH {_RULES} SELECT scope, id, round_even(score, 4) AS score, 'active' AS status FROM scored",
    "w_forgotten": f"WITH {_RULES} SELECT CASE WHEN scope = '7' THEN 'forgotten' ELSE scope END AS scope, count(*) AS n FROM scored GROUP BY 1",
    "w_full": f"WITH {_RULES} SELECT CAST(CAST(scope AS INTEGER) % 5 AS VARCHAR) AS scope, count(*) AS retired FROM scored WHERE hits >= total_misses GROUP BY 1 HAVING count(*) > 16",
    "x_capped": """SELECT 'https://tree.example/supplier/' || s_suppkey AS url, n, 'max_urls' AS limited_by FROM (SELECT s_suppkey, row_number() OVER (ORDER BY CASE n_regionkey WHEN 2 THEN 0 ELSE 1 END, n_nationkey, s_suppkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 2)) WHERE n <= 20""",
    "x_paged": """WITH l AS (SELECT s_nationkey AS k, max(s_suppkey // 40) + 2 AS last FROM supplier GROUP BY 1) SELECT 'page' AS what, 'https://paged.example/nation/' || k || '?page=' || unnest(range(1, last + 1)) AS url, CAST(1 AS BIGINT) AS n FROM l
 UNION ALL SELECT 'detail', 'https://paged.example/s/' || s_suppkey, 1 FROM supplier""",
    "u_urls": "SELECT DISTINCT href AS url, CAST(1 AS BIGINT) AS n FROM links",
    "u_log": "SELECT ok, status, count(*) AS n FROM (SELECT ok, status, row_number() OVER (PARTITION BY url ORDER BY delivery_id DESC) AS k FROM result_rows WHERE url IS NOT NULL) WHERE k = 1 GROUP BY 1, 2",
}
