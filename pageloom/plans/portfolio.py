"""Queries of extraction, rules, batches, request policy, expansion and keyed state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pageloom.operators import batch, expansion, extraction, policy, rulebook
from pageloom.session import shared_dir, table
from pageloom.streaming import state


def _money(c):
    return F.concat(F.translate(F.format_number(c, 2), ",.", ".,"), F.lit(" €"))


def _detail(spark, sf):
    """Detail pages of parts: a label with its value in a list; every third also has structured data, every ninth with another price."""
    p = table(spark, sf, "part")
    ld = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('<script type="application/ld+json">{"@type":"Offer","offers":{"price":'), F.format_string("%.2f", F.col("p_retailprice") + F.when(F.col("p_partkey") % 9 == 0, 1).otherwise(0)), F.lit("}}</script>"))).otherwise("")
    html = F.concat(F.lit("<html><head><title>"), F.col("p_name"), F.lit("</title>"), ld, F.lit("</head><body><h1>"), F.col("p_name"), F.lit("</h1><dl><dt>Preis</dt><dd id=v"), F.col("p_partkey"), F.lit(">"), _money("p_retailprice"), F.lit("</dd></dl></body></html>"))
    return p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.example/"), F.col("p_size").cast("string"), F.lit("/"), F.regexp_replace("p_brand", "[^A-Za-z]", ""), F.lit("/"), F.col("p_partkey")).alias("url"), F.col("p_size").alias("size"), html.alias("html"))


PRICE = {"name": "price", "type": "price", "aliases": ["Preis"], "paths": ["offers.price"]}


def e_stages(spark, sf):
    """Learns rules page by page and uses them on later pages of a scope; pages with structured data are among them."""
    res, _ = extraction.extract(_detail(spark, sf), [PRICE], scope=F.concat(F.lit("size"), F.col("size").cast("string")))
    return res.select("page_id", "stage", F.round("number", 2).alias("price"), "status")


def e_provenance(spark, sf):
    """Who stands behind each price where the label and the structured data agree, differ, or only one is there."""
    res, _ = extraction.replay(_detail(spark, sf), [{**PRICE, "min_provenance": "CROSS_CONFIRMED"}], scope=F.concat(F.lit("p"), F.col("page_id").cast("string")))
    return res.select("page_id", "stage", "provenance", "status", F.array_contains("signals", "STAGE_DISAGREEMENT").alias("differs"))


def e_cards(spark, sf):
    """Labels and values in sibling wrappers with other blocks between them."""
    s = table(spark, sf, "supplier")
    html = F.concat(F.lit("<main><section><div class=k><span>Kontostand</span></div><div><p>Stand heute</p></div><div class=v><span>"), _money(F.abs("s_acctbal")), F.lit("</span></div></section></main>"))
    pages = s.select(F.col("s_suppkey").alias("page_id"), F.concat(F.lit("https://cards.example/c/"), F.col("s_suppkey")).alias("url"), html.alias("html"))
    res, _ = extraction.replay(pages, [{"name": "balance", "type": "price", "aliases": ["Kontostand"]}], scope=F.concat(F.lit("p"), F.col("page_id").cast("string")))
    return res.select("page_id", "stage", F.round("number", 2).alias("balance"))


def e_portals(spark, sf):
    """The fields of field_specs on the fetched pages."""
    specs = [{"name": r["name"], "type": r["field_type"], "aliases": r["aliases"], "paths": r["paths"], "min": r["min_value"], "max": r["max_value"], "pattern": r["value_pattern"], "max_chars": r["max_chars"], "min_provenance": r["min_provenance"]} for r in table(spark, sf, "field_specs").collect()]
    res, _ = extraction.extract(table(spark, sf, "fetch_results").where("html is not null"), specs)
    return res.select("page_id", "scope", "field", "status", "stage", "value", "number", "provenance")


def e_calls(spark, sf):
    return extraction.calls(e_portals(spark, sf).withColumn("url", F.lit("")))


def w_streaks(spark, sf):
    e = table(spark, sf, "events")
    return rulebook.streaks(e.select("user_id", "event_id", F.floor("value").cast("string").alias("v"), "event_type"), ["user_id"], ["event_id"], "event_type", "v").select("user_id", "event_id", "streak")


def w_misses(spark, sf):
    e = table(spark, sf, "events")
    runs = rulebook.miss_runs(e.select("user_id", "event_id", "value"), ["user_id"], ["event_id"], F.col("value") >= 10)
    return runs.select("user_id", "event_id", "hits", "misses", "total_misses", (F.col("misses") >= 2).alias("stale"))


def _rules(spark, sf):
    """Rules of users: what each type of event found and missed."""
    e = table(spark, sf, "events")
    hit = (F.col("value") >= 10).cast("long")
    return e.groupBy((F.col("user_id") % 50).cast("string").alias("scope"), F.lit("f").alias("field"), F.col("user_id").cast("string").alias("pattern"), "event_type").agg(F.sum(hit).alias("hits"), F.sum(1 - hit).alias("total_misses"), F.min("event_id").alias("id"), F.max("ts").alias("updated_at")).select(
        "id", "scope", "field", "pattern", F.when(F.col("event_type") == "view", "json").when(F.col("event_type") == "click", "regex").otherwise("label").alias("kind"), "hits", F.lit(0).cast("long").alias("misses"), "total_misses", F.lit(0).cast("long").alias("contradictions"), F.lit("candidate").alias("role"), "updated_at"
    )


def w_ranked(spark, sf):
    return rulebook.ranked(_rules(spark, sf)).select("scope", "id", "kind", "hits", "total_misses", "rank")


def w_capped(spark, sf):
    return rulebook.enforce_caps(_rules(spark, sf)).select("scope", "id", "role")


def b_counters(spark, sf):
    return batch.counters(table(spark, sf, "result_rows"), ["batch_id"])


def b_errors(spark, sf):
    return batch.error_codes(table(spark, sf, "result_rows"))


def b_outcomes(spark, sf):
    return batch.field_outcomes(table(spark, sf, "result_rows"))


def b_advisories(spark, sf):
    return batch.advisories(table(spark, sf, "result_rows"), ["host"]).select("host", "code", "value")


def b_pending(spark, sf):
    rows = table(spark, sf, "result_rows")
    urls = table(spark, sf, "fetch_results").select("url", F.col("page_id").alias("pos"))
    return batch.pending(urls, rows, ["received_at", "delivery_id"])


def b_preflight(spark, sf):
    return batch.preflight(table(spark, sf, "result_rows").withColumn("part", F.col("delivery_id") % 2), ["received_at", "delivery_id"], ["part"])


def d_throttle(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return policy.throttle(e, "user_id", "at", ["event_id"], 3600.0).select("user_id", "event_id", F.round("start", 1).alias("start"))


def d_cache(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return policy.cache_hits(e, ["user_id"], "at", ["event_id"], 86400.0 * 3, []).select("user_id", "event_id", "hit")


def _tree(spark, sf):
    """A source of three levels: regions, nations, suppliers."""
    n, s, r = table(spark, sf, "nation"), table(spark, sf, "supplier"), table(spark, sf, "region")
    url = lambda kind, c: F.concat(F.lit(f"https://tree.example/{kind}/"), c.cast("string"))
    none = F.lit(None).cast("struct<template:string,last_page:bigint,next_url:string>")

    def level(df, at, kind, item, order):
        items = F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("url"))))
        g = df.groupBy(at.alias("url")).agg(F.transform(items, lambda x: F.struct(x.url.alias("url"), F.lit("").alias("text"))).alias("items"))
        return g.select("url", none.alias("pagination"), F.array(F.struct(F.lit(kind).alias("kind"), F.col("items"))).alias("groups"))

    top = level(r, F.lit("https://tree.example/"), "child_candidates", url("region", F.col("r_regionkey")), F.col("r_regionkey"))
    mid = level(n, url("region", F.col("n_regionkey")), "child_candidates", url("nation", F.col("n_nationkey")), F.col("n_nationkey"))
    low = level(s, url("nation", F.col("s_nationkey")), "detail_candidates", url("supplier", F.col("s_suppkey")), F.col("s_suppkey"))
    return top.unionByName(mid).unionByName(low)


def x_expand(spark, sf):
    seeds = spark.createDataFrame([("https://tree.example/", 0)], "url string, pos long")
    return expansion.expand(_tree(spark, sf), seeds, max_depth=3)["details"].select("url", F.col("n").cast("long").alias("n"))


def s_streaks(spark, sf):
    """w_streaks over a stream with keyed state."""
    e = table(spark, sf, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{sf}/event[s].parquet")
    rows = stream.select("user_id", "event_id", F.floor("value").cast("string").alias("v"), "event_type")
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    state.drain(state.streaks(rows, "user_id", "event_id", "event_type", "v"), at + "/out", at + "/ckpt")
    return spark.read.parquet(at + "/out").select("user_id", "event_id", "streak")


QUERIES = {f.__name__: f for f in (e_stages, e_provenance, e_cards, e_portals, e_calls, w_streaks, w_misses, w_ranked, w_capped, b_counters, b_errors, b_outcomes, b_advisories, b_pending, b_preflight, d_throttle, d_cache, x_expand, s_streaks)}

_STREAK = """WITH a AS (SELECT user_id, event_id, event_type AS u, CAST(floor(value) AS VARCHAR) AS v, lag(event_type) OVER w AS pu, lag(CAST(floor(value) AS VARCHAR)) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 b AS (SELECT *, sum(CASE WHEN pu IS NULL OR v IS DISTINCT FROM pv THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM a)
 SELECT user_id, event_id, CAST(1 + sum(CASE WHEN pu IS NOT NULL AND v = pv AND u <> pu THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS BIGINT) AS streak FROM b"""
_RULES = """rules AS (SELECT CAST(user_id % 50 AS VARCHAR) AS scope, event_type, sum(CASE WHEN value >= 10 THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN value >= 10 THEN 0 ELSE 1 END) AS total_misses, min(event_id) AS id, max(ts) AS updated_at FROM events GROUP BY 1, user_id, 2),
 scored AS (SELECT *, CASE event_type WHEN 'view' THEN 'json' WHEN 'click' THEN 'regex' ELSE 'label' END AS kind, CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS prior, (hits + 1) / (hits + total_misses + 2) AS score FROM rules),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, prior DESC, id) AS rank FROM scored)"""
_OK, _ST = "coalesce(ok, false)", "('COMPLETE', 'PARTIAL', 'INCOMPLETE')"
ORACLE = {
    # A rule from structured data finds a bare number, which only structured data may give as a price: it never hits, so structured
    # data are asked again until the first page without them teaches the label's rule, which hits ever after.
    "e_stages": """WITH p AS (SELECT p_partkey AS id, p_size AS s, p_retailprice AS v, p_partkey % 3 = 0 AS ld, p_partkey % 9 = 0 AS odd, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part),
 t AS (SELECT *, coalesce(min(n) FILTER (NOT ld) OVER (PARTITION BY s), 1000000000) AS m FROM p)
 SELECT id AS page_id, CASE WHEN n < m THEN 'structured' WHEN n = m THEN 'label' ELSE 'recipe' END AS stage, round(v + CASE WHEN n < m AND odd THEN 1 ELSE 0 END, 2) AS price, 'FOUND' AS status FROM t""",
    "e_provenance": """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 0 THEN 'structured' ELSE 'label' END AS stage, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 9 <> 0 THEN 'CROSS_CONFIRMED' ELSE 'ENGINE_OBSERVED' END AS provenance,
 CASE WHEN p_partkey % 3 = 0 AND p_partkey % 9 <> 0 THEN 'FOUND' ELSE 'UNCONFIRMED' END AS status, p_partkey % 9 = 0 AS differs FROM part""",
    "e_cards": "SELECT s_suppkey AS page_id, 'label' AS stage, round(abs(s_acctbal), 2) AS balance FROM supplier",
    "w_streaks": _STREAK,
    "s_streaks": _STREAK,
    "w_misses": """WITH a AS (SELECT user_id, event_id, value >= 10 AS hit, sum(CASE WHEN value >= 10 THEN 1 ELSE 0 END) OVER w AS hits, sum(CASE WHEN value >= 10 THEN 0 ELSE 1 END) OVER w AS total_misses FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 b AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, hits ORDER BY event_id) AS misses FROM a)
 SELECT user_id, event_id, CAST(hits AS BIGINT) AS hits, CAST(misses AS BIGINT) AS misses, CAST(total_misses AS BIGINT) AS total_misses, misses >= 2 AS stale FROM b""",
    "w_ranked": f"WITH {_RULES} SELECT scope, id, kind, CAST(hits AS BIGINT) AS hits, CAST(total_misses AS BIGINT) AS total_misses, CAST(rank AS INTEGER) AS rank FROM ranked",
    "w_capped": f"""WITH {_RULES}, c AS (SELECT *, CASE WHEN rank > 3 THEN 'retired' ELSE 'candidate' END AS role FROM ranked), k AS (SELECT *, row_number() OVER (PARTITION BY scope, role ORDER BY updated_at DESC, id DESC) AS n FROM c)
 SELECT scope, id, role FROM k WHERE role <> 'retired' OR n <= 16""",
    "b_counters": f"""SELECT batch_id, count(*) AS attempted, count(*) FILTER ({_OK} AND status = 'COMPLETE') AS complete, count(*) FILTER ({_OK} AND status = 'PARTIAL') AS partial, count(*) FILTER ({_OK} AND status = 'INCOMPLETE') AS incomplete,
 count(*) FILTER (NOT ({_OK} AND coalesce(status IN {_ST}, false))) AS errors, CAST(sum(CASE WHEN {_OK} THEN coalesce(len(list_filter(fields, lambda f: f.status = 'UNCONFIRMED')), 0) ELSE 0 END) AS BIGINT) AS unconfirmed_fields FROM result_rows GROUP BY 1""",
    "b_errors": f"SELECT coalesce(error.code, 'UNKNOWN_ERROR') AS code, count(*) AS n FROM result_rows WHERE NOT {_OK} GROUP BY 1",
    "b_outcomes": f"SELECT name, status, count(*) AS n FROM (SELECT coalesce(f.name, 'UNKNOWN') AS name, coalesce(f.status, 'UNKNOWN') AS status FROM (SELECT unnest(fields) AS f FROM result_rows WHERE {_OK})) GROUP BY GROUPING SETS ((status), (name, status))",
    "b_advisories": f"""WITH c AS (SELECT host, count(*) AS n, count(*) FILTER ({_OK} AND status IN ('COMPLETE', 'PARTIAL')) AS usable, sum(CASE WHEN {_OK} THEN len(fields) END) AS seen, sum(CASE WHEN {_OK} THEN len(list_filter(fields, lambda f: f.status = 'NEEDS_AGENT')) END) AS agent FROM result_rows GROUP BY 1),
 f AS (SELECT host, coalesce(f.name, 'UNKNOWN') AS name, count(*) AS n, count(*) FILTER (f.status = 'FOUND') AS found FROM (SELECT host, unnest(fields) AS f FROM result_rows WHERE {_OK}) GROUP BY 1, 2)
 SELECT host, 'LOW_BATCH_YIELD' AS code, round(usable / n, 4) AS value FROM c WHERE n >= 10 AND usable / n <= 0.10 UNION ALL SELECT host, 'HIGH_AGENT_ESCALATION', round(agent / seen, 4) FROM c WHERE seen >= 10 AND agent / seen >= 0.80
 UNION ALL SELECT host, 'SYSTEMATIC_FIELD_GAPS', CAST(count(*) AS DOUBLE) FROM f WHERE n >= 10 AND found = 0 GROUP BY 1""",
    "b_pending": f"""WITH r AS (SELECT url, ok, error.recoverable AS rec, row_number() OVER (PARTITION BY url ORDER BY received_at DESC, delivery_id DESC) AS n FROM result_rows)
 SELECT url, min(page_id) AS pos FROM fetch_results WHERE url IS NOT NULL AND trim(url) <> '' AND url NOT IN (SELECT url FROM r WHERE n = 1 AND url IS NOT NULL AND ({_OK} OR rec IS NOT DISTINCT FROM false)) GROUP BY 1""",
    "d_throttle": "WITH a AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS came FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY came, event_id) * 3600.0 AS k FROM a) SELECT user_id, event_id, round(max(came - k) OVER (PARTITION BY user_id ORDER BY came, event_id) + k, 1) AS start FROM n",
    "x_expand": "SELECT 'https://tree.example/supplier/' || s_suppkey AS url, row_number() OVER (ORDER BY n_regionkey, n_nationkey, s_suppkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey",
}
