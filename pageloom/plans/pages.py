"""Queries of the page graph and what is computed from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import native as N
from pageloom.operators import pagegraph, policy, relevance, summary, traversal
from pageloom.plans import sql as Q
from pageloom.session import cut, spread, table


def _graph(spark, sf):
    """Graphs of all pages with html."""
    return pagegraph.page_graph(table(spark, sf, "fetch_results").where("html is not null and html <> ''"))


def g_blocks(spark, sf):
    return pagegraph.blocks(_graph(spark, sf)).select("page_id", "block_id", "kind", N.normalize(F.col("text")).alias("text"), "region", F.round("weight", 4).alias("weight"), "table_row", "heading_level", F.size("emphasis").alias("strong"), F.size("section").alias("depth"))


def g_links(spark, sf):
    return pagegraph.links(_graph(spark, sf)).select("page_id", "pos", "href", N.normalize(F.col("text")).alias("text"), "internal", "nofollow", "block_id", F.array_join("rel", " ").alias("rel"))


def g_offers(spark, sf):
    t = pagegraph.triples(_graph(spark, sf))
    return t.where("source_kind = 'jsonld' and path = 'offers.price'").select("page_id", N.parse_number(F.col("value")).alias("price"))


def g_summary(spark, sf):
    s = summary.summarize(_graph(spark, sf))
    return s.select("page_id", "blocks", "text_chars", "links_internal", "links_external", "links_nofollow", F.coalesce(F.size("h1"), F.lit(0)).alias("h1"), F.size("outline").alias("outline"), "needs_render")


def v_pagination(spark, sf):
    p = traversal.pagination(_graph(spark, sf)).where("pagination.detected")
    return p.select("page_id", *[F.col(f"pagination.{c}").alias(c) for c in ("kind", "current_page", "last_page", "next_url", "last_url", "has_next", "remaining_pages", "last_evidence", "bounded")])


def v_children(spark, sf):
    g = traversal.frontier(_graph(spark, sf)).select("page_id", F.explode("groups").alias("g"))
    return g.select("page_id", F.col("g.scope").alias("scope"), F.col("g.kind").alias("kind"), F.col("g.count").alias("n"), F.col("g.items")[0]["url"].alias("first_url"))


def v_coverage(spark, sf):
    t = traversal.traversal(_graph(spark, sf))
    return t.groupBy("coverage_status", F.array_join("signals", "+").alias("signals")).agg(F.count("*").alias("pages"))


SEARCH = "Garten Kaufpreis garden price"


def r_search(spark, sf):
    r = relevance.score_blocks(_graph(spark, sf), SEARCH)
    return r.select("page_id", "block_id", F.round("score", 4).alias("score"), F.array_join("matched", " ").alias("matched"))


def r_located(spark, sf):
    g = cut(_graph(spark, sf))
    return relevance.locate(g, SEARCH, results=3, context=400).select("page_id", "rank", "block_id", "score", "next_text")


def d_challenge(spark, sf):
    f = spread(table(spark, sf, "fetch_results").select("page_id", "status", "html"))
    e = policy.http_error(F.col("status"))
    return f.select("page_id", policy.challenge(F.col("status"), F.col("html")).alias("challenge"), e.code.alias("error"), e.recoverable.alias("recoverable"), policy.visible_chars(F.col("html")).alias("visible"))


def d_gates(spark, sf):
    k = table(spark, sf, "links").select("href").distinct()
    return k.select("href", policy.url_gate(F.col("href"), ["partner-3.example"]).alias("gate"))


QUERIES = {f.__name__: f for f in (g_blocks, g_links, g_offers, g_summary, v_pagination, v_children, v_coverage, r_search, r_located, d_challenge, d_gates)}

#: Pages with html, and the page whose blocks and links are theirs: cached pages have those of the page with the same html and address.
_SRC = """twin AS (SELECT html, coalesce(final_url, url) AS u, min(page_id) AS id FROM fetch_results WHERE page_id IN (SELECT page_id FROM blocks) GROUP BY 1, 2),
 src AS (SELECT f.page_id, f.html, coalesce(b.page_id, t.id) AS from_id FROM fetch_results f LEFT JOIN (SELECT DISTINCT page_id FROM blocks) b ON b.page_id = f.page_id LEFT JOIN twin t ON t.html = f.html AND t.u IS NOT DISTINCT FROM coalesce(f.final_url, f.url) WHERE f.html <> ''),
 bl AS (SELECT s.page_id, b.* EXCLUDE (page_id) FROM src s JOIN blocks b ON b.page_id = s.from_id),
 lk AS (SELECT s.page_id, k.* EXCLUDE (page_id) FROM src s JOIN links k ON k.page_id = s.from_id)"""
_FACTOR = "CASE region WHEN 'main' THEN 1.0 WHEN 'header' THEN 0.6 WHEN 'aside' THEN 0.5 ELSE 0.3 END"
_LEVEL = "CASE heading_level WHEN 1 THEN 4.0 WHEN 2 THEN 3.0 WHEN 3 THEN 2.5 WHEN NULL THEN 1.0 ELSE CASE WHEN heading_level IS NULL THEN 1.0 ELSE 2.0 END END"
#: Links of a page whose address holds a page number and which belong to its pagination, and those that say what they are.
_PAGED = f"""{_SRC}, k AS (SELECT l.page_id, l.pos, {Q.clean("l.href")} AS href, {Q.norm("l.text")} AS text, l.rel, {Q.clean("coalesce(f.final_url, f.url)")} AS here FROM lk l JOIN fetch_results f ON l.page_id = f.page_id WHERE l.internal),
 m AS (SELECT *, TRY_CAST(nullif(regexp_extract(href, '[?&]page=([0-9]+)(&|$)', 1), '') AS BIGINT) AS pg,
   CASE WHEN list_contains(rel, 'last') THEN 'last' WHEN list_contains(rel, 'next') THEN 'next' WHEN list_contains(rel, 'prev') OR list_contains(rel, 'previous') THEN 'prev' WHEN list_contains(rel, 'first') THEN 'first'
     WHEN text IN ('»', '>', '›', '→') THEN 'next' WHEN text IN ('«', '<', '‹', '←') THEN 'prev' END AS means FROM k),
 pu AS (SELECT DISTINCT page_id, href FROM m WHERE means IS NOT NULL OR (pg IS NOT NULL AND (regexp_full_match(text, '[0-9]+') OR {Q.part("href", "path")} = {Q.part("here", "path")}))),
 a AS (SELECT page_id, any_value(here) AS here, arg_min(href, pos) FILTER (means = 'next') AS nx, arg_min(href, pos) FILTER (means = 'last') AS la FROM m GROUP BY page_id),
 s AS (SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(here, '[?&]page=([0-9]+)(&|$)', 1), '') AS BIGINT), 1) AS cur, nx, la, TRY_CAST(nullif(regexp_extract(la, '[?&]page=([0-9]+)(&|$)', 1), '') AS BIGINT) AS last FROM a)"""
_KIDS = f"""{_PAGED}, kids AS (SELECT m.page_id, m.pos, m.href, {Q.scope("m.href")} AS scope FROM m LEFT JOIN pu ON m.page_id = pu.page_id AND m.href = pu.href
   WHERE pu.href IS NULL AND m.href <> m.here AND {Q.host("m.href")} = {Q.host("m.here")} AND {Q.scope("m.href")} <> {Q.scope("m.here")}),
 g AS (SELECT page_id, scope, count(DISTINCT href) AS n, arg_min(href, pos) AS first_url, count(DISTINCT {Q.part("href", "path")}) AS paths FROM kids GROUP BY 1, 2 HAVING count(DISTINCT href) >= 2)"""
_VISIBLE = f"""length(trim(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<[^>]+>', ' ', 'g'), '{Q.UNI_WS}+', ' ', 'g')))"""
_TERMS = SEARCH.lower().split()
_SCORED = f"""WITH {_SRC}, t AS (SELECT unnest({_TERMS!r}) AS term),
 b AS (SELECT page_id, block_id, regexp_extract_all({Q.fold("text")}, '[a-z0-9]+') AS tok, list_transform(section, lambda h: regexp_extract_all({Q.fold("h")}, '[a-z0-9]+')) AS heads, regexp_extract_all({Q.fold("array_to_string(emphasis, ' ')")}, '[a-z0-9]+') AS strong, ({_LEVEL}) * ({_FACTOR}) AS weight FROM bl),
 p AS (SELECT page_id, count(*) AS n, CASE WHEN sum(len(tok)) = 0 THEN 1.0 ELSE sum(len(tok)) / count(*) END AS avg_len FROM b GROUP BY 1),
 d AS (SELECT b.page_id, t.term, count(*) FILTER (list_contains(b.tok, t.term)) AS df FROM b, t GROUP BY 1, 2),
 ti AS (SELECT page_id, regexp_extract_all({Q.fold("regexp_extract(html, '<title>([^<]*)', 1)")}, '[a-z0-9]+') AS title FROM fetch_results),
 x AS (SELECT b.page_id, b.block_id, t.term, ln(1 + (p.n - d.df + 0.5) / (d.df + 0.5)) AS idf, len(list_filter(b.tok, lambda q: q = t.term)) AS tf, 0.25 + 0.75 * len(b.tok) / p.avg_len AS norm, b.weight, list_contains(b.strong, t.term) AS strong, list_contains(ti.title, t.term) AS titled,
   coalesce(list_max(list_transform(b.heads, lambda h, i: CASE WHEN list_contains(h, t.term) THEN 0.5 + 0.5 * i / len(b.heads) ELSE 0 END)), 0) AS near
   FROM b JOIN p ON b.page_id = p.page_id CROSS JOIN t JOIN d ON d.page_id = b.page_id AND d.term = t.term JOIN ti ON ti.page_id = b.page_id WHERE len(b.tok) > 0),
 y AS (SELECT page_id, block_id, sum(CASE WHEN tf > 0 THEN idf * (tf * 2.2 / (tf + 1.2 * norm)) * weight + CASE WHEN strong THEN idf ELSE 0 END + CASE WHEN titled THEN idf * 0.75 ELSE 0 END ELSE 0 END + idf * 0.6 * near) AS raw,
   list_sort(list(term) FILTER (tf > 0 OR near > 0)) AS matched FROM x GROUP BY 1, 2),
 z AS (SELECT page_id, block_id, raw * (0.5 + 0.5 * len(matched) / {len(_TERMS)}) AS score, matched FROM y WHERE raw > 0)"""
ORACLE = {
    "g_blocks": f"WITH {_SRC} SELECT page_id, block_id, kind, {Q.norm('text')} AS text, region, CAST(round(({_LEVEL}) * ({_FACTOR}), 4) AS DOUBLE) AS weight, table_row, heading_level, CAST(len(emphasis) AS INTEGER) AS strong, CAST(len(section) AS INTEGER) AS depth FROM bl",
    "g_links": f"WITH {_SRC} SELECT page_id, pos, href, {Q.norm('text')} AS text, internal, nofollow, block_id, array_to_string(rel, ' ') AS rel FROM lk",
    "g_offers": f"""SELECT page_id, CAST(regexp_extract(html, '"offers":\\{{"price":"([0-9.]+)"', 1) AS DOUBLE) AS price FROM fetch_results WHERE regexp_matches(html, 'ld.json.*"offers":\\{{"price":"[0-9.]+"')""",
    "g_summary": f"""WITH {_SRC}, b AS (SELECT page_id, count(*) AS blocks, sum(length({Q.norm("text")})) AS chars, count(*) FILTER (heading_level = 1) AS h1, count(*) FILTER (heading_level IS NOT NULL) AS heads FROM bl GROUP BY 1),
 k AS (SELECT page_id, count(*) FILTER (internal) AS i, count(*) FILTER (NOT internal) AS e, count(*) FILTER (nofollow) AS n FROM lk GROUP BY 1),
 r AS (SELECT page_id, regexp_matches(html, '<div[^>]* id="?(root|app|__next|__nuxt)"') AS root, len(regexp_extract_all(html, '<script')) AS scripts, regexp_matches(html, 'application/ld.json') AS ld FROM src)
 SELECT r.page_id, CAST(coalesce(b.blocks, 0) AS INTEGER) AS blocks, CAST(coalesce(b.chars, 0) AS BIGINT) AS text_chars, CAST(coalesce(k.i, 0) AS INTEGER) AS links_internal, CAST(coalesce(k.e, 0) AS INTEGER) AS links_external, CAST(coalesce(k.n, 0) AS INTEGER) AS links_nofollow,
 CAST(least(coalesce(b.h1, 0), 5) AS INTEGER) AS h1, CAST(least(coalesce(b.heads, 0), 40) AS INTEGER) AS outline,
 (CASE WHEN coalesce(b.chars, 0) < 400 THEN 0.45 ELSE 0 END + CASE WHEN r.root THEN 0.30 ELSE 0 END + CASE WHEN r.scripts >= 5 THEN 0.15 ELSE 0 END - CASE WHEN r.ld THEN 0.10 ELSE 0 END) >= 0.599 AS needs_render
 FROM r LEFT JOIN b ON b.page_id = r.page_id LEFT JOIN k ON r.page_id = k.page_id""",
    "v_pagination": f"""WITH {_PAGED} SELECT s.page_id, 'page' AS kind, cur AS current_page, last AS last_page, nx AS next_url, la AS last_url, CASE WHEN last IS NULL THEN nx IS NOT NULL ELSE cur < last END AS has_next, greatest(0, last - cur) AS remaining_pages,
 CASE WHEN la IS NOT NULL THEN 'rel=last' END AS last_evidence, la IS NOT NULL AS bounded FROM s WHERE page_id IN (SELECT page_id FROM pu)""",
    "v_children": f"WITH {_KIDS} SELECT page_id, scope, CASE WHEN contains(scope, '*') OR paths = 1 THEN 'detail_candidates' ELSE 'child_candidates' END AS kind, CAST(n AS INTEGER) AS n, first_url FROM g",
    "v_coverage": f"""WITH {_KIDS}, c AS (SELECT p.page_id, coalesce(CASE WHEN s.last IS NULL THEN s.nx IS NOT NULL ELSE s.cur < s.last END, false) AS open, p.page_id IN (SELECT page_id FROM pu) AND s.la IS NULL AS unbounded, p.page_id IN (SELECT page_id FROM g) AS kids FROM src p LEFT JOIN s ON p.page_id = s.page_id)
 SELECT CASE WHEN open OR unbounded OR kids THEN 'INCOMPLETE' ELSE 'UNKNOWN' END AS coverage_status, concat_ws('+', CASE WHEN open THEN 'PAGINATION_OPEN' WHEN unbounded THEN 'PAGINATION_UNBOUNDED' END, CASE WHEN kids THEN 'CHILD_LEVEL_CANDIDATES' END) AS signals, count(*) AS pages FROM c GROUP BY 1, 2""",
    "r_search": f"""{_SCORED}
 SELECT page_id, block_id, round(score, 4) AS score, array_to_string(matched, ' ') AS matched FROM z""",
    "r_located": f"""{_SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, block_id) AS rank FROM z),
 h AS (SELECT k.page_id, k.rank, k.block_id, k.score, CASE WHEN length(b.text) > 400 THEN left(b.text, 400) || '…' ELSE b.text END AS shown,
   CASE WHEN n.section = b.section AND length(b.text) < 80 THEN CASE WHEN length(n.text) > 200 THEN left(n.text, 200) || '…' ELSE n.text END END AS next_text
   FROM k JOIN bl b ON b.page_id = k.page_id AND b.block_id = k.block_id LEFT JOIN bl n ON n.page_id = k.page_id AND n.block_id = k.block_id + 1 WHERE rank <= 3),
 u AS (SELECT *, sum(length(shown) + length(coalesce(next_text, ''))) OVER (PARTITION BY page_id ORDER BY rank) > 400 AS beyond FROM h),
 v AS (SELECT *, bool_or(beyond) OVER (PARTITION BY page_id ORDER BY rank) AS stopped FROM u)
 SELECT page_id, CAST(rank AS INTEGER) AS rank, block_id, round(score, 4) AS score, next_text FROM v WHERE NOT stopped OR rank = 1""",
    "d_challenge": f"""SELECT page_id, CASE WHEN status = 429 THEN 'RATE_LIMITED' WHEN tech <> '' AND (odd OR visible < 600) THEN 'CHALLENGE:' || tech WHEN phrase <> '' AND odd AND visible < 600 THEN 'CHALLENGE:' || phrase WHEN status IN (401, 403) THEN 'HTTP_' || status END AS challenge,
 CASE WHEN status >= 400 THEN 'HTTP_ERROR' END AS error, CASE WHEN status >= 400 THEN status >= 500 END AS recoverable, CAST(visible AS INTEGER) AS visible
 FROM (SELECT page_id, status, status IN (202, 401, 403, 503) AS odd, {_VISIBLE} AS visible, lower(regexp_extract(coalesce(html, ''), '(?i)g-recaptcha|grecaptcha|h-captcha|hcaptcha\\.com|cf-chl-|challenge-platform|cf_chl_opt|cf-turnstile|captcha-delivery|datadome|px-captcha|_incapsula_', 0)) AS tech,
  lower(regexp_extract(coalesce(html, ''), '(?i)are you a robot|are you human|verify you are human|unusual traffic|access denied|bitte bestätigen sie, dass sie kein roboter sind', 0)) AS phrase FROM fetch_results)""",
    "d_gates": f"SELECT href, CASE WHEN lower({Q.part('href', 'scheme')}) NOT IN ('http', 'https') THEN 'URL_SCHEME_DENIED' WHEN {Q.host('href')} = '' THEN 'URL_INVALID' WHEN {Q.host('href')} = 'partner-3.example' OR {Q.host('href')} LIKE '%.partner-3.example' THEN 'HOST_DENIED' END AS gate FROM (SELECT DISTINCT href FROM links)",
}
