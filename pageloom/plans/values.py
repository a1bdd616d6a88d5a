"""Queries of the text, number and URL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import native as N
from pageloom.plans import sql as Q
from pageloom.session import spread, table


def q_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(N.fold(F.col("text"))).alias("folded"), F.size(N.tokens(F.col("text"))).alias("tokens"), F.get(N.tokens(F.col("text")), F.lit(0)).alias("first_token"))


def q_token_counts(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.explode(N.tokens(F.col("text"))).alias("token"))
    return d.groupBy("lang", "token").agg(F.count("*").alias("n"))


def q_typed(spark, sf):
    b = spread(table(spark, sf, "blocks").select("page_id", "block_id", "text"))
    kinds = ("price", "area", "date", "email", "phone", "url", "integer", "number")
    # All kinds but these need a digit.
    some = b.where(r"text rlike '[\\p{Nd}@]|://'").withColumn("text", N.normalize(F.col("text")))
    return some.select("page_id", "block_id", *[N.find_typed(F.col("text"), k, normal=True).alias(k) for k in kinds]).where("coalesce(price, area, date, email, phone, url) is not null")


def _german(x):
    n = F.format_number(x, 2)
    return F.translate(n, ",.", ".,")


def q_numbers(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.round(N.parse_number(F.concat(_german(F.col("o_totalprice")), F.lit(" €"))), 2).alias("german"), F.round(N.parse_number(F.concat(F.lit("EUR "), F.format_number("o_totalprice", 2))), 2).alias("english"))


def q_validate(spark, sf):
    x = table(spark, sf, "lineitem")
    price = F.when(F.col("l_linenumber") == 7, F.lit("")).when(F.col("l_linenumber") == 6, F.lit("auf Anfrage")).otherwise(F.concat(_german(F.col("l_extendedprice")), F.lit(" €")))
    return x.select(N.validate(price, "price", 2000.0, 50000.0).alias("v")).groupBy(F.col("v.reason").alias("reason")).agg(F.count("*").alias("n"), F.round(F.sum("v.number"), 1).alias("total"))


def q_scopes(spark, sf):
    k = table(spark, sf, "links")
    return k.groupBy(N.scope_of(F.col("href")).alias("scope")).agg(F.count("*").alias("links"), F.count_distinct("href").alias("urls"))


def q_urls(spark, sf):
    k = table(spark, sf, "links").select("href").distinct()
    m = N.marker(F.col("href"))
    return k.select("href", N.clean_url(F.col("href")).alias("clean"), N.normalize_url(F.col("href")).alias("normal"), m.kind.alias("kind"), m.value.alias("value"), N.template(F.col("href"), m).alias("template"))


QUERIES = {f.__name__: f for f in (q_tokens, q_token_counts, q_typed, q_numbers, q_validate, q_scopes, q_urls)}
_TOK = f"regexp_extract_all({Q.fold('text')}, '[a-z0-9]+')"
ORACLE = {
    "q_tokens": f"SELECT doc_id, md5({Q.fold('text')}) AS folded, CAST(len({_TOK}) AS INTEGER) AS tokens, {_TOK}[1] AS first_token FROM documents",
    "q_token_counts": f"SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({_TOK}) AS token FROM documents) GROUP BY lang, token",
    "q_typed": "SELECT * FROM (SELECT page_id, block_id, "
    + ", ".join(f"{Q.typed('text', k)} AS {k}" for k in ("price", "area", "date", "email", "phone", "url", "integer", "number"))
    + " FROM blocks) WHERE coalesce(price, area, date, email, phone, url) IS NOT NULL",
    "q_numbers": "SELECT o_orderkey, round(o_totalprice, 2) AS german, round(o_totalprice, 2) AS english FROM orders",
    "q_validate": """WITH p AS (SELECT l_linenumber AS n, round(l_extendedprice, 2) AS v FROM lineitem),
 r AS (SELECT CASE WHEN n = 7 THEN 'EMPTY' WHEN n = 6 THEN 'TYPE_MISMATCH' WHEN v < 2000 THEN 'BELOW_MIN' WHEN v > 50000 THEN 'ABOVE_MAX' ELSE 'OK' END AS reason, v FROM p)
 SELECT reason, count(*) AS n, CASE WHEN reason = 'OK' THEN round(sum(v), 1) END AS total FROM r GROUP BY reason""",
    "q_scopes": f"SELECT {Q.scope('href')} AS scope, count(*) AS links, count(DISTINCT href) AS urls FROM links GROUP BY 1",
    "q_urls": f"""WITH u AS (SELECT DISTINCT href FROM links), m AS (SELECT href, {Q.clean("href")} AS clean, regexp_extract(href, '[?&]page=([0-9]+)(&|#|$)', 1) AS pg FROM u)
 SELECT href, clean, clean AS normal, CASE WHEN pg <> '' THEN 'page' END AS kind, TRY_CAST(nullif(pg, '') AS BIGINT) AS value, CASE WHEN pg <> '' THEN regexp_replace(clean, '([?&]page=)[0-9]+', '\\1{{page}}') END AS template FROM m""",
}
