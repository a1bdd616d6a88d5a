import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fake_web  # noqa: E402
from pageloom.operators import policy  # noqa: E402
from pageloom.sources import web  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

QUICK = dict(interval=0.0, max_bytes=300)


def test_codes_decoding_and_cache():
    fake_web.ASKED.clear()
    get = web.Fetcher(web.FetchPolicy(deny_hosts=("deny.example",), **QUICK), "fake_web:open_page", "fake_web:render_page")
    row = lambda u, **how: dict(zip([c.strip().split(" ")[0] for c in web.SCHEMA.split(",")], get(u, **how), strict=True))
    code = lambda u: (row(u)["error_code"], row(u)["recoverable"])
    assert (row("https://x.example/a")["html"], row("https://x.example/gz")["html"]) == ("<p>Größe</p>", "<p>Küche</p>")
    assert code("https://x.example/gone") == ("HTTP_ERROR", False) and code("https://x.example/down") == ("BLOCKED" if web.challenge(503, "<p>down</p>") else "HTTP_ERROR", True)
    assert code("https://x.example/much") == code("https://x.example/check") == ("BLOCKED", True)
    assert code("https://x.example/dead") == ("FETCH_FAILED", True) and code("https://x.example/private/1") == ("ROBOTS_DISALLOWED", False)
    assert [code(u)[0] for u in ("ftp://x.example/", "https:///x", "https://a.deny.example/")] == ["URL_SCHEME_DENIED", "URL_INVALID", "HOST_DENIED"]
    long = row("https://x.example/long")
    assert long["truncated"] and len(long["html"]) == 300
    fake_web.ASKED.clear()
    assert row("HTTPS://X.example/a#top")["notes"] == ["cache_hit"] and not fake_web.ASKED
    assert row("https://x.example/a", render=True)["html"] == "<p>rendered</p>" and row("https://x.example/a", render=True)["notes"] == ["cache_hit"]
    none = web.Fetcher(web.FetchPolicy(**QUICK), "fake_web:open_page")
    assert none("https://x.example/a", True)[10] == "RENDER_NOT_AVAILABLE"


def test_a_challenge_is_what_the_column_says(spark):
    rows = [(s, h) for s in (200, 202, 401, 403, 429, 503) for h in ("", "<p>Access denied</p>", '<div class="g-recaptcha"></div>', '<div class="g-recaptcha"></div>' + "<p>wort</p>" * 300, "Are you human" + "<p>wort</p>" * 300)]
    for r in spark.createDataFrame(rows, "s int, h string").select("s", "h", policy.challenge(F.col("s"), F.col("h")).alias("c")).collect():
        assert web.challenge(r["s"], r["h"]) == r["c"], r


def test_tables_of_urls(spark):
    spark.sparkContext.addPyFile(fake_web.__file__)
    urls = spark.createDataFrame([("https://x.example/a",), ("https://x.example/a",), ("https://y.example/gone",), (None,), ("https://y.example/private/2",)], "url string")
    got = sorted((r["url"], r["status"], r["error_code"], r["notes"]) for r in web.fetch(urls, web.FetchPolicy(**QUICK), "fake_web:open_page").collect())
    assert got == [("https://x.example/a", 200, None, []), ("https://x.example/a", 200, None, ["cache_hit"]), ("https://y.example/gone", 404, "HTTP_ERROR", []), ("https://y.example/private/2", None, "ROBOTS_DISALLOWED", [])]
    web.register(spark)
    df = spark.read.format("web_pages").option("urls", "https://x.example/gz\nhttps://y.example/dead").option("opener", "fake_web:open_page").option("interval", "0").load()
    assert {(r["html"], r["error_code"]) for r in df.collect()} == {("<p>Küche</p>", None), (None, "FETCH_FAILED")}
    assert web.fetch(urls.limit(0), web.FetchPolicy(**QUICK), "fake_web:open_page").count() == 0
