from pageloom.functions.markup import parse
from pageloom.functions.outline import Outliner
from pageloom.functions.paging import paging
from pageloom.operators import pagegraph, relevance, summary, traversal

HTML = """<html lang=de><head><title>T &amp; U</title><meta name=description content="d"><link rel=canonical href="/c"><script type="application/ld+json">{"offers":{"price":"12"}}</script></head>
<body><nav><a href="/">Start</a></nav><main><h1>Haus</h1><p>Ein <b>heller</b> Garten.</p><h2>Preis</h2><dl><dt>Kaufpreis</dt><dd>100 €</dd></dl><table><tr><th>Etage<td>3</tr></table><a href="/o/1" rel=nofollow>Eins</a></main>
<footer>Ende<script>var a="<p>nein</p>"</script></footer></body></html>"""


def test_parse():
    p = parse(HTML, "https://a.example/x")
    assert (p.title, p.lang, p.canonical) == ("T & U", "de", "https://a.example/c")
    assert [(b.kind, b.text, b.region) for b in p.blocks] == [("text", "Start", "nav"), ("h1", "Haus", "main"), ("p", "Ein heller Garten.", "main"), ("h2", "Preis", "main"), ("dt", "Kaufpreis", "main"), ("dd", "100 €", "main"), ("th", "Etage", "main"), ("td", "3", "main"), ("text", "Eins", "main"), ("text", "Ende", "footer")]
    assert p.blocks[2].emphasis == ["heller"] and p.blocks[2].section == ("Haus",) and p.blocks[6].row == p.blocks[7].row == 1
    assert [(k[0], k[1], k[3]) for k in p.links] == [("https://a.example/", "Start", False), ("https://a.example/o/1", "Eins", True)]


def test_malformed_html_is_read_as_far_as_it_goes():
    for bad in ("", None, "<", "<p", "<p>a<p>b</i><li>c", "<a href='x", '<div class="a>x</div>', "<script>", "a < b", "<!-- x", "</p></div>", "<p>" * 3000):
        assert len(parse(bad, "").blocks) == len(Outliner().blocks(bad or ""))


def test_outline_numbers_blocks_as_the_graph_does():
    assert [(k, t) for _, k, t, _ in Outliner().blocks(HTML)] == [(b.kind, b.text) for b in parse(HTML, "").blocks]


def test_paging():
    links = [("/l?page=1", "1"), ("/l?page=2", "2"), ("/l?page=3", "3"), ("/l?page=40", "40"), ("/o/11", "A"), ("/o/12", "B")]
    p, g = paging("https://a.example/l", None, [("https://a.example" + h, t, True, []) for h, t in links])
    assert (p["last_page"], p["last_evidence"], p["next_url"], p["remaining_pages"]) == (40, "terminal-page-gap", "https://a.example/l?page=2", 39)
    assert [(x["scope"], x["count"], x["kind"]) for x in g] == [("a.example/o/*", 2, "detail_candidates")]
    p, g = paging("", None, [])
    assert not p["detected"] and g == []


def test_graph_of_odd_rows(spark):
    rows = [(1, "https://a.example/x", HTML, 7), (2, None, None, 7), (3, "u", "", 7), (1, "https://a.example/x", HTML, 7), (4, "https://a.example/y", "<p>" + "wort " * 50_000, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    g = pagegraph.page_graph(pages)
    assert {(r["page_id"], r["n"]) for r in g.selectExpr("page_id", "size(blocks) n").collect()} == {(1, 10), (2, 0), (3, 0), (4, 1)}
    s = {r["page_id"]: r for r in summary.summarize(g).collect()}
    assert s[1]["blocks"] == 10 and s[1]["h1"] == ["Haus"] and s[2]["text_chars"] == 0
    assert {r["coverage_status"] for r in traversal.traversal(g).collect()} == {"UNKNOWN"}
    hits = relevance.locate(g, "Garten", results=2).collect()
    assert {h["page_id"] for h in hits} == {1} and hits[0]["text"] == "Ein heller Garten."
    assert relevance.score_blocks(g, " ").count() == 0
    assert pagegraph.page_graph(pages.limit(0)).count() == 0


def test_queries_parse_every_page_with_html(spark, tmp_path):
    """A page that the table blocks lacks, as cached copies are, gives what its twin gives."""
    from pageloom.plans import pages as plans

    html = HTML.replace('"price":"12"', '"price":"12.5"').replace("</main>", '<a href="/o/2">Zwei</a><a href="/l?page=1">1</a><a href="/l?page=2" rel=next>2</a><a href="/l?page=9" rel=last>9</a></main>')
    rows = [(1, "https://a.example/l", html), (2, "https://a.example/l", html), (3, "https://a.example/l", ""), (4, "https://a.example/l", None)]
    spark.createDataFrame([(i, u, u, h) for i, u, h in rows], "page_id long, url string, final_url string, html string").write.parquet(f"{tmp_path}/fetch_results.parquet")
    spark.createDataFrame([(1,)], "page_id long").write.parquet(f"{tmp_path}/blocks.parquet")
    for q in (plans.g_blocks, plans.g_links, plans.g_offers, plans.g_summary, plans.v_pagination, plans.v_children, plans.r_search, plans.r_located):
        got = [r.asDict() for r in q(spark, str(tmp_path)).collect()]
        of = lambda p: sorted(repr({**r, "page_id": 0}) for r in got if r["page_id"] == p)
        assert of(1) and of(2) == of(1) and {r["page_id"] for r in got} == {1, 2}, q.__name__
    assert sum(r["pages"] for r in plans.v_coverage(spark, str(tmp_path)).collect()) == 2


def test_challenges_are_found_in_long_pages(spark):
    from pyspark.sql import functions as F

    from pageloom.operators import policy

    script = "<script>" + "x = 1; " * 80_000 + "</script>"
    rows = [(1, 200, script + '<div class="g-recaptcha"></div>'), (2, 200, '<i class="g-recaptcha"></i>' + script + "<p>" + "Wohnung am See. " * 100), (3, 403, script + "Access denied")]
    df = spark.createDataFrame(rows, "page_id long, status int, html string")
    got = {r[0]: (r[1], r[2]) for r in df.select("page_id", policy.challenge(F.col("status"), F.col("html")), policy.visible_chars(F.col("html"))).collect()}
    assert got == {1: ("CHALLENGE:g-recaptcha", 0), 2: (None, 1599), 3: ("CHALLENGE:access denied", 13)}
