from pageloom.functions.markup import parse
from pageloom.functions.portfolio import Portfolio
from pageloom.functions.rules import apply_rule, compile_rule
from pageloom.functions.scalars import field_spec
from pageloom.operators import extraction, expansion
from pageloom.plans import portfolio as plans
from pyspark.sql import functions as F

PRICE = {"name": "price", "type": "price", "aliases": ["Kaufpreis"], "paths": ["offers.price"]}


def page(price, ld=None, label="Kaufpreis", extra=""):
    data = f'<script type="application/ld+json">{{"offers":{{"price":"{ld}"}}}}</script>' if ld else ""
    return f"<html><head>{data}</head><body><h1>Haus</h1>{extra}<dl><dt>{label}</dt><dd>{price} €</dd></dl></body></html>"


def run(spark, pages, spec=PRICE, **how):
    df = spark.createDataFrame([(i, f"https://a.example/expose/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    res, states = extraction.replay(df, [spec], **how)
    return {r["page_id"]: r for r in res.collect()}, states.collect()


def test_learns_then_reuses(spark):
    r, s = run(spark, [page("100.000"), page("200.000"), page("300.000")])
    assert [r[i]["stage"] for i in range(3)] == ["label", "recipe", "recipe"]
    assert [r[i]["number"] for i in range(3)] == [100000.0, 200000.0, 300000.0]
    assert Portfolio.load(__import__("json").loads(s[0]["state"])).rules[0].hits == 3


def test_provenance_and_gate(spark):
    r, _ = run(spark, [page("100.000", "100000")])
    assert (r[0]["stage"], r[0]["provenance"]) == ("structured", "CROSS_CONFIRMED")
    r, _ = run(spark, [page("100.000", "90000")], {**PRICE, "min_provenance": "cross_confirmed"})
    assert r[0]["status"] == "UNCONFIRMED" and r[0]["signals"] == ["STAGE_DISAGREEMENT"]


def test_repeated_unconfirmed_value_is_told(spark):
    html = '<p>Aktion</p><span class=teaser>500 €</span>'
    spec = {"name": "price", "type": "price", "aliases": ["Betrag"], "teach": "500 €"}
    r, _ = run(spark, [html] * 4, spec)
    assert r[0]["provenance"] == "AGENT_TAUGHT" and "REPEATED_VALUE" in r[2]["signals"] and "REPEATED_VALUE" not in r[1]["signals"]


def test_redesign_promotes_a_proven_alternative(spark):
    new = lambda p: f"<html><body><h1>Haus</h1><div>Kaufpreis: <b>{p} €</b></div></body></html>"
    r, s = run(spark, [page("100.000"), page("110.000")] + [new(f"{120 + i}.000") for i in range(5)])
    assert all(x["status"] == "FOUND" for x in r.values())
    assert any("promoted" in a for x in r.values() for a in x["attempts"])


def test_teach_must_be_on_the_page(spark):
    r, _ = run(spark, [page("100.000")], {**PRICE, "teach": "77.777 €"})
    assert (r[0]["status"], r[0]["reason"]) == ("NOT_GROUNDED", "VALUE_NOT_IN_PAGE")


def test_nothing_found_goes_to_the_agent_and_render_helps(spark):
    shell = '<div id="root"></div>' + "<script></script>" * 5
    df = spark.createDataFrame([(1, "https://a.example/x/1", shell, page("5.000")), (2, "https://a.example/x/2", None, None)], "page_id long, url string, html string, rendered string")
    res, _ = extraction.replay(df, [PRICE])
    got = {r["page_id"]: (r["status"], r["page_stage"]) for r in res.collect()}
    assert got == {1: ("FOUND", "render"), 2: ("NEEDS_AGENT", "first")}
    assert {r["status"] for r in extraction.calls(res).collect()} == {"COMPLETE", "INCOMPLETE"}


def test_epochs_give_what_the_replay_gives(spark):
    df = spark.createDataFrame([(i, f"https://a.example/expose/{i}", page(f"{100 + i}.000")) for i in range(12)], "page_id long, url string, html string")
    a, _ = extraction.replay(df, [PRICE])
    b, _ = extraction.extract(df, [PRICE], learn_pages=3)
    key = lambda d: sorted((r["page_id"], r["number"], r["status"]) for r in d.collect())
    assert key(a) == key(b)


def stages_by_hand(spark, sf):
    """e_stages by one loop over the pages in order."""
    books, out = {}, {}
    for r in sorted(plans._detail(spark, sf).collect(), key=lambda r: r["page_id"]):
        scope = f"size{r['size']}"
        f = extraction.page_fields(books.setdefault(scope, {}), [field_spec(plans.PRICE)], r["page_id"], r["url"], scope, r["page_id"], r["html"], None, "auto", True)[0]
        out[r["page_id"]] = (f["stage"], round(f["number"], 2), f["status"])
    return out


def parts(spark, tmp_path, n, sizes):
    rows = [(i, f"part {i}", "Brand#1", i % sizes, 900.0 + i * 1.01) for i in range(1, n + 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_stages_of_all_parts(spark, tmp_path):
    sf = parts(spark, tmp_path, 20, 4)
    got = {r["page_id"]: (r["stage"], r["price"], r["status"]) for r in plans.e_stages(spark, sf).collect()}
    assert got == stages_by_hand(spark, sf) and len(got) == 20
    assert {got[i][0] for i in range(3, 21, 3)} == {"structured", "recipe"}


def test_stages_of_long_scopes(spark, tmp_path):
    sf = parts(spark, tmp_path, 120, 2)
    assert {r["page_id"]: (r["stage"], r["price"], r["status"]) for r in plans.e_stages(spark, sf).collect()} == stages_by_hand(spark, sf)


def test_late_pages_of_a_scope_teach(spark):
    """A field that first comes on page 30, a redesign on page 40; the states count all pages."""
    new = lambda p: f"<html><body><h1>Haus</h1><div>Kaufpreis: <b>{p} €</b></div></body></html>"
    htmls = ["<h1>Haus</h1>"] * 30 + [page(f"{100 + i}.000") for i in range(10)] + [new(f"{200 + i}.000") for i in range(10)]
    df = spark.createDataFrame([(i, f"https://a.example/expose/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    res, states = extraction.extract(df, [PRICE])
    books, want = {}, {}
    for i, h in enumerate(htmls):
        f = extraction.page_fields(books, [field_spec(PRICE)], i, f"https://a.example/expose/{i}", "a.example/expose/*", i, h, None, "auto", True)[0]
        want[i] = (f["status"], f["stage"], f["number"], f["attempts"])
    assert {r["page_id"]: (r["status"], r["stage"], r["number"], r["attempts"]) for r in res.collect()} == want
    assert want[35][1] == "recipe" and any("promoted" in a for w in want.values() for a in w[3])
    assert __import__("json").loads(states.first()["state"]) == books["price"].dump()


def test_a_second_run_goes_on_where_the_first_ended(spark, tmp_path):
    """Two runs with the states of the first give what one run over all pages gives; scopes that do not come again stay in the store."""
    from pageloom.api import RuleStore

    new = lambda p: f"<html><body><h1>Haus</h1><div>Kaufpreis: <b>{p} €</b></div></body></html>"
    htmls = [page(f"{100 + i}.000") for i in range(4)] + [new(f"{200 + i}.000") for i in range(6)]
    rows = [(i, f"https://a.example/expose/{i}", h) for i, h in enumerate(htmls)]
    ddl = "page_id long, url string, html string"
    whole, end = extraction.replay(spark.createDataFrame(rows, ddl), [PRICE])
    store = RuleStore(spark, str(tmp_path / "rules"))
    got = {}
    for part in (rows[:3] + [(90, "https://b.example/x/1", page("5.000"))], rows[3:6], rows[6:]):
        base = store.version()
        res, states = extraction.extract(spark.createDataFrame(part, ddl), [PRICE], start=store.states())
        got |= {r["page_id"]: (r["stage"], r["number"], r["attempts"]) for r in res.collect()}
        store.save(states, base)
    want = {r["page_id"]: (r["stage"], r["number"], r["attempts"]) for r in whole.collect()}
    got.pop(90)
    assert got == want and got[3][0] == "recipe" and any("promoted" in a for g in got.values() for a in g[2])
    load = lambda df: {(r["scope"], r["field"]): __import__("json").loads(r["state"]) for r in df.collect()}
    kept = load(store.states())
    assert kept.pop(("b.example/x/*", "price"))["rules"] and kept == load(end)
    try:
        store.save(end, 1)
        raise AssertionError("the version is old")
    except RuntimeError:
        pass
    assert {r["scope"] for r in store.rules().collect()} == {"a.example/expose/*", "b.example/x/*"} and store.forget("b.example/x/*") == 1


def test_batch_runs_resume_and_stop_early(spark, tmp_path):
    from pageloom.operators import batchrun
    from pageloom.sources.files import result_log, write_jsonl

    ddl = "page_id long, url string, html string, status int"
    pages = spark.createDataFrame([(1, "u1", page("1.000"), 200), (2, "u1", page("2.000"), 200), (3, "u2", "<p>x</p>", 200), (4, "u3", page("3.000"), 500), (5, "u4", page("4.000"), 429), (6, "u5", page("5.000"), 404)], ddl)
    urls = spark.createDataFrame([(u, i) for i, u in enumerate(["u1", "u2", "u3", "u4", "u5", "u6", "u1", " "])], "url string, pos long")
    got = batchrun.run(pages, urls, [PRICE])
    assert {r["url"]: (r["ok"], r["status"], r["error"] and r["error"]["code"]) for r in got["rows"].collect()} == {
        "u1": (True, "COMPLETE", None), "u2": (True, "INCOMPLETE", None), "u3": (False, "ERROR", "HTTP_ERROR"), "u4": (False, "ERROR", "BLOCKED"), "u5": (False, "ERROR", "HTTP_ERROR"), "u6": (False, "ERROR", "FETCH_FAILED")
    }
    b = got["summary"]["batch"]
    assert (got["code"], b["total"], b["skipped"], b["attempted"], b["complete"], b["incomplete"], b["errors"], b["error_codes"]) == (0, 6, 0, 6, 1, 1, 4, {"HTTP_ERROR": 2, "BLOCKED": 1, "FETCH_FAILED": 1})
    assert b["field_outcomes"] == {"price": {"FOUND": 1, "NEEDS_AGENT": 1}} and b["stage_hits"] == {"label": 1}
    write_jsonl(got["rows"], str(tmp_path / "log"))
    again = batchrun.run(pages, urls, [PRICE], result_log(spark, str(tmp_path / "log")), ["written", "line"])
    # A server's error, a block and a missing page may mend; a 404 and what went well are final.
    assert {r["url"] for r in again["rows"].collect()} == {"u3", "u4", "u6"} and again["summary"]["batch"]["skipped"] == 3
    many = spark.range(1200).select(F.concat(F.lit("m"), "id").alias("url"), F.col("id").alias("pos"))
    empty = many.select(F.col("pos").alias("page_id"), "url", F.lit("<p>x</p>").alias("html"))
    stopped = batchrun.run(empty, many, [PRICE])
    assert stopped["code"] == 3 and stopped["rows"].count() == 10 and {a["code"] for a in stopped["summary"]["preflight"]["advisories"]} == {"LOW_BATCH_YIELD", "HIGH_AGENT_ESCALATION"}
    assert batchrun.run(empty, many, [PRICE], go_on=True)["rows"].count() == 1200
    nothing = batchrun.run(pages, urls.limit(0), [PRICE])
    assert nothing["rows"].count() == 0 and [a["code"] for a in nothing["summary"]["batch"]["advisories"]] == ["EMPTY_INPUT_SET"]


def test_sql_functions_are_the_native_ones(spark):
    from pageloom.api import register, safe_call
    from pageloom.functions import native as N

    register(spark)
    x = spark.createDataFrame([(t,) for t in ("1.234,56 €", "1,234.56", "-12'000", "３ Zimmer", "1.234", "1,5", "1.2.3", "", None, "a", "https://www.A.example/x/12/Some-Very-Long-Slug-With-Many-Words/d.html?q=1", "//h/", "ftp://u:p@h:80/a.b.c")], "x string")
    for r in x.select("x", F.expr("page_number(x)").alias("a"), N.parse_number(F.col("x")).alias("b"), F.expr("page_scope(x)").alias("c"), N.scope_of(F.col("x")).alias("d")).collect():
        assert r["a"] == r["b"] and r["c"] == r["d"], r
    rows = spark.sql("""SELECT b.kind, b.text, k.href FROM VALUES ('<h1>Haus</h1><p>Hier <a href="/x">mehr</a></p>', 'https://a.example/') AS t(html, url), LATERAL page_blocks(html, url) b, LATERAL page_links(html, url) k""").collect()
    assert sorted(map(tuple, rows)) == [("h1", "Haus", "https://a.example/x"), ("p", "Hier mehr", "https://a.example/x")]
    assert safe_call(lambda: 1) == {"ok": True, "value": 1} and safe_call(field_spec, {})["error"]["code"] == "FIELD_INVALID" and safe_call(lambda: 1 / 0)["error"]["code"] == "INTERNAL_ERROR"


def test_rules():
    html = page("100.000", extra='<a id="item-4711">x</a>')
    rule = compile_rule(html, "100.000 €", "price", "Kaufpreis")
    assert apply_rule(rule, page("250.500", extra='<a id="item-12">x</a>')) == "250.500 €"
    assert apply_rule("(", html) is None and compile_rule(html, "7 €", "price") is None


def test_portfolio_caps():
    book = Portfolio()
    for i in range(30):
        book.add("regex", f"p{i}", "label", i)
    assert len(book.live()) == 4 and sum(r.role == "retired" for r in book.rules) == 16
    assert book.observe("u1", "a") == 1 and book.observe("u1", "a") == 1 and book.observe("u2", "a") == 2 and book.observe("u3", "b") == 1


def test_labels_do_not_cross_cards():
    from pageloom.functions.candidates import labelled

    html = "<main><section><div><span>Kaufpreis</span></div><p>Hinweis</p></section><section><div><b>99 €</b></div></section></main>"
    spec = field_spec(PRICE)
    assert [c[0] for c in labelled(parse(html, ""), spec["aliases"], "price")] == []


def _queue(graph, seeds, max_pages, max_urls, max_depth):
    """The queue itself, as a measure."""
    from collections import deque

    q, ever, out = deque((s, 0) for s in seeds[:max_pages]), list(dict.fromkeys(seeds))[:max_pages], []
    while q:
        url, depth = q.popleft()
        for kind, items in graph.get(url, []):
            if kind == "detail_candidates":
                for i in items:
                    if i not in out:
                        if len(out) >= max_urls:
                            return ever, out
                        out.append(i)
            elif depth < max_depth:
                for i in items:
                    if i not in ever and len(ever) < max_pages:
                        ever.append(i)
                        q.append((i, depth + 1))
    return ever, out


def test_expansion_is_the_queue(spark):
    graph = {"r": [("child_candidates", ["a", "b"])], "a": [("child_candidates", ["c", "b"]), ("detail_candidates", ["1", "2"])], "b": [("detail_candidates", ["2", "3"])], "c": [("detail_candidates", ["4"])]}
    rows = [(u, None, [(k, [(i, "") for i in items]) for k, items in g]) for u, g in graph.items()]
    f = spark.createDataFrame(rows, "url string, pagination struct<template:string,last_page:bigint,next_url:string>, groups array<struct<kind:string,items:array<struct<url:string,text:string>>>>")
    seeds = spark.createDataFrame([("r", 0)], "url string, pos long")
    for limits in ((100, 100, 3), (2, 100, 3), (100, 100, 1)):
        got = expansion.expand(f, seeds, *limits)
        pages, out = _queue(graph, ["r"], *limits)
        told = expansion.report(got, seeds)
        assert (told["detail_count"], told["source_pages_fetched"], told["error_count"]) == (len(out), len(pages), 0) and sum(x["detail_urls"] for x in told["levels"]) == len(out)
        assert [r["url"] for r in got["pages"].orderBy("n").collect()] == pages
        assert [r["url"] for r in got["details"].orderBy("n").collect()] == out
