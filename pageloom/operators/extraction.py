"""Fields of pages: learned rules first, then structured data, then labels, then a rendered page, then a hand-over.

State belongs to a (scope, field) and changes from page to page, so the pages of
a scope are replayed in order.  What is costly is done in parallel, where the
pages are read, whatever their scope: a first pass turns each page into facts
(valid values by stage, the rule that each could teach), a second one tells what
the scope's rules find in the html.  The replay reads facts only, small rows that
are shuffled by scope and sorted; html is never shuffled, and a scope with a
third of all pages costs its task some microseconds a page.  Rules that are known
to matter beforehand (of the states at the start, and those that most pages of a
scope would teach) are tried in the first round; a scope that comes to need
another one names it and is replayed after the next round, until none is open.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import candidates as C
from pageloom.functions import native as N
from pageloom.functions import scalars as S
from pageloom.functions.markup import Page, parse
from pageloom.functions.patterns import NUMERIC, SHELL_SCORE
from pageloom.functions.portfolio import Facts, Missing, Portfolio, View, teach, visit
from pageloom.operators.pagegraph import arrow_schema
from pageloom.session import col_or_null, cut, spread

RESULT = (
    "page_id long, url string, scope string, seq long, field string, type string, status string, stage string, page_stage string, value string, number double, "
    "provenance string, confirmed_by array<string>, signals array<string>, attempts array<string>, rule_kind string, rule_pattern string, rule_role string, compiled boolean, detail string, reason string"
)
STATE = "scope string, field string, state string"
#: Portfolios up to this many characters in all are sent to every task; beyond it they are joined by scope.
SENT_WHOLE = 32_000_000


def js_score(page: Page) -> float:
    kinds = [k for k, _, _ in page.scripts]
    s = 0.45 * (page.text_chars < 400) + 0.30 * page.app_root + 0.15 * (page.script_count >= 5) - 0.20 * ("embedded_json" in kinds) - 0.10 * ("jsonld" in kinds)
    return max(0.0, min(1.0, round(s, 2)))


def page_views(specs: list[dict], url: str, html: str | None, rendered: str | None, render: str) -> tuple[list[View], list[View] | None, str | None]:
    """Views of a page by field, those of the rendered page, and why there are none."""
    html = html or ""
    page = parse(html, url, follow=False)
    flat = C.triples(page)
    first = [View(page, flat, html, spec) for spec in specs]
    if render == "never" or rendered is None:
        return first, None, "RENDER_NEVER" if render == "never" else "NO_URL_OR_RENDERER"
    if render == "auto" and js_score(page) < SHELL_SCORE:
        return first, None, "PAGE_NOT_JS_SHELL"
    p2 = parse(rendered, url, follow=False)
    flat2 = C.triples(p2)
    return first, [View(p2, flat2, rendered, spec) for spec in specs], None


def field_of(book: Portfolio, first: View | Facts, second: View | Facts | None, skipped: str | None, page_id, url: str, scope: str, seq: int, learn: bool) -> dict:
    """One field of one page; changes the portfolio."""
    spec, attempts = first.spec, []
    if spec.get("teach") not in (None, ""):
        r = teach(book, first, scope, url, seq, attempts)
    else:
        r = visit(book, first, scope, url, seq, learn, attempts)
        if r is None and second is None:
            attempts.append(f"render:SKIP:{skipped}")
        elif r is None:
            attempts.append("render:RENDERED")
            r = visit(book, second, scope, url, seq, learn, attempts)
            if r is not None:
                r["page_stage"] = "render"
    if r is None:
        attempts.append("agent:NEEDS_AGENT")
        r = {"status": "NEEDS_AGENT"}
    rule = r.get("rule")
    number = r.get("normalized") if spec["type"] in NUMERIC else None
    return {
        "page_id": page_id, "url": url, "scope": scope, "seq": seq, "field": spec["name"], "type": spec["type"], "status": r["status"], "stage": r.get("stage"), "page_stage": r.get("page_stage", "first"), "value": r.get("value"),
        "number": None if number is None else float(number), "provenance": r.get("provenance"), "confirmed_by": r.get("confirmed_by", []), "signals": r.get("signals", []), "attempts": attempts,
        "rule_kind": rule.kind if rule else None, "rule_pattern": rule.pattern if rule else None, "rule_role": rule.role if rule else None, "compiled": r.get("compiled", False), "detail": r.get("detail"), "reason": r.get("reason"),
    }


def page_fields(books: dict[str, Portfolio], specs: list[dict], page_id, url: str, scope: str, seq: int, html: str | None, rendered: str | None, render: str, learn: bool) -> list[dict]:
    """All fields of one page, from the page itself; changes the portfolios."""
    first, second, skipped = page_views(specs, url, html, rendered, render)
    return [field_of(books.setdefault(s["name"], Portfolio()), first[i], second and second[i], skipped, page_id, url, scope, seq, learn) for i, s in enumerate(specs)]


def _prepared(pages: DataFrame, scope: Column | None, seq: str | None) -> DataFrame:
    url = F.coalesce(col_or_null(pages, "final_url", "string"), col_or_null(pages, "url", "string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"), (N.scope_of(url) if scope is None else scope).alias("scope"), F.coalesce(F.col(seq or "page_id").cast("long"), F.lit(0)).alias("seq"),
        F.col("html").cast("string").alias("html"), col_or_null(pages, "rendered", "string").alias("rendered"),
    )


def _ready(specs: list) -> list[dict]:
    return S.field_specs(specs)


_FACTS = "page_id long, url string, scope string, seq long, key long, facts string, teaches array<string>"
_ROW = "scope string, seq long, page_id long, key long, what int, field string, body string, url string"
#: Rules that most pages of a (scope, field) would teach and that are tried in the first round; others follow when they are needed.
FIRST_RULES = 4


def _arrow_rows(df: DataFrame, ddl: str, one, few: int = 500) -> DataFrame:
    """mapInArrow with a function from a row, as a dict, to rows."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, few):
                rows = [out for r in b.slice(i, few).to_pylist() for out in one(r)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return df.mapInArrow(run, ddl)


def _key() -> Column:
    return F.xxhash64(F.coalesce("page_id", F.lit(0)), "url", F.coalesce("html", F.lit("")), F.coalesce("rendered", F.lit("")))


def _page_facts(prepared: DataFrame, specs: list[dict], render: str) -> DataFrame:
    """A row a page: what it says about each field, and which rules it would teach."""

    def one(r: dict) -> list[dict]:
        first, second, skipped = page_views(specs, r["url"], r["html"], r["rendered"], render)
        views = [[v.facts() for v in first], [v.facts() for v in second] if second else None, skipped]
        teaches = [f"{i}|{f['c']}" for part in views[:2] if part for i, f in enumerate(part) if f.get("c")]
        return [{"page_id": r["page_id"], "url": r["url"], "scope": r["scope"], "seq": r["seq"], "key": r["key"], "facts": json.dumps(views, ensure_ascii=False), "teaches": teaches}]

    return _arrow_rows(spread(prepared.withColumn("key", _key())), _FACTS, one)


def _found(prepared: DataFrame, rules: DataFrame, specs: list[dict], render: str) -> DataFrame:
    """What rules(scope, field, kind, pattern) find on the pages of their scopes, as rows of the replay.

    The rules are sent to every task where they are few; else they are joined by
    scope, and a scope with very many pages is split by adaptive execution."""
    spark = prepared.sparkSession
    each = rules.groupBy("scope").agg(F.to_json(F.collect_list(F.struct("field", "kind", "pattern"))).alias("rules"))
    size = rules.agg(F.coalesce(F.sum(F.length("pattern") + F.length("scope")), F.lit(0))).first()[0]
    known = spark.sparkContext.broadcast({r["scope"]: json.loads(r["rules"]) for r in each.collect()}) if size <= SENT_WHOLE else None
    rows = spread(prepared.withColumn("key", _key()))
    rows = rows if known is not None else rows.join(each, "scope")
    place = {s["name"]: i for i, s in enumerate(specs)}

    def one(r: dict) -> list[dict]:
        wanted = known.value.get(r["scope"], ()) if known is not None else json.loads(r["rules"])
        if not wanted:
            return []
        views = None
        if any(w["kind"] != "regex" for w in wanted) or (r["rendered"] is not None and render != "never"):
            views = page_views(specs, r["url"], r["html"], r["rendered"], render)
        bodies: dict[str, list[dict]] = {}
        for w in wanted:
            if w["field"] in place:
                parts = [v[place[w["field"]]] for v in views[:2] if v] if views else [View(None, [], r["html"] or "", specs[place[w["field"]]])]
                for found, v in zip(bodies.setdefault(w["field"], [{}, {}]), parts, strict=False):
                    found[f"{w['kind']}|{w['pattern']}"] = v.apply(w["kind"], w["pattern"])
        return [{"scope": r["scope"], "seq": r["seq"], "page_id": r["page_id"], "key": r["key"], "what": 0, "field": f, "body": json.dumps(b, ensure_ascii=False), "url": None} for f, b in bodies.items()]

    return _arrow_rows(rows, _ROW, one)


def _round(facts: DataFrame, found: DataFrame, start: DataFrame | None, specs: list[dict], learn: bool) -> DataFrame:
    """Results, states and, where a rule is met that was not tried, what is needed; each (scope, field) by itself."""
    ddl = RESULT + ", state string, need string"
    schema = arrow_schema(ddl)
    place = {s["name"]: i for i, s in enumerate(specs)}
    null = lambda kind: F.lit(None).cast(kind)
    rows = facts.select("scope", "seq", "page_id", "key", F.lit(1).alias("what"), null("string").alias("field"), F.col("facts").alias("body"), "url").unionByName(found)
    if start is not None:
        rows = rows.unionByName(start.join(facts.select("scope").distinct(), "scope", "left_semi").select("scope", F.lit(-(2**63)).cast("long").alias("seq"), null("long").alias("page_id"), null("long").alias("key"), F.lit(-1).alias("what"), "field", F.col("state").alias("body"), null("string").alias("url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, books, open_fields, told = None, {}, set(), {}

        def states() -> list[dict]:
            return [{"scope": scope, "field": f, "state": json.dumps(b.dump())} for f, b in books.items() if f not in open_fields]

        started = False
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            out: list[dict] = []
            for r in b.to_pylist():
                if not started or r["scope"] != scope:
                    out += states() if started else []
                    started, scope, books, open_fields, told = True, r["scope"], {}, set(), {}
                if r["what"] == -1:
                    books[r["field"]] = Portfolio.load(json.loads(r["body"]))
                elif r["what"] == 0:
                    if told.get("key") != (r["seq"], r["key"]):
                        told = {"key": (r["seq"], r["key"])}
                    mine = told.setdefault(r["field"], [{}, {}])
                    for have, more in zip(mine, json.loads(r["body"]), strict=True):
                        have.update(more)
                else:
                    if told.get("key") != (r["seq"], r["key"]):
                        told = {}
                    first, second, skipped = json.loads(r["body"])
                    for name, i in place.items():
                        if name in open_fields:
                            continue
                        known = told.get(name, [{}, {}])
                        try:
                            out.append(field_of(books.setdefault(name, Portfolio()), Facts(first[i], specs[i], known[0]), second and Facts(second[i], specs[i], known[1]), skipped, r["page_id"], r["url"], scope, r["seq"], learn))
                        except Missing as m:
                            open_fields.add(name)
                            out.append({"scope": scope, "field": name, "need": json.dumps([m.kind, m.pattern])})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if started and (last := states()):
            yield pa.RecordBatch.from_pylist(last, schema)

    # A set number of partitions: few bytes are much work here, so they must not be merged.
    width = max(2 * facts.sparkSession.sparkContext.defaultParallelism, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.coalesce("page_id", F.lit(0))
    return rows.repartition(width, "scope").sortWithinPartitions("scope", "seq", order, "key", "what").mapInArrow(run, ddl)


def _replay(prepared: DataFrame, specs: list[dict], start: DataFrame | None, render: str, learn: bool) -> DataFrame:
    """Results and, as rows with a state, the state of each (scope, field)."""
    names = F.array(*[F.lit(s["name"]) for s in specs])
    facts = cut(_page_facts(prepared, specs, render))
    t = facts.select("scope", F.explode("teaches").alias("t")).groupBy("scope", "t").agg(F.count("*").alias("n"))
    t = t.select("scope", "n", F.substring_index("t", "|", 1).cast("int").alias("i"), F.expr("substring(t, instr(t, '|') + 1)").alias("pattern"))
    often = Window.partitionBy("scope", "i").orderBy(F.desc("n"), "pattern")
    rules = t.withColumn("k", F.row_number().over(often)).where(F.col("k") <= FIRST_RULES).select("scope", F.get(names, F.col("i")).alias("field"), F.lit("regex").alias("kind"), "pattern")
    if start is not None:
        kept = start.join(facts.select("scope").distinct(), "scope", "left_semi").select("scope", "field", F.explode(F.from_json("state", "rules array<struct<kind:string,pattern:string,role:string>>").rules).alias("r"))
        rules = rules.unionByName(kept.where("r.role <> 'retired'").select("scope", "field", "r.kind", "r.pattern"))
    rules, found, done = cut(rules.distinct()), [], []
    scopes = None
    while True:
        found.append(cut(_found(prepared, rules, specs, render)))
        mine = facts if scopes is None else facts.join(scopes, "scope", "left_semi")
        tried = reduce(DataFrame.unionByName, found)
        tried = tried if scopes is None else tried.join(scopes, "scope", "left_semi")
        out = cut(_round(mine, tried, start, specs, learn))
        rules = cut(out.where("need is not null").select("scope", "field", F.from_json("need", "array<string>").alias("r")).select("scope", "field", F.col("r")[0].alias("kind"), F.col("r")[1].alias("pattern")).distinct())
        if rules.isEmpty():
            done.append(out.drop("need"))
            return reduce(DataFrame.unionByName, done)
        scopes = rules.select("scope").distinct()
        done.append(out.join(scopes, "scope", "left_anti").drop("need"))


def _split(out: DataFrame) -> tuple[DataFrame, DataFrame]:
    return out.where("state is null").drop("state"), out.where("state is not null").select("scope", "field", "state")


def replay(pages: DataFrame, specs: list, scope: Column | None = None, seq: str | None = None, render: str = "auto", learn: bool = True, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact results and states.

    start(scope, field, state): the states of an earlier run, one row each, from
    which the scopes go on; the states given back hold them with what this run
    changed.  Without `learn` rules are used and judged, but none is added."""
    return _split(_replay(_prepared(pages, scope, seq), _ready(specs), start, render, learn))


def apply_rules(prepared: DataFrame, specs: list[dict], states: DataFrame, render: str = "auto") -> DataFrame:
    """Every page with the portfolios as they are; pages of one scope don't see each other's changes."""
    spark = prepared.sparkSession
    whole = states.groupBy("scope").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("field", "state")))).alias("states"))
    size = states.agg(F.coalesce(F.sum(F.length("state") + F.length("scope")), F.lit(0))).first()[0]
    known = spark.sparkContext.broadcast({r["scope"]: r["states"] for r in whole.collect()}) if size <= SENT_WHOLE else None
    rows = spread(prepared) if known is not None else prepared.join(whole, "scope", "left").select(*prepared.columns, "states")

    schema = arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                states_of = known.value.get(r["scope"]) if known is not None else r["states"]
                books = {f: Portfolio.load(json.loads(s)) for f, s in json.loads(states_of or "{}").items()}
                out += page_fields(books, specs, r["page_id"], r["url"], r["scope"], r["seq"], r["html"], r["rendered"], render, False)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, RESULT)


def extract(pages: DataFrame, specs: list, scope: Column | None = None, seq: str | None = None, render: str = "auto", learn_pages: int | None = None, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, states), exact for scopes of any size.

    Only where a caller sets `learn_pages` are rules learned on that many pages
    of each scope and applied to the rest in parallel; then pages of the rest
    teach nothing and are not in the states.  `start` is as in `replay`.  Null html counts as an empty
    page; a url that repeats is one more page of its scope; ties in `seq` go by
    page_id."""
    if learn_pages is None:
        return replay(pages, specs, scope, seq, render, start=start)
    ready = _ready(specs)
    p = _prepared(pages, scope, seq)
    order = Window.partitionBy("scope").orderBy("seq", "page_id")
    # Only numbers are ranked; the limit is applied before the shuffle as well as after it.
    first = cut(p.select("scope", "seq", "page_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= learn_pages).select("page_id"))
    learned, states = _split(_replay(p.join(first, "page_id", "left_semi"), ready, start, render, True))
    rest = apply_rules(p.join(first, "page_id", "left_anti"), ready, states, render)
    return learned.unionByName(rest), states


def calls(results: DataFrame) -> DataFrame:
    """One row a page: COMPLETE where all fields are found, PARTIAL where some are, else INCOMPLETE."""
    found = F.count_if(F.col("status") == "FOUND")
    return results.groupBy("page_id", "url", "scope").agg(found.alias("found"), F.count("*").alias("total")).withColumn(
        "status", F.when(F.col("found") == F.col("total"), "COMPLETE").when(F.col("found") > 0, "PARTIAL").otherwise("INCOMPLETE")
    )


def provenance_of(origin: Column, confirmed: Column) -> Column:
    return F.when(confirmed >= 2, "CROSS_CONFIRMED").when((confirmed == 0) & (origin == "taught"), "AGENT_TAUGHT").otherwise("ENGINE_OBSERVED")


def provenance_rank(c: Column) -> Column:
    return F.array_position(F.array(F.lit("AGENT_TAUGHT"), F.lit("ENGINE_OBSERVED"), F.lit("CROSS_CONFIRMED")), c)


def gated(status: Column, provenance: Column, least: Column) -> Column:
    """UNCONFIRMED where a found value has less behind it than its field asks for."""
    return F.when((status == "FOUND") & least.isNotNull() & (provenance_rank(provenance) < provenance_rank(least)), "UNCONFIRMED").otherwise(status)


def fold_counters(states: DataFrame, results: DataFrame) -> DataFrame:
    """(scope, field, rule_kind, rule_pattern, hits, confirmed_hits) that applied pages add to each rule."""
    return results.where("stage = 'recipe' and not compiled").groupBy("scope", "field", "rule_kind", "rule_pattern").agg(F.count("*").alias("hits"), F.count_if(F.size("confirmed_by") > 0).alias("confirmed_hits"))


def agent_candidates(graph: DataFrame, results: DataFrame, specs: list, most: int = 3) -> DataFrame:
    """For fields that nobody found: the blocks of the page that fit the field's names best."""
    from pageloom.operators.relevance import locate

    out = None
    for spec in _ready(specs):
        open_pages = results.where((F.col("status") == "NEEDS_AGENT") & (F.col("field") == spec["name"])).select("page_id").distinct()
        hits = locate(graph.join(open_pages, "page_id", "left_semi"), " ".join(spec["aliases"]), most, 240, 1500).select("page_id", F.lit(spec["name"]).alias("field"), "rank", "block_id", "text", "score")
        out = hits if out is None else out.unionByName(hits)
    return out
