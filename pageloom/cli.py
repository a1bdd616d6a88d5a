"""Command line: observe, locate, extract, extract-batch, expand, rules and forget over tables of pages or HTML files.

Exit codes: 0 done, 2 wrong arguments or (with --fail-on-error) rows with errors, 3 the first rows of a batch say that its strategy needs a look."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pageloom.api import Pages, RuleStore, exists
from pageloom.functions.scalars import FieldError
from pageloom.operators import batch, batchrun
from pageloom.operators.expansion import report
from pageloom.operators.extraction import calls
from pageloom.sources.files import html_files, result_log, url_set, write_jsonl, write_url_list


def _pages(spark: SparkSession, a: argparse.Namespace) -> Pages:
    if a.html:
        df = html_files(spark, a.html).withColumn("page_id", F.xxhash64("url"))
    else:
        df = spark.read.parquet(a.pages)
        if a.urls:
            df = df.join(url_set(spark, a.urls).select("url"), "url", "left_semi")
    return Pages(df)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pageloom")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("observe", "locate", "extract", "extract-batch", "expand"):
        s = sub.add_parser(name)
        s.add_argument("--pages")
        s.add_argument("--html")
        s.add_argument("--urls")
        s.add_argument("--out", required=True)
        if name == "locate":
            s.add_argument("query")
        if name.startswith("extract"):
            s.add_argument("--fields", required=True, help="JSON list of names or specs")
            s.add_argument("--store")
            s.add_argument("--render", choices=["auto", "on_miss", "never"], default="auto")
            s.add_argument("--no-learn", action="store_true")
            s.add_argument("--fail-on-error", action="store_true")
        if name == "extract-batch":
            s.add_argument("--resume", action="store_true", help="skip urls whose last row in --out is final, and append")
            s.add_argument("--continue-on-preflight-warning", action="store_true")
        if name == "expand":
            s.add_argument("--seeds", required=True)
            for limit, n in (("max-pages", 5000), ("max-urls", 100_000), ("max-depth", 3)):
                s.add_argument(f"--{limit}", type=int, default=n)
    for name in ("rules", "forget"):
        s = sub.add_parser(name)
        s.add_argument("--store", required=True)
        s.add_argument("--scope", required=name == "forget")
        s.add_argument("--field")
    a = p.parse_args(argv)
    if a.what == "expand" and (min(a.max_pages, a.max_urls) < 1 or a.max_depth < 0):
        p.error("max-pages and max-urls must be 1 or more, max-depth 0 or more")
    if a.what in ("observe", "locate", "extract", "extract-batch", "expand") and bool(a.pages) == bool(a.html):
        p.error("exactly one of --pages and --html is needed")
    if a.what == "extract-batch" and not a.urls:
        p.error("extract-batch needs --urls")
    spark = SparkSession.builder.appName("pageloom").getOrCreate()
    say = lambda **x: print(json.dumps(x, ensure_ascii=False), file=sys.stderr)
    try:
        if a.what == "rules":
            for r in RuleStore(spark, a.store).rules(a.scope).toLocalIterator():
                print(json.dumps(r.asDict(True), default=str, ensure_ascii=False))
        elif a.what == "forget":
            say(removed=RuleStore(spark, a.store).forget(a.scope, a.field))
        elif a.what == "observe":
            write_jsonl(_pages(spark, a).observe(), a.out)
        elif a.what == "locate":
            write_jsonl(_pages(spark, a).locate(a.query), a.out)
        elif a.what == "expand":
            got = _pages(spark, a).expand(url_set(spark, a.seeds), max_pages=a.max_pages, max_urls=a.max_urls, max_depth=a.max_depth)
            write_url_list(got["details"], a.out)
            say(**report(got, url_set(spark, a.seeds)))
        else:
            store = RuleStore(spark, a.store) if a.store else None
            base = store.version() if store else 0
            how = {"render": a.render, "learn": not a.no_learn, "start": store.states() if store else None}
            if a.what == "extract":
                results, states = _pages(spark, a).extract(json.loads(a.fields), exact=True, **how)
                rows = results.groupBy("page_id", "url").agg(F.collect_list(F.struct(F.col("field").alias("name"), "status", "stage", "value", "number", "provenance", "signals", "attempts")).alias("fields")).join(calls(results).drop("url", "scope"), "page_id").withColumn("ok", F.lit(True))
                write_jsonl(rows, a.out)
                say(advisories=[r.asDict() for r in batch.advisories(rows).collect()])
                code, errors = 0, 0
            else:
                pages = spark.read.parquet(a.pages) if a.pages else html_files(spark, a.html).withColumn("page_id", F.xxhash64("url"))
                log = None
                if a.resume:
                    # A folder that is not there yet is an empty log; rows of later files stand after those of earlier ones.
                    log = result_log(spark, a.out) if exists(spark, a.out) else None
                got = batchrun.run(pages, url_set(spark, a.urls), json.loads(a.fields), log, ["written", "line"], go_on=a.continue_on_preflight_warning, **how)
                write_jsonl(got["rows"], a.out, append=a.resume)
                states, code, errors = got["states"], got["code"], got["summary"]["batch"]["errors"]
                say(**got["summary"])
            if store:
                store.save(states, base)
            if code:
                return code
            if a.fail_on_error and errors:
                return 2
    except FieldError as e:
        print(json.dumps({"ok": False, "error": {"code": e.code, "message": str(e), "recoverable": False}}))
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
