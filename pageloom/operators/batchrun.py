"""A batch of URLs from a table of fetched pages: what is pending, an early check of the strategy, results, errors, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators import batch, extraction, policy
from pageloom.session import col_or_null, cut

FIELD = "array<struct<name:string,field_type:string,status:string,stage:string,value:string,number:double,provenance:string,signals:array<string>>>"
ERROR = "struct<code:string,message:string,recoverable:boolean>"
ROW = f"url string, ok boolean, status string, fields {FIELD}, error {ERROR}"


def rows_of(pages: DataFrame, todo: DataFrame, specs: list, start: DataFrame | None = None, render: str = "auto", learn: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, states): one row for each url of todo, from its newest page (largest page_id).

    A url without page is FETCH_FAILED, a status from 400 HTTP_ERROR, a challenge
    BLOCKED; these reach no extraction and change no rule."""
    here = pages.withColumn("status", col_or_null(pages, "status", "int"))
    newest = here.join(todo.select("url"), "url", "left_semi").groupBy("url").agg(F.max("page_id").alias("page_id"))
    newest = cut(newest)
    met = here.join(newest.select("page_id"), "page_id", "left_semi")
    wrong, why = policy.http_error(F.col("status")), policy.challenge(F.col("status"), F.col("html"))
    failed = F.when(why.isNotNull(), F.struct(F.lit("BLOCKED").alias("code"), why.alias("message"), F.lit(True).alias("recoverable"))).when(wrong.isNotNull(), F.struct(wrong.code.alias("code"), F.concat(F.lit("HTTP status "), F.col("status").cast("string")).alias("message"), wrong.recoverable.alias("recoverable")))
    results, states = extraction.replay(met.where(failed.isNull()), specs, render=render, learn=learn, start=start)
    found = results.groupBy("page_id").agg(F.collect_list(F.struct(F.col("field").alias("name"), F.col("type").alias("field_type"), "status", "stage", "value", "number", "provenance", "signals")).cast(FIELD).alias("fields"))
    good = found.join(extraction.calls(results).select("page_id", "status"), "page_id").join(newest, "page_id").select("url", F.lit(True).alias("ok"), "status", "fields", F.lit(None).cast(ERROR).alias("error"))
    none = [F.lit(False).alias("ok"), F.lit("ERROR").alias("status"), F.array().cast(FIELD).alias("fields")]
    bad = met.select("page_id", failed.alias("error")).where("error is not null").join(newest, "page_id").select("url", *none, F.col("error").cast(ERROR).alias("error"))
    gone = todo.join(newest, "url", "left_anti").select("url", *none, F.struct(F.lit("FETCH_FAILED").alias("code"), F.lit("no page of this url was fetched").alias("message"), F.lit(True).alias("recoverable")).cast(ERROR).alias("error"))
    return good.unionByName(bad).unionByName(gone), states


def run(pages: DataFrame, urls: DataFrame, specs: list, log: DataFrame | None = None, order: list[str] | None = None, start: DataFrame | None = None, render: str = "auto", learn: bool = True, go_on: bool = False) -> dict:
    """rows, states, summary and exit code of a batch.

    urls(url, pos); log(url, ok, error, order columns) holds earlier rows of the
    same set: urls whose last row is final are skipped.  From a thousand pending
    urls on, the first ten are tried alone; if almost nothing is found there the
    batch ends with those rows and code 3, unless `go_on`.  They change no rule."""
    wanted = cut(urls.where("url is not null and trim(url) <> ''").groupBy("url").agg(F.min("pos").alias("pos")))
    todo = cut(batch.pending(wanted, log, order or []) if log is not None else wanted)
    total, pending = wanted.count(), todo.count()
    check: dict | None = None
    if pending >= batch.PREFLIGHT_FROM:
        rows, states = rows_of(pages, todo.orderBy("pos").limit(batch.PREFLIGHT), specs, start, render, learn)
        rows = cut(rows)
        said = batch.summary(rows, total, total - pending)
        bad = [a for a in said["advisories"] if a["code"] in ("LOW_BATCH_YIELD", "HIGH_AGENT_ESCALATION")]
        check = {"pending_urls": pending, "sample_size": batch.PREFLIGHT, "status": "REVIEW_REQUIRED" if bad else "PASS", "advisories": bad}
        if bad and not go_on:
            return {"rows": rows, "states": states, "code": 3, "summary": {"ok": False, "code": "STRATEGY_REVIEW_REQUIRED", "preflight": check, "batch": said}}
    rows, states = rows_of(pages, todo, specs, start, render, learn)
    rows = cut(rows)
    summary = {"ok": True, "batch": batch.summary(rows, total, total - pending)}
    return {"rows": rows, "states": states, "code": 0, "summary": summary if check is None else {**summary, "preflight": check}}
