"""Telemetry of batches of results: counters, advisories, resuming, early stop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# From how many rows on advisories speak, and their limits.
LEAST, LOW_YIELD, HIGH_AGENT, SHOWN, PREFLIGHT_FROM, PREFLIGHT = 10, 0.10, 0.80, 5, 1000, 10


def is_final(ok: Column, recoverable: Column) -> Column:
    """Done for good: it went well, or it failed in a way that a retry won't mend.  Unknown means retry."""
    return F.coalesce(ok, F.lit(False)) | recoverable.eqNullSafe(F.lit(False))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; a null key stands for itself.  Aggregation, so a hot key is combined before the shuffle."""
    cols = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*order, *cols), F.struct(*order)).alias("r")).select(key, "r.*")


def pending(urls: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """URLs of a set, each once in order of appearance, that no final last row has."""
    wanted = urls.where("url is not null and trim(url) <> ''").groupBy("url").agg(F.min("pos").alias("pos"))
    last = latest(rows.select("url", *order, "ok", F.col("error.recoverable").alias("recoverable")), "url", order)
    return wanted.join(last.where(is_final(F.col("ok"), F.col("recoverable"))).select("url"), "url", "left_anti")


def counters(rows: DataFrame, by: list[str] | None = None, total: Column | None = None) -> DataFrame:
    """Scalar counters, of all rows or by group.  Rows that are ok with an unknown status count as errors."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    known = {s: ok & F.coalesce(F.col("status") == s, F.lit(False)) for s in ("COMPLETE", "PARTIAL", "INCOMPLETE")}
    any_known = known["COMPLETE"] | known["PARTIAL"] | known["INCOMPLETE"]
    unconfirmed = F.size(F.filter(F.coalesce("fields", F.array().cast(rows.schema["fields"].dataType)), lambda f: f.status == "UNCONFIRMED"))
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("attempted"), *[F.count_if(c).alias(s.lower()) for s, c in known.items()], F.count_if(~any_known).alias("errors"), F.sum(F.when(ok, unconfirmed).otherwise(0)).alias("unconfirmed_fields")
    )


def error_codes(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce("ok", F.lit(False))).groupBy(F.coalesce("error.code", F.lit("UNKNOWN_ERROR")).alias("code")).agg(F.count("*").alias("n"))


def field_outcomes(rows: DataFrame) -> DataFrame:
    """Both grains at once: (null, status) over all fields, and (name, status)."""
    f = rows.where(F.coalesce("ok", F.lit(False))).select(F.explode("fields").alias("f")).select(F.coalesce("f.name", F.lit("UNKNOWN")).alias("name"), F.coalesce("f.status", F.lit("UNKNOWN")).alias("status"))
    return f.groupingSets([["status"], ["name", "status"]], "name", "status").agg(F.count("*").alias("n"))


def exploded_counts(rows: DataFrame, column: str, unknown: str) -> DataFrame:
    """Counts of the codes of an array column, as for signals and stages."""
    return rows.select(F.explode(column).alias("code")).groupBy(F.coalesce("code", F.lit(unknown)).alias("code")).agg(F.count("*").alias("n"))


def advisories(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(group, code, value, fields, omitted): what looks unusual in a batch; never why.

    `fields` are the first names of the fields that were never found, `omitted`
    how many more there are.  Without groups an empty batch gives EMPTY_INPUT_SET;
    with groups there is no row to give it for."""
    keys = by or []
    c = counters(rows, keys)
    no_names = [F.lit(None).cast("array<string>").alias("fields"), F.lit(None).cast("int").alias("omitted")]
    needs = F.filter(F.coalesce("fields", F.array().cast(rows.schema["fields"].dataType)), lambda f: f.status == "NEEDS_AGENT")
    seen = rows.where(F.coalesce("ok", F.lit(False))).groupBy(*keys).agg(F.sum(F.size("fields")).alias("observed"), F.sum(F.size(needs)).alias("agent"))
    both = c.join(seen, keys, "left") if keys else c.join(F.broadcast(seen))
    usable, share = (F.col("complete") + F.col("partial")) / F.col("attempted"), F.col("agent") / F.col("observed")
    low = both.where((F.col("attempted") >= LEAST) & (usable <= LOW_YIELD)).select(*keys, F.lit("LOW_BATCH_YIELD").alias("code"), F.bround(usable, 4).alias("value"), *no_names)
    high = both.where((F.col("observed") >= LEAST) & (share >= HIGH_AGENT)).select(*keys, F.lit("HIGH_AGENT_ESCALATION").alias("code"), F.bround(share, 4).alias("value"), *no_names)
    fields = rows.where(F.coalesce("ok", F.lit(False))).select(*keys, F.explode("fields").alias("f")).groupBy(*keys, F.coalesce("f.name", F.lit("UNKNOWN")).alias("name")).agg(F.count("*").alias("n"), F.count_if(F.col("f.status") == "FOUND").alias("found"))
    # Field names of a batch are those of its specs, so a group's list is short.
    gaps = fields.where((F.col("n") >= LEAST) & (F.col("found") == 0)).groupBy(*keys).agg(F.array_sort(F.collect_list("name")).alias("names")).where("size(names) > 0").select(
        *keys, F.lit("SYSTEMATIC_FIELD_GAPS").alias("code"), F.size("names").cast("double").alias("value"), F.slice("names", 1, SHOWN).alias("fields"), F.greatest(F.lit(0), F.size("names") - SHOWN).alias("omitted")
    )
    empty = [] if keys else [c.where("attempted = 0").select(F.lit("EMPTY_INPUT_SET").alias("code"), F.lit(0.0).alias("value"), *no_names)]
    return reduce(DataFrame.unionByName, [low, high, gaps, *empty])


def summary(rows: DataFrame, total: int, skipped: int) -> dict:
    """Counters of a finished batch as one object; a few small aggregates come to the driver."""
    ok = rows.where(F.coalesce("ok", F.lit(False)))
    out = {"total": total, "skipped": skipped, **counters(rows).first().asDict()}
    out["unconfirmed_fields"] = out["unconfirmed_fields"] or 0
    out["flagged_rows"] = ok.where(F.exists("fields", lambda f: F.size(f.signals) > 0)).count()
    fields = ok.select(F.explode("fields").alias("f"))
    pairs = lambda df: {r["code"]: r["n"] for r in df.collect()}
    out["error_codes"] = pairs(error_codes(rows))
    out["stage_hits"] = pairs(fields.where("f.stage is not null").groupBy(F.col("f.stage").alias("code")).agg(F.count("*").alias("n")))
    out["signals"] = pairs(exploded_counts(fields.select("f.signals"), "signals", "UNKNOWN_SIGNAL"))
    by_name: dict = {}
    out["field_statuses"] = {}
    for r in field_outcomes(rows).collect():
        (by_name.setdefault(r["name"], {}) if r["name"] is not None else out["field_statuses"])[r["status"]] = r["n"]
    out["field_outcomes"] = by_name
    out["advisories"] = [{"code": r["code"], "value": r["value"], **({"fields": r["fields"], "omitted": r["omitted"]} if r["fields"] else {})} for r in advisories(rows).collect()] if total else [{"code": "EMPTY_INPUT_SET", "value": 0.0}]
    return out


def preflight(rows: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """Of each group of a thousand rows or more: whether its first ten rows say to stop."""
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= PREFLIGHT).drop("n")
    size = rows.groupBy(*by).agg(F.count("*").alias("pending")).where(F.col("pending") >= PREFLIGHT_FROM)
    bad = advisories(first, by).where(F.col("code").isin("LOW_BATCH_YIELD", "HIGH_AGENT_ESCALATION")).groupBy(*by).agg(F.count("*").alias("bad"))
    return size.join(bad, by, "left").select(*by, "pending", F.coalesce(F.col("bad") > 0, F.lit(False)).alias("stop"))
