"""Rules as a table: ranks, caps, counters from outcome logs, listing, forgetting, migration; all native windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import patterns as P

RULES = (
    "id long, scope string, field string, kind string, pattern string, origin string, role string, hits long, misses long, total_misses long, contradictions long, confirmed_hits long, "
    "last_validated timestamp, created_at timestamp, updated_at timestamp"
)
KEY = ["scope", "field"]


def score() -> Column:
    return (F.col("hits") + 1) / (F.col("hits") + F.col("total_misses") + 2 * F.col("contradictions") + 2)


def status() -> Column:
    return F.when(F.col("role") == "retired", "retired").when(F.col("misses") >= P.STALE_AFTER, "stale").otherwise("active")


def kind_rank() -> Column:
    return F.when(F.col("kind") == "json", 3).when(F.col("kind") == "regex", 2).when(F.col("kind") == "label", 1).otherwise(0)


def _by_evidence():
    return [F.desc(score()), F.desc(kind_rank()), F.asc("id")]


def ranked(rules: DataFrame) -> DataFrame:
    """Live rules in the order they are tried."""
    w = Window.partitionBy(*KEY).orderBy((F.col("role") != "primary").cast("int"), *_by_evidence())
    return rules.where(F.col("role").isin(*P.ROLES[:3])).withColumn("rank", F.row_number().over(w))


def enforce_caps(rules: DataFrame) -> DataFrame:
    """Beyond three alternatives rules retire, weakest first; the newest sixteen retired ones stay."""
    alt = F.col("role").isin("fallback", "candidate")
    w = Window.partitionBy(*KEY, alt.cast("int")).orderBy(*_by_evidence())
    capped = rules.withColumn("n", F.row_number().over(w)).withColumn("role", F.when(alt & (F.col("n") > P.MAX_ALTERNATIVES), "retired").otherwise(F.col("role"))).drop("n")
    keep = Window.partitionBy(*KEY, (F.col("role") == "retired").cast("int")).orderBy(F.desc("updated_at"), F.desc("id"))
    return capped.withColumn("n", F.row_number().over(keep)).where((F.col("role") != "retired") | (F.col("n") <= P.KEEP_RETIRED)).drop("n")


def over_full(rules: DataFrame) -> DataFrame:
    return rules.where("role = 'retired'").groupBy(*KEY).agg(F.count("*").alias("retired")).where(F.col("retired") > P.KEEP_RETIRED)


def listing(rules: DataFrame, scope: str | None = None) -> DataFrame:
    shown = rules if scope is None else rules.where(F.col("scope") == scope)
    role = F.array_position(F.array(*map(F.lit, P.ROLES)), F.col("role"))
    return shown.withColumns({"score": F.round(score(), 4), "status": status()}).orderBy(*KEY, role, *_by_evidence())


def forget(rules: DataFrame, scope: str, field: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What stays, and a row with how many went."""
    gone = (F.col("scope") == scope) & (F.lit(True) if field is None else F.col("field") == field)
    return rules.where(~F.coalesce(gone, F.lit(False))), rules.where(gone).agg(F.count("*").alias("removed"))


def migrate(old: DataFrame) -> DataFrame:
    """Tables of one rule a field: each becomes the primary."""
    return old.withColumn("role", F.lit("primary")).withColumns({c: F.lit(0).cast("long") for c in ("total_misses", "contradictions", "confirmed_hits") if c not in old.columns})


def miss_runs(log: DataFrame, key: list[str], order: list[str], hit: Column) -> DataFrame:
    """Adds hits, misses in a row, and total misses after each outcome of the log."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    h = hit.cast("long")
    runs = log.withColumn("hits", F.sum(h).over(w)).withColumn("total_misses", F.sum(1 - h).over(w))
    island = Window.partitionBy(*key, "hits").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("misses", F.sum(1 - h).over(island))


def streaks(log: DataFrame, key: list[str], order: list[str], url: str, value: str) -> DataFrame:
    """Adds `streak`: how many different pages in a row had this value.  The same page again does not count."""
    w = Window.partitionBy(*key).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    moved = (~F.col(url).eqNullSafe(F.lag(url).over(w))).cast("int")
    run = log.withColumns({"_changed": changed, "_moved": moved}).withColumn("_island", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return run.withColumn("streak", 1 + F.sum(F.when(F.col("_changed") == 0, F.col("_moved")).otherwise(0)).over(inside)).drop("_changed", "_moved", "_island")
