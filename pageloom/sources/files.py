"""URL sets, HTML files and result logs as tables, and results as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.session import cut


def inline(pages: DataFrame) -> DataFrame:
    """Given HTML as fetched pages: status 200, stage inline, bytes of UTF-8."""
    return pages.withColumns({"status": F.lit(200), "stage": F.lit("inline"), "bytes": F.octet_length("html"), "truncated": F.lit(False), "final_url": F.col("url")})


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of HTML files; bytes that are no UTF-8 are replaced."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def url_set(spark: SparkSession, path: str) -> DataFrame:
    """(url, pos): a JSON array, or lines without blanks and # comments; each URL once, where it comes first.

    `pos` rises with the place in the list, over files in order of their paths.
    Lists are read in as many tasks as their size asks for, a JSON array as a
    whole.  Two jobs run here: one looks which files are arrays, one keeps the
    first place of each URL."""
    file = F.col("_metadata.file_path").alias("file")
    # A line's place is its file, its block, and its number among the lines of a task, which rises within a block.
    url = F.when(F.contains("value", F.lit("\t")), F.trim("value", F.lit(" \t"))).otherwise(F.trim("value"))
    lines = spark.read.text(path).select(file, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), url.alias("url"))
    kinds = {r["file"]: r["maybe"] for r in lines.groupBy("file").agg(F.max(F.col("url").startswith("[")).alias("maybe")).collect()}
    maybe = [f for f, x in kinds.items() if x]
    first = lines.where(F.col("file").isin(maybe) & (F.col("url") != "")).groupBy("file").agg(F.min_by("url", F.struct("block", "line")).alias("url")) if maybe else None
    arrays = [r["file"] for r in first.where(F.col("url").startswith("[")).collect()] if maybe else []
    at = F.broadcast(spark.createDataFrame([(f, i) for i, f in enumerate(sorted(kinds))], "file string, at int"))
    rows = lines.where((F.col("url") != "") & ~F.col("url").startswith("#"))
    if arrays:
        whole = spark.read.text(path, wholetext=True).select(file, F.ltrim("value", F.lit("\ufeff")).alias("value")).where(F.col("file").isin(arrays))
        items = whole.select("file", F.lit(0).cast("long").alias("block"), F.posexplode(F.from_json("value", "array<string>")).alias("line", "url")).select("file", "block", F.col("line").cast("long").alias("line"), F.trim("url").alias("url"))
        rows = rows.where(~F.col("file").isin(arrays)).unionByName(items.where("url <> ''"))
    found = cut(rows.join(at, "file").groupBy("url").agg(F.min(F.struct("at", "block", "line")).alias("k")).select("url", "k.*"))
    blocks = found.groupBy("at", "block").agg(F.min("line").alias("low"), (F.max("line") - F.min("line") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("at", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.join(F.broadcast(blocks.select("at", "block", "low", before.alias("before"))), ["at", "block"]).select("url", (F.col("before") + F.col("line") - F.col("low")).alias("pos"))


def result_log(spark: SparkSession, path: str, schema: str = "url string, ok boolean, status string, error struct<code:string,message:string,recoverable:boolean>") -> DataFrame:
    """Rows of a JSON-lines log with their line number and when their file was written; torn lines are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_modification_time").alias("written"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    parsed = lines.withColumn("r", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    return parsed.where("trim(value) <> '' and r._bad is null and r.url is not null").select("written", "line", "r.*").drop("_bad")


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a row; a job's files appear together or not at all."""
    rows.write.mode("append" if append else "overwrite").json(path)


def write_url_list(urls: DataFrame, path: str, pos: str = "n", compression: str = "none") -> None:
    urls.repartitionByRange(pos).sortWithinPartitions(pos).select("url").write.mode("overwrite").option("compression", compression).text(path)
