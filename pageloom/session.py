"""Sessions, table loading and cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, name: str = "pageloom") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it; a local one only where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("a cluster must name a folder that its executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pageloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df as a table written to the shared folder and read again: its lineage ends there, lost executors lose nothing.

    Compressed and columnar, so that later steps read only the columns they
    need.  The folder belongs to the cluster, which clears it when the
    application is over."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    out = df if partitions is None else df.coalesce(partitions)
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a scan reads at least in one partition, as Spark plans it by default.
_OPEN_COST = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A scan in as many partitions as there are cores, where its files are so small that most cores would be idle.

    Told by the size of the files alone: nothing runs while the query is built,
    and larger inputs, which fill all cores by themselves, are never shuffled."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(slots) if size < slots * _OPEN_COST else df


def col_or_null(df: DataFrame, name: str, kind: str):
    """Column `name` of df, or a null of `kind` where df has no such column."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
