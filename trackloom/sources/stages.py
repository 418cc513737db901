"""Stage tables: results written to a folder that all executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trackloom-"))
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/trackloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, by the schema given; without rows where there is nothing at ``path``."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_id(when) -> Column:
    """The name of a run started at a time: yyyymmdd_hhmmss."""
    return F.date_format(when, "yyyyMMdd_HHmmss")


def expired(runs: DataFrame, keep: int = 3) -> DataFrame:
    """Of ``case_id, run, modified``: the runs beyond the ``keep`` newest of each case, with their ``place``."""
    newest = Window.partitionBy("case_id").orderBy(F.desc("modified"), "run")
    return runs.withColumn("place", F.row_number().over(newest)).where(F.col("place") > keep)


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None, limit: int | None = None) -> None:
    """CSV of the wanted columns that exist; nested values become JSON."""
    names = [c for c in columns or df.columns if c in df.columns]
    flat = {c: t for c, t in df.dtypes if t.startswith(("array", "map", "struct"))}
    out = df.select(*[F.to_json(c).alias(c) if c in flat else F.col(c) for c in names])
    (out if limit is None else out.limit(limit)).write.mode("overwrite").option("header", True).csv(path)
