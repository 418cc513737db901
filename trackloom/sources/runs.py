"""Runs of cases: stage tables reused while their inputs stay the same, ordered sinks, logs and retention.

A stage's key is the hash of its name, its parameters and its parents' keys; an input's key that of its
files (path, length, time of change). So changed detections make every stage anew, changed rules of
association their own stages only, and a stage that is there already reads nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.stages import expired


class Folder:
    """Names, times and removals in a store that Spark can write to; metadata only passes through the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs

    def _at(self, path: str):
        at = self.hadoop.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def has(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def listed(self, path: str) -> list[tuple[str, bool, int, int]]:
        """Path, whether it is a folder, length and time of change of what lies in a folder."""
        fs, at = self._at(path)
        found = fs.listStatus(at) if fs.exists(at) else []
        return [(f.getPath().toString(), f.isDirectory(), f.getLen(), f.getModificationTime()) for f in found]

    def remove(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def write_text(self, path: str, text: str) -> None:
        fs, at = self._at(path)
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read_text(self, path: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect())


def digest(*parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def input_key(df: DataFrame) -> str:
    """Of the files that a table is read from and its plan; of its content where part of it comes from no file."""
    files, plan = sorted(df.inputFiles()), _plan(df)
    if not files or re.search(r"\b(LogicalRDD|LocalRelation|Range)\b", plan):
        row = df.select(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(*))"), F.expr("sum(cast(xxhash64(*) AS decimal(38, 0)))")).first()
        return digest(df.schema.simpleString(), *map(str, row))
    folder, wanted, seen = Folder(df.sparkSession, ""), defaultdict(set), []
    for f in files:
        wanted[os.path.dirname(f)].add(os.path.basename(f))
    for parent, names in sorted(wanted.items()):
        seen += sorted((p, size, at) for p, _, size, at in folder.listed(parent) if os.path.basename(p) in {n.replace("%20", " ") for n in names} | names)
    # what is done to the files before they come here counts too
    return digest(df.schema.simpleString(), seen, hashlib.sha256(plan.encode()).hexdigest())


def _plan(df: DataFrame) -> str:
    """The analysed plan without the numbers that differ from one session to another."""
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().analyzed().toString())


class StageGraph:
    """Stage tables under ``root/stage=/key=``. ``log`` tells of each whether it was reused, and the seconds it took."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder, self.keys, self.log = spark, Folder(spark, root), {}, []

    def path(self, stage: str) -> str:
        return f"{self.folder.root}/stage={stage}/key={self.keys[stage]}"

    def source(self, name: str, df: DataFrame) -> DataFrame:
        self.keys[name] = input_key(df)
        return df

    def stage(self, name: str, parents: str, make: Callable[[], DataFrame], *parameters) -> DataFrame:
        """The stage's table; ``make`` is called only if there is none for these parents and parameters."""
        self.keys[name] = digest(name, parameters, [self.keys[p] for p in parents.split()])
        began, reused = time.time(), self.folder.has(f"{self.path(name)}/_SUCCESS")
        if not reused:
            make().write.mode("overwrite").parquet(self.path(name))
        self.log.append({"stage": name, "key": self.keys[name], "reused": reused, "seconds": round(time.time() - began, 3)})
        return self.table(name)

    def table(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage))

    def save_run(self, case: str, run: str, **configs) -> None:
        """The run's configuration and stage log, as JSON under ``runs/case=/run=``."""
        at = f"{self.folder.root}/runs/case={case}/run={run}"
        for name, value in {**configs, "stage_log": self.log, "stage_keys": self.keys}.items():
            self.folder.write_text(f"{at}/{name}.json", json.dumps(value, indent=1, sort_keys=True, default=str))


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """``case_id, run, modified, path`` of the runs in a folder."""
    folder, rows = Folder(spark, root), []
    for case, is_folder, _, _ in folder.listed(f"{folder.root}/runs"):
        for run, inside, _, at in folder.listed(case) if is_folder else []:
            if inside:
                rows.append((os.path.basename(case).removeprefix("case="), os.path.basename(run).removeprefix("run="), at, run))
    return spark.createDataFrame(rows, "case_id string, run string, modified long, path string")


def delete_expired(spark: SparkSession, root: str, keep: int = 3) -> int:
    """Removes the runs beyond the ``keep`` newest of each case, and the stage tables that no run left needs."""
    folder, runs = Folder(spark, root), list_runs(spark, root)
    gone = [r.path for r in expired(runs, keep).collect()]
    for path in gone:
        folder.remove(path)
    needed = set()
    for r in list_runs(spark, root).collect():
        needed |= set(json.loads(folder.read_text(f"{r.path}/stage_keys.json")).items())
    for stage, is_folder, _, _ in folder.listed(folder.root):
        name = os.path.basename(stage)
        for key, *_ in folder.listed(stage) if is_folder and name.startswith("stage=") and gone else []:
            if (name.removeprefix("stage="), os.path.basename(key).removeprefix("key=")) not in needed:
                folder.remove(key)
    return len(gone)


def write_ordered(df: DataFrame, path: str, order: list, run: str | None = None, kind: str = "parquet", files: int | None = None) -> None:
    """Files whose order by name, and whose rows' order within, is the table's. With ``run`` they lie in that run's
    partition, and writing it again leaves the other runs. Nested values become JSON in CSV."""
    nested = {c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))} if kind == "csv" else set()
    keys = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    dealt = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions(*keys)
    flat = dealt.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])
    write = flat.write if run is None else flat.withColumn("run_id", F.lit(run)).write.partitionBy("run_id").option("partitionOverwriteMode", "dynamic")
    write.mode("overwrite").format(kind).option("header", True).save(path)


def read_ordered(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """The rows of ``write_ordered`` (Parquet) with ``place``, 1, 2, ... by file and row."""
    at = path if run is None else f"{path}/run_id={run}"
    rows = spark.read.parquet(at).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    # a row for each file
    sizes = [(r["__file"], r["n"]) for r in rows.groupBy("__file").agg(F.max("__row").alias("n")).orderBy("__file").collect()]
    before, offsets = 0, []
    for name, last in sizes:
        offsets.append((name, before))
        before += last + 1
    starts = F.broadcast(spark.createDataFrame(offsets, "__file string, __before long"))
    return rows.join(starts, "__file").withColumn("place", F.col("__before") + F.col("__row") + 1).drop("__file", "__row", "__before")
