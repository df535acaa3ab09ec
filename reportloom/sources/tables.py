"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Bytes of a row group, as writers usually make them.
ROW_GROUP = 128 << 20
_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; an own folder only where it is unset, on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the session's process ends."""
    path = f"{shared_folder(spark)}/reportloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a table and read from there: its lineage ends, and lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df for costly expressions on every row. A file's row groups are what tasks can share, so an input of fewer than one
    for each core is dealt out evenly first. What was shuffled before, or is larger, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    query = df._jdf.queryExecution()
    size = int(str(query.optimizedPlan().stats().sizeInBytes()))
    if "Exchange" in query.executedPlan().toString() or size >= cores * ROW_GROUP:
        return df
    return df.repartition(cores)


@atexit.register
def _clean() -> None:
    for path, spark in _WRITTEN.items():
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return
