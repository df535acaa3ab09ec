"""What the operators share: the folder for intermediate tables, Arrow batches and packed columns."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WRITTEN: dict[str, SparkSession] = {}

# Rows keep together up to this many bytes of text in one Python task.
TASK_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; an own one only where it is unset (single machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and it is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reportloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._reportloom_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that materialize() wrote and nothing reads any more."""
    path = getattr(df, "_reportloom_path", None)
    if path and _WRITTEN.pop(path, None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_WRITTEN.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return


def cleared(df: DataFrame, names: list[str], keep: list[str] = ()) -> DataFrame:
    """df without the columns that an operator is about to add; the ones it reads stay."""
    taken = {n.lower() for n in names} - {k.lower() for k in keep}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def partitions_for(df: DataFrame, column: str, per_task: int = TASK_BYTES) -> int:
    """Partitions so that each holds about per_task bytes of column; at least the session's number."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / per_task))


def sums_before(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """df with columns that sum each of values over all rows before, in the given order. Ranges of rows are summed one
    by one, after the ranges' own sums (one row each) have been summed, so no task holds all rows. Rows that are
    equal by order have to be equal."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    names = list(values)
    whole = ranged.groupBy("__range").agg(*[F.sum(values[k]).alias(f"__{k}") for k in names])
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = whole.select("__range", *[(F.sum(f"__{k}").over(upto) - F.col(f"__{k}")).alias(f"__{k}") for k in names])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.join(F.broadcast(whole), "__range")  # at most n rows
    return rows.withColumns({k: F.col(f"__{k}") + F.sum(values[k]).over(within) - values[k] for k in names}).drop("__range", *[f"__{k}" for k in names])


def as_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column row by row, None where null. Only the row at hand is copied."""
    data, offsets = flat(column)
    valid = column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else None
    for k, (s, e) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
        yield data[s:e].tobytes() if valid is None or valid[k] else None


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column end to end, and where each row starts (one more entry: the end)."""
    wide = column.cast(pa.large_binary())
    if wide.null_count:
        wide = wide.fill_null(b"")
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    if wide.buffers()[2] is None or not len(wide):
        return np.empty(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0) if len(offsets) else np.zeros(1, np.int64)
    data = np.frombuffer(wide.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lengths[0] entries, then the same for the next, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
