"""Optional: the same extraction over report files as they land. The batch operators are all there is to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reportloom.operators import extract


def new_reports(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """report_id, text of text files under path, at most per_trigger new ones in a batch."""
    rows = spark.readStream.option("maxFilesPerTrigger", per_trigger).option("wholetext", True).text(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("report_id"), F.col("value").alias("text"))


def extract_to(reports: DataFrame, rules: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Indicators of each batch of reports as Parquet under out, in a folder for each batch.

    First matches are found within a report, and a report comes as a whole, so no state is kept between batches.
    A batch that runs again overwrites its own folder only.
    """

    def write(batch: DataFrame, number: int) -> None:
        extract.extract(batch, rules).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
