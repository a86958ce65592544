"""A folder as a stream: new files are pseudonymized as they come; the checkpoint is the resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.pseudonymize import pseudonymize


def read_stream(spark: SparkSession, src: str) -> DataFrame:
    """path, text, arrived."""
    return spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(src).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.current_timestamp().alias("arrived"))


def start(docs: DataFrame, dst: str, checkpoint: str, config: Config | None = None, **options) -> StreamingQuery:
    """Every row is a document and no state is kept, so the plan is the batch plan; all that is
    there is processed and the query ends."""

    def batch(rows: DataFrame, _: int) -> None:
        pseudonymize(rows, config, id_col="path", **options).write.mode("append").parquet(dst)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(docs: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Documents by window of arrival (an extension: the batch engine has no such count)."""
    return docs.withWatermark("arrived", late).groupBy(F.window("arrived", window)).agg(F.count("*").alias("documents"))
