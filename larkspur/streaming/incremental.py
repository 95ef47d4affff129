"""An index that grows: passages arrive in a directory, only new ones are embedded and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_id
from ..providers import embed
from ..sources.stores import STORE, append_store, read_or_empty


def add_passages(batch: DataFrame, path: str, namespace: str = "passage") -> None:
    """Appends the texts of one batch that the store lacks; running a batch twice adds nothing."""
    spark = batch.sparkSession
    keyed = batch.where("text IS NOT NULL").select(content_id(namespace, F.col("text")).alias("hash_id"), "text").dropDuplicates(["hash_id"])
    new = keyed.join(read_or_empty(spark, path, STORE).select("hash_id"), "hash_id", "left_anti")
    append_store(embed(new), path)


def follow(spark: SparkSession, source: str, path: str, checkpoint: str, files_per_batch: int = 1, namespace: str = "passage") -> StreamingQuery:
    """Follows a directory of Parquet files with a `text` column until all present files are taken in."""
    stream = spark.readStream.schema("text string").option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (
        stream.writeStream.foreachBatch(lambda df, _: add_passages(df, path, namespace))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
