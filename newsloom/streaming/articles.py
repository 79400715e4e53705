"""Article files cleaned as they arrive.

The cleaning operators keep no state between rows, so they run on a stream as
they are; only the reader and the sink differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators import schema as S


def read_article_stream(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_batch: int = 1000) -> DataFrame:
    """New JSON-lines files of a folder, a bounded number per batch."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    )


def write_clean_metadata(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Cleaned standard columns as parquet, each input file exactly once."""
    writer = (
        S.clean_metadata(stream)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
