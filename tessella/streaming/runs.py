"""The batch run as a stream: new files of a folder are planned and run once, with Spark's checkpoint as the memory
of what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import workflow


def run_new_files(spark: SparkSession, folder: str, out_folder: str, checkpoint: str, work: Callable[[dict], bytes], suffix: str = "img") -> StreamingQuery:
    """Starts a stream that takes what is there and ends; started again, it takes only what has come since."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    items = files.select(workflow.stem(F.col("path")).alias("id"), F.col("path").alias("in"), "content")
    results = workflow.run(items, work)
    return results.writeStream.format("parquet").option("path", out_folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
