"""Files as they arrive: a stream over a folder, each batch parsed like a table of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import containers as C

_FILES = "path string, modificationTime timestamp, length long, content binary"


def incoming(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """A streaming (doc_id, path, content) of the supported files that appear under ``folder``."""
    x = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", C.name_filter()).option("maxFilesPerTrigger", per_batch).load(folder)
    return x.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def parse_into(files: DataFrame, target: str, checkpoint: str):
    """Parse the stream's files and append the documents to the Parquet table ``target``; ``checkpoint`` makes a restart go on where it stopped."""
    return C.documents(files).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
