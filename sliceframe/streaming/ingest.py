"""Incremental header scan: files that were not seen before are parsed and appended as Parquet."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from sliceframe.sources.dicom import headers_of, kept_paths

#: Columns of Spark's binary file reader (fixed values).
FILE = "path string, modificationTime timestamp, length long, content binary"


def ingest_headers(spark: SparkSession, root: str, dest: str, checkpoint: str, *, files_per_batch: int = 100_000) -> StreamingQuery:
    """Parses all new files below ``root`` and stops; the checkpoint remembers them, the Parquet sink commits each batch once."""
    source = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)
    rows = headers_of(kept_paths(source, root))
    return rows.writeStream.format("parquet").option("path", dest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
