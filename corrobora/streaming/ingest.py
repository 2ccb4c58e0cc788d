"""An extension: new documents arrive in a folder and are chunked as they come, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corrobora.functions import text as T
from corrobora.operators import chunks
from corrobora.sources import documents

FILES = "path string, modificationTime timestamp, length long, content binary"


def chunk_arrivals(spark: SparkSession, folder: str, target: str, checkpoint: str, size: int = 1200, overlap: int = 200, once: bool = True) -> StreamingQuery:
    """Appends the chunks of files that appear under ``folder`` to the Parquet table ``target``.

    A file's identifier is a hash of its path. The stream's checkpoint keeps what was read; a batch that is
    repeated after a failure rewrites its own part of the table.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        parsed = documents.parse(batch.where(documents.supported(T.basename("path")))).where("status = 'parsed'")
        parsed = parsed.withColumn("doc_id", F.xxhash64("path"))
        segments = parsed.select("doc_id", F.posexplode("segments").alias("seg", "s")).select("doc_id", "seg", "s.page", "s.text")
        made = chunks.chunk(segments, size, overlap).join(parsed.select("doc_id", "path"), "doc_id")
        made.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
