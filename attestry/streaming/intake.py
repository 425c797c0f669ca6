"""Extension: incremental intake of documents from a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestry.operators import chunking


def chunk_stream(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes sentence windows of every document that arrives, once each; ends when all present files are read.

    Batches are made whole by the checkpoint: one that is run again after a
    failure overwrites its own folder.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        chunks = chunking.sentence_windows(batch.select("doc_id", "text"), "text")
        chunks.select("doc_id", "chunk_index", "chunk", F.lit(epoch).alias("epoch")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
