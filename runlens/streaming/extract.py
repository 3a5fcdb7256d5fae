"""The batch extractors fed by a file stream.

New files below a folder are read once (the checkpoint remembers them), pass through the same column
expressions as in batch, and append to a Parquet sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens.operators.extract import Extractor
from runlens.sources.files import source_of


def line_stream(spark: SparkSession, folder: str, max_files: int | None = None, marked: bool = False) -> DataFrame:
    """(file, record_key, value) of files as they arrive; ``marked``: folders of part files stand for files.

    A stream has no row numbers, so the key is a hash of the line: equal lines of a file share it.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.text(folder).select(
        source_of(F.col("_metadata.file_path"), marked).alias("file"), F.xxhash64("value").alias("record_key"), "value"
    )


def run_extraction(
    lines: DataFrame, extractor: Extractor, sink: str, checkpoint: str, per_batch: bool = False
) -> StreamingQuery:
    """Drain what is there into ``sink`` and stop.

    Extractors that join a file's lines to its header need the whole file: with ``per_batch`` they
    run on each micro-batch, which holds new files completely and in line order.
    """
    if not per_batch:
        rows = extractor.extract(lines)
        writer = rows.writeStream.format("parquet").option("path", sink).outputMode("append")
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            # a batch that is redone overwrites its own folder
            numbered = batch.withColumn("record_key", F.monotonically_increasing_id())
            extractor.extract(numbered).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

        writer = lines.writeStream.foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
