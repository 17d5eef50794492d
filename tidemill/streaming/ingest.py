"""Landing files as a stream: each micro-batch becomes one commit, so a restart neither loses nor repeats rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemill.sources.versioned import VersionedTable


def landed_up_to(table: VersionedTable) -> int:
    """Number of the last micro-batch that was committed, or -1; micro-batches come in order, so the latest commit of one tells."""
    for v in reversed(table.log.versions()):
        name = table.log.commit(v)["info"]["user_metadata"].get("stream")
        if name:
            return int(name.removeprefix("stream-"))
    return -1


def land_files(spark: SparkSession, folder: str, schema: T.StructType, table: VersionedTable, checkpoint: str, *, kind: str = "parquet", per_batch: int = 100) -> StreamingQuery:
    """All files of a folder that weren't landed yet, then stop. A micro-batch that was committed before isn't committed again."""

    def commit(batch: DataFrame, number: int) -> None:
        name = f"stream-{number}"
        if number <= landed_up_to(table):
            return
        rows = batch.withColumns({"_ingest_ts": F.current_timestamp(), "_stream_batch": F.lit(number)})
        told = {"stream": name}
        table.append(rows, evolve=True, user_metadata=told) if table.exists() else table.create(rows, user_metadata=told)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(kind).load(folder)
    stream = stream.withColumn("_source_file", F.col("_metadata.file_path"))
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(commit).start()


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and their value by type and time window; works on batches and on streams, which forget what is older than `late`."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        ts = ts.withWatermark("ts", late)
    return ts.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
