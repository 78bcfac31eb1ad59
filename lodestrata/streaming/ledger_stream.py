"""A journal as a stream: records that arrive as JSON files are deduplicated by content and appended once.

Replay is idempotent: a record's key is its kind, item, level and payload digest,
and the query's checkpoint makes a restart go on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S

KEY = ["kind", "item", "level", "payload_sha256"]


def records(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    raw = spark.readStream.schema(S.JOURNAL).option("maxFilesPerTrigger", files_per_trigger).option("mode", "DROPMALFORMED").json(path)
    return raw.withColumn("payload_sha256", F.sha2("payload", 256)).withColumn("arrived", F.current_timestamp())


def deduplicated(stream: DataFrame, horizon: str | None = None) -> DataFrame:
    """First record of each key; with a horizon, state older than it is dropped (the journal's retry window)."""
    if horizon is None:
        return stream.dropDuplicates(KEY)
    return stream.withWatermark("arrived", horizon).dropDuplicatesWithinWatermark(KEY)


def start(stream: DataFrame, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start() if once else writer.start()


def call_counts(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Calls per kind in tumbling windows, late records within the watermark counted."""
    return stream.withWatermark("arrived", late).groupBy(F.window("arrived", width), "kind").agg(F.count(F.lit(1)).alias("calls"))
