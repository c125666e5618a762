"""New decisions into an index as they arrive, and log lines counted in event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terazi.functions.vectors import HashedEncoder, encode_column
from terazi.operators.chunking import chunk_table
from terazi.sources.io import exists


def index_decisions(stream: DataFrame, path: str, checkpoint: str, method: str = "recursive", limit: int = 512, encoder: HashedEncoder | None = None) -> StreamingQuery:
    """Chunk and encode each micro-batch of decisions into a folder of its own below path.

    A batch that is run again after a failure overwrites its folders, so no decision is indexed twice. Decisions that an earlier
    batch had are left out: their ids stand in a narrow table beside it (path-kimlik), so that no earlier chunk is read again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, ids = batch.sparkSession, f"{path}-kimlik"
        fresh = batch
        if number and exists(spark, ids):
            known = spark.read.schema("id string, parti int").parquet(ids).filter(F.col("parti") < number)
            fresh = batch.join(known, "id", "left_anti")
        chunks = encode_column(chunk_table(fresh, method, limit), "text", encoder=encoder)
        chunks.write.mode("overwrite").parquet(f"{path}/parti={number}")
        fresh.filter(F.col("id").isNotNull()).select("id").distinct().write.mode("overwrite").parquet(f"{ids}/parti={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that index_decisions() has written, with parti, the batch of each."""
    return spark.read.parquet(path)


def to_table(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream's whole aggregate as a table that each micro-batch replaces."""
    write = lambda batch, _: batch.write.mode("overwrite").parquet(path)
    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "2 hours", value: str | None = None) -> DataFrame:
    """Events per window of event time and key; rows later than the watermark no longer count in a stream."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    sums = [F.sum(value).alias("toplam")] if value else []
    return timed.groupBy(F.window(time, width).alias("pencere"), *keys).agg(F.count("*").alias("n"), *sums).select(F.col("pencere.start").alias("baslangic"), *keys, "n", *[c for c in ["toplam"] if value])


def drain(query: StreamingQuery) -> None:
    """Wait until everything available has been worked off."""
    query.awaitTermination()


def replay(spark: SparkSession, folder: str, schema: str, into: Callable[[DataFrame], StreamingQuery]) -> None:
    """Run a folder of parquet files through a stream to its end."""
    drain(into(spark.readStream.schema(schema).parquet(folder)))
