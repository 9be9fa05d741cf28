"""The earliest message per Message-ID in arriving batches, held back until its delay is over.

A batch meets what is still held, the earliest of each key wins, and keys whose first copy arrived longer
ago than the delay are settled: they leave for ``settled/batch=N`` and are never looked at again. The rest
is the state of the batch, a table under ``held``; its size follows the delay, not the age of the mailbox.
A batch that runs again starts from the state before it and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.functions.headers import header
from mailsieve.sources import files

SCHEMA = "key string, message_id string, id string, internal_date timestamp, arrived_at timestamp"
_OUT = ("message_id", "id", "internal_date")


def _earliest(rows: DataFrame) -> DataFrame:
    """One row per key: the earliest message, and when the first copy arrived; copies meet before the shuffle."""
    first = F.min(F.struct("internal_date", "id")).alias("first")
    found = rows.groupBy("key").agg(first, F.min("message_id").alias("message_id"), F.min("arrived_at").alias("arrived_at"))
    return found.select("key", "message_id", "first.id", "first.internal_date", "arrived_at")


def _before(spark: SparkSession, path: str, batch: int) -> DataFrame:
    numbers = [int(n) for n in files.names(spark, f"{path}/held") if n.isdigit() and int(n) < batch]
    if not numbers:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{path}/held/{max(numbers):012d}")


def dedupe_batch(messages: DataFrame, path: str, batch: int, delay: str = "7 days", arrived: Column | None = None) -> None:
    """Fold a batch in. ``arrived`` is the time of arrival (now, unless given); the latest of a batch moves the clock.

    Messages without a Message-ID are all kept, whatever their number."""
    spark = messages.sparkSession
    message_id = header(F.col("headers"), "Message-ID")
    rows = messages.select(
        F.when(message_id != "", message_id).otherwise(F.concat(F.lit("\u0000"), "id")).alias("key"),
        message_id.alias("message_id"),
        "id",
        "internal_date",
        (F.current_timestamp() if arrived is None else arrived).alias("arrived_at"),
    )
    held, settled = f"{path}/held/{batch:012d}", f"{path}/settled/batch={batch}"
    staging = f"{path}/_staging/{batch}"
    everything = _earliest(_before(spark, path, batch).unionByName(rows))
    everything.write.mode("overwrite").parquet(staging)
    everything = spark.read.schema(SCHEMA).parquet(staging)
    # The clock is the latest arrival known; a message without one is as new as that.
    clock = everything.agg(F.max("arrived_at").alias("now")).select((F.col("now") - F.expr(f"INTERVAL {delay}")).alias("due"))
    over = F.coalesce(F.col("arrived_at") <= clock.scalar(), F.lit(False))
    everything.where(over).write.mode("overwrite").parquet(settled)
    everything.where(~over).write.mode("overwrite").parquet(held)
    files.remove(spark, staging)
    older = sorted(int(n) for n in files.names(spark, f"{path}/held") if n.isdigit() and int(n) < batch)
    for number in older[:-1]:  # the state before this one is needed if the batch runs again
        files.remove(spark, f"{path}/held/{number:012d}")


def read_deduped(spark: SparkSession, path: str, settled_only: bool = False) -> DataFrame:
    """``message_id, id, internal_date``: settled messages, and those held as they stand now."""
    numbers = [int(n) for n in files.names(spark, f"{path}/held") if n.isdigit()]
    if not numbers:
        return spark.createDataFrame([], SCHEMA).select(*_OUT)
    done = spark.read.schema(SCHEMA).parquet(f"{path}/settled").select(*_OUT)
    return done if settled_only else done.unionByName(_before(spark, path, max(numbers) + 1).select(*_OUT))


def dedupe_arriving(messages: DataFrame, path: str, checkpoint: str, delay: str = "7 days", arrived: Column | None = None) -> DataFrame:
    """Fold in what has arrived in a stream of messages, and stop; returns the messages kept so far."""
    query = messages.writeStream.foreachBatch(lambda rows, number: dedupe_batch(rows, path, number, delay, arrived))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_deduped(messages.sparkSession, path)
