"""The same transforms on arriving messages.

Extraction, cleaning and redaction are stateless per row, so a stream of dump files goes
through the batch functions unchanged. Only removing duplicates keeps state, and a
watermark bounds it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.headers import header
from mailsieve.operators.fields import FIELD_SETS, choose_fields, project_fields
from mailsieve.operators.options import ExportOptions
from mailsieve.operators.predicates import PRESETS
from mailsieve.plans.export import ExportSummary
from mailsieve.sources.csv_files import close_rolled, roll_batch, rolled_state
from mailsieve.sources.messages import stream_messages
from mailsieve.sources.session import work_path


def dedupe_stream(messages: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first message to arrive per Message-ID, among those that arrive less than ``delay`` apart.

    The watermark follows the time of arrival, so old mail is never late. Messages without a
    Message-ID are all kept, as in batch: the message's own id takes its place.
    """
    message_id = header(F.col("headers"), "Message-ID")
    own_key = F.concat(F.lit("\u0000"), "id")
    keyed = messages.withColumns(
        {
            "message_id": message_id,
            "key": F.when(message_id != "", message_id).otherwise(own_key),
            "arrived_at": F.current_timestamp(),
        }
    )
    return keyed.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["key"]).drop("key")


def export_stream(messages: DataFrame, options: ExportOptions = ExportOptions()) -> DataFrame:
    return project_fields(messages, options, ("id",))


def export_rolled(
    messages: DataFrame, options: ExportOptions, base: str, checkpoint: str, close: bool = True
) -> ExportSummary:
    """Export what has arrived into size-limited files of one series, oldest batch first, and stop.

    Messages of a batch come newest first, as in a single export. The open file stays in the state under
    ``checkpoint`` and a later run goes on filling it; ``close`` publishes it and ends the series. The
    summary holds the totals of the whole series and the time and rate of this run."""
    began = time.monotonic()
    spark = messages.sparkSession
    names = choose_fields(options.fields or FIELD_SETS["default"])
    state = f"{checkpoint}/rolled"

    def roll(batch: DataFrame, number: int) -> None:
        chosen = batch.where(options.where or PRESETS[options.selection]())
        rows = project_fields(chosen, options, ("id", "internal_date"))
        order = [F.col("internal_date").desc()]
        roll_batch(rows, options.output_dir, base, names, "id", order, options.max_bytes_per_file, state, number)

    query = messages.writeStream.foreachBatch(roll).option("checkpointLocation", f"{checkpoint}/stream")
    query.trigger(availableNow=True).start().awaitTermination()
    if close:
        total = close_rolled(spark, options.output_dir, base, names, state)
    else:
        _, note = rolled_state(spark, state)
        total = {"rows": note["rows"], "bytes": note["bytes"], "files": note["files"]}
    return ExportSummary(total["rows"], total["bytes"], total["files"], time.monotonic() - began)


def run_available(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what has arrived, append it to Parquet files and stop."""
    query = (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def arrived(transform: Callable[[DataFrame], DataFrame], dump: DataFrame) -> DataFrame:
    """Land a dump as files, stream it through ``transform`` and return the result."""
    spark = dump.sparkSession
    landing = work_path(spark, "landing")
    dump.write.json(landing)
    rows = transform(stream_messages(spark, landing))
    return run_available(rows, work_path(spark, "arrived"), work_path(spark, "progress"))
