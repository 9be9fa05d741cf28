"""Reading message dumps, and landing them in columns, in batch or incrementally.

A dump holds one message per row. ``payload`` is the MIME tree as JSON; headers and the
flat part list are derived from it, per row and without a shuffle. Landed messages are parsed once:
headers, part metadata and (decoded) bodies are columns of their own there, so that a query on headers or
attachments reads no body, and days are folders, so that a range of dates reads only its days. Where mail
is too scarce to fill a file a day, a folder holds a span of days: folders grow with messages, not with days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.functions.parts import flatten_parts, raw_bodies, with_bodies, without_data
from mailsieve.sources import files

# Columns of a dump.
DUMP_SCHEMA = (
    "id string, internal_date timestamp, thread_id string, label_ids array<string>, "
    "snippet string, payload string"
)
# Columns of landed messages; the last two are folders, and so is the day or month that follows them.
# A folder's day is the first of ``span`` days.
LANDED_SCHEMA = (
    "id string, internal_date timestamp, thread_id string, label_ids array<string>, snippet string, "
    "headers array<struct<name:string,value:string>>, "
    "parts array<struct<path:string,mime_type:string,filename:string,attachment_id:string,size:bigint>>, "
    "bodies array<binary>, batch bigint, span int"
)
PERIODS = ("day", "month")
# Folders of a batch that are few whatever they hold, and messages that make a folder of their own worth it.
_FEW_FOLDERS = 64
_FOLDER_MESSAGES = 10_000
QUARANTINE_SCHEMA = "id string, reason string, payload string, batch bigint"


def _has_id() -> Column:
    return F.coalesce(F.col("id"), F.lit("")) != ""


def _parsed(dump: DataFrame) -> DataFrame:
    """``headers``, ``parts`` and the ``reason`` why a row cannot be landed, from one parse."""
    tree = dump.withColumn("tree", F.try_parse_json("payload"))
    unreadable = F.col("payload").isNotNull() & F.col("tree").isNull()
    return tree.withColumns(
        {
            "headers": F.try_variant_get("tree", "$.headers", "array<struct<name:string,value:string>>"),
            "parts": flatten_parts(F.col("tree"), F.col("payload")),
            "reason": F.when(~_has_id(), "no id").when(unreadable, "bad payload"),
        }
    ).drop("tree")


def with_parts(dump: DataFrame) -> DataFrame:
    """Add ``headers`` and ``parts``; rows without an id are skipped.

    A payload that is not JSON (or too long or too deeply nested for it) ends no job: headers and
    parts of such a row are null, its other columns stay, and ``quarantine`` lists it.
    """
    return _parsed(dump).where(_has_id()).drop("reason")


def quarantine(dump: DataFrame) -> DataFrame:
    """``id, reason``: rows that have no id or a payload that cannot be read."""
    return _parsed(dump).select("id", "reason").where("reason IS NOT NULL")


def utc_day(at: Column) -> Column:
    """The day in UTC, whatever the time zone of the session that writes or reads."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(at) / 86400).cast("int"))


def period_of(at: Column, period: str) -> Column:
    """The UTC day, or the first day of its month."""
    return F.trunc(utc_day(at), "month") if period == "month" else utc_day(at)


def day_span(dump: DataFrame) -> int:
    """Days of a folder, a power of two: few folders, or folders of many messages on average."""
    day = F.unix_date(utc_day(F.col("internal_date")))
    seen = dump.agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("internal_date").alias("rows")).first()
    days = seen["last"] - seen["first"] + 1 if seen["rows"] else 1
    most = max(_FEW_FOLDERS, seen["rows"] // _FOLDER_MESSAGES)
    return 1 << max(0, -(-days // most) - 1).bit_length()


def span_start(day: Column, span: int) -> Column:
    """The first day of the span that holds a day."""
    return F.date_sub(day, F.pmod(F.unix_date(day), F.lit(span))) if span > 1 else day


def land_messages(dump: DataFrame, path: str, batch: int = 0, period: str = "day") -> None:
    """Land one batch: readable messages under ``messages``, by day, the others under ``quarantine``.

    Dates are read ahead for the span of a folder: a file for each day of scarce mail would make the files, not the
    messages, the work. Batches may differ in it. Mail can also be landed by ``period="month"``; all batches of a
    path need the same period.

    Payloads are parsed once, for one write into a staging folder; then both tables get their part of it by
    a rename. Until then nothing of the batch is seen, and landing the same batch again
    replaces it. Rows meet by day before they are written (adaptive execution splits large
    days and joins small ones), so that days hold few files."""
    spark = dump.sparkSession
    staging = f"{path}/_staging/batch={batch}"
    span = day_span(dump) if period == "day" else 1
    rows = _parsed(dump).select(
        "id",
        "internal_date",
        "thread_id",
        "label_ids",
        "snippet",
        "headers",
        without_data(F.col("parts")).alias("parts"),
        raw_bodies(F.col("parts")).alias("bodies"),
        "reason",
        F.when(F.col("reason").isNotNull(), F.col("payload")).alias("payload"),
        F.col("reason").isNotNull().alias("aside"),
        F.lit(span).alias("span"),
        span_start(period_of(F.col("internal_date"), period), span).alias(period),
    )
    written = rows.hint("rebalance", "aside", period).write.mode("overwrite").option("compression", "zstd")
    written.partitionBy("aside", "span", period).parquet(staging)
    for aside, name in (("true", "quarantine"), ("false", "messages")):
        files.remove(spark, f"{path}/{name}/batch={batch}")
        if files.exists(spark, f"{staging}/aside={aside}"):
            files.move(spark, f"{staging}/aside={aside}", f"{path}/{name}/batch={batch}")
    files.remove(spark, staging)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed messages; ``parts`` holds no bodies, which stand in ``bodies`` at the same places."""
    at = f"{path}/messages"
    spans = (f"{at}/{batch}/{span}" for batch in files.names(spark, at) for span in files.names(spark, f"{at}/{batch}"))
    folders = (n.split("=")[0] for span in spans for n in files.names(spark, span))
    period = next((f for f in folders if f in PERIODS), PERIODS[0])
    return _read(spark, f"{path}/messages", f"{LANDED_SCHEMA}, {period} date")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Rows that could not be landed, with their payload."""
    return _read(spark, f"{path}/quarantine", QUARANTINE_SCHEMA)


def whole_parts(messages: DataFrame) -> Column:
    """Parts ``with_bodies``, of landed messages or of a dump; landed bodies are decoded already."""
    return with_bodies(F.col("parts"), F.col("bodies") if "bodies" in messages.columns else None)


def ingest(
    spark: SparkSession,
    source: str,
    path: str,
    checkpoint: str,
    fmt: str = "json",
    files_per_batch: int = 1000,
    period: str = "day",
) -> None:
    """Land the files of a dump folder that have arrived since the last run, and stop.

    A batch that Spark runs again after a failure has the same number and the same files, so it
    replaces what it left and every message is landed once."""
    reader = spark.readStream.schema(DUMP_SCHEMA).format(fmt).option("maxFilesPerTrigger", files_per_batch)
    stream = reader.load(source).writeStream.foreachBatch(lambda rows, number: land_messages(rows, path, number, period))
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_messages(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return with_parts(spark.read.schema(DUMP_SCHEMA).format(fmt).load(path))


def stream_messages(
    spark: SparkSession, path: str, fmt: str = "json", files_per_batch: int = 1000
) -> DataFrame:
    """The same rows as new files arrive."""
    reader = spark.readStream.schema(DUMP_SCHEMA).format(fmt)
    return with_parts(reader.option("maxFilesPerTrigger", files_per_batch).load(path))
