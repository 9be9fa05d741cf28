"""CSV sinks: one folder of files, or files of limited size."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.functions.csv_lines import csv_line, csv_line_bytes, csv_value, header_line
from mailsieve.operators.rollover import assign_parts
from mailsieve.sources import files
from mailsieve.sources.session import job_folder, work_path

STATS_SCHEMA = "part bigint, file string, rows bigint, bytes bigint"

# Quotes are doubled, empty values stay empty and nothing is trimmed on the way.
_CSV = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(rows: DataFrame, path: str) -> None:
    """Every task writes its own file; each begins with the header."""
    rows.select(*[csv_value(F.col(f"`{c}`")).alias(c) for c in rows.columns]).write.options(**_CSV).csv(path)


def read_csv(spark, path: str, columns: Sequence[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).options(**_CSV).csv(path).fillna("")


def file_name(base: str, part: Column) -> Column:
    """``base[_partNNN].csv``; the first file has no suffix."""
    number = part.cast("string")
    padded = F.when(part < 1000, F.lpad(number, 3, "0")).otherwise(number)
    return F.concat(
        F.lit(base), F.when(part > 1, F.concat(F.lit("_part"), padded)).otherwise(""), F.lit(".csv")
    )


def _numbered(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The lines, computed once and written to the shared folder, with a number each."""
    steering = [c for c in rows.columns if c not in fields]
    path = work_path(rows.sparkSession, "lines")
    rows.select(*steering, csv_line(fields).alias("line"), F.monotonically_increasing_id().alias("_line")).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _placed(
    lines: DataFrame, order: Sequence[str | Column], header_bytes: int, max_bytes: int, block_bytes: int | None
) -> DataFrame:
    """``_line, start, size, part``: only order and size are sorted, the text stays where it is."""
    steering = [c for c in lines.columns if c != "line"]
    sizes = lines.select(*steering, csv_line_bytes(F.col("line")).alias("size"))
    parts = assign_parts(sizes, order, "size", max_bytes, header_bytes, block_bytes)
    path = work_path(lines.sparkSession, "parts")
    parts.select("_line", "start", "size", "part").write.parquet(path)
    return lines.sparkSession.read.parquet(path)


def _stage(lines: DataFrame, parts: DataFrame, staging: str, base: str, header: str, numbers: range) -> list[dict]:
    """Write the parts ``numbers`` as folders ``file=<name>`` with one file of lines each; returns a dict per file.

    The text moves twice: to meet its part number and to its file. Part numbers have no gaps; a part without
    lines is a file with a header."""
    spark = lines.sparkSession
    headers = spark.range(numbers.start, numbers.stop).select(
        F.col("id").alias("part"), F.lit(-1).cast("bigint").alias("start"), F.lit(header).alias("value")
    )
    # Files are dealt out evenly, a task at most one more than another.
    writers = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    writers = max(1, min(len(numbers), writers))
    body = lines.join(parts, "_line").select("part", "start", F.col("line").alias("value"))
    (
        body.unionByName(headers)
        .repartitionById(writers, F.pmod(F.col("part") - 1, F.lit(writers)).cast("int"))
        .withColumn("file", file_name(base, F.col("part")))
        .sortWithinPartitions("file", "start")
        .select("file", "value")
        .write.mode("overwrite")
        .partitionBy("file")
        .text(staging)
    )
    per_part = parts.groupBy("part").agg(F.count("*").alias("rows"), F.sum("size").alias("line_bytes"))
    each = headers.select("part", file_name(base, F.col("part")).alias("file")).join(per_part, "part", "left")
    own = len(header.encode()) + 1
    found = each.select(
        "part", "file", F.coalesce("rows", F.lit(0)).alias("rows"), (F.coalesce("line_bytes", F.lit(0)) + own).alias("bytes")
    )
    return sorted((r.asDict() for r in found.collect()), key=lambda r: r["part"])  # a row per file, as for its rename


def _publish(spark: SparkSession, staging: str, path: str, written: list[dict], replace: bool = False) -> None:
    """Move each staged file to its name under ``path``; those moved before are left alone."""

    def publish(name: str) -> None:
        target, folder = f"{path}/{name}", f"{staging}/file={name}"
        staged = [n for n in files.names(spark, folder) if n.startswith("part-")]
        if staged:
            if replace:
                files.remove(spark, target)
            files.move(spark, f"{folder}/{staged[0]}", target)
        elif not files.exists(spark, target):
            raise FileNotFoundError(target)

    files.side_by_side(publish, [f["file"] for f in written])
    files.remove(spark, staging)


def _stats(spark: SparkSession, written: list[dict]) -> DataFrame:
    rows = [(f["part"], f["file"], f["rows"], f["bytes"]) for f in written]
    return spark.createDataFrame(rows, STATS_SCHEMA)


def write_rolled_csv(
    rows: DataFrame,
    path: str,
    base: str,
    fields: Sequence[str],
    key: str,
    order: Sequence[str | Column],
    max_bytes: int,
    block_bytes: int | None = None,
) -> DataFrame:
    """Write ``base.csv``, ``base_part002.csv`` … of at most ``max_bytes`` and return ``part, file, rows, bytes``.

    ``fields`` are the exported columns; the others (``key``, which breaks ties, and what
    ``order`` reads) steer the split. Every row is one line, also where keys repeat: lines are
    numbered when they are written to the shared folder and joined by that number.

    All files are staged in a hidden folder, noted there, and renamed. A file of one of these names that is there
    before is an error. If a run fails between renames, the next run with the same ``path`` and ``base`` finds the
    note, makes the renames that are left and returns what was written. Nothing else stays behind.
    """
    if max_bytes <= 0:
        raise ValueError("an unlimited export goes through write_csv")
    spark = rows.sparkSession
    staging = f"{path}/_export-{base}"
    note = f"{staging}/_files.json"
    if not files.exists(spark, note):
        own_name = re.compile(re.escape(base) + r"(_part\d{3,})?\.csv")
        taken = [n for n in files.names(spark, path) if own_name.fullmatch(n)]
        if taken:
            raise FileExistsError(f"{path}/{taken[0]}")
        with job_folder(spark):
            lines = _numbered(rows, fields)
            header = header_line(fields)
            parts = _placed(lines, [*order, key, "_line"], len(header.encode()) + 1, max_bytes, block_bytes)
            count = parts.agg(F.coalesce(F.max("part"), F.lit(1))).first()[0]
            written = _stage(lines, parts, staging, base, header, range(1, count + 1))
        files.write_note(spark, note, json.dumps(written))
    written = json.loads(files.read_note(spark, note))
    _publish(spark, staging, path, written)
    return _stats(spark, written)


def _tail_path(state: str, batch: int) -> str:
    return f"{state}/{batch:012d}"


def rolled_state(spark: SparkSession, state: str, before: int | None = None) -> tuple[str | None, dict]:
    """The newest complete state, of a batch before ``before`` if that is given."""
    numbers = [int(n) for n in files.names(spark, state) if n.isdigit()]
    for number in sorted((n for n in numbers if before is None or n < before), reverse=True):
        folder = _tail_path(state, number)
        if files.exists(spark, f"{folder}/open.json"):
            return folder, json.loads(files.read_note(spark, f"{folder}/open.json"))
    return None, {"part": 1, "rows": 0, "bytes": 0, "files": 0}


def roll_batch(
    rows: DataFrame,
    path: str,
    base: str,
    fields: Sequence[str],
    key: str,
    order: Sequence[str | Column],
    max_bytes: int,
    state: str,
    batch: int,
) -> None:
    """Append a batch to rolled files, which come out as if one run had written all batches one after the other.

    The file still open after a batch is held back: its lines (at most one file of them) and its number are the
    state of the batch, which the next one puts in front of its own lines. Full files are published. A batch
    that runs again starts from the state before it and replaces the files it had published. Lines of
    equal ``order`` and ``key`` come in the order of a hash, so that it makes the same files."""
    spark = rows.sparkSession
    header = header_line(fields)
    own = len(header.encode()) + 1
    folder, before = rolled_state(spark, state, batch)
    after = _tail_path(state, batch)
    files.remove(spark, after)
    with job_folder(spark):
        new = _numbered(rows, fields).withColumns({"_held": F.lit(1), "_place": F.lit(0).cast("bigint")})
        new = new.withColumn("_hash", F.xxhash64("line"))
        lines = new
        if folder:
            tail = spark.read.parquet(f"{folder}/tail").withColumns({"_held": F.lit(0), "_line": -1 - F.col("_place")})
            lines = new.unionByName(tail, allowMissingColumns=True)
        by = ["_held", "_place", *order, key, "_hash", "_line"]
        parts = _placed(lines, by, own, max_bytes, None)
        ends = parts.agg(F.max("part"), F.min("part")).first()
        if ends[0] is None:  # nothing yet
            shift, last = 0, 1
        else:  # the first line opens a second file if it fits no first one: the held file has its number already
            shift = before["part"] - ends[1] if folder and before["open"] else 0
            last = ends[0] + shift
        parts = parts.withColumn("part", F.col("part") + shift)
        staging = f"{path}/_export-{base}-{batch}"
        written = []
        if last > before["part"]:
            full = parts.where(F.col("part") < last)
            written = _stage(lines, full, staging, base, header, range(before["part"], last))
            _publish(spark, staging, path, written, replace=True)
        held = lines.join(parts.where(F.col("part") == last), "_line")
        held.select(F.col("start").alias("_place"), "line").write.parquet(f"{after}/tail")
        open_rows, open_bytes = parts.where(F.col("part") == last).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    note = {
        "part": last,
        "open": open_rows,
        "open_bytes": open_bytes,
        "rows": before["rows"] + sum(f["rows"] for f in written),
        "bytes": before["bytes"] + sum(f["bytes"] for f in written),
        "files": before["files"] + len(written),
    }
    files.write_note(spark, f"{after}/open.json", json.dumps(note))
    # The batch before is needed if this one runs again; what lies further back is not.
    for number in (int(n) for n in files.names(spark, state) if n.isdigit()):
        if folder and _tail_path(state, number) < folder:
            files.remove(spark, _tail_path(state, number))


def close_rolled(spark: SparkSession, path: str, base: str, fields: Sequence[str], state: str) -> dict:
    """Publish the file that is still open; returns ``rows, bytes, files`` of all batches."""
    header = header_line(fields)
    folder, note = rolled_state(spark, state)
    with job_folder(spark):
        if folder:
            tail = spark.read.parquet(f"{folder}/tail")
        else:
            tail = spark.createDataFrame([], "_place bigint, line string")
        lines = tail.withColumn("_line", F.col("_place"))
        parts = lines.select(
            "_line", F.col("_place").alias("start"), csv_line_bytes(F.col("line")).alias("size"),
            F.lit(note["part"]).cast("bigint").alias("part"),
        )
        staging = f"{path}/_export-{base}-open"
        written = _stage(lines, parts, staging, base, header, range(note["part"], note["part"] + 1))
        _publish(spark, staging, path, written, replace=True)
    last = written[0]
    return {"rows": note["rows"] + last["rows"], "bytes": note["bytes"] + last["bytes"], "files": note["files"] + 1}
