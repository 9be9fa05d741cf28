"""The export job: select, cap, project, write."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mailsieve.functions.csv_lines import csv_line, csv_line_bytes, header_line
from mailsieve.operators.fields import FIELD_SETS, choose_fields, project_fields
from mailsieve.operators.options import ExportOptions, base_name
from mailsieve.operators.predicates import PRESETS, row_cap
from mailsieve.sources.csv_files import STATS_SCHEMA, write_csv, write_rolled_csv

_ORDER = ("id", "internal_date")


def select_messages(messages: DataFrame, options: ExportOptions = ExportOptions()) -> DataFrame:
    """Messages of the selection, newest first up to the cap."""
    chosen = messages.where(options.where or PRESETS[options.selection]())
    return row_cap(chosen, options.max_messages)


def export_rows(messages: DataFrame, options: ExportOptions = ExportOptions(), keep=()) -> DataFrame:
    return project_fields(select_messages(messages, options), options, keep)


def run_export(messages: DataFrame, options: ExportOptions = ExportOptions()) -> DataFrame:
    """Write the export; returns ``part, file, rows, bytes`` of what was written.

    Rolled files hold the messages newest first. Without a size limit every task writes a
    file of its own; the result is then one row, with the size of a single equivalent file,
    counted while writing.
    """
    names = choose_fields(options.fields or FIELD_SETS["default"])
    base = base_name(options)
    rows = export_rows(messages, options, _ORDER)
    if options.max_bytes_per_file > 0:
        order = (F.col("internal_date").desc(), "id")
        return write_rolled_csv(
            rows, options.output_dir, base, names, "id", order, options.max_bytes_per_file
        )
    path = f"{options.output_dir}/{base}.csv"
    header_bytes = len(header_line(names)) + 1
    seen = Observation()
    line_bytes = F.coalesce(F.sum(csv_line_bytes(csv_line(names))), F.lit(0))
    write_csv(rows.select(*names).observe(seen, F.count("*").alias("rows"), line_bytes.alias("bytes")), path)
    counted = seen.get
    written = (1, f"{base}.csv", counted["rows"], counted["bytes"] + header_bytes)
    return messages.sparkSession.createDataFrame([written], STATS_SCHEMA)


@dataclass(frozen=True)
class ExportSummary:
    """What an export did as a whole."""

    rows: int
    bytes: int
    files: int
    seconds: float

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds > 0 else 0.0


def export_totals(stats: DataFrame) -> DataFrame:
    """One row: ``rows, bytes, files`` over all parts."""
    return stats.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.count("*").alias("files"),
    )


def run_export_timed(
    messages: DataFrame, options: ExportOptions = ExportOptions()
) -> tuple[DataFrame, ExportSummary]:
    """``run_export``, and its totals, elapsed seconds and rate."""
    began = time.monotonic()
    stats = run_export(messages, options)
    total = export_totals(stats).first()
    return stats, ExportSummary(total["rows"], total["bytes"], total["files"], time.monotonic() - began)
