"""CSV serialisation as Catalyst expressions, so that line sizes can be computed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.whitespace import collapse_ws


def csv_value(c: Column) -> Column:
    """A value on one line: white space collapsed and trimmed, null as empty."""
    return collapse_ws(F.coalesce(c.cast("string"), F.lit("")))


def csv_escape(c: Column) -> Column:
    """``csv_value``, quoted only if it holds a quote or a comma."""
    v = csv_value(c)
    quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(v.rlike('[",]'), quoted).otherwise(v)


def csv_line(columns: Sequence[str]) -> Column:
    return F.concat_ws(",", *[csv_escape(F.col(f"`{c}`")) for c in columns])


def csv_line_bytes(line: Column) -> Column:
    """Size of the line on disk, newline included."""
    return (F.octet_length(line) + 1).cast("bigint")


def header_line(columns: Sequence[str]) -> str:
    return ",".join(columns)
