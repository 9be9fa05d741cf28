"""MIME trees and their parts as Catalyst expressions, plus the body-text UDF."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.once import once
from mailsieve.functions.redaction import redact_batch
from mailsieve.functions.redaction_rules import rules_for
from mailsieve.functions.text import body_text_batch
from mailsieve.functions.whitespace import trim_ws

_PAD = 6


def _node(path: Column, tree: Column) -> Column:
    below = F.try_variant_get(tree, "$.parts", "array<variant>")
    return F.struct(
        path.alias("path"),
        tree.alias("v"),
        F.coalesce(below, F.array().cast("array<variant>")).alias("below"),
    )


def _children(node: Column) -> Column:
    count = F.size(node["below"])
    numbers = F.slice(F.sequence(F.lit(0), count), F.lit(1), count)
    rows = F.arrays_zip(
        F.array_repeat(node["path"], count).alias("parent"), numbers.alias("i"), node["below"].alias("v")
    )

    def child(row: Column) -> Column:
        position = F.when(row["i"] < 10**_PAD, F.lpad(row["i"].cast("string"), _PAD, "0")).otherwise(
            F.raise_error(F.lit("too many sibling parts")).cast("string")
        )
        return _node(F.concat(row["parent"], F.lit("."), position), row["v"])

    return F.transform(rows, child)


def flatten_parts(tree: Column, text: Column | None = None) -> Column:
    """The MIME tree (a VARIANT) as an array of parts in depth-first pre-order, however deep.

    Level by level, in as many rounds as the JSON text has opening brackets at most: every level
    of parts opens a list of its own. Rounds below the deepest level change nothing. Zero-padded
    paths then give the order. ``text`` saves writing the tree as JSON to count.

    No lambda below reads a variable of an enclosing one: Spark 4.1 does not recognise such
    expressions when they end up as the input of a Python UDF.
    """
    text = F.to_json(tree) if text is None else text
    lists = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("["), F.lit(""))), F.lit(0))
    top = F.array(F.array(_node(F.lit(""), tree)))

    def add_level(levels: Column, _: Column) -> Column:
        below = F.flatten(F.transform(F.element_at(levels, -1), _children))
        return F.when(F.size(F.element_at(levels, -1)) == 0, levels).otherwise(F.concat(levels, F.array(below)))

    levels = F.reduce(F.sequence(F.lit(0), lists), top, add_level)
    parts = F.transform(
        F.flatten(levels),
        lambda n: F.struct(
            n["path"].alias("path"),
            F.try_variant_get(n["v"], "$.mimeType", "string").alias("mime_type"),
            F.try_variant_get(n["v"], "$.filename", "string").alias("filename"),
            F.try_variant_get(n["v"], "$.body.attachmentId", "string").alias("attachment_id"),
            F.try_variant_get(n["v"], "$.body.size", "bigint").alias("size"),
            F.try_variant_get(n["v"], "$.body.data", "string").alias("data"),
        ),
    )
    return F.array_sort(parts)


def without_data(parts: Column) -> Column:
    """The parts without their bodies."""
    return F.transform(parts, lambda p: p.dropFields("data"))


def raw_bodies(parts: Column) -> Column:
    """The decoded bytes of the parts' bodies, null where a part has none; they pack better than base64."""
    return F.transform(parts["data"], lambda data: F.when(_is_set(data), _raw_body(data)))


def with_bodies(parts: Column, bodies: Column | None = None) -> Column:
    """Parts with a ``body``: the decoded bytes at the same place of ``bodies``, which stand for ``data`` then.

    Without ``bodies`` it is null, and readers decode ``data`` of the parts they want."""
    if bodies is None:
        return F.transform(parts, lambda p: p.withField("body", F.lit(None).cast("binary")))
    none = F.lit(None).cast("string")
    return F.zip_with(parts, bodies, lambda p, body: p.withField("data", none).withField("body", body))


def _is_set(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _filename(part: Column) -> Column:
    return trim_ws(F.coalesce(part["filename"], F.lit("")))


def attachment_summary(parts: Column) -> Column:
    """``struct(has, types, count)``: distinct sorted types, plain count."""

    def is_attachment(p: Column) -> Column:
        has_content = _is_set(p["attachment_id"]) | (F.coalesce(p["size"], F.lit(0)) > 0)
        return (_filename(p) != "") & has_content

    def kind(p: Column) -> Column:
        extension = F.regexp_extract(F.lower(_filename(p)), r"\.([a-z0-9]{1,10})\z", 1)
        other = F.when(_is_set(p["mime_type"]), F.lower(p["mime_type"])).otherwise("unknown")
        return F.coalesce(F.nullif(extension, F.lit("")), other)

    def summary(kinds: Column) -> Column:
        return F.struct(
            (F.size(kinds) > 0).alias("has"),
            F.array_sort(F.array_distinct(kinds)).alias("types"),
            F.size(kinds).alias("count"),
        )

    return once(F.transform(F.filter(parts, is_attachment), kind), summary)


def _raw_body(data: Column) -> Column:
    def tolerant(body: Column) -> Column:
        clean = F.regexp_replace(F.substring_index(body, "=", 1), "[^A-Za-z0-9+/]", "")
        # A single left-over character holds no whole byte.
        left_over = F.when(F.length(clean) % 4 == 1, 1).otherwise(0)
        return F.unbase64(F.left(clean, F.length(clean) - left_over))

    def decode(body: Column) -> Column:
        # Well-formed data decodes directly; only the rest pays for the clean-up.
        return F.coalesce(F.try_to_binary(body, F.lit("base64")), tolerant(body))

    body = F.replace(F.replace(data, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    return once(body, decode)


def decode_body(data: Column) -> Column:
    """Base64url text to a string; stray characters are skipped, bad bytes become U+FFFD."""
    return F.make_valid_utf8(_raw_body(data).cast("string"))


def joined_bodies(parts: Column, mime_type: str, whole: bool = False) -> Column:
    """Decoded bodies of the non-attachment parts of one type, one per line; ``whole`` parts come ``with_bodies``."""

    def is_body(p: Column) -> Column:
        attached = (_filename(p) != "") | _is_set(p["attachment_id"])
        given = _is_set(p["data"]) | p["body"].isNotNull() if whole else _is_set(p["data"])
        return ~attached & given & (F.lower(p["mime_type"]) == mime_type)

    def text(p: Column) -> Column:
        raw = F.coalesce(p["body"], _raw_body(p["data"])) if whole else _raw_body(p["data"])
        return F.make_valid_utf8(raw.cast("string"))

    return F.array_join(F.transform(F.filter(parts, is_body), text), "\n")


def truncate_chars(c: Column, n: int) -> Column:
    """The first ``n`` characters; all of them if ``n`` is not positive."""
    return F.left(c, F.lit(n)) if n > 0 else c


def body_html(parts: Column, max_chars: int = 0, whole: bool = False) -> Column:
    """The raw HTML bodies."""
    return truncate_chars(trim_ws(joined_bodies(parts, "text/html", whole)), max_chars)


def body_text(
    parts: Column,
    max_chars: int = 0,
    categories: Sequence[str] | None = None,
    mode: str = "reference",
    whole: bool = False,
) -> Column:
    """Readable body; truncated, then redacted if categories are given.

    One UDF does all of it, so that a body crosses to Python once, and filters on the
    result stay above it instead of rendering bodies a second time. HTML is handed over
    only where there is no plain text.
    """
    rules = rules_for(categories) if categories else ()

    @F.arrow_udf("string")
    def body_text_udf(bodies: pa.Array) -> pa.Array:
        text = body_text_batch(bodies.field("plain"), bodies.field("html"), mode)
        if max_chars > 0:
            text = pc.utf8_slice_codeunits(text, 0, max_chars)
        return redact_batch(text, rules)[0] if rules else text

    def html_if_needed(plain: Column) -> Column:
        html = F.when(plain == "", joined_bodies(parts, "text/html", whole)).otherwise("")
        return F.struct(plain.alias("plain"), html.alias("html"))

    plain = trim_ws(joined_bodies(parts, "text/plain", whole))
    return body_text_udf.asNondeterministic()(once(plain, html_if_needed))
