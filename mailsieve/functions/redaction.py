"""Redaction as Arrow UDFs: ordered rules, counts per category.

Patterns of a category none of which matches a text leave that text unchanged, so an
alternation of a few consecutive patterns decides which rows enter them one by one.
The result is the same as running every pattern over every row; only the rows that
can change pay for it. Batches are taken in slices, so that what a step copies is small.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.address_rules import ADDRESS_TOKEN, address_patterns
from mailsieve.functions.arrow_text import GATE_WIDTH, any_of, matching_rows, put_rows, run_steps, slices
from mailsieve.functions.redaction_rules import (
    ALL_CATEGORIES,
    CATEGORIES,
    DEFAULT_CATEGORIES,
    Rule,
    rules_for,
)
from mailsieve.functions.whitespace import WS, spell_out

RESULT_TYPE = "struct<text:string,n:int,by_category:map<string,int>>"


def _run_rule(texts: pa.Array, rule: Rule) -> tuple[pa.Array, np.ndarray]:
    counts = np.zeros(len(texts), dtype=np.int32)
    for first in range(0, len(rule.patterns), GATE_WIDTH):
        patterns = rule.patterns[first : first + GATE_WIDTH]
        rows = matching_rows(texts, *any_of(patterns))
        if not len(rows):
            continue
        part = texts.take(rows)
        for pattern in patterns:
            found = pc.count_substring_regex(part, pattern).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(found)
            if len(hit):
                counts[rows[hit]] += found[hit]
                part = put_rows(part, hit, pc.replace_substring_regex(part.take(hit), pattern, rule.token))
        texts = put_rows(texts, rows, part)
    return texts, counts


def redact_batch(texts: pa.Array, rules: Sequence[Rule]) -> tuple[pa.Array, np.ndarray]:
    """Redacted texts and a rows-by-rules matrix of match counts."""
    counts = np.zeros((len(texts), len(rules)), dtype=np.int32)
    done, first = [], 0
    for part in slices(texts):
        for j, rule in enumerate(rules):
            part, counts[first : first + len(part), j] = _run_rule(part, rule)
        done.append(part)
        first += len(part)
    return pa.concat_arrays(done) if done else texts, counts


def _count_maps(texts: pa.Array, counts: np.ndarray, rules: Sequence[Rule]) -> pa.Array:
    """All 27 keys for a text that was examined, an empty map otherwise."""
    by_key = np.zeros((len(texts), len(ALL_CATEGORIES)), dtype=np.int32)
    for j, rule in enumerate(rules):
        by_key[:, ALL_CATEGORIES.index(rule.category)] += counts[:, j]
    examined = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    examined = examined.to_numpy(zero_copy_only=False)
    width = len(ALL_CATEGORIES)
    offsets = np.concatenate([[0], np.cumsum(examined * width)]).astype(np.int32)
    keys = pa.array(list(ALL_CATEGORIES) * int(examined.sum()), pa.string())
    return pa.MapArray.from_arrays(offsets, keys, pa.array(by_key[examined].ravel()))


def _redact_rules(c: Column, rules: Sequence[Rule]) -> Column:
    @F.arrow_udf(RESULT_TYPE)
    def redact_udf(texts: pa.Array) -> pa.Array:
        out, counts = redact_batch(texts, rules)
        total = pa.array(counts.sum(axis=1, dtype=np.int32))
        maps = _count_maps(texts, counts, rules)
        return pa.StructArray.from_arrays([out, total, maps], ["text", "n", "by_category"])

    return redact_udf(c)


def redact(c: Column, categories: Sequence[str] = DEFAULT_CATEGORIES, enabled: bool = True) -> Column:
    """``struct(text, n, by_category)`` of a text column.

    Disabled, null or empty text comes back unchanged with no counts.
    """
    rules = rules_for(categories)
    if not enabled or not rules:
        examined = F.lit(enabled) & (F.length(c) > 0)
        zeros = F.map_from_arrays(*[F.array(*map(F.lit, v)) for v in (ALL_CATEGORIES, [0] * 27)])
        empty = F.create_map().cast("map<string,int>")
        return F.struct(
            c.alias("text"),
            F.lit(0).alias("n"),
            F.when(examined, zeros).otherwise(empty).alias("by_category"),
        )
    return _redact_rules(c, rules)


def redact_text(
    c: Column,
    categories: Sequence[str] = DEFAULT_CATEGORIES,
    enabled: bool = True,
    pinned: bool = False,
) -> Column:
    """Only the redacted text. ``pinned`` keeps filters on the result above the UDF, so
    that it runs once per row."""
    rules = rules_for(categories)
    if not enabled or not rules:
        return c

    @F.arrow_udf("string")
    def redact_text_udf(texts: pa.Array) -> pa.Array:
        return redact_batch(texts, rules)[0]

    return (redact_text_udf.asNondeterministic() if pinned else redact_text_udf)(c)


def redact_addresses(c: Column, patterns: Sequence[str] | None = None) -> Column:
    """Stand-alone address redaction: ``struct(text, n)``, runs of tokens collapsed.

    ``patterns`` narrows it to some of the address rules.
    """
    rule = Rule("physical_addresses", ADDRESS_TOKEN, tuple(map(spell_out, patterns or address_patterns())))
    run = rf"(?:\[REDACTED_ADDRESS\]{WS}*)+"

    @F.arrow_udf("struct<text:string,n:int>")
    def redact_addresses_udf(texts: pa.Array) -> pa.Array:
        out, counts = redact_batch(texts, [rule])
        out = run_steps(out, [(run, ADDRESS_TOKEN + " ")])
        return pa.StructArray.from_arrays([out, pa.array(counts[:, 0])], ["text", "n"])

    return redact_addresses_udf(c)


def redact_columns(
    df: DataFrame, columns: Sequence[str], categories: Sequence[str] = DEFAULT_CATEGORIES
) -> DataFrame:
    """Redact the named free-text columns in place."""
    return df.withColumns({c: redact_text(F.col(c), categories) for c in columns})


def redaction_report(
    df: DataFrame, column: str, categories: Sequence[str] = DEFAULT_CATEGORIES
) -> DataFrame:
    """Matches and affected rows per enabled category over the whole data set.

    Batches are reduced to one row per category where they are read: neither redacted
    texts nor per-row counts leave the tasks.
    """
    rules = rules_for(categories)
    labels = {c.key: c.name for c in CATEGORIES}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = np.zeros(len(rules), dtype=np.int64)
        texts = np.zeros(len(rules), dtype=np.int64)
        for batch in batches:
            counts = redact_batch(batch.column(0), rules)[1]
            matches += counts.sum(axis=0)
            texts += (counts > 0).sum(axis=0)
        keys = [r.category for r in rules]
        rows = {"category": keys, "category_name": [labels[k] for k in keys], "matches": matches, "texts": texts}
        yield pa.RecordBatch.from_pydict(rows)

    schema = "category string, category_name string, matches bigint, texts bigint"
    tallies = df.select(column).mapInArrow(tally, schema)
    return tallies.groupBy("category", "category_name").agg(
        F.sum("matches").alias("matches"), F.sum("texts").alias("texts")
    )
