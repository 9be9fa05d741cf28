"""Resampling towards a target text: hashed-feature weights, and a cutoff found by counting.

Features are all runs of one to ``longest`` consecutive words, hashed into ``buckets``. A bucket's gain is the
logarithm of its smoothed share in the target over its share in the documents; the gains are one
array, and a document's weight is the floored mean of the gains its features point at. With
Gumbel noise from a hash of the id the highest scores are a draw without replacement.

No sort over all rows picks them: scores are persisted once, and the cutoff is found by bisection
on numbers, exact counts over the persisted rows narrowing the interval until one score is left, then
the same among the rows tied at it by doc_id, and among repeated ids by row number. A count job
halves ``_HALVINGS`` times at once, and the driver sees its few counts. Only the rows above the cutoff are
sorted, dealt by range; the sizes of the partitions before one give its first rank.

Defined cases: a null text has no words; a document without features has weight 0; a null id is hashed as
an empty one and stands behind all others in ties; rows that repeat an id are drawn one by one, in
the order of their rows; other columns are ignored; an empty table gives an empty result, and with an
empty target all features count as unseen in it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HALVINGS = 8


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def feature_buckets(found: Column, longest: int, buckets: int) -> Column:
    """The bucket of every run of words, repeats included."""

    def bucket(run: Column) -> Column:
        return (F.crc32(run.cast("binary")) % buckets).cast("int")

    out = F.transform(found, bucket)
    for n in range(2, longest + 1):
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(F.array().cast("array<int>"))
        out = F.concat(out, F.transform(starts, lambda at: bucket(F.array_join(F.slice(found, at, n), " "))))
    return out


def bucket_counts(featured: DataFrame) -> dict[int, int]:
    """Features by bucket; at most one row per bucket reaches the driver."""
    found = featured.select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return {r["bucket"]: r["n"] for r in found.collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """By bucket, a thousand times the logarithm of the shares' ratio, floored."""
    s, t = sum(source.values()), sum(target.values())
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (s + buckets) / ((source.get(b, 0) + 1.0) * (t + buckets))))
        for b in range(buckets)
    ]


def _noise(document: Column, seed: int) -> Column:
    """Standard Gumbel noise in thousandths, from the first 32 bits of a hash."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(document.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((bits + 0.5) / F.lit(4294967296.0))))


def _number(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(21,0)")


def _cutoff(rows: DataFrame, key: Column, wanted: int) -> tuple[int, int]:
    """The largest ``c`` so that at least ``wanted`` rows have ``key >= c``, and how many have ``key > c``.

    ``wanted`` is at least 1 and at most the number of rows. Counts of up to 2^_HALVINGS parts a job."""
    keys = rows.select(key.cast("decimal(21,0)").alias("key"))
    low, high = (int(x) for x in keys.agg(F.min("key"), F.max("key")).first())
    above = 0  # rows beyond ``high``
    while low < high:
        width = -(-(high - low + 1) // 2**_HALVINGS)
        part = F.expr(f"(key - CAST('{low}' AS DECIMAL(21,0))) DIV CAST('{width}' AS DECIMAL(21,0))")
        inside = keys.where(F.col("key").between(_number(low), _number(high)))
        counts = dict(inside.groupBy(part.alias("part")).count().collect())
        for at in sorted(counts, reverse=True):
            if above + counts[at] >= wanted:
                low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                break
            above += counts[at]
    return low, above


def _drawn(scored: DataFrame, wanted: int) -> Column:
    """Which rows of ``scored`` are among the first ``wanted``: by ``score`` downwards, then by ``doc_id`` upwards
    (null last), then by ``row`` upwards. Each key is bisected among the rows tied at those before it."""
    if not wanted:
        return F.lit(False)
    keys = [
        F.col("score"),
        F.col("doc_id").isNotNull().cast("int"),
        -F.coalesce(F.col("doc_id"), F.lit(0)).cast("decimal(21,0)"),
        -F.col("row"),
    ]
    tied, above = F.col("able"), F.lit(False)
    for key in keys:
        cut, before = _cutoff(scored.where(tied), key, wanted)
        wanted -= before
        exact = F.lit(cut) if abs(cut) < 2**62 else _number(cut)
        above, tied = above | (tied & (key > exact)), tied & (key == exact)
    return above | tied


def _ranked(drawn: DataFrame) -> DataFrame:
    """``rank`` by range partitions: rows before one's partition, then its place there."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    placed = drawn.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("place", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("place", 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())  # one row per partition
    before, firsts = 0, {}
    for number, size in sizes:
        firsts[number] = before
        before += size
    if not firsts:
        return placed.withColumn("rank", F.lit(None).cast("bigint"))
    starts = F.lit(np.array([firsts.get(i, 0) for i in range(max(firsts) + 1)]))
    rank = F.get(starts, part.cast("int")) + F.col("place").bitwiseAND(F.lit(2**33 - 1)) + 1
    return placed.withColumn("rank", rank)


def resample(
    documents: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    longest: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` is null for those not drawn.

    Of the documents with ``least_words`` words ``percent`` in a hundred are drawn, rounded down."""

    def featured(rows: DataFrame, *columns: Column) -> DataFrame:
        found = rows.select(*columns, words(F.col(f"`{text_column}`")).alias("words"))
        return found.select("*", feature_buckets(F.col("words"), longest, buckets).alias("features"))

    docs = featured(documents, F.col(f"`{id_column}`").cast("bigint").alias("doc_id"))
    docs = written(docs.select("doc_id", (F.size("words") >= least_words).alias("able"), "features"), "features")
    table = F.lit(np.array(gains(bucket_counts(docs), bucket_counts(featured(target)), buckets)))
    n = F.size("features").cast("bigint")
    total = F.aggregate("features", F.lit(0).cast("bigint"), lambda s, b: s + F.get(table, b))
    scored = docs.select(
        "doc_id",
        "able",
        F.monotonically_increasing_id().alias("row"),
        n.alias("n_features"),
        F.when(n > 0, F.floor(total / n)).otherwise(0).cast("bigint").alias("weight"),
    )
    scored = written(scored.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)), "scores")
    drawn = _drawn(scored, percent * scored.where("able").count() // 100)
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    others = scored.where(~drawn).withColumn("rank", F.lit(None).cast("bigint"))
    return _ranked(scored.where(drawn)).select(*out).unionByName(others.select(*out))
