"""Exact duplicates: group by a 128-bit content hash, compare bytes inside groups, keep one id.

Only DataFrame functions. The first aggregation groups by hash *and* text, so the engine
compares the bytes of texts that share a hash, and copies collapse before the shuffle: a text
that a third of all rows repeat leaves every task as one row. The second one counts the
different texts of each hash. Rows then fetch their group by hash alone, without their text;
the few hashes with several texts (collisions) are resolved by hash and text.

Defined cases: a null text is the empty text; a null id never wins against another id; rows
that repeat an id and its text share its verdict; an empty table gives an empty result.
Columns of the input other than the two named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.llm.common import written

HASH_BITS = 128


def exact_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "min",
    hash_bits: int = HASH_BITS,
    row_column: str | None = None,
) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``.

    ``keep`` says which id of equal texts stays, the smallest or the largest. ``hash_bits``
    (a multiple of 4) is the length of the content hash, the start of the SHA-256 digest.
    ``row_column`` is handed on, so that rows that repeat an id and its text can be told apart.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep!r}")
    best = F.min if keep == "min" else F.max
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    own = [F.col(f"`{row_column}`").alias("_row")] if row_column else []
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), text.alias("_text"), *own)
    keyed = rows.withColumn("_sha", F.sha2("_text", 256)).withColumn(
        "_hash", F.substring("_sha", 1, hash_bits // 4)
    )
    by_text = keyed.groupBy("_hash", "_text").agg(best("_id").alias("_keep"), F.count("*").alias("_size"))
    groups = written(
        by_text.groupBy("_hash").agg(
            F.count("*").alias("_texts"), F.max("_keep").alias("_keep"), F.max("_size").alias("_size")
        ),
        "hash-groups",
    )
    out = [
        F.col("_id").alias(id_column),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *[F.col("_row").alias(row_column) for _ in own],
    ]
    # A much-repeated hash makes this join uneven; adaptive execution splits its rows.
    clear = keyed.drop("_text").join(groups.where("_texts = 1"), "_hash").select(*out)
    collided = groups.where("_texts > 1").select("_hash")
    if collided.isEmpty():
        return clear
    clashing = keyed.join(collided, "_hash", "left_semi")
    texts = clashing.groupBy("_hash", "_text").agg(best("_id").alias("_keep"), F.count("*").alias("_size"))
    return clear.unionByName(clashing.join(texts, ["_hash", "_text"]).select(*out))
