"""Phrase search in bodies over a trigram index.

Rendering a body is the dear part of a search. The index renders every body once and posts the
hashes of its trigrams with the message. A search looks up the rarest trigrams of its
phrase, renders only messages that hold all of them, and verifies the phrase there, so the result
is that of a full search. Postings lie in folders by hash and are sorted in their files, so that a look-up reads
few row groups; a trigram that nearly all bodies hold is spread over the files of its folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from mailsieve.functions.parts import body_text
from mailsieve.operators.analyses import body_search
from mailsieve.operators.predicates import text_contains
from mailsieve.sources.messages import whole_parts

BUCKETS = 64
RAREST = 4  # trigrams looked up; more would read longer postings to drop few candidates
_SPREAD = 8
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def trigrams(text: str) -> np.ndarray:
    """Distinct hashes of all runs of three characters; different runs may share a hash."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = points[:-2] * _FACTORS[0] + points[1:-1] * _FACTORS[1] + points[2:] * _FACTORS[2]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


@F.arrow_udf(ArrayType(LongType()))
def _trigrams_udf(texts: pa.Array) -> pa.Array:
    found = [trigrams(t) for t in texts.fill_null("").to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*found, np.empty(0, np.int64)])))


def build_index(messages: DataFrame, path: str) -> None:
    """Write ``postings`` (gram, id) and ``counts`` (gram, messages) of all bodies."""
    texts = messages.select("id", F.lower(body_text(whole_parts(messages), whole=True)).alias("text"))
    grams = texts.select("id", F.explode(_trigrams_udf("text")).alias("gram"))
    bucket = F.pmod("gram", F.lit(BUCKETS)).cast("int")
    dealt = grams.withColumn("bucket", bucket).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SPREAD)))
    dealt = dealt.repartition("bucket", "salt").sortWithinPartitions("bucket", "gram").drop("salt")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    postings = messages.sparkSession.read.parquet(f"{path}/postings")
    counts = postings.groupBy("bucket", "gram").agg(F.count("*").alias("messages"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")


def _rarest(spark: SparkSession, path: str, grams: list[int]) -> list[int] | None:
    """The rarest grams of a phrase, at most ``RAREST``; none if one of them occurs nowhere."""
    buckets = sorted({g % BUCKETS for g in grams})
    counts = spark.read.parquet(f"{path}/counts").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    known = counts.orderBy("messages").select("gram").collect()  # at most as many as the phrase has
    return [r["gram"] for r in known[:RAREST]] if len(known) == len(grams) else None


def candidates(spark: SparkSession, path: str, phrase: str) -> DataFrame | None:
    """``id`` of the messages that may hold the phrase; ``None`` if it is too short for the index to tell."""
    grams = trigrams(phrase.lower()).tolist()
    if not grams:
        return None
    rarest = _rarest(spark, path, grams)
    if rarest is None:
        return spark.createDataFrame([], "id string")
    buckets = sorted({g % BUCKETS for g in rarest})
    hits = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(rarest))
    held = hits.groupBy("id").agg(F.count_distinct("gram").alias("n"))
    return held.where(F.col("n") == len(rarest)).select("id")


def indexed_search(messages: DataFrame, path: str, phrase: str) -> DataFrame:
    """``body_search`` of the messages the index was built from, rendering candidates only."""
    found = candidates(messages.sparkSession, path, phrase)
    if found is None:
        return body_search(messages, phrase)
    chosen = messages.join(found, "id", "left_semi")
    rows = chosen.select("id", body_text(whole_parts(messages), whole=True).alias("body_text"))
    return rows.where(text_contains(F.col("body_text"), phrase))
