"""From raw documents to token digests: five stages, each written as Parquet and read by the next.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame. All but the last return the columns of ``documents``. Every stage works on all rows
its predecessor kept. The second and the third stage keep one row of each group, whatever its id:
ids may be null, repeated, or have several texts. Null, empty and letterless texts have no
language and leave in the first stage; a text of any length is processed whole. Ties: of equal ids with equal texts
any one row stays, of equal smallest ids in a group of similar texts the first row. Columns beyond those of
``documents`` are dropped, whatever their names. An empty table passes through all stages.
"""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsieve.llm import byte_convnet
from mailsieve.llm.common import written
from mailsieve.llm.exact_dedup import exact_dedup
from mailsieve.llm.pfair_mixing import mix
from mailsieve.llm.sentence_pieces import piece_digests
from mailsieve.llm.trie_join import similar_documents
from mailsieve.sources.session import job_folder, work_path
from mailsieve.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW = "_row"
MIN_LANGUAGE_SCORE = 0.3
PIECES = "piece_bpe_32k.model"


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs``, written with a number for every row: ids may be null or occur several times."""
    path = work_path(spark, "numbered")
    rows = docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW))
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters and those no language fits go."""
    sample = byte_convnet.training_windows(docs, "doc_id", "text", "lang")
    found = byte_convnet.identify(docs.select(*COLUMNS), byte_convnet.train(sample))
    fits = (F.col("lang_pred") != byte_convnet.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.where(fits).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one with the largest id (one of them if a row is repeated).

    A row is told by its id and the digest of its text, so no copy of the documents is written."""
    kept = exact_dedup(docs.select("doc_id", "text"), keep="max").where("kept")
    wanted = kept.select(F.col("text_sha256").alias("_sha"), F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(*COLUMNS, F.sha2(F.coalesce("text", F.lit("")), 256).alias("_digest"))
    same = (F.col("_digest") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    return rows.join(wanted, same, "left_semi").dropDuplicates(["_digest", "doc_id"]).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar ones, the one with the smallest id (of several of these, the
    first row); a null id counts as larger than all others."""
    rows = _numbered(spark, docs)
    path = work_path(spark, "first-rows")
    with job_folder(spark):  # what the join wrote on its way goes with it
        found = similar_documents(rows.select(ROW, "text"), id_column=ROW).join(rows.select(ROW, "doc_id"), ROW)
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first")
        found.groupBy("component_id").agg(first).select(f"first.{ROW}").write.parquet(path)
    return rows.join(spark.read.parquet(path), ROW, "left_semi").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture of their sources, which the next stage reads as ``place``."""
    placed = mix(docs.select(*COLUMNS))
    return placed.repartitionByRange("position").sortWithinPartitions("position").select(*COLUMNS)


def _is_table(docs: DataFrame) -> bool:
    """Whether these are the rows of files as they lie there, so that files and rows in them have an order."""
    node = docs._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "SubqueryAlias"):
        node = node.child()
    return node.getClass().getSimpleName() == "LogicalRelation"


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``place``, the number of rows before it in the order in which rows were written.

    Spark reads files in any order, so the place is told by the names of files (numbered by the task
    that wrote them) and the index of the row in its file. The driver sees one count per file."""
    docs = docs if _is_table(docs) else written(docs, "ordered")
    rows = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    counts = {r["_file"]: r["n"] for r in rows.groupBy("_file").agg(F.count("*").alias("n")).collect()}

    def order(path: str) -> tuple[int, str]:
        part = re.match(r"part-(\d+)", path.rsplit("/", 1)[-1])
        return int(part[1]) if part else -1, path

    bases, place = [], 0
    for path in sorted(counts, key=order):
        bases.append((path, place))
        place += counts[path]
    files = docs.sparkSession.createDataFrame(bases, "_file string, _base bigint")
    return rows.join(F.broadcast(files), "_file").select(*docs.columns, (F.col("_base") + F.col("_index")).alias("place"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of each document in the mixture, number of its pieces, and digests of its ids and of what
    they decode to."""
    placed = _placed(docs).select("doc_id", "source", "text", "place")
    return piece_digests(placed, public_tokenizers.path(PIECES)).select(
        "doc_id", "source", "place", "n_tokens", "ids_sha256", "decoded_sha256"
    )


STAGES = [
    ("language", language),
    ("exact_dedup", exact),
    ("jaccard_join", near),
    ("mixing", mixture),
    ("sentence_pieces", pieces),
]

# Language identification and the vocabulary are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
