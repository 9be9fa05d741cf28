"""Registered queries of the operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from mailsieve.llm import byte_convnet, url_filter
from mailsieve.llm.context_mixing import score_documents
from mailsieve.llm.edit_counts import apply_edits, count_tokens
from mailsieve.llm.exact_dedup import exact_dedup
from mailsieve.llm.huffman_ids import read_token_files, write_token_files
from mailsieve.llm.importance_resampling import resample
from mailsieve.llm.permutation_index import nearest
from mailsieve.llm.pfair_mixing import mix
from mailsieve.llm.projection_dedup import near_vectors
from mailsieve.llm.query_blocks import finite
from mailsieve.llm.sentence_pieces import encode_pieces
from mailsieve.llm.slot_negatives import hard_negatives
from mailsieve.llm.trie_join import similar_documents
from mailsieve.sources.session import work_path
from mailsieve.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return keep


def _remainder(n: int):
    """CRC-32 of the id's decimal text modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three quarters of the labelled ones."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    sample = byte_convnet.training_windows(docs.where(_remainder(4) != 2), "doc_id", "text", "lang")
    found = byte_convnet.identify(docs.select("doc_id", "text"), byte_convnet.train(sample))
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query("op2_mixing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its place in a mixture of tempered source weights."""
    return mix(table(spark, folder, "documents").select("doc_id", "source"))


@query(
    "op8_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"), keep="max")


URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


@query("op4_url_filter")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    weights = url_filter.train(url_filter.labelled_urls())
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages, weights, URL_RULES).drop("url")


@query("op6_sentence_pieces")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Number of pieces, and digests of the ids and of the text they decode to."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_edit_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document before and after three edits: its language put in front,
    twelve characters replaced after a third, its source put in after two thirds."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    size = F.coalesce(F.length("text"), F.lit(0))

    def edit(at, cut, put):
        return F.struct(at.cast("int").alias("at"), F.lit(cut).alias("cut"), put.alias("put"))

    edits = F.array(
        edit(F.floor(size * 2 / 3), 0, F.concat(F.lit(" "), F.coalesce("source", F.lit("")), F.lit("'s "))),
        edit(F.floor(size / 3), 12, F.lit(" an edit ")),
        edit(F.lit(0), 0, F.concat(F.coalesce("lang", F.lit("")), F.lit(": "))),
    )
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counted = count_tokens(docs.select("doc_id", "text", edits.alias("edits")), ranks, public_tokenizers.PATTERN)
    return apply_edits(counted, ranks, public_tokenizers.PATTERN).select(
        "doc_id", "n_before", F.col("n_tokens").alias("n_after"), "n_segments", "n_reencoded",
        F.sha2("text", 256).alias("text_sha256"),
    )


@query("op9_token_files")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written as token files and read back."""
    path = work_path(spark, "token-files")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@query("op10_embedding_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


@query(
    "op5_jaccard_join",
    r"""
    WITH RECURSIVE w AS MATERIALIZED (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    g AS MATERIALIZED (
      SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS gs FROM w),
    s AS MATERIALIZED (SELECT doc_id, len(gs) AS n, unnest(gs) AS s FROM g),
    l AS MATERIALIZED (
      SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    r(doc_id, other) AS (
      SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
    SELECT g.doc_id, len(gs)::BIGINT AS n_shingles, min(r.other) AS component_id
    FROM g JOIN r ON g.doc_id = r.doc_id GROUP BY ALL
    """,
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return similar_documents(table(spark, folder, "documents"))


@query("op3_lm_score")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents, learned from nine tenths of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_documents(docs, _remainder(10) != 0)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), *scored.columns[2:])


@query(
    "op11_importance_resampling",
    r"""
    WITH steps(i, r, k) AS MATERIALIZED (
      WITH RECURSIVE s(i, r, k) AS (
        SELECT range, range, 0 FROM range(256)
        UNION ALL
        SELECT i, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM s WHERE k < 8)
      SELECT * FROM s WHERE k = 8),
    crc AS MATERIALIZED (SELECT list(r ORDER BY i) AS t FROM steps),
    texts AS MATERIALIZED (
      SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark)),
    f AS MATERIALIZED (SELECT kind, id, unnest(ws) AS word FROM texts),
    hashed AS MATERIALIZED (
      SELECT word, xor(list_reduce(list_transform(range(0, length(hex(encode(word))), 2),
               lambda p: ('0x' || substr(hex(encode(word)), p + 1, 2))::BIGINT),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
      FROM (SELECT DISTINCT word FROM f), crc),
    counts AS (
      SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 't') AS t
      FROM f JOIN hashed USING (word) GROUP BY bucket),
    gains AS MATERIALIZED (
      SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE
        / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
    w AS (
      SELECT id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
      FROM f JOIN hashed USING (word) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
    scored AS MATERIALIZED (
      SELECT d.id AS doc_id, coalesce(w.n_features, 0)::BIGINT AS n_features, coalesce(w.weight, 0)::BIGINT AS weight,
        coalesce(w.weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.id), 1, 8))::BIGINT + 0.5::DOUBLE)
          / 4294967296::DOUBLE)))::BIGINT AS score, len(ws) >= 20 AS able
      FROM texts d LEFT JOIN w ON d.id = w.id WHERE kind = 'd'),
    places AS (
      SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place,
        count(*) FILTER (able) OVER () AS n FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * n // 100 THEN place END AS rank FROM places
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the documents, drawn towards the words of the benchmark."""
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_nearest_neighbours")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query(
    "op13_hard_negatives",
    """
    WITH v AS MATERIALIZED (
      SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS MATERIALIZED (
      SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.vector, b.vector)::BIGINT AS score
      FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id,
      row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
      id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, after a seventh of the labels moved on by one."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    rows = table(spark, folder, "embeddings").select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.when(finite(F.col("embedding")), whole).alias("vector"),
    )
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)
