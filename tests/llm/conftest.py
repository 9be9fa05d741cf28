import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and clashing columns."""
    long = " ".join(f"word{i % 997} and{i % 13}" for i in range(20_000))
    rows = [
        (1, "the same text of six words", "en", "a", 1),
        (2, "the same text of six words", "en", None, None),
        (2, "the same text of six words", "en", None, None),
        (3, None, None, "b", None),
        (4, "", "fr", "b", 0),
        (5, "   \n\t ", None, "", 6),
        (6, long, "en", "a", len(long)),
        (7, long + " end", "en", "a", None),
        (None, "no id but some words here", "en", "c", 2),
        (8, "123 456 !!", "en", "c", 2),
        (9, "ein Wort: ça  marche très▁bien <|endoftext|> \u0000 x", "fr", "a", 3),
        (10, "The Same text of six words", "en", "b", 4),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    clashing = (
        "kept score ids decoded block phase slot position component_id n_shingles lang_pred tree n_tokens n_before "
        "host path rule verdict probability train record key chunk word start vector class a b"
    ).split()
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in clashing])


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
