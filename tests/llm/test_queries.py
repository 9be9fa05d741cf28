"""Every query of the operators is registered and covers its whole table; SQL where there is some."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare
from mailsieve.llm.queries import ORACLE, QUERIES

TABLES = {"op4_url_filter": "pages", "op10_embedding_dedup": "embeddings"}


def test_all_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) <= set(names) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name in ORACLE:
        assert compare(spark, sf, name, QUERIES, ORACLE).startswith("ok")
    elif name == "op12_nearest_neighbours":  # its neighbours are held against brute force elsewhere
        rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").count()
        assert QUERIES[name](spark, sf).count() == 20 * rows
    else:
        rows = spark.read.parquet(f"{sf}/{TABLES.get(name, 'documents')}.parquet").count()
        assert QUERIES[name](spark, sf).count() == rows
