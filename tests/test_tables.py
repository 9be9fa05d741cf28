"""Reading tables so that all cores work."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from mailsieve.sources.tables import spread


def shares(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_rows_of_few_row_groups_are_spread(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    text = pa.table({"k": range(4000), "v": [f"{i * 7919 % 4001:09d}" * 9 for i in range(4000)]})
    pq.write_table(text, tmp_path / "one.parquet", row_group_size=4000, compression="none", use_dictionary=False)
    pq.write_table(text, tmp_path / "many.parquet", row_group_size=100, compression="none", use_dictionary=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        one, many = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("one", "many"))
        assert one.rdd.getNumPartitions() >= 4 and shares(one) == [4000]  # split by bytes, read by one task
        assert len(shares(spread(one))) >= 4 and max(shares(spread(one))) < 2000
        assert spread(one).agg(F.sum("k")).first()[0] == sum(range(4000))
        assert spread(many) is many
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
