from pyspark.sql import functions as F

from sealcol.queries import Q


def test_a_declared_index_is_judged_by_its_declaration(spark, tmp_path):
    """More users than the gate asks for change nothing: user_id's index is declared for fewer."""
    n = F.col("id")
    spark.range(3000).select(F.concat(F.lit("c"), n).alias("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(6000).select((n % 1500).alias("user_id"), (n % 5).cast("string").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(100).select((n % 5).cast("string").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["col"]: r["verdict"] for r in Q["leak_verdict"](spark, str(tmp_path)).collect()}
    assert got == {"c_name": "OK", "event_type": "REFUSE", "o_orderpriority": "REFUSE", "user_id": "REFUSE"}
