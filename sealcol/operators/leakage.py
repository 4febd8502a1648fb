"""What a blind index on a column would give away: measured on the plaintext, before the choice is permanent.

The bounds are heuristics, not proofs; index leakage adds up with query logs. Reports hold counts and ranks, never values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import hmac_padded, lit_bytes, pads, truncate_col
from ..plans.declare import CARDINALITY_GATE

#: A column is skewed when its first value has more than this share of rows, or its first ten more than that.
TOP1, TOP10 = 0.01, 0.10


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value; nulls are not values."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k largest counts by rank, with their share of rows so far."""
    f = frequencies(df, column)
    best = f.orderBy(F.desc("n")).limit(k)
    ranked = best.agg(F.sort_array(F.collect_list("n"), asc=False).alias("ns")).select(F.posexplode("ns").alias("i", "n"), "ns")
    so_far = F.aggregate(F.slice("ns", F.lit(1), F.col("i") + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    total = f.agg(F.sum("n").alias("total"))
    return ranked.select((F.col("i") + 1).alias("rank"), "n", so_far.alias("so_far")).join(F.broadcast(total)).select("rank", "n", (F.col("so_far") / F.col("total")).alias("mass"))


def profile(df: DataFrame, column: str, population: int | None = None) -> DataFrame:
    """One row: n_rows, n_distinct, population, top1 and top10 shares, entropy and its uniform bound in bits, skewed."""
    f = frequencies(df, column)
    sums = f.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.max("n"), F.lit(0)).alias("m1"), F.coalesce(F.sum(F.col("n") * F.log2(F.col("n").cast("double"))), F.lit(0.0)).alias("nlogn"))
    ten = f.orderBy(F.desc("n")).limit(10).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("m10"))
    row = sums.join(F.broadcast(ten))
    n = F.col("n_rows").cast("double")
    share = lambda m: F.when(F.col("n_rows") > 0, F.col(m) / n).otherwise(0.0)
    entropy = F.when(F.col("n_rows") > 0, F.log2(n) - F.col("nlogn") / n).otherwise(0.0)
    uniform = F.when(F.col("n_distinct") > 0, F.log2(F.col("n_distinct").cast("double"))).otherwise(0.0)
    out = row.select("n_rows", "n_distinct", (F.lit(population).cast("long") if population else F.col("n_distinct")).alias("population"), share("m1").alias("top1"), share("m10").alias("top10"), entropy.alias("entropy"), uniform.alias("entropy_uniform"))
    return out.withColumn("skewed", (F.col("top1") > TOP1) | (F.col("top10") > TOP10))


def collisions(df: DataFrame, column: str, bits: int, key: bytes = b"throwaway key of a simulation!!!") -> DataFrame:
    """One row: buckets in use, values and rows a bucket on average and at most, under a throwaway key; and the predicted number."""
    ipad, opad = (lit_bytes(p) for p in pads(key))
    f = frequencies(df, column)
    b = f.withColumn("b", truncate_col(hmac_padded(ipad, opad, F.encode(F.col("v").cast("string"), "UTF-8")), bits)).groupBy("b").agg(F.count(F.lit(1)).alias("vals"), F.sum("n").alias("rows"), F.max("n").alias("most"))
    out = b.agg(F.count(F.lit(1)).alias("buckets"), F.sum("vals").alias("n_values"), F.avg("vals").alias("values_avg"), F.max("vals").alias("values_max"), (F.sum(F.col("rows") * F.col("vals")) / F.sum("rows")).alias("over_fetch"), F.avg(F.col("most") / F.col("rows")).alias("identifying"))
    return out.withColumn("predicted", F.col("n_values") / F.lit(float(2**bits)))


def verdict(df: DataFrame, column: str, bits: int, population: int | None = None) -> DataFrame:
    """One row: verdict REFUSE (few or skewed values), CAUTION (outside the band, or near skew), OK."""
    p = profile(df, column, population)
    expected = F.col("population") / F.lit(float(2**bits))
    band = (expected >= 2) & (expected < F.sqrt(F.col("population").cast("double")))
    near = (F.col("top1") > TOP1 / 2) | (F.col("top10") > TOP10 / 2)
    v = F.when((F.col("population") < CARDINALITY_GATE) | F.col("skewed"), "REFUSE").when(~band | near, "CAUTION").otherwise("OK")
    return p.select("n_distinct", "population", F.lit(bits).alias("bits"), "skewed", v.alias("verdict"))
