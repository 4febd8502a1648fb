"""Whether two columns may both have a blind index: how much the values of one tell about those of the other.

Two indexes over correlated columns undo each other's collisions: who sees both sees which rows of a bucket are surplus. The
columns' values are put into buckets by a hash, as an index would, and rows are counted by pair of buckets. There are at most 2 **
(bits of both) counters, whatever the table holds, added up on the map side; no pair of values ever leaves a task.

Of these counters: the entropies of both columns and of the pair, the bits that they share (less the bias that a sample of
independent columns shows, (pairs - as - bs + 1) / (2 n ln 2)), the share of the smaller entropy that this is, and how often the
likeliest bucket of one column given the other's is right, against how often the likeliest is without it. Rows with a null on either side are
left out; an empty table gives zeros and INDEPENDENT.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..plans.declare import Table

#: The most bits of both columns' buckets together, and how many rows a counter has on average at least.
MOST_BITS, ROWS_A_COUNTER = 20, 8
#: A pair is refused if it shares so much of the smaller entropy, or predicts so many more rows.
SHARED, PREDICTED = 0.05, 0.05


def bucket(c: Column, bits: int) -> Column:
    """A value's bucket, by the leading 60 bits of the SHA-256 of its text."""
    head = F.conv(F.substring(F.sha2(c.cast("string").cast("binary"), 256), 1, 15), 16, 10).cast("long")
    return head % F.lit(2**bits)


def bits_of(n_rows: int, most: int = MOST_BITS) -> int:
    """Bits for each of two columns, such that counters are bounded and full."""
    return max(1, min(most, int(math.log2(max(4, n_rows / ROWS_A_COUNTER)))) // 2)


def counters(df: DataFrame, a: str, b: str, bits: int) -> DataFrame:
    """x, y (buckets) and n (rows) of each pair of buckets."""
    if not 1 <= 2 * bits <= MOST_BITS:
        raise ConfigurationError(f"two columns have 2 to {MOST_BITS} bits together")
    rows = df.select(bucket(F.col(f"`{a}`"), bits).alias("x"), bucket(F.col(f"`{b}`"), bits).alias("y")).filter("x is not null and y is not null")
    return rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, a: str, b: str, bits: int | None = None) -> DataFrame:
    """One row on a pair of columns: n_rows, counters, entropies, shared_bits, shared, predicts_a, predicts_b, verdict."""
    if bits is None:
        bits = bits_of(df.count())
    pairs = counters(df, a, b, bits)
    plogp = lambda c: F.coalesce(F.sum(F.col(c) * F.log2(c)), F.lit(0.0))
    whole = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("k"), plogp("n").alias("s"))
    side = {}
    for own, other in (("x", "y"), ("y", "x")):
        each = pairs.groupBy(own).agg(F.sum("n").alias("n"), F.max("n").alias("top"))
        # ``top`` of a bucket: rows of the other column's likeliest bucket there
        side[own] = each.agg(F.count(F.lit(1)).alias(f"k_{own}"), plogp("n").alias(f"s_{own}"), F.coalesce(F.sum("top"), F.lit(0)).alias(f"right_{other}"), F.coalesce(F.max("n"), F.lit(0)).alias(f"base_{own}"))
    one = whole.join(side["x"]).join(side["y"])
    n = F.col("n_rows").cast("double")
    entropy = lambda s: F.when(n > 0, F.round(F.log2(n) - F.col(s) / n, 12)).otherwise(0.0)
    one = one.select("*", entropy("s_x").alias("entropy_a"), entropy("s_y").alias("entropy_b"), entropy("s").alias("entropy_ab"))
    bias = F.when(n > 0, (F.col("k") - F.col("k_x") - F.col("k_y") + 1) / (2 * n * F.lit(math.log(2)))).otherwise(0.0)
    one = one.withColumn("shared_bits", F.greatest(F.lit(0.0), F.col("entropy_a") + F.col("entropy_b") - F.col("entropy_ab") - bias))
    least = F.least("entropy_a", "entropy_b")
    one = one.withColumn("shared", F.when(least > 0, F.col("shared_bits") / least).otherwise(0.0))
    for c, own in (("a", "x"), ("b", "y")):
        one = one.withColumn(f"predicts_{c}", F.when(n > 0, (F.col(f"right_{own}") - F.col(f"base_{own}")) / n).otherwise(0.0))
    bad = (F.col("shared") >= SHARED) | (F.greatest("predicts_a", "predicts_b") >= PREDICTED)
    names = ("entropy_a", "entropy_b", "entropy_ab", "shared_bits", "shared", "predicts_a", "predicts_b")
    return one.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n_rows", F.col("k").alias("counters"), *names, F.when(bad, "CORRELATED").otherwise("INDEPENDENT").alias("verdict"))


def check(df: DataFrame, table: Table, allowed: Sequence[tuple[str, str]] = ()) -> list[tuple[str, str, str]]:
    """(column, column, verdict) of each pair of indexed columns of a plain table; a correlated pair that is not allowed by name is refused."""
    names, out = [c.source or c.name for c in table.columns if c.index], []
    bits = bits_of(df.count()) if len(names) > 1 else 1
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            verdict = profile(df, a, b, bits).first()["verdict"]
            if verdict == "CORRELATED" and (a, b) not in allowed and (b, a) not in allowed:
                raise ConfigurationError(f"{a} and {b} are correlated; two indexes over them undo each other's collisions")
            out.append((a, b, verdict))
    return out
