"""Pairs of columns that may not both be indexed."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sealcol.errors import ConfigurationError
from sealcol.operators import correlation
from sealcol.plans.declare import Column, Index, Table

INDEX = Index(bits=9, population=1500, suite=0xFF01)


@pytest.fixture(scope="module")
def people(spark):
    city = F.pmod(F.xxhash64("id"), F.lit(200))
    rows = spark.range(40_000).select("id", F.concat(F.lit("c"), city).alias("city"), F.concat(F.lit("z"), city * 7 + F.pmod(F.hash("id"), F.lit(3))).alias("zip"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(300)).cast("string").alias("shoe"))
    return rows.withColumn("city", F.when(F.col("id") % 10 != 0, F.col("city")))


def test_verdicts(people):
    got = {(r["a"], r["b"]): r for pair in (("city", "zip"), ("city", "shoe"), ("zip", "shoe")) for r in correlation.profile(people, *pair).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {("city", "zip"): "CORRELATED", ("city", "shoe"): "INDEPENDENT", ("zip", "shoe"): "INDEPENDENT"}
    assert got["city", "zip"]["n_rows"] == 36_000 and got["city", "shoe"]["shared"] < 0.01 < got["city", "zip"]["shared"]
    assert all(r["counters"] <= 2**correlation.MOST_BITS and r["counters"] <= r["n_rows"] / 8 * 2 for r in got.values())


def test_numbers_equal_plain_counting(people):
    r = correlation.profile(people, "city", "zip", 5).first()
    rows = [(x["a"], x["b"]) for x in people.select(correlation.bucket(F.col("city"), 5).alias("a"), correlation.bucket(F.col("zip"), 5).alias("b")).collect() if x["a"] is not None]
    entropy = lambda c: -sum(n / len(rows) * math.log2(n / len(rows)) for n in c.values())
    ab, a, b = Counter(rows), Counter(x for x, _ in rows), Counter(y for _, y in rows)
    bias = (len(ab) - len(a) - len(b) + 1) / (2 * len(rows) * math.log(2))
    assert (r["entropy_a"], r["entropy_b"], r["entropy_ab"]) == pytest.approx((entropy(a), entropy(b), entropy(ab)))
    assert r["shared_bits"] == pytest.approx(entropy(a) + entropy(b) - entropy(ab) - bias)
    best_b = {x: max(n for (u, _), n in ab.items() if u == x) for x in a}
    assert r["predicts_b"] == pytest.approx((sum(best_b.values()) - max(b.values())) / len(rows))


def test_a_table_with_correlated_indexes_is_refused(people):
    columns = {n: Column(n, n.encode().ljust(16, b"_"), "string", INDEX) for n in ("city", "zip", "shoe")}
    fine = Table("p", b"p" * 16, (columns["city"], columns["shoe"]), pk=("id",))
    assert correlation.check(people, fine) == [("city", "shoe", "INDEPENDENT")]
    bad = Table("p", b"p" * 16, tuple(columns.values()), pk=("id",))
    with pytest.raises(ConfigurationError, match="city and zip are correlated"):
        correlation.check(people, bad)
    assert ("city", "zip", "CORRELATED") in correlation.check(people, bad, allowed=[("zip", "city")])


def test_defined_cases(spark, people):
    empty = correlation.profile(people.limit(0), "city", "zip").first()
    assert (empty["n_rows"], empty["shared"], empty["verdict"]) == (0, 0.0, "INDEPENDENT")
    one = correlation.profile(people.withColumn("zip", F.lit("x")), "city", "zip", 3).first()
    assert (one["shared"], one["verdict"]) == (0.0, "INDEPENDENT")
    with pytest.raises(ConfigurationError):
        correlation.counters(people, "city", "zip", 11)
