"""Counted reads, and the store with a budget of uses for each key."""

import warnings

import pytest
from pyspark.sql import functions as F

from sealcol.engine import Engine
from sealcol.errors import ConfigurationError, SealError
from sealcol.plans.declare import Column, Table
from sealcol.plans.keys import DerivedKeyProvider
from sealcol.sources.store import SealedStore

ROOT = bytes(range(32))
TABLE = Table("t", b"t" * 16, (Column("v", b"v" * 16, "string"), Column("f", b"f" * 16, "float")), pk=("id",))


@pytest.fixture(scope="module")
def plain(spark):
    return spark.range(60).select("id", F.when(F.col("id") % 5 != 0, F.concat(F.lit("v"), F.col("id"))).alias("v"), (F.col("id") / 4).alias("f"))


@pytest.fixture(scope="module")
def mixed(spark, plain, tmp_path_factory):
    """Sealed under two keys, some rows plain."""
    at = str(tmp_path_factory.mktemp("mixed"))
    for k, versions in enumerate(((1,), (1, 2))):
        engine = Engine(spark, DerivedKeyProvider(ROOT, versions), arm_provisional=True)
        engine.seal(plain.filter(F.col("id") % 3 == k), TABLE).write.parquet(f"{at}/{k}")
    rest = plain.filter("id % 3 = 2").select("id", F.encode("v", "UTF-8").alias("v"), F.encode(F.col("f").cast("string"), "UTF-8").alias("f"))
    rest.withColumn("f", F.lit(None).cast("binary")).write.parquet(f"{at}/2")
    return spark.read.parquet(*[f"{at}/{k}" for k in range(3)])


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def test_reads_are_counted_by_column_outcome_and_key(spark, plain, mixed):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        engine = Engine(spark, DerivedKeyProvider(ROOT, (1, 2)), mode="permissive")
    df, counts = engine.counted(mixed, TABLE, ("v", "f"))
    noop(df.repartition(3).filter("id >= 0"))
    of = [i for i in range(60) if i % 5]
    want = {"v": {"OK": sum(i % 3 < 2 for i in of), "PLAIN": sum(i % 3 == 2 for i in of), "null": 12}, "f": {"OK": 40, "null": 20}}
    assert counts.values() == want == counts.values()
    assert engine.metrics.plaintext_reads == want["v"]["PLAIN"] and engine.metrics.decrypt_errors == {}
    first, second = (engine.provider.key_id(b"", n) for n in (1, 2))
    assert counts.by_key() == {"v": {first: sum(i % 3 == 0 for i in of), second: sum(i % 3 == 1 for i in of)}, "f": {first: 20, second: 20}}
    assert {r["id"]: (r["v"], r["f"]) for r in engine.counted(mixed, TABLE, ("v", "f"))[0].filter("id % 3 < 2").collect()} == {r["id"]: (r["v"], r["f"]) for r in plain.filter("id % 3 < 2").collect()}


def test_errors_are_counted_where_they_are_values(spark, mixed):
    engine = Engine(spark, DerivedKeyProvider(ROOT, (1,)))
    df, counts = engine.counted(mixed, TABLE, ("v",), raw=True)
    noop(df)
    of = [i for i in range(60) if i % 5]
    assert counts.values() == {"v": {"OK": sum(i % 3 == 0 for i in of), "KEY_UNAVAILABLE": sum(i % 3 == 1 for i in of), "NOT_CIPHERTEXT": sum(i % 3 == 2 for i in of), "null": 12}}
    assert engine.metrics.decrypt_errors == {"KEY_UNAVAILABLE": sum(i % 3 == 1 for i in of), "NOT_CIPHERTEXT": sum(i % 3 == 2 for i in of)}
    assert sorted(tuple(r) for r in counts.rows().collect()) == sorted(("v", k, n) for k, n in counts.values()["v"].items())


def test_empty_tables_are_counted(spark, mixed):
    df, counts = Engine(spark, DerivedKeyProvider(ROOT)).counted(mixed.limit(0), TABLE, ("v",))
    noop(df)
    assert counts.values() == {"v": {}}


def test_store_refuses_what_exceeds_a_budget(spark, plain, tmp_path):
    engine = Engine(spark, DerivedKeyProvider(ROOT), arm_provisional=True)
    store = SealedStore(engine, TABLE, str(tmp_path / "s"), max_uses=150)
    with pytest.raises(ConfigurationError):
        store.read()
    assert store.append(plain) == 0  # 48 texts and 60 numbers
    assert [r["n"] for r in store.uses().collect()] == [108]
    with pytest.raises(SealError, match="KEY_UNAVAILABLE"):
        store.append(plain)
    assert store.append(plain.filter("id < 20").withColumn("id", F.col("id") + 100)) == 1  # 36 more
    assert [r["n"] for r in store.uses().collect()] == [144] and store.read().df.count() == 80
    # a new key has a budget of its own; another store object sees the same log
    newer = SealedStore(Engine(spark, DerivedKeyProvider(ROOT, (1, 2)), arm_provisional=True), TABLE, str(tmp_path / "s"), max_uses=150)
    assert newer.append(plain.withColumn("id", F.col("id") + 200)) == 2
    assert sorted(r["n"] for r in newer.uses().collect()) == [108, 144]
    assert newer.read().decrypted("v").filter("v = 'v7'").count() == 3
    with pytest.raises(ConfigurationError):
        SealedStore(engine, TABLE, str(tmp_path / "s"), max_uses=0)


def test_store_keeps_tenants_apart(spark, tmp_path):
    table = Table("t", b"t" * 16, (Column("v", b"v" * 16, "string"),), pk=("id",), tenant="org")
    rows = spark.range(30).select("id", F.concat(F.lit("o"), F.col("id") % 3).alias("org"), F.lit("x").alias("v"))
    store = SealedStore(Engine(spark, DerivedKeyProvider(ROOT), arm_provisional=True), table, str(tmp_path / "s"), max_uses=10)
    store.append(rows)
    assert sorted(r["n"] for r in store.uses().collect()) == [10, 10, 10]
    with pytest.raises(SealError):
        store.append(rows.filter("org = 'o1'").limit(1))
    store.append(rows.withColumn("org", F.concat(F.lit("p"), F.col("org"))))
    assert store.read().df.count() == 60
