import hmac

from pyspark.sql import functions as F

from sealcol.engine import Engine
from sealcol.functions import crypto, envelope
from sealcol.functions.normalize import CASEFOLD, casefold, normalize_col
from sealcol.plans.declare import Column, Table
from sealcol.plans.keys import DerivedKeyProvider
from sealcol.queries import Q

T = Table("t", b"t" * 16, (Column("v", b"v" * 16, "float"),), pk=("id",))


def test_keys_of_whole_batches_equal_those_of_the_expressions(spark):
    row = spark.range(300).select(*[F.unhex(F.sha2(F.concat(F.lit(c), F.col("id")), 256)).alias(c) for c in ("d", "s", "c")])
    row = row.withColumn("k", F.substring("c", 3, 16)).withColumn("none", F.lit(None).cast("binary"))
    key = envelope.record_key(F.col("d"), F.col("k"), F.col("s"), F.col("c"))
    both = envelope.derived_keys(F.col("d"), F.col("k"), F.col("s"), F.col("c"), b"label")
    found = envelope.committed_key(F.array("none", "s", "d", "c"), F.col("k"), F.col("s"), F.col("c"), F.substring(both, 33, 32), b"label")
    lost = envelope.committed_key(F.array("s", "c"), F.col("k"), F.col("s"), F.col("c"), F.substring(both, 33, 32), b"label")
    got = row.select("d", "k", "s", "c", key.alias("key"), F.concat(key, envelope.commitment(key, b"label")).alias("want"), both.alias("both"), found.alias("found"), lost.alias("lost"), envelope.derived_keys(F.col("none"), F.col("k"), F.col("s"), F.col("c"), b"label").alias("null")).collect()
    for r in got:
        assert r["both"] == r["want"] and r["found"] == r["key"] and r["lost"] is None and r["null"] is None
        assert bytes(r["key"]) == crypto.hkdf(bytes(r["d"]), bytes(r["k"] + r["s"]), bytes(r["c"]), 32)
    assert len({bytes(r["key"]) for r in got}) == 300 and hmac.compare_digest(bytes(got[0]["want"]), bytes(got[0]["both"]))


def test_values_of_a_raw_reading_are_those_of_a_plain_one(spark, tmp_path):
    engine = Engine(spark, DerivedKeyProvider(bytes(32)), arm_provisional=True)
    df = spark.range(40).select("id", F.when(F.col("id") % 5 > 0, F.col("id") / 8).alias("v"))
    engine.seal(df, T).write.parquet(f"{tmp_path}/t")
    sealed = spark.read.parquet(f"{tmp_path}/t")
    raw = engine.values(engine.open(sealed, T, ("v",), raw=True), T, "v", "back")
    assert sorted(raw.select("id", "back").collect()) == sorted(engine.open(sealed, T, ("v",)).collect()) == sorted(df.collect())


def test_codec_queries_open_each_value_once(spark, tmp_path):
    spark.range(30).select(F.col("id").alias("o_orderkey"), (F.col("id") * 5000.0).alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    df = Q["codec_boolean"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "\nJoin Inner" not in plan and plan.count("Relation [") == 1
    assert df.filter("same").count() == 30


def test_a_batch_of_a_stream_is_spread_over_the_cores(spark, tmp_path, monkeypatch):
    from sealcol.streaming.seal import seal_stream

    engine = Engine(spark, DerivedKeyProvider(bytes(32)), arm_provisional=True)
    monkeypatch.setattr(engine, "seal", lambda df, table: seen.append(df.rdd.getNumPartitions()) or df)
    seen = []
    spark.range(50).selectExpr("id", "id / 2 AS v").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, v double").parquet(f"{tmp_path}/in")
    seal_stream(engine, stream, T, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert seen and min(seen) >= spark.sparkContext.defaultParallelism and spark.read.parquet(f"{tmp_path}/out/batch=*").count() == 50


def test_folding_holds_few_texts_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from sealcol.functions import normalize

    texts = ["Straße" * 5, None, "", "͸", "É" * 50, "ǰ"] * 40
    want = [None if t is None or casefold(t) is None else casefold(t).encode() for t in texts]
    held = []
    real = pa.array
    monkeypatch.setattr(normalize, "BYTES", 300)
    monkeypatch.setattr(normalize.pa, "array", lambda x, *a: held.append(sum(len(t or b"") for t in x)) or real(x, *a))
    assert normalize._folded(real(texts)).to_pylist() == want and len(held) > 10 and max(held) < 450
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:6])], "i int, t string")
    got = df.select("i", normalize_col(CASEFOLD, F.col("t"), F.encode("t", "UTF-8")).alias("n")).orderBy("i").collect()
    assert [None if r["n"] is None else bytes(r["n"]) for r in got] == want[:6]


def test_keys_are_drawn_with_seeds_of_their_own(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.unhex(F.sha2(F.lit("d"), 256))).alias("d"), F.unhex(F.repeat(F.lit("6b"), F.lit(16))).alias("k"), F.encode(F.col("id").cast("string"), "UTF-8").alias("c"))
    df = df.withColumn("drawn", envelope.drawn_keys(F.col("d"), F.col("k"), F.col("c"), b"label"))
    rows = df.select("*", F.length("drawn").alias("n")).collect()
    assert all((r["drawn"] is None) == (r["d"] is None) for r in rows)
    some = [r for r in rows if r["d"] is not None]
    assert len(some) == 200 == len({bytes(r["drawn"][:32]) for r in some}) == len({bytes(r["drawn"][32:44]) for r in some})
    for r in some:
        key = crypto.hkdf(bytes(r["d"]), bytes(r["k"] + r["drawn"][:32]), bytes(r["c"]), 32)
        assert r["n"] == 108 and bytes(r["drawn"][44:76]) == key and bytes(r["drawn"][76:]) == crypto.hkdf(key, b"", b"label", 32)


def test_values_are_cut_from_slices_and_around_nulls():
    import pyarrow as pa

    values = [b"a", None, b"", b"bcd", None, b"e" * 40]
    for t in (pa.binary(), pa.large_binary()):
        for a in range(7):
            for b in range(a, 7):
                assert envelope._items(pa.array(values, t).slice(a, b - a)) == values[a:b]
    lists = [[b"a", None], None, [], [b"bc"], [None, b"", b"d"]]
    for a in range(6):
        for b in range(a, 6):
            assert envelope._lists(pa.array(lists, pa.list_(pa.binary())).slice(a, b - a)) == lists[a:b]
    assert envelope._items(pa.array([], pa.binary())) == [] == envelope._lists(pa.array([], pa.list_(pa.binary())))


def test_decryption_stands_in_no_lambda_and_entropy_in_no_expression(spark):
    engine = Engine(spark, DerivedKeyProvider(bytes(32)), arm_provisional=True)
    sealed = engine.seal(spark.range(5).selectExpr("id", "id / 2 AS v"), T)
    plan = engine.open(sealed, T, ("v",), raw=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "randomUUID" not in plan
    assert "try_aes_decrypt" not in "".join(part.split(", namedlambda")[0] for part in plan.split("lambdafunction(")[1:])
