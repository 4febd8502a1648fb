"""Registered queries over the engine's operators, with plaintext SQL that gives the same rows.

A query seals what it needs, writes it to the shared folder (sealing draws fresh entropy, so it is done once), and asks the
sealed table. Keys are of this module, for demonstration.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import Engine
from .errors import ConfigurationError, NotSupported, SealError
from .functions import codec
from .functions.normalize import CASEFOLD, DIGITS, IDENTITY, casefold, normalize_col
from .operators import backfill, census, correlation, leakage, prefix, record
from .operators.frame import SealedFrame
from .plans.declare import Column, Index, Override, Slow, Table, bits_for
from .plans.keys import DerivedKeyProvider
from .plans.predicates import Plain, ref
from .plans.suites import AES_GCM
from .sources import tables
from .sources.store import SealedStore

ROOT = bytes(range(32))
SUITE = AES_GCM.id
DEMO = Override("demonstration data", "sealcol.queries", "2026-01-01")


def _id(name: str) -> bytes:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"urn:sealcol:{name}").bytes


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _engine(spark: SparkSession, provider=None, **options) -> Engine:
    return Engine(spark, provider or DerivedKeyProvider(ROOT), arm_provisional=True, **options)


def _shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ConfigurationError("spark.checkpoint.dir names the folder that driver and executors share; it is not set")
        base = "file://" + os.path.join(tempfile.gettempdir(), "sealcol-shared")
    return f"{base.rstrip('/')}/sealed-{uuid.uuid4().hex}"


def _stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder, and read again."""
    path = _shared(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _index(population: int, normalize: str = IDENTITY, **more) -> Index:
    """An index for a column of so many values; the override is on record for columns below the gate."""
    p = max(16, population)
    return Index(bits=bits_for(p), population=p, suite=SUITE, form=normalize, few=DEMO, **more)


def _with_nulls(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(key) % 7 != 0, F.col(column)))


def _customers(spark: SparkSession, sf: str, engine: Engine | None = None, **table) -> SealedFrame:
    """customer with sealed c_name (indexed, null for every seventh) and c_acctbal."""
    engine = engine or _engine(spark)
    df = _with_nulls(_read(spark, sf, "customer"), "c_name", "c_custkey")
    name = Column("c_name", _id("customer.c_name"), "string", _index(df.count()))
    balance = Column("c_acctbal", _id("customer.c_acctbal"), "float")
    t = Table("customer", _id("customer"), (name, balance), pk=("c_custkey",), **table)
    return SealedFrame(engine, _stored(engine.seal(df, t)), t)


#: Values of events.user_id that its index is declared for.
USERS = 256


def _events(spark: SparkSession, sf: str) -> SealedFrame:
    """events with sealed user_id (indexed) and value."""
    engine = _engine(spark)
    df = _read(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    t = Table("events", _id("events"), (Column("user_id", _id("events.user_id"), "int", _index(USERS)), Column("value", _id("events.value"), "float")), pk=("event_id",))
    return SealedFrame(engine, _stored(engine.seal(df, t)), t)


NAMES = ("Customer#000000005", "Customer#000000012", "Customer#000000037", "Customer#000000107")


def _some(spark: SparkSession, sf: str, n: int = 3) -> list[str]:
    """Names to look up: those of a few keys."""
    return [r["c_name"] for r in _read(spark, sf, "customer").filter(F.col("c_custkey").isin(5, 12, 37, 107)).orderBy("c_custkey").limit(n).select("c_name").collect()]


N3 = "(SELECT c_name FROM customer WHERE c_custkey IN (5, 12, 37, 107) ORDER BY c_custkey LIMIT 3)"
N1 = "(SELECT c_name FROM customer WHERE c_custkey IN (5, 12, 37, 107) ORDER BY c_custkey LIMIT 1)"
C = "(SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer)"
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


@query(f"SELECT c_custkey, c_name, sum(o_totalprice) AS total FROM {C} JOIN orders ON c_custkey = o_custkey WHERE c_name = {N1} GROUP BY ALL")
def eq_verified(spark, sf):
    """Equality through the index, verified; then a join on the plain key."""
    hit = _customers(spark, sf).filter(ref("c_name").eq(_some(spark, sf)[0]))
    orders = _read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return hit.decrypted("c_name").join(orders, "c_custkey").groupBy("c_custkey", "c_name").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"SELECT c_custkey, c_name, c_acctbal FROM {C} WHERE c_name IN {N3}")
def in_verified(spark, sf):
    return _customers(spark, sf).filter(ref("c_name").isin(*_some(spark, sf), None)).decrypted().select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_custkey, c_name FROM customer WHERE false")
def in_empty(spark, sf):
    return _customers(spark, sf).filter(ref("c_name").isin()).decrypted("c_name").select("c_custkey", "c_name")


@query(f"SELECT c_custkey FROM {C} WHERE c_name IS NULL")
def is_null_exact(spark, sf):
    return _customers(spark, sf).filter(ref("c_name").eq(None)).df.select("c_custkey")


@query(f"SELECT c_custkey FROM {C} WHERE c_name IS NOT NULL")
def is_not_null_exact(spark, sf):
    return _customers(spark, sf).filter(~ref("c_name").is_null()).df.select("c_custkey")


@query(f"SELECT c_custkey, c_name FROM {C} WHERE c_name IN {N3} AND c_custkey < 20")
def and_terms(spark, sf):
    return _customers(spark, sf).filter(ref("c_name").isin(*_some(spark, sf)) & Plain(F.col("c_custkey") < 20)).decrypted("c_name").select("c_custkey", "c_name")


@query()
def candidates_superset(spark, sf):
    """Unverified rows by index value."""
    return _customers(spark, sf).candidates(ref("c_name").isin(*_some(spark, sf))).rows().select("c_custkey")


@query(f"SELECT count(*) AS n_answers, true AS contained FROM {C} WHERE c_name IN {N3}")
def candidates_contain_answers(spark, sf):
    """Every verified row is among the candidates, which are no fewer."""
    f, asked = _customers(spark, sf), ref("c_name").isin(*_some(spark, sf))
    rows = f.candidates(asked).rows().select("c_custkey").withColumn("candidate", F.lit(True))
    both = f.filter(asked).df.select("c_custkey").join(rows, "c_custkey", "left")
    return both.agg(F.count(F.lit(1)).alias("n_answers"), F.coalesce(F.bool_and(F.coalesce("candidate", F.lit(False))), F.lit(True)).alias("contained"))


@query(f"SELECT count(*) AS n FROM {C} WHERE c_name IN {N3}")
def count_verified(spark, sf):
    return _one(spark, n=_customers(spark, sf).filter(ref("c_name").isin(*_some(spark, sf))).count())


@query(f"SELECT EXISTS (SELECT 1 FROM {C} WHERE c_name = {N1}) AS found, EXISTS (SELECT 1 FROM {C} WHERE c_name = 'nobody') AS missing")
def exists_verified(spark, sf):
    f = _customers(spark, sf)
    return _one(spark, found=f.filter(ref("c_name").eq(_some(spark, sf)[0])).exists(), missing=f.filter(ref("c_name").eq("nobody")).exists())


@query(f"SELECT c_custkey, c_name FROM {C} WHERE c_name IN {N3} ORDER BY c_custkey LIMIT 1")
def first_verified(spark, sf):
    r = _customers(spark, sf).filter(ref("c_name").isin(*_some(spark, sf))).first("c_custkey")
    return _one(spark, c_custkey=r["c_custkey"], c_name=r["c_name"])


@query(f"SELECT c_custkey, c_name, c_acctbal FROM {C} WHERE c_name = {N1}")
def get_one(spark, sf):
    r = _customers(spark, sf).filter(ref("c_name").eq(_some(spark, sf)[0])).get()
    return _one(spark, c_custkey=r["c_custkey"], c_name=r["c_name"], c_acctbal=r["c_acctbal"])


@query(f"SELECT count(c_name) AS n FROM {C}")
def count_nonnull_sealed(spark, sf):
    return _one(spark, n=_customers(spark, sf).count_nonnull("c_name"))


@query(f"SELECT c_nationkey, count(c_name) AS n FROM {C} GROUP BY 1")
def group_plain_count_sealed(spark, sf):
    return _customers(spark, sf).group_count(["c_nationkey"], "c_name")


@query(f"SELECT c_custkey, c_name, c_acctbal FROM {C}")
def project_decrypted(spark, sf):
    return _customers(spark, sf).decrypted().select("c_custkey", "c_name", "c_acctbal")


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM {C} ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def order_after_decrypt(spark, sf):
    top = _customers(spark, sf).decrypted("c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).agg(F.array_sort(F.collect_list(F.struct((-F.col("c_acctbal")).alias("a"), "c_custkey"))).alias("t"))
    return top.select(F.posexplode("t").alias("i", "x")).select(F.col("x.c_custkey").alias("c_custkey"), (F.col("i") + 1).cast("long").alias("rank"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def group_after_decrypt(spark, sf):
    return _events(spark, sf).decrypted("user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT user_id FROM events")
def distinct_after_decrypt(spark, sf):
    return _events(spark, sf).decrypted("user_id").select("user_id").distinct()


@query(f"SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, count(DISTINCT c_acctbal) AS n FROM {C}")
def minmax_after_decrypt(spark, sf):
    return _customers(spark, sf).decrypted("c_acctbal").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.countDistinct("c_acctbal").alias("n"))


@query(f"SELECT c_custkey, c_acctbal FROM {C} WHERE c_acctbal BETWEEN 100 AND 2000")
def range_after_decrypt(spark, sf):
    return _customers(spark, sf).decrypted("c_acctbal").filter(F.col("c_acctbal").between(100, 2000)).select("c_custkey", "c_acctbal")


@query(f"SELECT c_custkey, c_name FROM {C} WHERE c_name LIKE '%3_'")
def like_after_decrypt(spark, sf):
    return _customers(spark, sf).decrypted("c_name").filter(F.col("c_name").like("%3_")).select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_name FROM {C} WHERE c_name IN {N3} ORDER BY c_custkey LIMIT 2")
def limit_after_verify(spark, sf):
    return _customers(spark, sf).filter(ref("c_name").isin(*_some(spark, sf))).limit(2, "c_custkey").decrypted("c_name").select("c_custkey", "c_name")


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM {C} WHERE c_name IN {N3})")
def semi_join_verified(spark, sf):
    return _customers(spark, sf).filter(ref("c_name").isin(*_some(spark, sf))).semi_join(_read(spark, sf, "orders"), "o_custkey").select("o_orderkey", "o_custkey")


@query(f"SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {C} WHERE c_name IN {N3})")
def anti_join_verified(spark, sf):
    return _customers(spark, sf).filter(ref("c_name").isin(*_some(spark, sf))).anti_join(_read(spark, sf, "orders"), "o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT c_nationkey, count(c_name) AS n, round(sum(o_totalprice), 2) AS total FROM {C} JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_on_plain_key(spark, sf):
    orders = _read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return _customers(spark, sf).join(orders, "c_custkey").groupBy("c_nationkey").agg(F.count("c_name").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT n_name, count(*) AS n FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def join_decrypted(spark, sf):
    """Both sides' join keys are sealed; they meet on opened values."""
    engine = _engine(spark)
    nt = Table("nation", _id("nation"), (Column("n_nationkey", _id("nation.key"), "int"),), pk=("n_name",))
    st = Table("supplier", _id("supplier"), (Column("s_nationkey", _id("supplier.nation"), "int"),), pk=("s_suppkey",))
    n = SealedFrame(engine, _stored(engine.seal(_read(spark, sf, "nation"), nt)), nt)
    s = SealedFrame(engine, _stored(engine.seal(_read(spark, sf, "supplier"), st)), st)
    return n.join_decrypted("n_nationkey", s, "s_nationkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_orderkey, n FROM orders LEFT JOIN (SELECT c_custkey, count(*) AS n FROM {C} WHERE c_name IS NOT NULL GROUP BY 1) ON c_custkey = o_custkey")
def nested_include_verified(spark, sf):
    """Verified children in an array under each parent row."""
    child = _customers(spark, sf).filter(ref("c_name").is_not_null())
    parent = SealedFrame(child.engine, _read(spark, sf, "orders").select("o_orderkey", "o_custkey"), Table("orders", _id("orders"), (), pk=("o_custkey",)))
    return parent.include(child, "c_custkey", "children").select("o_orderkey", F.when(F.col("children").isNotNull(), F.size("children").cast("long")).alias("n"))


@query(f"SELECT c_custkey, c_name FROM {C} WHERE c_name IN {N3} OR c_name = {N1}")
def union_verified(spark, sf):
    names = _some(spark, sf)
    return _customers(spark, sf).filter_any(ref("c_name").isin(*names), ref("c_name").eq(names[0])).decrypted("c_name").select("c_custkey", "c_name")


@query(f"SELECT c_custkey FROM {C} WHERE c_name IN {N3} AND c_name = {N1}")
def intersect_verified(spark, sf):
    names = _some(spark, sf)
    f = _customers(spark, sf)
    return f.filter(ref("c_name").isin(*names)).intersect(f.filter(ref("c_name").eq(names[0]))).df.select("c_custkey")


@query(f"SELECT c_custkey FROM {C} WHERE c_name IN {N3} AND c_name <> {N1}")
def except_verified(spark, sf):
    names = _some(spark, sf)
    f = _customers(spark, sf)
    return f.filter(ref("c_name").isin(*names)).difference(f.filter(ref("c_name").eq(names[0]))).df.select("c_custkey")


@query(f"SELECT c_custkey, c_name FROM {C} WHERE c_name IS NULL OR c_name NOT IN {N3}")
def not_in_after_decrypt(spark, sf):
    """What NOT IN stands for: all rows without the verified ones."""
    f = _customers(spark, sf)
    return SealedFrame(f.engine, f.delete(f.filter(ref("c_name").isin(*_some(spark, sf)))), f.table).decrypted("c_name").select("c_custkey", "c_name")


@query()
def bucket_group(spark, sf):
    return _customers(spark, sf).bucket_groups("c_name")


@query(f"SELECT count(*) AS n_rows, true AS bounded FROM {C}")
def bucket_group_bounds(spark, sf):
    """Buckets hold all rows, and are no more than the index has bits for, besides that of null."""
    f = _customers(spark, sf)
    bits = f.table.column("c_name").index.bits
    return f.bucket_groups("c_name").agg(F.sum("bucket_rows").alias("n_rows"), (F.count("bucket_c_name") <= F.lit(2**bits)).alias("bounded"))


@query(f"SELECT c_mktsegment, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS n FROM {C} GROUP BY 1")
def conditional_count_after_decrypt(spark, sf):
    return _customers(spark, sf).decrypted("c_acctbal").groupBy("c_mktsegment").agg(F.sum(F.when(F.col("c_acctbal") > 0, 1).otherwise(0)).alias("n"))


@query(f"SELECT c_custkey, CASE WHEN c_name = {N1} THEN 'renamed' ELSE c_name END AS c_name FROM {C}")
def update_verified(spark, sf):
    f = _customers(spark, sf)
    out = f.update(f.filter(ref("c_name").eq(_some(spark, sf)[0])), c_name=F.lit("renamed"))
    return SealedFrame(f.engine, _stored(out), f.table).decrypted("c_name").select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_name FROM {C} WHERE c_custkey >= 10 UNION ALL SELECT c_custkey, 'upserted' FROM customer WHERE c_custkey < 10")
def upsert_sealed(spark, sf):
    f = _customers(spark, sf)
    rows = _read(spark, sf, "customer").filter("c_custkey < 10").withColumn("c_name", F.lit("upserted"))
    return SealedFrame(f.engine, _stored(f.upsert(rows)), f.table).decrypted("c_name").select("c_custkey", "c_name")


@query(f"SELECT c_custkey FROM {C} WHERE c_name IS NULL OR c_name <> {N1}")
def delete_verified(spark, sf):
    f = _customers(spark, sf)
    return f.delete(f.filter(ref("c_name").eq(_some(spark, sf)[0]))).select("c_custkey")


def _codec(table: str, key: str, source, logical: str, sql: str, opens_as: str | None = None, name: str = ""):
    """A type's canonical bytes as text, through an envelope and back."""

    def run(spark, sf):
        engine = _engine(spark)
        df = _read(spark, sf, table)
        df = df.select(key, source().alias("v"))
        t = Table(f"codec-{logical}", _id(f"codec.{logical}"), (Column("v", _id(f"codec.{logical}.v"), logical, opens_as=opens_as),), pk=(key,))
        kind = df.schema["v"].dataType
        sealed = _stored(engine.seal(df, t))
        opened = engine.values(engine.open(sealed, t, ("v",), raw=True), t, "v", "back")
        text = F.col("v.plaintext").cast("string") if logical != "bytes" else F.sha2("v.plaintext", 256)
        opened = opened.select(key, text.alias("canonical"), F.col("back").cast(kind).alias("back"))
        again = codec.render(F.col("back"), kind)
        return opened.select(key, "canonical", (again.cast("string") == F.col("canonical") if logical != "bytes" else F.sha2("back", 256) == F.col("canonical")).alias("same"))

    run.__name__ = f"codec_{name or logical}"
    query(sql)(run)


_codec("part", "p_partkey", lambda: F.col("p_name"), "string", "SELECT p_partkey, p_name AS canonical, true AS same FROM part")
_codec("pages", "page_id", lambda: F.encode("html", "UTF-8"), "bytes", "SELECT page_id, sha256(html) AS canonical, true AS same FROM pages")
_codec("events", "event_id", lambda: F.col("user_id") - 70, "int", "SELECT event_id, CAST(user_id - 70 AS VARCHAR) AS canonical, true AS same FROM events")
_codec("orders", "o_orderkey", lambda: F.col("o_totalprice").cast("decimal(18,4)"), "decimal", "SELECT o_orderkey, regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR), '\\.?0+$', '') AS canonical, true AS same FROM orders")
_codec("customer", "c_custkey", lambda: F.col("c_acctbal"), "float", "SELECT c_custkey, regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '') AS canonical, true AS same FROM customer")
_codec("orders", "o_orderkey", lambda: F.col("o_totalprice") > 50000, "boolean", "SELECT o_orderkey, CASE WHEN o_totalprice > 50000 THEN 'true' ELSE 'false' END AS canonical, true AS same FROM orders")
_codec("orders", "o_orderkey", lambda: F.col("o_orderdate").cast("date"), "date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS canonical, true AS same FROM orders")
_codec("events", "event_id", lambda: F.to_utc_timestamp(F.col("ts").cast("string").cast("timestamp"), "UTC"), "datetime", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS canonical, true AS same FROM events")

DIGITS22 = "1234567890123456789012"
_codec("orders", "o_orderkey", lambda: F.concat((F.col("o_orderkey") % 10).cast("string"), F.lit(f".{DIGITS22}"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")).cast("decimal(38,25)"), "decimal", f"SELECT o_orderkey, regexp_replace(concat(o_orderkey % 10, '.{DIGITS22}', lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0')), '\\.?0+$', '') AS canonical, true AS same FROM orders", "decimal(38,25)", "decimal_wide")
_codec("orders", "o_orderkey", lambda: F.concat(F.lit(f"-{DIGITS22}"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(".50")).cast("decimal(38,4)"), "decimal", f"SELECT o_orderkey, concat('-{DIGITS22}', lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0'), '.5') AS canonical, true AS same FROM orders", "decimal(38,4)", "decimal_long")
_codec("orders", "o_orderkey", lambda: F.concat(F.lit(f"{DIGITS22}34"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0")).cast("decimal(30,0)"), "int", f"SELECT o_orderkey, concat('{DIGITS22}34', lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0')) AS canonical, true AS same FROM orders", "decimal(38,0)", "int_wide")


@query("SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits FROM part")
def normalize_digits(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", normalize_col(DIGITS, F.col("p_brand"), F.encode("p_brand", "UTF-8")).cast("string").alias("digits"))


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = lower((SELECT min(n_name) FROM nation))")
def casefold_eq(spark, sf):
    """A lookup that ignores case and Unicode form."""
    engine = _engine(spark)
    t = Table("nation", _id("nation"), (Column("n_name", _id("nation.name"), "string", _index(32, CASEFOLD)),), pk=("n_nationkey",))
    df = _read(spark, sf, "nation")
    f = SealedFrame(engine, _stored(engine.seal(df, t)), t)
    low = df.agg(F.min("n_name").alias("m")).first()["m"]
    return f.filter(ref("n_name").eq(low.swapcase())).decrypted().select("n_nationkey", "n_name")


@query("SELECT count(*) AS n, count(*) FILTER (n_regionkey >= 0) AS same FROM nation")
def argon2_verified(spark, sf):
    """An argon2id index: derived once for each distinct value."""
    engine = _engine(spark)
    t = Table("nation", _id("nation"), (Column("n_regionkey", _id("nation.region"), "int", _index(16, slow=Slow())),), pk=("n_nationkey",))
    df = _read(spark, sf, "nation")
    f = SealedFrame(engine, _stored(engine.seal(df, t)), t)
    hits = [f.filter(ref("n_regionkey").eq(k)).count() for k in range(5)]
    return _one(spark, n=df.count(), same=sum(hits))


@query(f"SELECT c_custkey, c_name, 2 AS version FROM {C} WHERE c_name IS NOT NULL")
def rotate_roundtrip(spark, sf):
    """Sealed under version 1, rotated to version 2, opened."""
    f = _customers(spark, sf)
    newer = _engine(spark, DerivedKeyProvider(ROOT, (1, 2)))
    rotated = _stored(newer.rotate_table(f.df, f.table))
    version = F.conv(F.hex(F.substring("c_name", 16, 4)), 16, 10).cast("int")
    opened = SealedFrame(newer, rotated, f.table).decrypted("c_name")
    return opened.join(rotated.filter("c_name is not null").select("c_custkey", version.alias("version")), "c_custkey").select("c_custkey", "c_name", "version")


def _migrating(spark: SparkSession, sf: str, engine: Engine) -> tuple[DataFrame, Table]:
    """customer with c_name as bytes, every third row sealed already."""
    df = _with_nulls(_read(spark, sf, "customer"), "c_name", "c_custkey").select("c_custkey", "c_nationkey", "c_name")
    t = Table("customer", _id("customer"), (Column("c_name", _id("customer.c_name"), "string", _index(1 << 11)),), pk=("c_custkey",))
    sealed = engine.seal(df.filter("c_custkey % 3 = 0"), t)
    rest = df.filter("c_custkey % 3 <> 0").withColumn("c_name", F.encode("c_name", "UTF-8")).withColumn("c_name_bidx", F.lit(None).cast("binary"))
    return _stored(sealed.unionByName(rest)), t


M = f"(SELECT c_custkey, c_name FROM {C})"


@query(f"SELECT 'c_name' AS column, count(*) FILTER (c_name IS NULL) AS values_null, count(*) FILTER (c_name IS NOT NULL AND c_custkey % 3 = 0) AS values_current, count(*) FILTER (c_name IS NOT NULL AND c_custkey % 3 <> 0) AS values_pending, 0 AS values_anomalous FROM {M}")
def backfill_counts(spark, sf):
    df, t = _migrating(spark, sf, _engine(spark))
    return backfill.counts(df, t)


@query(f"SELECT c_custkey, c_name, c_name IS NOT NULL AS indexed FROM {M}")
def backfill_encrypt(spark, sf):
    """What is pending gets sealed and indexed; all rows open afterwards."""
    engine = _engine(spark)
    df, t = _migrating(spark, sf, engine)
    done = _stored(backfill.encrypt(engine, df, t))
    return SealedFrame(engine, done, t).decrypted().join(done.select("c_custkey", F.col("c_name_bidx").isNotNull().alias("indexed")), "c_custkey").select("c_custkey", "c_name", "indexed")


@query(f"SELECT 'c_name' AS column, 'OK' AS status, count(*) AS n FROM {M} WHERE c_name IS NOT NULL")
def backfill_verify(spark, sf):
    engine = _engine(spark)
    df, t = _migrating(spark, sf, engine)
    original = _with_nulls(_read(spark, sf, "customer"), "c_name", "c_custkey")
    return backfill.verify(engine, _stored(backfill.encrypt(engine, df, t)), t, original)


class Withheld(DerivedKeyProvider):
    """Derived keys, but none for one scope."""

    def __init__(self, root: bytes, scope: bytes):
        super().__init__(root)
        self.scope = scope

    def data_keys(self, scope):
        return [] if scope == self.scope else super().data_keys(scope)


#: What a run does with each customer's name, by key: six kinds of values that cannot be sealed.
BAD = """CASE WHEN c_custkey % 7 = 0 THEN 'null' WHEN c_custkey % 11 = 1 THEN 'UNKNOWN_FORMAT_VERSION' WHEN c_custkey % 13 = 0 THEN 'CONTEXT_UNAVAILABLE' WHEN c_custkey % 11 = 2 THEN 'RENDERING_REFUSED'
WHEN c_custkey % 11 = 4 THEN 'LENGTH_EXCEEDED' WHEN c_nationkey = 3 THEN 'KEY_UNAVAILABLE' WHEN c_custkey % 11 = 3 THEN 'INVALID_ARGUMENT' ELSE 'written' END"""


@query(f"SELECT outcome, count(*) AS n, count(*) AS n_counted, CASE WHEN outcome <> 'written' THEN count(*) ELSE 0 END AS n_unchanged FROM (SELECT {BAD} AS outcome FROM customer) GROUP BY 1")
def backfill_failures(spark, sf):
    """A run over a table with bad values ends complete: each is counted by its code and left byte for byte."""
    name = F.encode("c_name", "UTF-8")
    kind = F.col("c_custkey") % 11
    raw = F.when(kind == 1, F.concat(F.lit(b"\2"), F.encode(F.lit("x" * 120), "UTF-8"))).when(kind == 2, F.concat(name, F.lit(b"\xff\xfe"))).when(kind == 3, F.encode(F.concat("c_name", F.lit("\u0378")), "UTF-8")).when(kind == 4, F.encode(F.repeat("c_name", F.lit(20)), "UTF-8")).otherwise(name)
    df = _read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 13 != 0, F.col("c_nationkey")).alias("c_nationkey"), F.when(F.col("c_custkey") % 7 != 0, raw).alias("c_name"))
    source = _stored(df)
    engine = _engine(spark, Withheld(ROOT, b"3"), max_plaintext=200)
    t = Table("customer", _id("customer"), (Column("c_name", _id("customer.c_name"), "string", _index(1 << 11, CASEFOLD)),), pk=("c_custkey",), tenant="c_nationkey")
    at = _shared(spark)
    runner = backfill.Runner(engine, t, f"{at}/log", f"{at}/rows")
    run = runner.work(runner.start("encrypt", source, ranges=4), source)
    if run.status != "complete":
        raise SealError("INTERNAL", "the run did not end")
    counted = run.total("counts")[t.columns[0].uuid.hex()] | run.total("failures")[t.columns[0].uuid.hex()]
    told = spark.createDataFrame([(k, n) for k, n in counted.items() if k != "failed"], "outcome string, n_counted long")
    rows = runner.result(run).select("c_custkey", F.col("c_name").alias("now")).join(source.select("c_custkey", "c_name"), "c_custkey")
    rows = rows.join(runner.quarantine(run).select("c_custkey", "code"), "c_custkey", "left")
    rows = rows.select(F.coalesce("code", F.when(F.col("c_name").isNull(), "null").otherwise("written")).alias("outcome"), F.col("now").eqNullSafe(F.col("c_name")).cast("long").alias("same"))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("same").alias("n_unchanged")).join(told, "outcome").select("outcome", "n", "n_counted", "n_unchanged")


def _priorities(spark: SparkSession, sf: str) -> tuple[DataFrame, Table, str]:
    """orders with o_orderpriority as bytes, and a table to seal it in place."""
    source = _stored(_read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.encode("o_orderpriority", "UTF-8").alias("o_orderpriority")))
    return source, Table("orders", _id("orders"), (Column("o_orderpriority", _id("orders.o_orderpriority"), "string"),), pk=("o_orderkey",)), _shared(spark)


@query("SELECT o_orderkey, o_custkey, o_orderpriority, 8 AS ranges, 5 AS resumed FROM orders")
def range_resume(spark, sf):
    """Ranges of the key, one committed output each: a second runner does what the first, stopped after three, left."""
    source, t, at = _priorities(spark, sf)
    engine = _engine(spark)
    first = backfill.Runner(engine, t, f"{at}/log", f"{at}/rows")
    run = first.lay_out(first.start("encrypt", source, ranges=8), source)
    run = first.work(run, source, only=3)
    second = backfill.Runner(engine, t, f"{at}/log", f"{at}/rows")
    left = len(second.resume(run.run_id).todo)
    run = second.work(run, source)
    opened = SealedFrame(engine, second.result(run), t).decrypted()
    return opened.select("o_orderkey", "o_custkey", "o_orderpriority", F.lit(run.ranges).alias("ranges"), F.lit(left).alias("resumed"))


@query("SELECT o_orderkey, o_orderpriority, true AS refused FROM orders")
def run_taken_over(spark, sf):
    """A runner whose lease ran out is taken over; what it wrote in the meantime is refused and its rows are nowhere read."""
    source, t, at = _priorities(spark, sf)
    engine, now = _engine(spark), [1000.0]
    slow, other = (backfill.Runner(engine, t, f"{at}/log", f"{at}/rows", holder=h, lease=60.0, clock=lambda: now[0]) for h in ("slow", "other"))
    run = slow.work(slow.start("encrypt", source, ranges=4), source, only=1)
    held = slow.claim(run.run_id)
    now[0] += 61
    run = other.work(other.resume(run.run_id), source, only=2)
    refused = False
    try:
        slow._range(held, 1, backfill.in_range(source, t.pk, held.splits, 1))
    except backfill.LostRun:
        refused = True
    run = other.work(run, source)
    opened = SealedFrame(engine, other.result(run), t).decrypted()
    return opened.select("o_orderkey", "o_orderpriority", F.lit(refused).alias("refused"))


@query(f"SELECT 'c_name' AS column, count(*) FILTER (c_custkey % 3 = 0 AND c_name IS NOT NULL) AS n_pending FROM {M}")
def rotate_pending(spark, sf):
    df, t = _migrating(spark, sf, _engine(spark))
    return backfill.rotation_pending(_engine(spark, DerivedKeyProvider(ROOT, (1, 2))), df, t)


@query(f"SELECT 'c_name' AS column, count(*) AS n_rows, count(*) FILTER (c_name IS NULL) AS n_null, count(*) FILTER (c_name IS NOT NULL AND c_custkey % 3 = 0) AS n_envelope, count(*) FILTER (c_name IS NOT NULL AND c_custkey % 3 <> 0) AS n_other FROM {M}")
def census_counts(spark, sf):
    df, t = _migrating(spark, sf, _engine(spark))
    return census.census(df, t)


@query(f"SELECT 65281 AS suite_id, 1 AS version, count(*) AS n FROM {C} WHERE c_name IS NOT NULL")
def census_by_key(spark, sf):
    f = _customers(spark, sf)
    return census.by_key(f.df, f.table, "c_name").select("suite_id", F.conv(F.hex(F.substring("key_id", 13, 4)), 16, 10).cast("int").alias("version"), "n")


def _freq(table: str, column: str) -> str:
    return f"(SELECT {column} AS v, count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY 1)"


PROFILE = """SELECT n_rows, n_distinct, n_distinct AS population, round(m1 / n_rows, 9) AS top1, round(m10 / n_rows, 9) AS top10, m1 / n_rows > 0.01 OR m10 / n_rows > 0.1 AS skewed
FROM (SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, max(n) AS m1 FROM {f}), (SELECT sum(n) AS m10 FROM (SELECT n FROM {f} ORDER BY n DESC LIMIT 10))"""


@query(PROFILE.format(f=_freq("events", "user_id")))
def leak_profile(spark, sf):
    p = leakage.profile(_read(spark, sf, "events"), "user_id")
    return p.select("n_rows", "n_distinct", "population", F.round("top1", 9).alias("top1"), F.round("top10", 9).alias("top10"), "skewed")


@query(f"SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy, round(log2(count(*)), 6) AS entropy_uniform FROM {_freq('events', 'event_type')}")
def leak_entropy(spark, sf):
    return leakage.profile(_read(spark, sf, "events"), "event_type").select(F.round("entropy", 6).alias("entropy"), F.round("entropy_uniform", 6).alias("entropy_uniform"))


@query(f"SELECT rank, n, round(sum(n) OVER (ORDER BY rank) / total, 9) AS mass FROM (SELECT CAST(row_number() OVER (ORDER BY n DESC) AS INTEGER) AS rank, n, sum(n) OVER () AS total FROM {_freq('orders', 'o_orderpriority')}) WHERE rank <= 10")
def leak_topk(spark, sf):
    return leakage.top(_read(spark, sf, "orders"), "o_orderpriority").select("rank", "n", F.round("mass", 9).alias("mass"))


@query()
def leak_collisions(spark, sf):
    df = _read(spark, sf, "customer")
    return leakage.collisions(df, "c_name", bits_for(max(16, df.count())))


@query("SELECT count(DISTINCT c_name) AS n_values, true AS bounded FROM customer")
def leak_collision_totals(spark, sf):
    """A simulated index holds every value, in no more buckets than it has bits for."""
    df = _read(spark, sf, "customer")
    bits = bits_for(max(16, df.count()))
    return leakage.collisions(df, "c_name", bits).select("n_values", (F.col("buckets") <= 2**bits).alias("bounded"))


@query("SELECT * FROM (VALUES ('c_name'), ('event_type'), ('o_orderpriority'), ('user_id')) AS t(col), LATERAL (SELECT CASE WHEN col <> 'c_name' OR (SELECT count(DISTINCT c_name) FROM customer) < 1024 THEN 'REFUSE' ELSE 'OK' END AS verdict)")
def leak_verdict(spark, sf):
    """Verdicts on indexes: for user_id as it is declared, for the others as many values as there are."""
    out = None
    for table, c, declared in (("customer", "c_name", None), ("events", "event_type", None), ("orders", "o_orderpriority", None), ("events", "user_id", USERS)):
        df = _read(spark, sf, table)
        n = declared or df.select(c).distinct().count()
        row = leakage.verdict(df, c, bits_for(max(16, n)), declared).select(F.lit(c).alias("col"), "verdict")
        out = row if out is None else out.union(row)
    return out


#: Pairs of columns: independent, one a function of the other, and in part.
PAIRS = (("customer", "c_nationkey", "c_mktsegment", 4), ("lineitem", "l_returnflag", "l_linestatus", 3), ("orders", "o_orderkey", "o_custkey", 5), ("supplier", "s_nationkey", "s_name", 3))


def _pair_sql(table: str, a: str, b: str, bits: int) -> str:
    of = lambda c: f"CAST('0x' || substr(sha256(CAST({c} AS VARCHAR)), 1, 15) AS BIGINT) % {2**bits}"
    return f"""(WITH p AS (SELECT {of(a)} AS x, {of(b)} AS y, count(*) AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
x AS (SELECT sum(n) AS n, max(n) AS top FROM p GROUP BY x), y AS (SELECT sum(n) AS n, max(n) AS top FROM p GROUP BY y),
t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * log2(n)) AS s FROM p), tx AS (SELECT count(*) AS k, sum(n * log2(n)) AS s, sum(top) AS r, max(n) AS m FROM x), ty AS (SELECT count(*) AS k, sum(n * log2(n)) AS s, sum(top) AS r, max(n) AS m FROM y),
h AS (SELECT CAST(t.n AS BIGINT) AS n, t.k AS k, log2(t.n) - tx.s / t.n AS ha, log2(t.n) - ty.s / t.n AS hb, log2(t.n) - t.s / t.n AS hab, (t.k - tx.k - ty.k + 1) / (2 * t.n * ln(2)) AS bias, (ty.r - tx.m) / t.n AS pa, (tx.r - ty.m) / t.n AS pb FROM t, tx, ty),
v AS (SELECT *, greatest(0, ha + hb - hab - bias) AS i, CASE WHEN least(ha, hb) > 0 THEN greatest(0, ha + hb - hab - bias) / least(ha, hb) ELSE 0 END AS sh FROM h)
SELECT '{a}' AS a, '{b}' AS b, n AS n_rows, k AS counters, round(hab, 6) AS entropy_ab, round(i, 6) AS shared_bits, round(sh, 6) AS shared, round(pa, 6) AS predicts_a, round(pb, 6) AS predicts_b, CASE WHEN sh >= 0.05 OR greatest(pa, pb) >= 0.05 THEN 'CORRELATED' ELSE 'INDEPENDENT' END AS verdict FROM v)"""


@query(" UNION ALL ".join(_pair_sql(*p) for p in PAIRS))
def correlated_pairs(spark, sf):
    """What two indexes would tell about each other, from bounded counters of bucket pairs."""
    out = None
    for table, a, b, bits in PAIRS:
        p = correlation.profile(_read(spark, sf, table), a, b, bits)
        p = p.select("a", "b", "n_rows", "counters", *[F.round(c, 6).alias(c) for c in ("entropy_ab", "shared_bits", "shared", "predicts_a", "predicts_b")], "verdict")
        out = p if out is None else out.union(p)
    return out


@query(f"SELECT c_custkey, c_nationkey, c_name FROM {C} WHERE c_name IN {N3}")
def tenant_scoped_eq(spark, sf):
    """Every nation has keys of its own; the lookup is made under each row's."""
    f = _customers(spark, sf, tenant="c_nationkey")
    return f.filter(ref("c_name").isin(*_some(spark, sf))).decrypted("c_name").select("c_custkey", "c_nationkey", "c_name")


@query(f"SELECT c_custkey, c_name FROM {C}")
def row_bound_open(spark, sf):
    """Envelopes bound to their row's key."""
    return _customers(spark, sf, row="c_custkey").decrypted("c_name").select("c_custkey", "c_name")


@query(f"""SELECT c_custkey, status, CASE WHEN status = 'OK' THEN c_acctbal END AS c_acctbal FROM (SELECT c_custkey, c_acctbal, CASE c_custkey % 10
WHEN 1 THEN CASE WHEN c_name IS NULL THEN 'DROPPED' ELSE 'SWAPPED' END WHEN 2 THEN CASE WHEN c_name IS NULL THEN 'OK' ELSE 'REPLACED' END WHEN 3 THEN 'DROPPED'
WHEN 4 THEN 'MAC_INVALID' WHEN 5 THEN 'MAC_MISSING' WHEN 6 THEN CASE WHEN c_name IS NULL THEN 'ADDED' ELSE 'OK' END ELSE 'OK' END AS status FROM {C})""")
def record_mac_status(spark, sf):
    """Fields swapped, rolled back, dropped, added, and tags of other records: each told apart before anything is opened."""
    f = _customers(spark, sf)
    older = _stored(f.engine.seal(_read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), f.table)).select("c_custkey", F.col("c_name").alias("old_name"))
    df = _stored(record.attach(f.engine, f.df, f.table)).join(older, "c_custkey")
    case, name, tag = F.col("c_custkey") % 10, F.col("c_name"), F.col("record_mac")
    moved = F.overlay(tag, F.lit(b"\0"), F.octet_length(tag))
    moved = F.when(F.substring(tag, F.octet_length(tag), F.lit(1)) == F.lit(b"\0"), F.overlay(tag, F.lit(b"\1"), F.octet_length(tag))).otherwise(moved)
    replaced = {
        "c_name": F.when(case == 1, F.col("c_acctbal")).when((case == 2) & name.isNotNull(), F.col("old_name")).when((case == 6) & name.isNull(), F.col("old_name")).otherwise(name),
        "c_acctbal": F.when(case == 1, name).when(case != 3, F.col("c_acctbal")),
        "record_mac": F.when(case == 4, moved).when(case != 5, tag),
    }
    got = record.open_checked(f.engine, df.withColumns(replaced).drop("old_name"), f.table, ("c_acctbal",), raises=False)
    return got.select("c_custkey", F.col("record_mac_status").alias("status"), "c_acctbal")


@query("SELECT 'part' AS source, p_partkey AS key, p_name AS name FROM part WHERE starts_with(p_name, (SELECT substring(min(p_name), 1, 4) FROM part)) OR starts_with(p_name, (SELECT substring(max(p_name), 1, 3) FROM part)) UNION ALL SELECT 'customer', c_custkey, c_name FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS c_name FROM customer) WHERE starts_with(c_name, 'Customer#00000001')")
def prefix_verified(spark, sf):
    """Prefix lookups through tables of keyed tokens, verified."""
    engine, out = _engine(spark), None
    names = _read(spark, sf, "part").agg(F.min("p_name").alias("a"), F.max("p_name").alias("z")).first()
    for table, key, column, lengths, asked in (("part", "p_partkey", "p_name", (3, 6), (names["a"][:4], names["z"][:3])), ("customer", "c_custkey", "c_name", (9, 16), ("Customer#00000001",))):
        df = _read(spark, sf, table).select(key, column)
        df = _with_nulls(df, column, key) if table == "customer" else df
        t = Table(table, _id(table), (Column(column, _id(f"{table}.{column}"), "string"),), pk=(key,))
        f = SealedFrame(engine, _stored(engine.seal(df, t)), t)
        found = prefix.build(f, prefix.Prefix(column, lengths, _index(1 << 10), DEMO), _shared(spark)).starts_with(*asked)
        rows = found.decrypted().select(F.lit(table).alias("source"), F.col(key).alias("key"), F.col(column).alias("name"))
        out = rows if out is None else out.union(rows)
    return out


@query(f"SELECT 'c_name' AS column, outcome, count(*) AS n FROM (SELECT CASE WHEN c_name IS NULL THEN 'null' WHEN c_custkey % 3 <> 0 THEN 'NOT_CIPHERTEXT' WHEN c_custkey % 10 = 1 THEN 'COMMITMENT_INVALID' WHEN c_custkey % 10 = 2 THEN 'KEY_UNAVAILABLE' ELSE 'OK' END AS outcome FROM {C}) GROUP BY 2")
def read_counts(spark, sf):
    """Outcomes of a read, counted in the pass that opens the values."""
    engine = _engine(spark)
    df, t = _migrating(spark, sf, engine)
    e, n = F.col("c_name"), F.octet_length("c_name")
    case, sealed = F.col("c_custkey") % 10, F.col("c_custkey") % 3 == 0
    last = F.when(F.substring(e, n, F.lit(1)) == F.lit(b"\0"), F.lit(b"\1")).otherwise(F.lit(b"\0"))
    broken = F.when(sealed & (case == 1), F.overlay(e, last, n)).when(sealed & (case == 2), F.overlay(e, F.lit(b"?" * 16), F.lit(4))).otherwise(e)
    opened, counts = engine.counted(df.withColumn("c_name", broken).withMetadata("c_name", t.metadata(t.columns[0])), t, ("c_name",), raw=True)
    opened.write.format("noop").mode("overwrite").save()
    return counts.rows()


@query("SELECT event_id, user_id, (SELECT count(*) FROM events) AS used, true AS refused FROM events")
def key_uses(spark, sf):
    """Batches of a store under a budget of uses a key: the one that would exceed it is refused, the others are read."""
    events = _read(spark, sf, "events").select("event_id", "user_id")
    t = Table("events", _id("events"), (Column("user_id", _id("events.user_id"), "int"),), pk=("event_id",))
    store = SealedStore(_engine(spark), t, _shared(spark), max_uses=events.count())
    for part in (0, 1):
        store.append(events.filter(F.col("event_id") % 2 == part))
    refused = False
    try:
        store.append(events)
    except SealError as e:
        refused = e.code == "KEY_UNAVAILABLE"
    used = store.uses().agg(F.sum("n").alias("used"))
    return store.read().decrypted().select("event_id", "user_id").join(F.broadcast(used)).withColumn("refused", F.lit(refused))


@query(f"SELECT c_nationkey, count(*) AS n, count(c_name) AS named, 5 AS refused FROM {C} GROUP BY 1")
def sql_over_envelopes(spark, sf):
    """SQL that passes envelopes on and counts them is served; what would read them, under another name too, is refused."""
    f, refused = _customers(spark, sf), 0
    for text in ("SELECT x FROM (SELECT c_name AS x FROM t) ORDER BY x", "SELECT c_name, count(*) FROM t GROUP BY 1", "SELECT max(c_acctbal) FROM t", "SELECT a.c_custkey FROM t a JOIN t b ON a.c_name_bidx = b.c_name_bidx", "SELECT c_custkey FROM t WHERE c_name IN (SELECT c_name FROM t)"):
        try:
            tables.sql(text, t=f)
        except NotSupported:
            refused += 1
    return tables.sql("SELECT c_nationkey, count(*) AS n, count(name) AS named FROM (SELECT c_nationkey, c_name AS name FROM t) GROUP BY c_nationkey", t=f).withColumn("refused", F.lit(refused))


def _quiet(spark: SparkSession, mode: str) -> Engine:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _engine(spark, mode=mode)


@query(f"SELECT c_custkey, c_name FROM {M}")
def permissive_passthrough(spark, sf):
    """A half-migrated column reads whole."""
    df, t = _migrating(spark, sf, _engine(spark))
    return SealedFrame(_quiet(spark, "permissive"), df, t).decrypted().select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_name FROM {M}")
def readonly_read(spark, sf):
    df, t = _migrating(spark, sf, _engine(spark))
    return SealedFrame(_quiet(spark, "readonly"), df, t).decrypted().select("c_custkey", "c_name")


@query("SELECT region, round(sum(total), 2) AS total FROM (SELECT r_name AS region, c_acctbal AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY 1")
def sealed_sum_by_region(spark, sf):
    """Sealed payload, plain join keys, small sides."""
    c = _customers(spark, sf).decrypted("c_acctbal")
    n, r = _read(spark, sf, "nation"), _read(spark, sf, "region")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("region")).agg(F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE lower(text) = lower((SELECT text FROM documents ORDER BY doc_id LIMIT 1))")
def long_text_casefold_eq(spark, sf):
    """Long multilingual texts under a folding index."""
    engine = _engine(spark)
    df = _read(spark, sf, "documents").select("doc_id", "text")
    t = Table("documents", _id("documents"), (Column("text", _id("documents.text"), "string", _index(1 << 11, CASEFOLD)),), pk=("doc_id",))
    first = df.orderBy("doc_id").limit(1).first()["text"]
    f = SealedFrame(engine, _stored(engine.seal(df, t)), t)
    return f.filter(ref("text").eq(casefold(first))).decrypted().select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT event_id, user_id, value FROM events")
def stream_sealed(spark, sf):
    """A stream of rows sealed batch by batch, read back."""
    from .streaming.seal import read_sealed, seal_stream

    engine = _engine(spark)
    t = Table("events", _id("events"), (Column("user_id", _id("events.user_id"), "int", _index(USERS)), Column("value", _id("events.value"), "float")), pk=("event_id",))
    rows = _read(spark, sf, "events").select("event_id", "user_id", "value")
    source = _stored(rows)
    base = source.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(T.StructType(rows.schema.fields)).parquet(base)
    seal_stream(engine, stream, t, f"{base}-out", f"{base}-checkpoint").awaitTermination()
    return SealedFrame(engine, read_sealed(engine, t, f"{base}-out"), t).decrypted().select("event_id", "user_id", "value")
