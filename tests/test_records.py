"""Record tags and prefix lookups."""

import pytest
from pyspark.sql import functions as F

from sealcol.engine import Engine
from sealcol.errors import ConfigurationError, InvalidArgument, NotSupported
from sealcol.functions.normalize import CASEFOLD
from sealcol.operators import prefix, record
from sealcol.operators.frame import SealedFrame
from sealcol.plans.declare import Column, Index, Override, Table
from sealcol.plans.keys import DerivedKeyProvider

ROOT = bytes(range(32))
INDEX = Index(bits=9, population=1500, suite=0xFF01)
DEMO = Override("test", "tests", "2026-01-01")
TABLE = Table("people", b"p" * 16, (Column("name", b"n" * 16, "string", INDEX), Column("note", b"o" * 16, "string", storage="base64"), Column("age", b"a" * 16, "int")), pk=("id", "part"), tenant="org")


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, DerivedKeyProvider(ROOT), arm_provisional=True)


def stored(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


@pytest.fixture(scope="module")
def sealed(spark, engine, tmp_path_factory):
    rows = [(i, None if i == 9 else f"p{i % 3}", f"o{i % 2}", None if i % 5 == 0 else f"name {i}", "x" * i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, part string, org string, name string, note string, age int")
    at = tmp_path_factory.mktemp("records")
    first, second = stored(engine.seal(df, TABLE), at / "a"), stored(engine.seal(df, TABLE), at / "b")
    return df, stored(record.attach(engine, first, TABLE), at / "c"), stored(record.attach(engine, second, TABLE), at / "d")


def statuses(engine, df, **more):
    out = record.with_status(engine, df, TABLE, **more)
    return {r["id"]: (r["record_mac_status"], r["record_mac_fields"]) for r in out.collect()}


def test_untouched_records_are_authentic(engine, sealed):
    df, now, _ = sealed
    assert set(x[0] for x in statuses(engine, now).values()) == {"OK"}
    opened = record.open_checked(engine, now, TABLE, ("name", "age"))
    assert sorted((r["id"], r["name"], r["age"]) for r in opened.collect()) == sorted((r["id"], r["name"], r["age"]) for r in df.collect())
    assert now.filter(F.octet_length("record_mac") == record.Fields(TABLE).size).count() == 20
    wider = now.withColumns({"status": F.lit(1), "k": F.lit("x"), "m_ipadding": F.lit(2)})
    assert set(x[0] for x in statuses(engine, wider).values()) == {"OK"}


def test_each_change_has_a_status_of_its_own(engine, sealed):
    _, now, other = sealed
    both = now.join(other.select("id", F.col("name").alias("n2"), F.col("name_bidx").alias("x2"), F.col("record_mac").alias("m2"), F.col("note").alias("o2")), "id")
    i = F.col("id")
    cut = lambda c: F.substring(c, F.lit(1), F.octet_length(c) - 1)
    changed = both.withColumns({
        "name": F.when(i == 1, F.unbase64("note")).when(i == 2, F.col("n2")).when(i == 3, F.lit(None)).when(i == 5, F.lit(b"new")).when(i == 8, F.col("n2")).otherwise(F.col("name")),
        "note": F.when(i == 4, F.lit("no base64!")).when(i == 8, F.col("o2")).otherwise(F.col("note")),
        "name_bidx": F.when(i == 6, F.lit(None)).when(i == 7, F.lit(b"\0\0")).otherwise(F.col("name_bidx")),
        "record_mac": F.when(i == 8, F.col("m2")).when(i == 9, F.lit(None)).when(i == 10, cut("record_mac")).when(i == 11, F.concat(cut("record_mac"), F.lit(b"\0\1"))).when(i == 12, F.lit(b"")).otherwise(F.col("record_mac")),
        "org": F.when(i == 13, "o9").otherwise(F.col("org")), "part": F.when(i == 14, "p9").otherwise(F.col("part")),
    }).drop("n2", "x2", "m2", "o2")
    got = statuses(engine, changed)
    assert got.pop(1) == ("SWAPPED", ["name"])
    assert got.pop(2) == ("REPLACED", ["name"])
    assert got.pop(3) == ("DROPPED", ["name"])
    assert got.pop(4) == ("DROPPED", ["note"])
    assert got.pop(5) == ("ADDED", ["name"])
    assert got.pop(6) == ("DROPPED", ["name_bidx"])
    assert got.pop(7) == ("REPLACED", ["name_bidx"])
    assert got.pop(8) == ("REPLACED", ["age"])  # rolled back with its tag, but for one field
    assert got.pop(9) == ("MAC_MISSING", None)
    assert [got.pop(k) for k in range(10, 15)] == [("MAC_INVALID", None)] * 5
    assert all(s == "OK" and f == [] for s, f in got.values())
    # a tag is of one record: another record's whole set of fields does not pass under it
    moved = now.filter("id = 15").withColumn("id", F.lit(16).cast("long"))
    assert statuses(engine, moved) == {16: ("MAC_INVALID", None)}


def test_nothing_of_a_bad_record_is_opened(engine, sealed):
    _, now, _ = sealed
    bad = now.withColumn("note", F.when(F.col("id") != 4, F.col("note")))
    got = {r["id"]: r["age"] for r in record.open_checked(engine, bad, TABLE, ("age",), raises=False).collect()}
    assert got == {i: None if i == 4 else i for i in range(20)}
    with pytest.raises(Exception, match="a record's tag says DROPPED"):
        record.open_checked(engine, bad, TABLE, ("age",)).collect()
    with pytest.raises(ConfigurationError):
        record.Fields(Table("t", b"t" * 16, (), pk=()))
    with pytest.raises(InvalidArgument):
        record.attach(engine, now, TABLE, "name")
    other = Table("people", b"p" * 16, TABLE.columns[1:], pk=TABLE.pk, tenant="org")  # a declared column less
    assert {r["record_mac_status"] for r in record.with_status(engine, now, other).collect()} == {"MAC_INVALID"}


# prefixes

NAMES = Table("names", b"q" * 16, (Column("name", b"n" * 16, "string"),), pk=("id",))
VALUES = ["Anna", "anna-lena", "ANNE", "Ännchen", "Änne", "An", "B", "", None, "Annabel", "anna", "Bernd"] + [f"shared{i}" for i in range(60)]


def frame_of(spark, engine, table, at, tenant=False):
    rows = [(i, f"o{i % 2}", v) for i, v in enumerate(VALUES)]
    return SealedFrame(engine, stored(engine.seal(spark.createDataFrame(rows, "id long, org string, name string"), table), at), table)


def declared(lengths=(2, 4), form=CASEFOLD):
    return prefix.Prefix("name", lengths, Index(bits=5, population=256, suite=0xFF01, form=form, few=DEMO), DEMO)


@pytest.mark.parametrize("tenant", [None, "org"])
def test_prefixes_are_exact(spark, engine, tmp_path, tenant):
    table = Table("names", b"q" * 16, NAMES.columns, pk=("id",), tenant=tenant)
    f = frame_of(spark, engine, table, tmp_path / "t")
    found = prefix.build(f, declared(), str(tmp_path / "p"), files=3)
    fold = lambda x: x.casefold()
    for asked in (("an",), ("ANNA",), ("änn", "be"), ("anna-l",), ("shared1",), ("zz",), ("shared",)):
        want = sorted(i for i, v in enumerate(VALUES) if v and any(fold(v).startswith(fold(a)) for a in asked))
        assert sorted(r["id"] for r in found.starts_with(*asked).df.collect()) == want, asked
        n = found.over_fetch(*asked).first()
        assert n["n_answers"] == len(want) <= n["n_candidates"]
    if tenant:
        assert sorted(r["id"] for r in found.starts_with("shared", tenant=b"o1").df.collect()) == [i for i, v in enumerate(VALUES) if v and v.startswith("shared") and i % 2]
    else:
        opened = found.starts_with("anna").decrypted()
        assert sorted(r["name"] for r in opened.collect()) == ["Anna", "Annabel", "anna", "anna-lena"]


def test_tokens_are_pushed_down_and_spread(spark, engine, tmp_path):
    f = frame_of(spark, engine, NAMES, tmp_path / "t")
    found = prefix.build(f, declared((1, 6)), str(tmp_path / "p"), files=4)
    plan = found.candidates("shared1")._jdf.queryExecution().toString()
    assert "EqualTo(prefix_length,6)" in plan and "EqualTo(token," in plan
    both = found.candidates("shared1", "annabe")._jdf.queryExecution().toString()
    assert "In(token, [" in both
    # a token that most rows share is in more than one file
    hot = found.stored.select("token", F.input_file_name().alias("f")).groupBy("token").agg(F.countDistinct("f").alias("files"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).first()
    assert hot["n"] >= 60 and hot["files"] > 1
    assert found.stored.count() == sum(len(v) >= n for v in VALUES if v for n in (1, 6))


def test_prefix_declarations(spark, engine, tmp_path):
    index = Index(bits=5, population=256, suite=0xFF01, few=DEMO)
    for bad in (dict(lengths=()), dict(lengths=(3, 2)), dict(lengths=(0,)), dict(accepted=None)):
        with pytest.raises(ConfigurationError):
            prefix.Prefix(**({"column": "name", "lengths": (2,), "index": index, "accepted": DEMO} | bad))
    with pytest.raises(ConfigurationError):
        prefix.Prefix("name", (2,), Index(bits=5, population=256, suite=0xFF01, few=DEMO, as_hex=True), DEMO)
    f = frame_of(spark, engine, NAMES, tmp_path / "t")
    found = prefix.build(f, declared((3,)), str(tmp_path / "p"))
    with pytest.raises(NotSupported, match="shortest declared prefix has 3"):
        found.starts_with("an")
    # every length has a key of its own
    a, b = (engine._derive(b"anna", NAMES.binding(NAMES.columns[0]), declared().of(n)) for n in (2, 4))
    keys = {engine.index_key(NAMES.binding(NAMES.columns[0]), declared().of(n)) for n in (2, 4)}
    assert len(keys) == 2 and len(a) == len(b) == 1
