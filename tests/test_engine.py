import warnings

import pytest
from pyspark.sql import functions as F

from sealcol.engine import ARM, Engine
from sealcol.errors import CODES, ConfigurationError, InvalidArgument, NotSupported, SealError
from sealcol.functions.normalize import CASEFOLD, first_unassigned, normalize
from sealcol.operators import census, leakage
from sealcol.operators.checks import validate
from sealcol.operators.frame import SealedFrame
from sealcol.plans.context import Binding
from sealcol.plans.declare import Column, Index, Override, Slow, Table, bits_for, changed_paths, config_hash, run_config
from sealcol.plans.keys import DataKey, DerivedKeyProvider, EnvelopeKeyProvider, KeyCache, KeyDirectory, StaticKeyProvider, WrappedKey
from sealcol.plans.predicates import Plain, ref

ROOT = bytes(range(32))
CTX = Binding(b"t" * 16 + b"c" * 16)
NOTE = Override("test", "tests", "2026-01-01")
INDEX = Index(bits=9, population=1500, suite=0xFF01, form=CASEFOLD, bucket=NOTE)
TABLE = Table("people", b"p" * 16, (Column("email", b"e" * 16, "string", INDEX), Column("note", b"n" * 16, "string"), Column("age", b"a" * 16, "int")), pk=("id",))
ROWS = [(1, "Ada@x.org", "first", 36), (2, "grace@x.org", None, 45), (3, None, "", 41), (4, "straße@x.org", "n", None), (5, "ada@X.ORG", "twin", 7), (6, "odd͸@x.org", "u", 8)]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, DerivedKeyProvider(ROOT), arm_provisional=True, tables=(TABLE,))


@pytest.fixture(scope="module")
def people(spark, engine, tmp_path_factory):
    df = spark.createDataFrame(ROWS, "id long, email string, note string, age int")
    path = str(tmp_path_factory.mktemp("people") / "t")
    engine.seal(df, TABLE).write.parquet(path)
    return SealedFrame(engine, spark.read.parquet(path), TABLE)


def ids(frame):
    return sorted(r["id"] for r in (frame.df if hasattr(frame, "df") else frame).select("id").collect())


def code(f, *a):
    with pytest.raises(SealError) as e:
        f(*a)
    return e.value.code


def test_values_round_trip_and_tampering_is_told_apart(engine):
    blob = engine.encrypt(b"value", CTX)
    assert len(blob) == 111 + 5 and engine.decrypt(blob, CTX) == b"value" and blob != engine.encrypt(b"value", CTX)
    flip = lambda i: blob[:i] + bytes([blob[i] ^ 1]) + blob[i + 1 :]
    assert code(engine.decrypt, flip(63), CTX) == "TAG_INVALID"
    assert code(engine.decrypt, flip(70), CTX) == "TAG_INVALID"
    assert code(engine.decrypt, flip(len(blob) - 1), CTX) == "COMMITMENT_INVALID"
    assert code(engine.decrypt, flip(30), CTX) == "COMMITMENT_INVALID"
    assert code(engine.decrypt, flip(5), CTX) == "KEY_UNAVAILABLE"
    assert code(engine.decrypt, blob, Binding(b"t" * 16 + b"d" * 16)) == "COMMITMENT_INVALID"
    assert code(engine.decrypt, blob, Binding(b"t" * 16 + b"c" * 16, row=b"1")) == "COMMITMENT_INVALID"
    assert code(engine.decrypt, b"plain", CTX) == "NOT_CIPHERTEXT"
    assert code(engine.decrypt, b"\2" + bytes(200), CTX) == "UNKNOWN_FORMAT_VERSION"
    assert code(engine.decrypt, b"\1\xff\2" + bytes(200), CTX) == "SUITE_NOT_ALLOWED"
    assert engine.decrypt(engine.rotate(blob, CTX), CTX) == b"value"
    assert code(engine.rotate, b"plain", CTX) == "NOT_CIPHERTEXT"


def test_gates_come_in_order(spark, monkeypatch):
    monkeypatch.delenv(ARM, raising=False)
    unarmed = Engine(spark, DerivedKeyProvider(ROOT))
    assert code(unarmed.encrypt, b"x", CTX) == "SUITE_PROVISIONAL"
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        readonly = Engine(spark, DerivedKeyProvider(ROOT), mode="readonly")
    assert told and code(readonly.encrypt, b"x", CTX) == "MODE_VIOLATION" and code(readonly.rotate, b"x", CTX) == "MODE_VIOLATION"
    assert readonly.decrypt(b"plain", CTX) == b"plain" and readonly.metrics.plaintext_reads == 1
    assert unarmed.blind_index("A", CTX, INDEX) == readonly.blind_index("a", CTX, INDEX)
    monkeypatch.setenv(ARM, "yes")
    assert not Engine(spark, DerivedKeyProvider(ROOT)).armed
    monkeypatch.setenv(ARM, "1")
    assert Engine(spark, DerivedKeyProvider(ROOT)).armed
    for bad in ({"mode": "x"}, {"write_suite": 0xFF02}, {"write_suite": 1}, {"allowed_suites": ()}):
        with pytest.raises(ConfigurationError):
            Engine(spark, DerivedKeyProvider(ROOT), **bad)
    with pytest.raises(InvalidArgument):
        unarmed.blind_index(3, CTX, INDEX)
    assert len(set(CODES)) == 10


def test_lookups_are_verified(people):
    assert ids(people.filter(ref("email").eq("ADA@x.org"))) == [1, 5]
    assert ids(people.filter(ref("email").isin("grace@x.org", None, "STRASSE@X.ORG"))) == [2, 4]
    assert ids(people.filter(ref("email").isin())) == [] and ids(people.filter(ref("email").eq("nobody"))) == []
    assert ids(people.filter(ref("email").is_null())) == [3] and ids(people.filter(~ref("note").is_null())) == [1, 3, 4, 5, 6]
    assert ids(people.filter(ref("email").eq("odd͸@x.org"))) == [6]
    assert people.filter(ref("email").eq("grace@x.org")).get()["age"] == 45
    assert [r["note"] for r in people.decrypted().orderBy("id").collect()] == ["first", None, "", "n", "twin", "u"]


def test_forged_collisions_do_not_pass(people, spark, tmp_path):
    forged = people.df.withColumn("email_bidx", F.lit(people.df.filter("id = 1").first()["email_bidx"]))
    forged.write.parquet(str(tmp_path / "f"))
    f = SealedFrame(people.engine, spark.read.parquet(str(tmp_path / "f")), TABLE)
    assert ids(f.candidates(ref("email").eq("ada@x.org")).rows()) == [1, 2, 3, 4, 5, 6]
    hit = f.filter(ref("email").eq("ada@x.org"))
    assert ids(hit) == [1, 5] and hit.count() == 2 and ids(hit.limit(1)) == [1]
    assert ids(f.delete(hit)) == [2, 3, 4, 6]
    assert hit.first()["id"] == 1 and hit.last()["id"] == 5
    with pytest.raises(LookupError):
        hit.get()


def test_shapes_that_would_be_wrong_are_refused(people):
    a, b = ref("email").eq("x"), ref("email").eq("y")
    hit = people.filter(a)
    refused = [
        lambda: people.filter(a | b), lambda: people.filter(a ^ b), lambda: people.filter(~a), lambda: people.candidates(~a), lambda: people.candidates(a ^ b),
        lambda: people.filter(ref("note").eq("n")), lambda: people.filter(Plain(F.col("email") == "x")), lambda: people.filter(Plain(F.length("email_bidx") > 1)),
        lambda: people.order_by("email"), lambda: people.group_by("note"), lambda: people.distinct("email"), lambda: people.aggregate(m=F.max("age")), lambda: people.join(people.df, "email"),
        lambda: people.candidates(a).count(), lambda: people.candidates(a).anti_join(people.df, "id"), lambda: hit.union(people.candidates(a)), lambda: hit.limit(1, "email"),
        *[lambda n=n: people.filter(ref("email").lookup(n, "x")) for n in ("contains", "gt", "range", "year", "anything")],
    ]
    for f in refused:
        with pytest.raises(NotSupported):
            f()
    assert ids(people.filter_any(a, ref("email").eq("grace@x.org"))) == [2]
    assert set(ids(people.candidates(a | ref("email").eq("grace@x.org")).rows())) >= {2}
    assert people.group_by("id").count().count() == 6


def test_conditions_are_refused_by_what_they_read(people):
    for c in (F.col("email") == "a", F.expr("length(email) > 3"), people.df["EMAIL_bidx"].isNull(), F.col("email").isNull(), F.when(F.col("id") > 1, F.col("note")).isNotNull(), F.exists(F.array(F.lit(1)), lambda x: F.col("note") == "n")):
        with pytest.raises(NotSupported):
            people.filter(Plain(c))
    for c in (F.col("id") == 1, F.lit("email") == "email", F.expr("id = 1 or 'email' = 'note'"), F.col("id").cast("string") != "note"):
        assert people.filter(Plain(c)).count() >= 1


def test_plans_push_the_index_down_and_show_no_key(people, engine):
    hit = people.filter(ref("email").eq("grace@x.org")).decrypted()
    text = hit._jdf.queryExecution().toString()
    assert "PushedFilters: [" in text and "email_bidx" in text.split("PushedFilters: [")[1].split("]")[0]
    keys = engine.provider.data_keys(b"")[0].dek, engine.provider.index_key(b""), engine.index_key(TABLE.binding(TABLE.column("email")), INDEX)
    assert not any(k.hex() in text.lower() for k in keys)


def test_metadata_travels_and_is_compared(people, spark):
    assert "sealed" in people.df.filter("id > 1").schema["email"].metadata
    other = Table("people", b"p" * 16, (Column("email", b"E" * 16, "string", INDEX),), pk=("id",))
    with pytest.raises(ConfigurationError):
        SealedFrame(people.engine, people.df, other).decrypted("email")
    assert {i.code for i in validate([other], {"people": people.df})} >= {"E005", "W002"}
    assert validate([TABLE], {"people": people.df})[0].code.startswith("W")


def test_tenants_have_keys_of_their_own(spark, engine, tmp_path):
    t = Table("docs", b"d" * 16, (Column("body", b"b" * 16, "string", INDEX),), pk=("id",), tenant="org")
    df = spark.createDataFrame([(1, 10, "same"), (2, 11, "same"), (3, 10, "else")], "id long, org int, body string")
    engine.seal(df, t).write.parquet(str(tmp_path / "t"))
    f = SealedFrame(engine, spark.read.parquet(str(tmp_path / "t")), t)
    assert ids(f.filter(ref("body").eq("SAME"))) == [1, 2] and ids(f.filter(ref("body").eq("same"), tenant=b"10")) == [1]
    moved = SealedFrame(engine, f.df.withColumn("org", F.lit(11)), t)
    with pytest.raises(Exception, match="KEY_UNAVAILABLE|COMMITMENT_INVALID"):
        moved.decrypted().collect()
    with pytest.raises(Exception, match="CONTEXT_UNAVAILABLE"):
        engine.seal(df.withColumn("org", F.lit(None).cast("int")), t).collect()


def test_providers():
    p = DerivedKeyProvider(ROOT, (1, 2))
    old, new = {k.version: k for k in p.data_keys(b"s")}[1], p.data_keys(b"s")[0]
    assert new.version == 2 and old.dek != new.dek and not old.active and p.index_key(b"s") == DerivedKeyProvider(ROOT).index_key(b"s")
    for bad in (lambda: DerivedKeyProvider(b"short"), lambda: DerivedKeyProvider(ROOT, (1, 1)), lambda: DerivedKeyProvider(ROOT, (1,), 2), lambda: StaticKeyProvider(b"k" * 32, b"k" * 32), lambda: DataKey(b"", 1, b"x", b"y"), lambda: KeyCache(max_age=0)):
        with pytest.raises(ConfigurationError):
            bad()

    class Xor:
        calls = 0

        def unwrap(self, wrapped):
            self.calls += 1
            return bytes(b ^ 1 for b in wrapped)

    keys = [WrappedKey(b"s", 1, b"1" * 16, b"a" * 32, False), WrappedKey(b"s", 2, b"2" * 16, b"b" * 32)]
    now, wrapper = [0.0], Xor()
    env = EnvelopeKeyProvider(KeyDirectory(keys, {b"s": b"i" * 32}), wrapper, KeyCache(10, max_uses=3, capacity=3, clock=lambda: now[0]))
    assert env.data_keys(b"s") == [] and code(env.index_key, b"s") == "KEY_UNAVAILABLE"
    env.warm([b"s", b"s"])
    assert [k.version for k in env.data_keys(b"s")] == [2, 1] and wrapper.calls == 3
    now[0] = 11
    assert env.data_keys(b"s") == [] and env.cache.evictions == 2
    for bad in (lambda: KeyDirectory(keys[:1], {b"s": b""}), lambda: KeyDirectory(keys, {}), lambda: KeyDirectory(keys + keys, {b"s": b""})):
        with pytest.raises(ConfigurationError):
            bad()


def test_declarations():
    ok = dict(bits=15, population=100_000, suite=0xFF01)
    Index(**ok)
    for bad in ({"bits": 16}, {"bits": 8}, {"bits": True}, {"population": 15}, {"suite": 3}, {"form": "mine"}, {"slow": Slow(passes=2)}, {"slow": Slow(kib=1)}, {"skewed": True}, {"bucket": NOTE}, {"name": "UP"}):
        with pytest.raises(ConfigurationError):
            Index(**{**ok, **bad})
    with pytest.raises(ConfigurationError):
        Index(bits=6, population=150, suite=0xFF01)
    Index(bits=6, population=150, suite=0xFF01, few=NOTE)
    assert bits_for(1500) == 9
    a, b = run_config(TABLE, "encrypt"), run_config(TABLE, "rotate")
    assert config_hash(a) != config_hash(b) and changed_paths(a, b)[-1] == "/job" and {p.split("/indexes")[0] for p in changed_paths(a, b)[:-1]} == {"/columns/1"} and changed_paths(a, a) == []
    with pytest.raises(ConfigurationError):
        Override("", "x", "y")


def test_normal_forms():
    assert normalize(CASEFOLD, "StraßE") == b"strasse" and normalize(CASEFOLD, "é") == "é".encode()
    assert normalize(CASEFOLD, "͸") is None and first_unassigned("a͸") == 1 and normalize(CASEFOLD, b"\xff") is None
    assert normalize("digits-only-v1", "+1 (2) ٣-4") == b"124" and normalize("identity", "x") == b"x"
    with pytest.raises(ConfigurationError):
        normalize("other", "x")


def test_census_and_leakage(people, spark):
    got = {r["column"]: tuple(r)[1:] for r in census.census(people.df, TABLE).collect()}
    assert got == {"email": (6, 1, 5, 0), "note": (6, 1, 5, 0), "age": (6, 1, 5, 0)}
    assert [r["n"] for r in census.by_key(people.df, TABLE, "email").collect()] == [5]
    assert {r["column"]: r["n_unindexed"] for r in census.index_missing(people.df, TABLE).collect()} == {"email": 0}
    flat = spark.range(4000).select(F.col("id").cast("string").alias("v"))
    assert leakage.verdict(flat, "v", bits_for(4000)).first()["verdict"] == "OK"
    assert leakage.verdict(flat, "v", 3).first()["verdict"] == "CAUTION"
    assert leakage.verdict(flat.union(flat.limit(1).crossJoin(spark.range(100)).select("v")), "v", 10).first()["verdict"] == "REFUSE"
    c = leakage.collisions(flat, "v", 10).first()
    assert abs(c["values_avg"] - c["predicted"]) < 0.5
    assert leakage.profile(flat.filter("false"), "v").first()["n_rows"] == 0
