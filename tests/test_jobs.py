import pytest
from pyspark.sql import functions as F

from sealcol.engine import Engine
from sealcol.errors import ConfigurationError
from sealcol.operators import backfill
from sealcol.operators.frame import SealedFrame
from sealcol.plans.declare import Column, Index, Table
from sealcol.plans.keys import DerivedKeyProvider
from sealcol.plans.predicates import ref
from sealcol.sources import tables
from sealcol.streaming.seal import read_sealed, seal_stream

ROOT = bytes(range(32))
INDEX = Index(bits=9, population=1500, suite=0xFF01)
TABLE = Table("t", b"t" * 16, (Column("v", b"v" * 16, "string", INDEX),), pk=("id",))


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, DerivedKeyProvider(ROOT), arm_provisional=True)


@pytest.fixture(scope="module")
def plain(spark):
    return spark.range(40).select("id", F.when(F.col("id") % 5 != 0, F.concat(F.lit("v"), F.col("id"))).alias("v"))


def runner(engine, table, tmp_path, **more):
    return backfill.Runner(engine, table, str(tmp_path / "state"), str(tmp_path / "out"), **more)


@pytest.fixture
def legacy(spark, plain, tmp_path):
    """The table with v as bytes, one value of a future format."""
    df = plain.withColumn("v", F.when(F.col("id") == 3, F.encode(F.lit("\2" + "x" * 200), "UTF-8")).otherwise(F.encode("v", "UTF-8")))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("laid_out", [False, True])
def test_a_killed_run_is_resumed(spark, engine, legacy, tmp_path, laid_out):
    first = runner(engine, TABLE, tmp_path)
    run = first.start("encrypt", legacy, ranges=4)
    assert run.ranges == 4
    if laid_out:
        run = first.lay_out(run, legacy)
        assert first.lay_out(run, legacy).source == run.source
    run = first.work(run, legacy, only=2)
    assert run.status == "running" and len(run.committed) == 2
    with pytest.raises(ConfigurationError):
        first.start("encrypt", legacy)
    other = Table("t", b"t" * 16, (Column("v", b"v" * 16, "string", Index(bits=8, population=1500, suite=0xFF01)),), pk=("id",))
    with pytest.raises(ConfigurationError, match="columns/0"):
        runner(engine, other, tmp_path).resume(run.run_id)
    second = runner(engine, TABLE, tmp_path)
    done = second.work(second.resume(run.run_id), legacy)
    assert [done.committed[k]["folder"] for k in sorted(run.committed)] == [run.committed[k]["folder"] for k in sorted(run.committed)]
    report = second.report(done)
    assert report["status"] == "complete" and report["values"] == {"null": 8, "current": 0, "anomalous": 0, "written": 31, "failed": 1} and report["warning"]
    assert report["failures_by_code"] == {"UNKNOWN_FORMAT_VERSION": 1} and report["rows"] == 40
    assert [tuple(r) for r in second.quarantine(done).collect()] == [(3, "v", "UNKNOWN_FORMAT_VERSION")]
    with pytest.raises(ConfigurationError, match="other indexes"):
        runner(engine, other, tmp_path).start("encrypt", legacy)
    sealed = second.result(done)
    assert sorted(r["id"] for r in SealedFrame(engine, sealed, TABLE).filter(ref("v").eq("v7")).df.collect()) == [7]
    again = {r["column"]: tuple(r)[1:] for r in backfill.counts(sealed, TABLE).collect()}
    assert again == {"v": (8, 31, 0, 1)}
    assert sealed.select("id").distinct().count() == sealed.count() == 40


def test_two_runners_of_one_run(engine, legacy, tmp_path):
    now = [0.0]
    one, two = (runner(engine, TABLE, tmp_path, holder=h, lease=10.0, clock=lambda: now[0]) for h in ("one", "two"))
    run = one.claim(one.start("encrypt", legacy, ranges=3).run_id)
    with pytest.raises(backfill.LostRun, match="held by another"):
        two.work(run, legacy)
    with pytest.raises(backfill.LostRun):
        two.abandon(run.run_id)
    now[0] = 11.0
    two.claim(run.run_id)
    with pytest.raises(backfill.LostRun, match="taken over"):
        one._range(run, 0, backfill.in_range(legacy, TABLE.pk, run.splits, 0))
    done = two.work(run, legacy)
    assert done.status == "complete" and two.result(done).count() == 40
    with pytest.raises(ConfigurationError):
        one.resume(run.run_id)
    later = two.start("encrypt", two.result(done), ranges=2)
    two.abandon(later.run_id)
    assert [r.status for r in one.runs()] == ["complete", "abandoned"]


def test_too_many_failures_stop_a_run_between_ranges(spark, engine, tmp_path):
    rows = spark.range(30).select("id", F.when(F.col("id") < 15, F.lit(b"\xff")).otherwise(F.encode(F.lit("ok"), "UTF-8")).alias("v"))
    one = runner(engine, TABLE, tmp_path)
    run = one.work(one.start("encrypt", rows, ranges=6), rows, max_failures=7)
    assert run.status == "running" and len(run.committed) == 2 and run.total("failures") == {(b"v" * 16).hex(): {"RENDERING_REFUSED": 10}}
    run = one.work(run, rows, max_failures=7)
    assert run.status == "complete" and one.report(run)["failures_by_code"] == {"RENDERING_REFUSED": 15} and one.report(run)["values"]["written"] == 15


def test_log_entries_are_written_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from sealcol.operators.runlog import RunLog

    path = str(tmp_path / "log of runs")
    assert RunLog(spark, path).entries() == []
    logs = [RunLog(spark, path) for _ in range(4)]
    for number in range(3):
        with ThreadPoolExecutor(4) as pool:
            won = list(pool.map(lambda k: logs[k].append(number, {"by": k, "n": number}), range(4)))
        assert sum(won) == 1
        assert all(log.entries()[number] == {"by": won.index(True), "n": number} for log in logs)
    assert not [x for x in (tmp_path / "log of runs").iterdir() if x.name.endswith(".tmp")]
    assert logs[0].append(5, {"by": 9})
    with pytest.raises(ValueError, match="lacks an entry"):
        logs[1].entries()


@pytest.mark.parametrize("pk", [("name",), ("n", "name"), ("raw",), ("day",)])
def test_ranges_cover_every_row_once(spark, pk):
    rows = spark.range(200).select((F.col("id") % 7).cast("decimal(10,2)").alias("n"), F.concat(F.lit("it's "), F.col("id") % 50).alias("name"), F.unhex(F.hex(F.col("id") % 90)).alias("raw"), F.expr("date'2024-01-01' + cast(id % 40 as int)").alias("day"))
    if len(pk) == 1:
        rows = rows.unionByName(rows.limit(3).withColumn(pk[0], F.lit(None).cast(rows.schema[pk[0]].dataType)))
    splits = backfill.splits_of(rows, pk, 5)
    assert 2 <= len(splits) <= 4
    parts = [backfill.in_range(rows, pk, splits, k) for k in range(len(splits) + 1)]
    assert sum(p.count() for p in parts) == rows.count()
    for k, p in enumerate(parts):
        assert 0 < p.count() == rows.filter(backfill.range_of(rows, pk, splits) == k).count()


def test_each_failure_has_its_code_and_keeps_its_bytes(spark, engine, tmp_path):
    table = Table("t", b"t" * 16, (Column("v", b"v" * 16, "int"), Column("w", b"w" * 16, "string", INDEX)), pk=("id",), tenant="org")
    rows = spark.createDataFrame([(1, "a", b"12", b"x"), (2, None, b"12", b"x"), (3, "", b"1", None), (4, "a", b"012", b"\xff"), (5, None, b"zz", b"y"), (6, "a", None, b"0123456789ABC"), (7, "b", b"-5", b"y")], "id long, org string, v binary, w binary")
    short = Engine(spark, DerivedKeyProvider(ROOT), arm_provisional=True, max_plaintext=12)
    one = runner(short, table, tmp_path)
    run = one.work(one.start("encrypt", rows, ranges=2), rows)
    got = sorted(tuple(r) for r in one.quarantine(run).collect())
    assert got == [(2, "v", "CONTEXT_UNAVAILABLE"), (2, "w", "CONTEXT_UNAVAILABLE"), (3, "v", "CONTEXT_UNAVAILABLE"), (4, "v", "RENDERING_REFUSED"), (4, "w", "RENDERING_REFUSED"), (5, "v", "CONTEXT_UNAVAILABLE"), (5, "w", "CONTEXT_UNAVAILABLE"), (6, "w", "LENGTH_EXCEEDED")]
    before = {r["id"]: r for r in rows.collect()}
    after = {r["id"]: r for r in one.result(run).collect()}
    assert all(after[i][c] == before[i][c] for i, c, _ in got) and all(after[i]["w_bidx"] is None for i, c, _ in got if c == "w")
    assert after[6]["v"] is None and after[3]["w"] is None
    opened = Engine(spark, DerivedKeyProvider(ROOT)).open(one.result(run).filter("id in (1, 7)"), table, ("v", "w"))
    assert sorted((r["id"], r["v"], r["w"]) for r in opened.collect()) == [(1, 12, "x"), (7, -5, "y")]


def test_a_rotation_leaves_what_it_cannot_open(spark, engine, plain, tmp_path):
    sealed = engine.seal(plain, TABLE)
    sealed.write.parquet(str(tmp_path / "a"))
    sealed = spark.read.parquet(str(tmp_path / "a"))
    e = F.col("v")
    n = F.octet_length("v")
    broken = F.when(F.col("id") == 1, F.concat(F.substring(e, F.lit(1), n - 1), F.lit(b"\0\1"))).when(F.col("id") == 2, F.concat(F.substring(e, 1, 3), F.lit(b"?" * 16), F.substring(e, F.lit(20), n))).when(F.col("id") == 4, F.lit(b"\2" * 130)).when(F.col("id") == 6, F.lit(b"plain")).otherwise(e)
    mixed = sealed.withColumn("v", broken)
    newer = Engine(spark, DerivedKeyProvider(ROOT, (1, 2)), arm_provisional=True)
    one = runner(newer, TABLE, tmp_path)
    run = one.work(one.start("rotate", mixed, ranges=2), mixed)
    report = one.report(run)
    assert report["status"] == "complete" and report["warning"] and report["values"] == {"null": 8, "current": 0, "anomalous": 1, "written": 28, "failed": 3}
    assert dict((r["id"], r["code"]) for r in one.quarantine(run).collect()) == {1: "COMMITMENT_INVALID", 2: "KEY_UNAVAILABLE", 4: "UNKNOWN_FORMAT_VERSION"}
    both = one.result(run).join(mixed.select("id", F.col("v").alias("old")), "id")
    assert sorted(r["id"] for r in both.filter("v = old").collect()) == [1, 2, 4, 6]
    again = one.start("rotate", one.result(run), ranges=1)
    assert one.report(one.work(again, one.result(run)))["values"] == {"null": 8, "current": 28, "anomalous": 1, "written": 0, "failed": 3}


def test_rotation_touches_old_envelopes_only(spark, engine, plain, tmp_path):
    engine.seal(plain.filter("id < 20"), TABLE).write.parquet(str(tmp_path / "a"))
    newer = Engine(spark, DerivedKeyProvider(ROOT, (1, 2)), arm_provisional=True)
    newer.seal(plain.filter("id >= 20"), TABLE).write.parquet(str(tmp_path / "b"))
    df = spark.read.parquet(str(tmp_path / "a"), str(tmp_path / "b"))
    assert backfill.rotation_pending(newer, df, TABLE).first()["n_pending"] == 16
    newer.rotate_table(df, TABLE).write.parquet(str(tmp_path / "c"))
    out = spark.read.parquet(str(tmp_path / "c"))
    same = out.join(df.select("id", F.col("v").alias("old"), F.col("v_bidx").alias("oldx")), "id")
    assert same.filter("id >= 20 and not (v <=> old)").count() == 0 and same.filter("id < 20 and v <=> old and v is not null").count() == 0
    assert same.filter("not (v_bidx <=> oldx)").count() == 0
    assert backfill.rotation_pending(newer, out, TABLE).first()["n_pending"] == 0
    assert [tuple(r) for r in backfill.verify(newer, out, TABLE, plain).collect()] == [("v", "OK", 32)]


def test_two_column_shape(spark, engine, plain, tmp_path):
    t = Table("t", b"u" * 16, (Column("sealed_v", b"w" * 16, "string", INDEX, source="v"),), pk=("id",))
    plain.write.parquet(str(tmp_path / "in"))
    backfill.encrypt(engine, spark.read.parquet(str(tmp_path / "in")), t).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.filter("v is not null and sealed_v is null").count() == 0 and out.filter("v is null and sealed_v is not null").count() == 0
    assert SealedFrame(engine, out, t).decrypted().filter("not (v <=> sealed_v)").count() == 0
    assert backfill.encrypt(engine, out, t).join(out.select("id", F.col("sealed_v").alias("o")), "id").filter("not (sealed_v <=> o)").count() == 0


@pytest.mark.parametrize("storage, form", [("base64", "hex"), ("binary", "binary")])
def test_storage_forms_sinks_and_views(spark, engine, plain, tmp_path, storage, form):
    t = Table("t", b"x" * 16, (Column("v", b"y" * 16, "string", Index(bits=9, population=1500, suite=0xFF01, as_hex=form == "hex"), storage=storage),), pk=("id",))
    f = tables.write(engine, plain, t, str(tmp_path / "w"), cluster_by="v")
    assert f.filter(ref("v").eq("v8")).count() == 1
    tables.dump(f, str(tmp_path / "d"))
    assert tables.read(engine, t, str(tmp_path / "d")).decrypted().filter("v = 'v9'").count() == 1
    tables.expose(f, "opened")
    assert spark.sql("select count(v) n from opened").first()["n"] == 32
    newer = Engine(spark, DerivedKeyProvider(ROOT, (1, 2)), arm_provisional=True)
    assert SealedFrame(newer, newer.rotate_table(f.df, t), t).decrypted().filter("v = 'v9'").count() == 1


def test_streams(spark, engine, plain, tmp_path):
    plain.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(plain.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        seal_stream(engine, stream, TABLE, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    f = SealedFrame(engine, read_sealed(engine, TABLE, str(tmp_path / "out")), TABLE)
    assert f.df.count() == 40 and f.filter(ref("v").eq("v11")).count() == 1


def test_reports_are_compared(spark):
    a = spark.createDataFrame([("x", "ok"), ("y", "ok")], "id string, outcome string")
    b = spark.createDataFrame([("x", "ok"), ("z", "ok")], "id string, outcome string")
    assert sorted(r["id"] for r in backfill.compare_reports(a, b).collect()) == ["y", "z"]


def test_queries_of_the_operators_cover_whole_tables(spark):
    from sealcol import queries

    sf = "/root/testdata/sf0.001"
    customers = {r["c_custkey"]: r["c_name"] if r["c_custkey"] % 7 else None for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    assert {r["c_custkey"]: r["c_name"] for r in queries.row_bound_open(spark, sf).collect()} == customers
    orders = [(r["o_orderkey"], r["o_custkey"]) for r in spark.read.parquet(f"{sf}/orders.parquet").collect()]
    want = sorted((o, 1 if customers.get(c) else None) for o, c in orders)
    assert sorted(tuple(r) for r in queries.nested_include_verified(spark, sf).collect()) == want
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "value")
    assert sorted(tuple(r) for r in queries.stream_sealed(spark, sf).collect()) == sorted(tuple(r) for r in events.collect())


def test_keys_of_many_scopes_are_all_warm(spark):
    """A job of more scopes than the cache holds has all its keys; the next job's make room."""
    from sealcol.plans.keys import EnvelopeKeyProvider, KeyCache, KeyDirectory, WrappedKey

    class Plain:
        def unwrap(self, wrapped):
            return wrapped

    scopes = [b"%05d" % i for i in range(5000)]
    keys = [WrappedKey(s, 1, s.rjust(16, b"k"), s.rjust(32, b"d")) for s in scopes]
    provider = EnvelopeKeyProvider(KeyDirectory(keys, {s: s.rjust(32, b"i") for s in scopes}), Plain(), KeyCache(capacity=1000))
    provider.warm(scopes)
    assert all(provider.data_keys(s) and provider.index_key(s) for s in scopes)
    engine = Engine(spark, provider, arm_provisional=True)
    table = Table("many", b"m" * 16, (Column("v", b"v" * 16, "string", INDEX),), pk=("id",), tenant="org")
    df = spark.createDataFrame([(i, s.decode(), f"v{i % 7}") for i, s in enumerate(scopes)], "id long, org string, v string")
    f = SealedFrame(engine, engine.seal(df, table).cache(), table)
    assert f.decrypted("v").filter("v = 'v3'").count() == sum(i % 7 == 3 for i in range(5000))
    assert f.filter(ref("v").eq("v3")).count() == sum(i % 7 == 3 for i in range(5000))
    provider.warm(scopes[:10])
    assert len(provider.cache._held) <= 1020 and all(provider.data_keys(s) for s in scopes[:10])
