"""SQL over stored bytes: what is refused, and what is not."""

import pytest
from pyspark.sql import functions as F

from sealcol.engine import Engine
from sealcol.errors import NotSupported
from sealcol.operators.frame import SealedFrame
from sealcol.plans import lineage
from sealcol.plans.declare import Column, Index, Table
from sealcol.plans.keys import DerivedKeyProvider
from sealcol.sources import tables

TABLE = Table("t", b"t" * 16, (Column("v", b"v" * 16, "string", Index(bits=9, population=1500, suite=0xFF01)), Column("w", b"w" * 16, "int")), pk=("id",))


@pytest.fixture(scope="module")
def frame(spark, tmp_path_factory):
    engine = Engine(spark, DerivedKeyProvider(bytes(range(32))), arm_provisional=True)
    df = spark.range(12).select("id", F.concat(F.lit("v"), F.col("id") % 4).alias("v"), F.when(F.col("id") % 3 != 0, F.col("id")).cast("long").alias("w"), (F.col("id") % 2).alias("g"))
    path = str(tmp_path_factory.mktemp("lineage") / "t")
    engine.seal(df, TABLE).write.parquet(path)
    return SealedFrame(engine, spark.read.parquet(path), TABLE)


REFUSED = [
    "select * from t order by v", "select v, count(*) from t group by v", "select distinct v from t", "select id from t where v = unhex('00')", "select max(v) from t",
    "select count(distinct w) from t", "select length(v) from t", "select a.id from t a join t b on a.v = b.v", "select id from t where v_bidx = unhex('00')", "select id, row_number() over (order by v) from t",
    "select id, row_number() over (partition by x order by id) from (select id, v as x from t)", "select * from (select v as x, id from t) order by x", "select named_struct('a', v) from t", "select collect_list(v) from t",
    "select id from t where id in (select length(v) from t)", "select id from t where v in (select v from t)", "select v from t intersect select v from t", "select v from t union select w from t",
    "select x from (select id as k, w as x from t union all select id, unhex('00') from t) where x > unhex('00')", "select (select v from t where id = 1) as one", "with c as (select w as z from t) select case when z is null then 1 else hex(z) end from c", "select first(v) from t",
    "select id from t x where exists (select 1 from t y where y.v = x.v)", "select g, min(id) from t group by g having max(w) > unhex('00')", "select t.* from t lateral view explode(array(v)) e as y", "select * from t distribute by v",
]

SERVED = {
    "select count(*) n, count(v) c, count(w) d from t": [(12, 12, 8)],
    "select g, count(w) n from t where v is not null group by g": [(0, 4), (1, 4)],
    "select id from t where w is null order by id": [(0,), (3,), (6,), (9,)],
    "select 'v' as v2, max(id) m from t where 'w' = 'w' group by 1": [("v", 11)],
    "select a.id from (select id, v x, w y from t) a join t b on a.id = b.id + 11 where a.x is not null": [(11,)],
    "select count(x) from (select v x from t union all select w from t)": [(20,)],
    "select v from (select id as v from t) where v > 10": [(11,)],
    "select id from t where exists (select v from t) and id < 1": [(0,)],
}


@pytest.mark.parametrize("text", REFUSED)
def test_readings_of_envelopes_are_refused(frame, text):
    with pytest.raises(NotSupported, match="holds sealed bytes"):
        tables.sql(text, t=frame)


@pytest.mark.parametrize("text", list(SERVED))
def test_what_needs_no_value_is_served(frame, text):
    assert sorted(tuple(r) for r in tables.sql(text, t=frame).collect()) == SERVED[text]


def test_passed_on_envelopes_open_afterwards(frame):
    out = tables.sql("select t.id, t.v, t.w from t join (select id k from t where g = 1) o on t.id = o.k", t=frame)
    opened = frame.engine.open(out, TABLE, ("v", "w"))
    assert sorted((r["id"], r["v"]) for r in opened.collect()) == [(i, f"v{i % 4}") for i in range(1, 12, 2)]


def test_other_views_are_not_its_business(spark, frame):
    spark.range(5).select(F.col("id").alias("v")).createOrReplaceTempView("plain_v")
    assert tables.sql("select max(v) m from plain_v", t=frame).first()["m"] == 4


def test_frames_by_what_is_added_to_them(frame):
    for add in (lambda d: d.filter(F.col("v") == F.lit(b"")), lambda d: d.withColumnRenamed("v", "x").orderBy("x"), lambda d: d.groupBy("g").agg(F.max("v_bidx")), lambda d: d.select(F.hex("w"))):
        with pytest.raises(NotSupported):
            lineage.guard_over(add(frame.df), frame.df, TABLE)
    kept = lineage.guard_over(frame.df.filter((F.col("g") == 1) & F.col("v").isNotNull()).select("id", F.col("v").alias("x")), frame.df, TABLE)
    assert kept.count() == 6
