import datetime as dt
import math
from decimal import Decimal, localcontext

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealcol.errors import ConfigurationError
from sealcol.functions.codec import canonical_bytes, fitting, float_text, holds, logical_type, opening_type, parse, render

UTC = dt.timezone.utc
CASES = [
    ("string", T.StringType(), ["", "é\n", None], ["", "é\n", None]),
    ("bytes", T.BinaryType(), [bytearray(b"\x00a"), None], ["\x00a", None]),
    ("int", T.LongType(), [0, -5, 2**63 - 1, None], ["0", "-5", "9223372036854775807", None]),
    ("decimal", T.DecimalType(38, 18), [Decimal("1.50"), Decimal("100"), Decimal("0"), Decimal("-0.000001"), None], ["1.5", "100", "0", "-0.000001", None]),
    ("float", T.DoubleType(), [1.0, -0.0, 1e21, 1e-7, 0.1, 1234567895.5, 5e-324, None], ["1", "-0", "1e+21", "1e-7", "0.1", "1234567895.5", "5e-324", None]),
    ("boolean", T.BooleanType(), [True, False, None], ["true", "false", None]),
    ("date", T.DateType(), [dt.date(1, 1, 1), dt.date(9999, 12, 31), None], ["0001-01-01", "9999-12-31", None]),
    ("datetime", T.TimestampType(), [dt.datetime(2020, 2, 29, 1, 2, 3, 4, UTC), dt.datetime(1969, 12, 31, 23, 59, 59, 999999, UTC), None], ["2020-02-29T01:02:03.000004Z", "1969-12-31T23:59:59.999999Z", None]),
]


@pytest.mark.parametrize("logical, t, values, texts", CASES, ids=[c[0] for c in CASES])
def test_canonical_forms_round_trip(spark, logical, t, values, texts):
    assert logical_type(t) == logical
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.LongType()), T.StructField("v", t)]))
    rendered = df.select("i", "v", render(F.col("v"), t).alias("b"))
    got = rendered.select("i", "b", render(parse(F.col("b"), logical, t), t).alias("again")).orderBy("i").collect()
    assert [None if r["b"] is None else bytes(r["b"]).decode() for r in got] == texts
    assert [r["again"] for r in got] == [r["b"] for r in got]


BAD = {"int": ["+1", "01", "-0", "", "1.0"], "decimal": ["1.50", "1.", ".5", "1E2", "-0"], "float": ["1.0", "1e21", "NaN", "0.10", "01"], "boolean": ["True", "1"], "date": ["2020-2-29", "2021-02-29", "2020-02-29 "], "datetime": ["2020-02-29T01:02:03Z", "2020-02-29T01:02:03.000004", "2020-02-30T01:02:03.000004Z"]}


@pytest.mark.parametrize("logical, text", [(k, x) for k, own in BAD.items() for x in own])
def test_readers_are_strict(spark, logical, text):
    df = spark.createDataFrame([(bytearray(text.encode()),)], "b binary")
    with pytest.raises(Exception, match="RENDERING_REFUSED"):
        df.select(parse(F.col("b"), logical)).collect()


@pytest.mark.parametrize("logical, text", [("int", "99999999999999999999"), ("decimal", "1.1234567890123456789"), ("decimal", "123456789012345678901")])
def test_what_the_opening_type_does_not_hold_is_refused_not_rounded(spark, logical, text):
    """Canonical, and read by a wider type."""
    df = spark.createDataFrame([(bytearray(text.encode()),)], "b binary")
    with pytest.raises(Exception, match="RENDERING_REFUSED"):
        df.select(parse(F.col("b"), logical)).collect()
    wide = opening_type(logical, "decimal(38,0)" if logical == "int" else "decimal(38,19)" if "." in text else "decimal(38,2)")
    assert Decimal(text) == df.select(parse(F.col("b"), logical, wide).alias("v")).first()["v"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 38).flatmap(lambda p: st.tuples(st.just(p), st.integers(0, p), st.lists(st.integers(-(10**p) + 1, 10**p - 1), min_size=1, max_size=8))))
def test_decimals_of_any_precision_and_scale_open_to_what_was_sealed(spark, case):
    p, s, numbers = case
    t = T.DecimalType(p, s)
    with localcontext() as c:
        c.prec = 60
        values = [Decimal(n).scaleb(-s) for n in numbers]
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", t)]))
    rows = df.select("v", render(F.col("v"), t).alias("b")).select("v", "b", parse(F.col("b"), "decimal", t).alias("again")).collect()
    assert all(r["v"] == r["again"] and bytes(r["b"]) == canonical_bytes(r["v"], "decimal") for r in rows)


def test_values_that_would_open_to_others_are_refused_on_sealing(spark):
    wide = T.DecimalType(38, 25)
    df = spark.createDataFrame([(Decimal("1.5"),), (None,)], T.StructType([T.StructField("v", wide)]))
    assert [r["v"] for r in df.select(fitting(F.col("v"), wide, T.DecimalType(38, 18)).alias("v")).collect()] == [Decimal("1.5"), None]
    bad = spark.createDataFrame([(Decimal("1.1234567890123456789012345"),)], T.StructType([T.StructField("v", wide)]))
    with pytest.raises(Exception, match="RENDERING_REFUSED"):
        bad.select(fitting(F.col("v"), wide, T.DecimalType(38, 18))).collect()
    assert fitting(F.lit(1), T.LongType(), T.LongType()) is not None and not holds(T.LongType(), T.DecimalType(10, 0))
    for logical, name in (("int", "decimal(10,2)"), ("string", "decimal(10,0)"), ("int", "bigint")):
        with pytest.raises(ConfigurationError):
            opening_type(logical, name)


@pytest.mark.parametrize("logical, t, values, texts", CASES, ids=[c[0] for c in CASES])
def test_one_value_on_the_driver_renders_alike(logical, t, values, texts):
    assert [None if v is None else canonical_bytes(v, logical).decode() for v in values] == texts


def test_not_utf8_and_not_finite_are_refused(spark):
    with pytest.raises(Exception, match="RENDERING_REFUSED"):
        spark.createDataFrame([(bytearray(b"\xff"),)], "b binary").select(parse(F.col("b"), "string")).collect()
    for x in (math.nan, math.inf, -math.inf):
        with pytest.raises(Exception, match="RENDERING_REFUSED"):
            spark.createDataFrame([(x,)], "v double").select(render(F.col("v"), T.DoubleType())).collect()


def test_types_without_a_canonical_form_are_refused():
    for t in (T.ArrayType(T.FloatType()), T.TimestampNTZType(), T.MapType(T.StringType(), T.StringType()), T.StructType()):
        with pytest.raises(ConfigurationError):
            logical_type(t)


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_float_text_round_trips(x):
    s = float_text(x)
    assert float(s) == x and math.copysign(1, float(s)) == math.copysign(1, x)
    assert "e" not in s or abs(x) >= 1e21 or abs(x) < 1e-6


@pytest.mark.parametrize("text", ["0", "-0.5", "100", "-100.25", "0.0000000000000000000000001", "9999999999999.9999999999999999999999999"])
def test_decimals_are_rendered_once_and_without_a_pattern(spark, text):
    """Sealing and opening: a cast to text for each time that a number is rendered, where there were six."""
    t = T.DecimalType(38, 25)
    df = spark.range(1).select(F.lit(text).cast(t).alias("v"))
    rendered = df.select(render(F.col("v"), t).alias("b"))
    assert bytes(rendered.first()["b"]) == text.encode()
    again = rendered.select(parse(F.col("b"), "decimal", t).alias("v"))
    assert canonical_bytes(again.first()["v"], "decimal") == text.encode()
    stored = spark.createDataFrame([], T.StructType([T.StructField("v", t), T.StructField("b", T.BinaryType())]))
    plan = stored.select(render(F.col("v"), t).alias("r"), parse(F.col("b"), "decimal", t).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("as string)") - plan.count("x_") <= 4 and "regexp" not in plan and "RLIKE" not in plan
