"""Canonical bytes of the eight logical types, and back.

Readers are as strict as writers: what a reader gives must render to the bytes it was read from. All types but ``float`` are
Catalyst expressions; ``float`` needs the shortest digits that the JVM's cast does not give. NULL is never encoded.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError
from .crypto import let

LOGICAL = ("string", "bytes", "int", "decimal", "float", "boolean", "date", "datetime")
DATE, DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z$"


def logical_type(t: T.DataType) -> str:
    """The logical type of a Spark type; anything else is refused."""
    if isinstance(t, T.TimestampNTZType):
        raise ConfigurationError("a timestamp without time zone is no instant; convert it first")
    for name, kinds in {"string": (T.StringType,), "bytes": (T.BinaryType,), "boolean": (T.BooleanType,), "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "float": (T.FloatType, T.DoubleType), "date": (T.DateType,), "datetime": (T.TimestampType,)}.items():
        if isinstance(t, kinds):
            return name
    if isinstance(t, T.DecimalType):
        return "decimal"
    raise ConfigurationError(f"{t.simpleString()} has no canonical form")


def opening_type(logical: str, wide: str | None = None) -> T.DataType:
    """The type that a logical type opens to; ``wide`` names another one for ints and decimals."""
    if wide is not None:
        t = T.DataType.fromDDL(wide)
        if not isinstance(t, T.DecimalType) or logical not in ("int", "decimal") or (logical == "int" and t.scale):
            raise ConfigurationError(f"{logical} does not open as {wide}")
        return t
    return {"string": T.StringType(), "bytes": T.BinaryType(), "int": T.LongType(), "decimal": T.DecimalType(38, 18), "float": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampType()}[logical]


def float_text(x: float) -> str:
    """The shortest digits that round-trip, plain from 1e-6 to below 1e21, else with an exponent; -0 keeps its sign."""
    if math.isnan(x) or math.isinf(x):
        raise ValueError("not a finite number", raises)
    sign = "-" if math.copysign(1, x) < 0 else ""
    if x == 0:
        return sign + "0"
    _, digits, exp = Decimal(repr(abs(x))).as_tuple()
    s = "".join(map(str, digits)).rstrip("0")
    point = exp + len(digits)  # places before the decimal point
    k = len(s)
    if k <= point <= 21:
        return sign + s + "0" * (point - k)
    if 0 < point <= 21:
        return sign + s[:point] + "." + s[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + s
    e = point - 1
    return sign + s[0] + ("." + s[1:] if k > 1 else "") + "e" + ("+" if e > 0 else "-") + str(abs(e))


def _short_text(x: float) -> str:
    """float_text(); the digits of repr() are the shortest, and plain from 1e-4 to below 1e16."""
    s = repr(x)
    if "e" in s:
        return float_text(x)
    return s[:-2] if s.endswith(".0") else s


@F.pandas_udf(T.StringType())
def _float_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for p in parts:
        yield pd.Series([_short_text(v) if v is not None and math.isfinite(v) else None for v in p.tolist()], dtype=object)


def refusal(what: str, t: T.DataType | str, raises: bool) -> Column:
    """What stands for a value that has no canonical form: an error, or null where errors are values."""
    return F.raise_error(F.lit(f"RENDERING_REFUSED: {what}")).cast(t) if raises else F.lit(None).cast(t)


def _refuse(condition: Column, c: Column, what: str, raises: bool) -> Column:
    return F.when(condition, refusal(what, "string", raises)).otherwise(c)


def plain_digits(c: Column, t: T.DataType) -> Column:
    """A number's text without closing zeros. Its type tells whether there is a point; the number is rendered once, without a pattern."""
    s = c.cast("string")
    return F.rtrim(F.rtrim(s, F.lit("0")), F.lit(".")) if isinstance(t, T.DecimalType) and t.scale > 0 else s


def holds(t: T.DataType, source: T.DataType) -> bool:
    """Whether every value of a source type is a value of t."""
    digits = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
    of = lambda x: (x.precision - x.scale, x.scale) if isinstance(x, T.DecimalType) else (digits[type(x)], 0)
    if not isinstance(t, T.DecimalType):
        return type(source) in digits
    return all(a >= b for a, b in zip(of(t), of(source)))


def fitting(c: Column, source: T.DataType, t: T.DataType, raises: bool = True) -> Column:
    """An int or decimal column, refusing values that would open to something else."""
    if holds(t, source):
        return c
    same = plain_digits(c.try_cast(t), t) == plain_digits(c, source)  # as numbers they would be rounded first
    return F.when(c.isNotNull() & ~F.coalesce(same, F.lit(False)), refusal(f"no {t.simpleString()} is this number", source, raises)).otherwise(c)


def canonical_bytes(value: object, logical: str) -> bytes:
    """One value's canonical bytes, on the driver."""
    if logical == "bytes":
        return bytes(value)
    if logical == "string":
        return value.encode()
    if logical == "boolean":
        return b"true" if value else b"false"
    if logical == "int":
        return str(int(value)).encode()
    if logical == "decimal":
        text = format(Decimal(value), "f")
        text = text.rstrip("0").rstrip(".") if "." in text else text
        return b"0" if text in ("-0", "") else text.encode()
    if logical == "float":
        return float_text(float(value)).encode()
    if logical == "date":
        return value.isoformat().encode()
    at = value.astimezone(datetime.timezone.utc)
    return (at.strftime("%Y-%m-%dT%H:%M:%S").rjust(19, "0") + f".{at.microsecond:06d}Z").encode()


def render(c: Column, t: T.DataType, raises: bool = True) -> Column:
    """A column's canonical bytes. ``raises=False``: null for a value that has none."""
    kind = logical_type(t)
    if kind == "bytes":
        return c
    if kind == "string":
        return F.encode(c, "UTF-8")
    s = c.cast("string")
    if kind == "decimal":
        s = plain_digits(c, t)
    elif kind == "float":
        d = c.cast("double")
        s = _refuse(F.isnan(d) | F.abs(d).eqNullSafe(F.lit(float("inf"))), _float_text(d), "not a finite number", raises)
    elif kind == "date":
        s = _refuse((F.year(c) < 1) | (F.year(c) > 9999), s, "a year outside 0001 to 9999", raises)
    elif kind == "datetime":
        utc = F.to_utc_timestamp(c, F.current_timezone())
        s = _refuse((F.year(utc) < 1) | (F.year(utc) > 9999), F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "a year outside 0001 to 9999", raises)
    return F.encode(s, "UTF-8")


def parse(b: Column, logical: str, t: T.DataType | None = None, raises: bool = True) -> Column:
    """The value of canonical bytes; bytes that are not canonical are an error, or with ``raises=False`` null."""
    t = t or opening_type(logical)
    if logical == "bytes":
        return b

    def decoded(raw: Column) -> Column:
        s = raw.cast("string")
        return F.when(raw.isNotNull() & ~F.is_valid_utf8(s), refusal(f"not UTF-8 ({logical})", "string", raises)).otherwise(s)

    text = let(b, decoded)
    if logical == "string":
        return text

    def strict(s: Column, valid: Column, value: Column) -> Column:
        return F.when(s.isNull(), F.lit(None).cast(t)).when(valid, value).otherwise(refusal(f"not canonical ({logical})", t, raises))

    def checked(pattern: str, value) -> Column:
        return let(text, lambda s: let(value(s), lambda v: strict(s, s.rlike(pattern) & v.isNotNull(), v)))

    if logical == "boolean":
        return let(text, lambda s: strict(s, s.isin("true", "false"), s == "true"))
    if logical in ("int", "decimal"):
        # what is not canonical, or not held exactly by the type, renders to other bytes
        return let(text, lambda s: let(s.try_cast(t), lambda v: strict(s, F.coalesce(plain_digits(v, t) == s, F.lit(False)), v)))
    if logical == "float":
        value = text.try_cast("double")
        return strict(text, F.coalesce(_float_text(value) == text, F.lit(False)), value.cast(t))
    if logical == "date":
        return checked(DATE, lambda s: s.try_cast("date"))
    return checked(DATETIME, lambda s: F.from_utc_timestamp(F.try_to_timestamp(F.substring(s, 1, 26)), F.current_timezone()))
