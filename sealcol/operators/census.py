"""Header-only counts over sealed columns: no key, no opening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.envelope import header_col, kind_col
from ..plans.declare import Table


def stored(table: Table, name: str):
    c = table.column(name)
    return F.try_to_binary(F.col(f"`{name}`"), F.lit("base64")) if c.storage == "base64" else F.col(f"`{name}`").cast("binary")


def census(df: DataFrame, table: Table) -> DataFrame:
    """One row per sealed column: rows, nulls, envelopes, values that are none."""
    parts = []
    for c in table.columns:
        kind = kind_col(stored(table, c.name))
        is_env = F.coalesce(kind == "envelope", F.lit(False))
        parts.append(F.struct(F.lit(c.name).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(f"`{c.name}`").isNull().cast("long")).alias("n_null"), F.sum(is_env.cast("long")).alias("n_envelope"), F.sum((F.col(f"`{c.name}`").isNotNull() & ~is_env).cast("long")).alias("n_other")))
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def by_key(df: DataFrame, table: Table, column: str) -> DataFrame:
    """Envelopes of a column by suite and key."""
    h = header_col(stored(table, column)).alias("h")
    return df.select(h).filter("h is not null").groupBy("h.suite_id", "h.key_id").agg(F.count(F.lit(1)).alias("n"))


def index_missing(df: DataFrame, table: Table) -> DataFrame:
    """One row per indexed column: envelopes without an index value, and index values without an envelope."""
    parts = [F.struct(F.lit(c.name).alias("column"), F.sum((F.col(c.name).isNotNull() & F.col(c.sibling).isNull()).cast("long")).alias("n_unindexed"), F.sum((F.col(c.name).isNull() & F.col(c.sibling).isNotNull()).cast("long")).alias("n_orphaned")) for c in table.columns if c.index]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
