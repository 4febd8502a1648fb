"""Sealed tables in files and databases. Declarations travel in the schema; sealing is done once, by writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine, check_metadata
from ..operators.frame import SealedFrame
from ..plans import lineage
from ..plans.declare import Table


def write(engine: Engine, df: DataFrame, table: Table, path: str, *, mode: str = "errorifexists", cluster_by: str | None = None, files: int | None = None) -> SealedFrame:
    """Seal and write Parquet; clustered by a column's index values, row groups that hold no candidate are skipped."""
    sealed = engine.seal(df, table)
    if cluster_by:
        sibling = table.column(cluster_by).sibling
        sealed = (sealed.repartitionByRange(files, sibling) if files else sealed.repartitionByRange(sibling)).sortWithinPartitions(sibling)
    sealed.write.mode(mode).parquet(path)
    return read(engine, table, path)


def read(engine: Engine, table: Table, path: str) -> SealedFrame:
    df = engine.spark.read.parquet(path)
    check_metadata(df, table)
    return SealedFrame(engine, df, table)


def read_jdbc(engine: Engine, table: Table, url: str, dbtable: str, **options: str) -> SealedFrame:
    """A sealed table in a database; index predicates are pushed down as equality on the index column."""
    reader = engine.spark.read.format("jdbc").option("url", url).option("dbtable", dbtable)
    return SealedFrame(engine, reader.options(**options).load(), table)


def write_jdbc(frame: SealedFrame, url: str, dbtable: str, mode: str = "append", **options: str) -> None:
    """Stored bytes as they are."""
    frame.df.write.format("jdbc").option("url", url).option("dbtable", dbtable).options(**options).mode(mode).save()


def dump(frame: SealedFrame, path: str) -> None:
    """Copy stored bytes verbatim; nothing is opened."""
    frame.df.write.parquet(path)


def text_to_binary(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns as the bytes of their UTF-8, the form that in-place jobs take."""
    return df.withColumns({c: F.encode(F.col(f"`{c}`"), "UTF-8") for c in columns})


def expose(frame: SealedFrame, name: str, *columns: str) -> None:
    """A view of the table's plain columns and these opened ones, for SQL."""
    frame.decrypted(*columns).createOrReplaceTempView(name)


def expose_sealed(frame: SealedFrame, name: str) -> None:
    """A view of stored bytes: SQL over it sees envelopes only. ``sql`` refuses what would read them as values."""
    frame.df.createOrReplaceTempView(name)


def sql(text: str, **frames: SealedFrame) -> DataFrame:
    """The rows of a query over views of sealed tables, by their names, if it only passes envelopes on, counts them or tests them for null.

    Any other reading, under whatever name and however deep, is refused before anything runs.
    """
    for name, frame in frames.items():
        expose_sealed(frame, name)
    spark = next(iter(frames.values())).engine.spark
    return lineage.guard(spark.sql(text), {name: f.table for name, f in frames.items()})
