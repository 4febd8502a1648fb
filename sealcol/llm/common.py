"""Small helpers that the operators share: shared folders, table reading, plan-time checks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, in local mode alone, one of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names the folder that driver and executors share; it is not set")
        at = "file://" + os.path.join(tempfile.gettempdir(), "sealcol-shared")
    return at.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark removes the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Written tables of one run. A table goes when all that is made of it is written: then no plan reads it, and a lost executor asks for nothing older.

    The shuffle files of a write go with its end; elsewhere they stay until the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._at: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As materialise() does, under a name of this run."""
        path = self._at[name] = f"{shared_dir(self._spark)}/{name}-{uuid.uuid4().hex}"
        before = self._spark.conf.get(CLEANUP)
        self._spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self._spark.conf.set(CLEANUP, before)
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more. One that was never written is none."""
        for name in names:
            if name in self._at:
                path = self._spark._jvm.org.apache.hadoop.fs.Path(self._at.pop(name))
                path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df has not, so that an input's own columns never clash with ours."""
    taken = {c.lower() for c in df.columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


def with_fields(df: DataFrame, ddl: str) -> T.StructType:
    """df's schema followed by the fields of ddl."""
    return T.StructType(df.schema.fields + T.StructType.fromDDL(ddl).fields)


def col(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def bucket_of(id_col: str, n: int):
    """crc32 of an id's decimal text, modulo n: the fold a row belongs to. A null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n)), F.lit(0)).cast("int")
