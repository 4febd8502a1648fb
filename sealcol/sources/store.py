"""An append-only store of sealed rows with a budget of uses for each data key.

How often a key has sealed a value is known nowhere but in what was written: executors seal, and a retried task seals anew. So a
batch is written first, its envelopes are counted by the key ids in their headers, without opening any, and the batch becomes part of
the store by one entry of a commit log, unless a key's uses over all committed batches would exceed the budget. Uses are rows of a
table beside the data, however many keys there are; none of them comes to the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine, check_metadata
from ..errors import ConfigurationError, SealError
from ..functions.envelope import header_col
from ..operators.census import stored
from ..operators.frame import SealedFrame
from ..operators.runlog import RunLog
from ..plans.declare import Table

USES = "key_id binary, n long"


class SealedStore:
    """``max_uses``: values that one key may seal over all batches; None counts without a limit."""

    def __init__(self, engine: Engine, table: Table, path: str, max_uses: int | None = None):
        if max_uses is not None and max_uses < 1:
            raise ConfigurationError("a budget of uses is positive")
        self.engine, self.table, self.path, self.max_uses = engine, table, path.rstrip("/"), max_uses
        self.log = RunLog(engine.spark, f"{self.path}/log")

    def _uses_of(self, sealed: DataFrame) -> DataFrame:
        """Envelopes by key, of all sealed columns in one pass over their headers."""
        headers = F.array_compact(F.array(*[header_col(stored(self.table, c.name)) for c in self.table.columns]))
        return sealed.select(F.explode(headers).alias("h")).groupBy(F.col("h.key_id").alias("key_id")).agg(F.count(F.lit(1)).alias("n"))

    def _committed(self, entries: list[dict]) -> DataFrame:
        spark, folders = self.engine.spark, [e["folder"] for e in entries]
        return spark.read.schema(USES).parquet(*[f"{f}/uses" for f in folders]) if folders else spark.createDataFrame([], USES)

    def uses(self) -> DataFrame:
        """key_id and how many committed values it has sealed."""
        return self._committed(self.log.entries()).groupBy("key_id").agg(F.sum("n").alias("n"))

    def append(self, df: DataFrame) -> int:
        """Seals plain rows and commits them; gives the batch's number. A refused batch is in no entry, and is never read."""
        folder = f"{self.path}/batch-{uuid.uuid4().hex}"
        self.engine.seal(df, self.table).write.parquet(f"{folder}/rows")
        self._uses_of(self.engine.spark.read.parquet(f"{folder}/rows")).write.parquet(f"{folder}/uses")
        own = self.engine.spark.read.schema(USES).parquet(f"{folder}/uses")
        while True:
            entries = self.log.entries()
            if self.max_uses is not None:
                held = self._committed(entries).join(own.select("key_id"), "key_id", "left_semi")
                over = held.unionByName(own).groupBy("key_id").agg(F.sum("n").alias("n")).filter(F.col("n") > self.max_uses)
                if not over.isEmpty():
                    raise SealError("KEY_UNAVAILABLE", f"a key would have sealed more than {self.max_uses} values; rotate it, the batch is not committed")
            if self.log.append(len(entries), {"folder": folder}):
                return len(entries)
            # another batch was committed in between: its uses count too

    def read(self) -> SealedFrame:
        """The rows of all committed batches."""
        folders = [e["folder"] for e in self.log.entries()]
        if not folders:
            raise ConfigurationError("nothing is committed yet")
        df = self.engine.spark.read.parquet(*[f"{f}/rows" for f in folders])
        check_metadata(df, self.table)
        return SealedFrame(self.engine, df, self.table)
