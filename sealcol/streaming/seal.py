"""Sealing and opening streams. Both are stateless projections; a batch is sealed once, by the write that stores it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import PARTS, Engine
from ..plans.declare import Table


def seal_stream(engine: Engine, stream: DataFrame, table: Table, path: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream's rows, sealed, to Parquet. A batch that is repeated after a failure overwrites its own folder."""
    engine.write_gate("seal")

    def store(batch: DataFrame, number: int) -> None:
        # a batch's size is not known to the optimizer; its files may be fewer than there are cores
        cores = engine.spark.sparkContext.defaultParallelism
        batch = batch.repartition(PARTS * cores) if batch.rdd.getNumPartitions() < PARTS * cores else batch
        engine.seal(batch, table).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_sealed(engine: Engine, table: Table, path: str) -> DataFrame:
    """The sealed rows that a stream has stored."""
    return engine.spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
