"""Exact dedup over a persistent digest index: bucketed and sorted by digest, extended by sort-merge anti-join.

Texts are equal when they are identical after deleting space, tab, line feed, vertical tab, form feed and carriage return.
Their digest is SHA-256 of what is left, in UTF-8. Of equal texts the row with the most code points in its original text
is the best, then the smallest id (nulls last), then that of the first batch, then the first as its batch was written.

The index is a table partitioned by batch, with one row a digest and batch: how many rows the batch has of it, its best row,
and whether the digest was new (no other batch had it). ``annotate`` tells each row of the batches it is given how large its
group is and which row is best over all batches of the index. ``admit`` returns whole rows of a batch's new texts only:
what an earlier batch brought stays there. A batch has a name; adding it again replaces what it had added, so a job that is
run again after a failure gives the same result. One job at a time may add to an index. ``compacted`` makes a new index with one
sorted file a bucket out of one whose batches have left many.

DataFrame operations only. Groups are counted with partial aggregates before any shuffle, so a digest that a third of all
rows share costs one row per task; the per-row result is a join of two plain exchanges, which adaptive execution splits
when one digest is hot. Null text counts as empty, and empty texts are equal to each other; very long texts are hashed whole.
Null ids and fully repeated rows are told apart by a row number that is written with the batch's ledger before anything
reads it. An empty batch returns no rows and adds none. Extra columns are not looked at, and carried by ``admit`` alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, materialise, shared_dir

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: A row of the index; ``less`` is the best row's length, negative, and ``fresh`` whether the digest was new.
FIELDS = "digest binary, less long, none boolean, id {id}, seq long, row long, group_size long, fresh boolean, batch string"
#: What orders rows of equal texts, the best first.
ORDER = ("less", "none", "id", "seq", "row")


def squeezed(text: Column) -> Column:
    """The text without white space. One replace() per character is a byte search; translate() would look up each character."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


class DigestIndex:
    """An index at ``path``; ``buckets`` and the type of ids are fixed when its table is made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.path, self.buckets, self.id_type = spark, path.rstrip("/"), buckets, id_type
        self.name = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex
        where = self.path.replace("'", "\\'")
        fields = FIELDS.format(id=id_type)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({fields}) USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{where}'")
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # an index of another session: its batches are found again
            spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forgets the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _marked(self, groups: DataFrame, batch: str) -> DataFrame:
        """Groups with ``fresh``: whether no other batch has the digest, by sort-merge anti-join with the bucketed table."""
        others = self.table().filter((F.col("batch") != batch) & F.col("fresh")).select("digest")
        new = groups.select("digest").join(others.hint("merge"), "digest", "left_anti").withColumn("fresh", F.lit(True))
        return groups.join(new.hint("merge"), "digest", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))

    def _seq(self, batch: str) -> int:
        """Where a batch stands among all; one that is added again keeps its place."""
        row = self.table().agg(F.max(F.when(F.col("batch") == batch, F.col("seq"))).alias("own"), F.max("seq").alias("last")).first()
        return row["own"] if row["own"] is not None else (row["last"] or 0) + 1

    def _append(self, groups: DataFrame, batch: str) -> None:
        """A batch's groups, bucket by bucket in order, instead of what the batch had before."""
        fields = [f.split()[0] for f in FIELDS.split(", ")][:-1]
        rows = groups.select(*fields).repartition(self.buckets, "digest").sortWithinPartitions("digest")
        name = batch.replace("\\", "\\\\").replace("'", "\\'")
        view = f"groups_{uuid.uuid4().hex}"
        rows.createTempView(view)
        try:
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{name}') SELECT * FROM {view}")
        finally:
            self.spark.catalog.dropTempView(view)

    def add(self, docs: DataFrame, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds a batch; returns its ledger, written: id, digest, less, none, seq, row of each row."""
        batch, text = batch or uuid.uuid4().hex, col(text_col)
        size = F.length(F.coalesce(text.cast("string"), F.lit(""))).cast("long")
        ledger = docs.select(col(id_col).cast(self.id_type).alias("id"), F.unhex(F.sha2(squeezed(text).cast("binary"), 256)).alias("digest"), (-size).alias("less"), col(id_col).isNull().alias("none"))
        ledger = materialise(ledger.withColumn("seq", F.lit(self._seq(batch)).cast("long")).withColumn("row", F.monotonically_increasing_id()), "digest-ledger")
        # one fixed-width row per digest and task goes to the shuffle
        groups = ledger.groupBy("digest").agg(F.min(F.struct(*ORDER)).alias("b"), F.count(F.lit(1)).alias("group_size")).select("digest", "b.*", "group_size")
        self._append(materialise(self._marked(groups, batch), "digest-groups"), batch)
        return ledger

    def annotate(self, ledger: DataFrame) -> DataFrame:
        """One row per row of ledgers of this index: id, keep_id, group_size (rows of the text in all batches), kept, text_sha256."""
        digests = ledger.select("digest").distinct()
        seen = self.table().join(digests.hint("merge"), "digest", "left_semi")
        best = seen.groupBy("digest").agg(F.min(F.struct(*ORDER)).alias("best"), F.sum("group_size").alias("group_size"))
        # an exchange of its own: both sides of the join are plain ones, and a hot digest can be split
        out = ledger.join(best.repartition("digest").hint("merge"), "digest")
        kept = (F.col("best.seq") == F.col("seq")) & (F.col("best.row") == F.col("row"))
        return out.select("id", F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def admit(self, docs: DataFrame, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds a batch and returns whole rows of the texts that are new, the best of each: the input's columns.

        Rows are reduced to one per digest inside each task before they are shuffled, whatever the size of a group.
        """
        batch, text = batch or uuid.uuid4().hex, col(text_col)
        row = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
        size = F.length(F.coalesce(text.cast("string"), F.lit(""))).cast("long")
        marked = docs.select(F.unhex(F.sha2(squeezed(text).cast("binary"), 256)).alias("digest"), (-size).alias("less"), col(id_col).isNull().alias("none"), col(id_col).cast(self.id_type).alias("id"), row.alias("doc"))
        marked = marked.withColumn("seq", F.lit(self._seq(batch)).cast("long")).withColumn("row", F.monotonically_increasing_id())
        order = F.struct(*ORDER)
        won = marked.groupBy("digest").agg(F.min_by("doc", order).alias("doc"), F.min(order).alias("b"), F.count(F.lit(1)).alias("group_size")).select("digest", "b.*", "group_size", "doc")
        # The ticket is nondeterministic and used by what follows: else the optimizer would move the anti-join below the
        # grouping, and every row, not every group, would be shuffled.
        others = self.table().filter((F.col("batch") != batch) & F.col("fresh")).select("digest")
        won = won.withColumn("ticket", F.monotonically_increasing_id()).join(others.hint("merge"), "digest", "left_anti")
        fresh = materialise(won.filter("ticket >= 0").drop("ticket").withColumn("fresh", F.lit(True)), "admitted")
        self._append(fresh.drop("doc"), batch)
        return fresh.select(*[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(docs.columns)])

    def compacted(self, path: str) -> DigestIndex:
        """A new index at ``path`` with the same digests, each in the batch that brought it first; one sorted file a bucket."""
        new = DigestIndex(self.spark, path, self.buckets, self.id_type)
        best = self.table().groupBy("digest").agg(F.min(F.struct(*ORDER)).alias("b"), F.sum("group_size").alias("group_size")).select("digest", "b.*", "group_size", F.lit(True).alias("fresh"))
        new._append(best, "compacted")
        return new


def fresh_index(spark: SparkSession, buckets: int = 64, id_type: str = "bigint") -> DigestIndex:
    """An empty index of its own in the shared folder."""
    return DigestIndex(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}", buckets, id_type)
