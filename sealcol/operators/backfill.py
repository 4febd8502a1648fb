"""Bulk jobs over existing tables: encrypt what is not sealed yet, rotate what is under old keys, verify a sample, report.

A value's class is read off its stored bytes: null, current (an envelope), anomalous (of a future format), pending. In a run, a
value that cannot be sealed or opened is no error but an outcome: it stays byte for byte, its code is counted and kept beside its
row. A run's work is cut into ranges of the primary key, at quantiles; each range's rows are one committed output with the counts
that its write observed. The log of a table's runs (``runlog``) says who holds a run until when and which ranges are committed:
a run that was killed does the other ranges and no more, and of two runners one is refused. A run records what decides its
bytes and is resumed under the same configuration only.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..engine import CODE, SCOPE, Engine, is_current, tenant_bytes, with_scope
from ..errors import BACKFILL_CODES, CODES, LOCAL_CODES, ConfigurationError, SealError
from ..functions.codec import parse
from ..functions.envelope import kind_col
from ..plans.declare import PROCEDURE_VERSION, Column, Table, changed_paths, config_hash, overrides, run_config
from .census import stored
from .runlog import RunLog

CLASSES = ("null", "current", "pending", "anomalous")
#: What a run does with a value, besides failing with a code.
OUTCOMES = ("null", "current", "anomalous", "written")
#: Columns that a run's output has besides the table's: how many values of the row failed, and which, with their codes.
FAILED, FAILURES = "seal_failed", "seal_failures"
#: The column that a laid-out source is partitioned by.
RANGE = "seal_range"


def classify(df: DataFrame, table: Table, name: str):
    """The class of a stored value. A two-column job's source is pending wherever its target is null."""
    c = table.column(name)
    if c.source:
        source, target = F.col(f"`{c.source}`"), stored(table, name) if name in df.columns else F.lit(None).cast("binary")
        return F.when(kind_col(target) == "envelope", "current").when(target.isNotNull(), "anomalous").when(source.isNull(), "null").otherwise("pending")
    x = F.col(f"`{name}`")
    kind = kind_col(x if isinstance(df.schema[name].dataType, T.BinaryType) else x.cast("string").cast("binary"))
    if c.storage == "base64":
        kind = kind_col(stored(table, name))
        return F.when(x.isNull(), "null").when(kind == "envelope", "current").when(kind == "reserved", "anomalous").otherwise("pending")
    return F.when(x.isNull(), "null").when(kind == "envelope", "current").when(kind == "reserved", "anomalous").otherwise("pending")


def counts(df: DataFrame, table: Table) -> DataFrame:
    """One row per sealed column: values of each class."""
    parts = []
    for c in table.columns:
        k = classify(df, table, c.name)
        parts.append(F.struct(F.lit(c.name).alias("column"), *[F.sum((k == x).cast("long")).alias(f"values_{x}") for x in CLASSES]))
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def encrypt(engine: Engine, df: DataFrame, table: Table, codes: bool = False) -> DataFrame:
    """In-place columns of binary or text, pending values sealed and indexed, current ones kept byte for byte.

    ``codes``: a value that cannot be sealed stays as it is; a column CODE + name has each value's outcome (OUTCOMES or a code).
    """
    engine.write_gate("backfill")
    for c in table.columns:
        if c.source:
            df = df.withColumn(c.name, F.lit(None).cast("binary")) if c.name not in df.columns else df
            df = df.withColumn(f"__k_{c.name}", classify(df, table, c.name))
            held = F.col(f"`{c.name}`")
        else:
            text = not isinstance(df.schema[c.name].dataType, T.BinaryType)
            df = df.withColumn(f"__k_{c.name}", classify(df, table, c.name))
            held = F.encode(F.col(f"`{c.name}`").cast("string"), "UTF-8") if text else F.col(f"`{c.name}`")
        df = df.withColumn(f"__old_{c.name}", held)
        if c.index:
            old = F.col(f"`{c.sibling}`") if c.sibling in df.columns else F.lit(None).cast("binary" if not c.index.as_hex else "string")
            df = df.withColumn(f"__oldx_{c.name}", old)
        pending = F.col(f"__k_{c.name}") == "pending"
        if c.source:
            continue
        plain = F.when(pending, F.col(f"`__old_{c.name}`"))
        df = df.withColumn(c.name, plain if c.logical == "bytes" else parse(plain, c.logical, c.spark_type, raises=not codes))
        if codes:
            df = df.withColumn(f"__bad_{c.name}", F.when(pending & F.col(f"`{c.name}`").isNull(), "RENDERING_REFUSED"))
    for c in table.columns:
        if c.source:
            df = df.withColumn(f"__src_{c.name}", F.col(f"`{c.source}`")).withColumn(c.source, F.when(F.col(f"__k_{c.name}") == "pending", F.col(f"`{c.source}`")))
    df = engine.seal(df.drop(*[c.sibling for c in table.columns if c.index]), table, codes=codes)
    for c in table.columns:
        written = F.col(f"__k_{c.name}") == "pending"
        if codes:
            df = df.withColumn(CODE + c.name, _outcome(df, table, c, written))
            written = F.col(CODE + c.name) == "written"
        old = F.col(f"`__old_{c.name}`")
        df = df.withColumn(c.name, F.when(written, F.col(f"`{c.name}`")).otherwise(old.cast("string") if c.storage == "base64" else old)).withMetadata(c.name, table.metadata(c))
        if c.index:
            df = df.withColumn(c.sibling, F.when(written, F.col(f"`{c.sibling}`")).otherwise(F.col(f"`__oldx_{c.name}`"))).drop(f"__oldx_{c.name}")
        if c.source:
            df = df.withColumn(c.source, F.col(f"`__src_{c.name}`")).drop(f"__src_{c.name}")
        df = df.drop(f"__k_{c.name}", f"__old_{c.name}", f"__bad_{c.name}")
    return df


def _outcome(df: DataFrame, table: Table, c: Column, pending: SparkColumn) -> SparkColumn:
    """A value's outcome in an encrypt run. A tenant that is missing comes before bytes that are not canonical."""
    kind, code = F.col(f"__k_{c.name}"), F.col(CODE + c.name)
    if not c.source:
        # what is no envelope and of a future format is refused as such, in place
        kind = F.when(kind == "anomalous", "UNKNOWN_FORMAT_VERSION").otherwise(kind)
        bad = F.col(f"__bad_{c.name}")
        if table.tenant:
            tenant = tenant_bytes(df, table)
            bad = F.when(bad.isNotNull() & (tenant.isNull() | (F.octet_length(tenant) == 0)), "CONTEXT_UNAVAILABLE").otherwise(bad)
        code = F.coalesce(bad, code)
    return F.when(pending, F.coalesce(code, F.lit("written"))).otherwise(kind)


def rotate(engine: Engine, df: DataFrame, table: Table) -> DataFrame:
    """rotate_table() with each value's outcome in a column CODE + name; what is no envelope at all is anomalous."""
    df = df.withColumns({f"__was_{c.name}": stored(table, c.name) for c in table.columns})
    key = engine.write_keys(engine._scopes(df, table), lenient=True)
    df = engine.rotate_table(df, table, codes=True)
    df = with_scope(df, table).join(key, F.col(SCOPE) == F.col("k_scope"), "left")
    for c in table.columns:
        was, code = F.col(f"`__was_{c.name}`"), F.col(CODE + c.name)
        outcome = F.when(F.col(f"`{c.name}`").isNull(), "null").when(code == "NOT_CIPHERTEXT", "anomalous").when(code.isNotNull(), code)
        df = df.withColumn(CODE + c.name, outcome.when(is_current(was, F.col("k_id"), engine.write_suite), "current").otherwise("written"))
    return df.drop(SCOPE, "k_scope", "k_id", "k_dek", *[f"__was_{c.name}" for c in table.columns])


def rotation_pending(engine: Engine, df: DataFrame, table: Table) -> DataFrame:
    """One row per sealed column: envelopes that a rotation would touch, by header alone."""
    df = with_scope(df, table)
    df = df.join(engine.write_keys(engine._scopes(df, table)), F.col(SCOPE) == F.col("k_scope"), "left")
    parts = [F.struct(F.lit(c.name).alias("column"), F.sum((F.coalesce(kind_col(stored(table, c.name)) == "envelope", F.lit(False)) & ~is_current(stored(table, c.name), F.col("k_id"), engine.write_suite)).cast("long")).alias("n_pending")) for c in table.columns]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def verify(engine: Engine, sealed: DataFrame, table: Table, original: DataFrame | None = None, share: float = 1.0, seed: int = 1) -> DataFrame:
    """One row per column and outcome over a random share of rows: OK, an error's code, or DIFFERENT from the original."""
    some = sealed.sample(share, seed) if share < 1 else sealed
    opened = engine.open(some, table, tuple(c.name for c in table.columns), raw=True)
    out = []
    for c in table.columns:
        o = F.col(f"`{c.name}`")
        rows = opened.select(*table.pk, o["status"].alias("status"), o["plaintext"].alias("p"))
        if original is not None:
            from ..functions.codec import render

            source = c.source or c.name
            plain = original.select(*table.pk, render(F.col(f"`{source}`"), original.schema[source].dataType).alias("want"))
            rows = rows.join(plain, list(table.pk))
            rows = rows.withColumn("status", F.when((F.col("status") == "OK") & ~F.col("p").eqNullSafe(F.col("want")), "DIFFERENT").otherwise(F.col("status")))
        out.append(rows.filter("status is not null").groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(c.name).alias("column"), "status", "n"))
    from functools import reduce

    return reduce(DataFrame.unionByName, out)


# ranges of the primary key


def splits_of(df: DataFrame, pk: tuple[str, ...], ranges: int) -> list[list[str | None]]:
    """Keys at which ``ranges`` ranges of about equal size begin, but the first: each key as the texts of its columns.

    Spark's own range partitioner samples the key; of each of its partitions the least key comes to the driver.
    """
    keys = df.select(*[F.col(f"`{k}`") for k in pk]).repartitionByRange(ranges, *[F.col(f"`{k}`") for k in pk])
    least = keys.select(F.spark_partition_id().alias("p"), F.struct(*[F.col(f"`{k}`") for k in pk]).alias("k")).groupBy("p").agg(F.min("k").alias("k")).orderBy("p")
    rows = least.select([_as_text(F.col("k")[k], df.schema[k].dataType).alias(k) for k in pk]).collect()
    return [list(r) for r in rows[1:]]


def _as_text(c: SparkColumn, t: T.DataType) -> SparkColumn:
    return F.hex(c) if isinstance(t, T.BinaryType) else c.cast("string")


def _key(df: DataFrame, pk: tuple[str, ...]) -> SparkColumn:
    return F.struct(*[F.col(f"`{k}`") for k in pk])


def _split(df: DataFrame, pk: tuple[str, ...], texts: list[str | None]) -> SparkColumn:
    return F.struct(*[(F.unhex(F.lit(x)) if isinstance(df.schema[k].dataType, T.BinaryType) else F.lit(x).cast(df.schema[k].dataType)).alias(k) for k, x in zip(pk, texts)])


def in_range(df: DataFrame, pk: tuple[str, ...], splits: list, k: int) -> DataFrame:
    """The rows of range k. For a key of one column the bounds reach the scan, which skips row groups outside of them."""
    if len(pk) == 1:
        key, at = F.col(f"`{pk[0]}`"), lambda i: _split(df, pk, splits[i])[pk[0]]
    else:
        key, at = _key(df, pk), lambda i: _split(df, pk, splits[i])
    above = key >= at(k - 1) if k else F.lit(True)
    below = key < at(k) if k < len(splits) else F.lit(True)
    inside = above & below
    return df.filter(inside if k else F.coalesce(inside, F.lit(True)) if splits else F.lit(True))


def range_of(df: DataFrame, pk: tuple[str, ...], splits: list) -> SparkColumn:
    """The number of a row's range."""
    if not splits:
        return F.lit(0)
    return F.size(F.filter(F.array(*[_split(df, pk, s) for s in splits]), lambda s: s <= _key(df, pk)))


# runs


class LostRun(SealError):
    """Another runner has taken the run over, or holds it."""

    def __init__(self, message: str):
        super().__init__("CONFIGURATION_ERROR", message)


@dataclass
class Run:
    """A run as its log tells it. ``committed``: range -> its folder, rows, counts by column id and failures by column id and code."""

    run_id: str
    job: str
    config: dict
    splits: list
    status: str = "running"
    holder: str = ""
    until: float = 0.0
    source: str | None = None
    committed: dict[int, dict] = field(default_factory=dict)
    started_at: float = 0.0
    ended_at: float = 0.0
    procedure_version: int = PROCEDURE_VERSION

    @property
    def ranges(self) -> int:
        return len(self.splits) + 1

    @property
    def todo(self) -> list[int]:
        return [k for k in range(self.ranges) if k not in self.committed]

    def total(self, part: str) -> dict[str, dict[str, int]]:
        """Sums over the committed ranges of "counts" or "failures", by column id."""
        out: dict[str, dict[str, int]] = {}
        for done in self.committed.values():
            for column, own in done[part].items():
                for name, n in own.items():
                    out.setdefault(column, {})[name] = out.get(column, {}).get(name, 0) + n
        return out

    def take(self, entry: dict) -> None:
        """The run after one more entry of its log."""
        if entry["type"] in ("claim", "layout", "commit"):
            self.holder, self.until = entry["holder"], entry["until"]
        if entry["type"] == "layout":
            self.source = entry["folder"]
        elif entry["type"] == "commit":
            self.committed[entry["range"]] = entry
        elif entry["type"] == "release":
            self.until = 0.0
        elif entry["type"] in ("complete", "abandoned"):
            self.status, self.ended_at, self.until = entry["type"], entry["at"], 0.0


class Runner:
    """Encrypt or rotate jobs over one table, with the log of its runs under ``state`` and rows under ``out``.

    ``lease``: seconds for which a claim or a commit holds a run. A range that takes longer may be taken over; its output is
    then not committed. Clocks of drivers are compared, so a lease is far longer than they differ.
    """

    def __init__(self, engine: Engine, table: Table, state: str, out: str, *, holder: str | None = None, lease: float = 3600.0, clock: Callable[[], float] = time.time):
        if not table.pk:
            raise ConfigurationError("a job needs a primary key")
        self.engine, self.table, self.out, self.spark = engine, table, out.rstrip("/"), engine.spark
        self.log = RunLog(engine.spark, f"{state.rstrip('/')}/{table.uuid.hex()}")
        self.holder, self.lease, self.clock = holder or uuid.uuid4().hex, lease, clock

    # the log

    def runs(self) -> list[Run]:
        """This table's runs, oldest first."""
        return list(self._folded()[1].values())

    def _folded(self) -> tuple[int, dict[str, Run]]:
        entries, runs = self.log.entries(), {}
        for e in entries:
            if e["type"] == "start":
                runs[e["run_id"]] = Run(e["run_id"], e["job"], e["config"], e["splits"], started_at=e["at"], procedure_version=e["procedure_version"])
            else:
                runs[e["run_id"]].take(e)
        return len(entries), runs

    def start(self, job: str, df: DataFrame, ranges: int = 16) -> Run:
        """A new run, not claimed yet. A table has one running run: of two starts at once one is refused."""
        if job not in ("encrypt", "rotate"):
            raise ConfigurationError("a job is 'encrypt' or 'rotate'")
        config = run_config(self.table, job, self.engine.write_suite)
        config_hash(config)
        splits = splits_of(df, self.table.pk, ranges)
        number, runs = self._folded()
        for old in runs.values():
            if old.status == "running":
                raise ConfigurationError(f"run {old.run_id} is not finished; resume or abandon it")
            if job == "encrypt" and old.job == "encrypt":
                self._same_bytes(old, config)
        run_id = uuid.uuid4().hex
        if not self.log.append(number, {"type": "start", "run_id": run_id, "job": job, "config": config, "splits": splits, "at": self.clock(), "procedure_version": PROCEDURE_VERSION}):
            raise ConfigurationError("another run of the table was started at the same time")
        return self._folded()[1][run_id]

    @staticmethod
    def _same_bytes(old: Run, config: dict) -> None:
        """Columns that an earlier run wrote keep their indexes and tenants."""
        before, counts = {c["column_uuid"]: c for c in old.config["columns"]}, old.total("counts")
        for c in config["columns"]:
            b = before.get(c["column_uuid"])
            if b and counts.get(c["column_uuid"], {}).get("written", 0):
                changed = [k for k in ("indexes", "tenant") if b[k] != c[k]]
                if changed:
                    raise ConfigurationError(f"run {old.run_id} wrote column {c['column_uuid']} with other {', '.join(changed)}")

    def _running(self, run_id: str) -> tuple[int, Run]:
        number, runs = self._folded()
        run = runs.get(run_id)
        if run is None or run.status != "running":
            raise ConfigurationError("no such run to resume")
        return number, run

    def resume(self, run_id: str) -> Run:
        """A running run, under the configuration that it was started with."""
        run = self._running(run_id)[1]
        if run.procedure_version != PROCEDURE_VERSION:
            raise ConfigurationError(f"run {run_id} follows procedure {run.procedure_version}")
        changed = changed_paths(run.config, run_config(self.table, run.job, self.engine.write_suite))
        if changed:
            raise ConfigurationError(f"the configuration differs in {', '.join(changed)}")
        return run

    def claim(self, run_id: str) -> Run:
        """Holds a run for a lease. Refused while another's lease lasts; an expired one is taken over."""
        number, run = self._running(run_id)
        if run.holder != self.holder and run.until > self.clock():
            raise LostRun(f"run {run_id} is held by another runner for {run.until - self.clock():.0f} s more")
        if not self.log.append(number, {"type": "claim", "run_id": run_id, "holder": self.holder, "until": self.clock() + self.lease}):
            raise LostRun(f"run {run_id} was claimed by another runner at the same time")
        return self._running(run_id)[1]

    def _write(self, run: Run, entry: dict) -> Run:
        """One more entry of a run that this runner holds. What another has written in between means that the run is lost."""
        number, now = self._running(run.run_id)
        if now.holder != self.holder:
            raise LostRun(f"run {run.run_id} was taken over by another runner; this one's last output is not committed")
        if not self.log.append(number, {"run_id": run.run_id, "holder": self.holder, "until": self.clock() + self.lease, "at": self.clock(), **entry}):
            raise LostRun(f"run {run.run_id} was taken over by another runner; this one's last output is not committed")
        return self._folded()[1][run.run_id]

    def abandon(self, run_id: str) -> None:
        """Ends a running run that nobody else holds; what it committed stays readable."""
        run = self.claim(run_id)
        self._write(run, {"type": "abandoned"})

    # the work

    def lay_out(self, run: Run, df: DataFrame) -> Run:
        """Writes the source once, partitioned by range, where its files are not clustered by the key: each range then reads its own rows."""
        run = self.claim(run.run_id)
        if run.source:
            return run
        folder = f"{self.out}/run={run.run_id}/source-{uuid.uuid4().hex}"
        ranged = df.withColumn(RANGE, range_of(df, self.table.pk, run.splits)).repartitionByRange(*[F.col(f"`{k}`") for k in self.table.pk])
        ranged.write.partitionBy(RANGE).parquet(folder)
        return self._write(run, {"type": "layout", "folder": folder})

    def work(self, run: Run, df: DataFrame, only: int | None = None, max_failures: int | None = None) -> Run:
        """Does the ranges that are not committed (``only`` so many of them), one committed output each.

        Each range is one scan of its own rows: of ``df`` between two keys, or of the laid-out source. ``max_failures``: stops
        after the range in which this call's failures reach that number; the run stays running and that range is committed.
        """
        run, failed = self.claim(run.run_id), 0
        for k in run.todo[:only]:
            if run.source:
                rows = self.spark.read.schema(df.schema).parquet(f"{run.source}/{RANGE}={k}") if self._has(f"{run.source}/{RANGE}={k}") else df.limit(0)
            else:
                rows = in_range(df, self.table.pk, run.splits, k)
            run = self._range(run, k, rows)
            failed += sum(n for own in run.committed[k]["failures"].values() for n in own.values())
            if max_failures is not None and failed >= max_failures:
                break
        if not run.todo:
            return self._write(run, {"type": "complete"})
        return self._write(run, {"type": "release"})

    def _has(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _range(self, run: Run, k: int, rows: DataFrame) -> Run:
        """One range: rows and failures in one write, counts observed in it, then the commit that makes it part of the run."""
        done = encrypt(self.engine, rows, self.table, codes=True) if run.job == "encrypt" else rotate(self.engine, rows, self.table)
        codes = (*CODES, *LOCAL_CODES, *BACKFILL_CODES)
        seen = Observation()
        sums = [F.sum((F.col(CODE + c.name) == x).cast("long")).alias(f"{c.uuid.hex()} {x}") for c in self.table.columns for x in (*OUTCOMES, *codes)]
        done = done.observe(seen, F.count(F.lit(1)).alias("rows"), *sums)
        failures = F.array_compact(F.array(*[F.when(~F.col(CODE + c.name).isin(*OUTCOMES), F.struct(F.lit(c.name).alias("column"), F.col(CODE + c.name).alias("code"))) for c in self.table.columns]))
        done = done.withColumn(FAILURES, F.when(F.size(failures) > 0, failures)).withColumn(FAILED, F.coalesce(F.size(FAILURES), F.lit(0)))
        folder = f"{self.out}/run={run.run_id}/range={k:06d}/{uuid.uuid4().hex}"
        done.drop(*[CODE + c.name for c in self.table.columns]).write.parquet(folder)
        got = seen.get
        counts, failed = {}, {}
        for c in self.table.columns:
            own = {x: got[f"{c.uuid.hex()} {x}"] or 0 for x in (*OUTCOMES, *codes)}
            failed[c.uuid.hex()] = {x: own[x] for x in codes if own[x]}
            counts[c.uuid.hex()] = {x: own[x] for x in OUTCOMES} | {"failed": sum(failed[c.uuid.hex()].values())}
        return self._write(run, {"type": "commit", "range": k, "folder": folder, "rows": got["rows"], "counts": counts, "failures": failed})

    # what came of it

    def output(self, run: Run) -> DataFrame:
        """Rows of the committed ranges, with their failures beside them."""
        return self.spark.read.parquet(*[run.committed[k]["folder"] for k in sorted(run.committed)])

    def result(self, run: Run) -> DataFrame:
        """The table's rows of the committed ranges. Other folders, of runners that lost the run, are never read."""
        return self.output(run).drop(FAILED, FAILURES)

    def quarantine(self, run: Run) -> DataFrame:
        """Primary key, column and code of each value that failed. Row groups without failures are skipped by their statistics."""
        bad = self.output(run).filter(F.col(FAILED) > 0)
        return bad.select(*self.table.pk, F.explode(FAILURES).alias("f")).select(*self.table.pk, F.col("f.column").alias("column"), F.col("f.code").alias("code"))

    def report(self, run: Run) -> dict:
        """Counts and exceptions of a run. Complete means that all ranges are committed, not that every value is sealed."""
        counts, by_code = dict.fromkeys((*OUTCOMES, "failed"), 0), {}
        for own in run.total("counts").values():
            for x, n in own.items():
                counts[x] += n
        for own in run.total("failures").values():
            for x, n in own.items():
                by_code[x] = by_code.get(x, 0) + n
        rows, seconds = sum(c["rows"] for c in run.committed.values()), (run.ended_at or self.clock()) - run.started_at
        unfinished = counts["failed"] or counts["anomalous"] or run.status != "complete"
        return {
            "warning": "the table is not fully converted" if unfinished else "", "run_id": run.run_id, "job": run.job, "status": run.status, "config_hash": config_hash(run.config), "ranges": [len(run.committed), run.ranges],
            "rows": rows, "seconds": round(seconds, 3), "rows_per_second": round(rows / seconds, 1) if seconds > 0 else 0.0, "values": counts, "failures_by_code": dict(sorted(by_code.items())), "overrides": overrides(self.table),
        }


def compare_reports(a: DataFrame, b: DataFrame) -> DataFrame:
    """Result ids that two conformance reports (id, outcome) do not share or do not agree on."""
    x, y = a.select("id", F.col("outcome").alias("left")), b.select("id", F.col("outcome").alias("right"))
    return x.join(y, "id", "full_outer").filter(~F.col("left").eqNullSafe(F.col("right")))


def new_uuid() -> bytes:
    """A surrogate id for a table or a column."""
    return uuid.uuid4().bytes
