"""The engine: configuration, gates, and sealing, opening, rotating and indexing of tables.

Experimental: its suites are provisional, their constructions not independently reviewed; not for production data.
"""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import CODES, ConfigurationError, InvalidArgument, SealError
from .functions import codec, crypto, envelope
from .functions import normalize as N
from .plans import suites
from .plans.context import Binding, encoded_col, lit_bytes
from .plans.declare import META, Column, Index, Table
from .plans.keys import KeyProvider, Labels, write_key

ARM = "SEALCOL_ARM_PROVISIONAL"
MODES = ("strict", "permissive", "readonly")
#: Rows of the key relation up to which it is broadcast; a key's row is under 1 KB.
BROADCAST_KEYS = 10_000
#: Bytes a core up to which a table is spread over all cores, and in how many parts for each.
SMALL, PARTS = 128 << 20, 3
SCOPE = "__scope"
#: Prefix of the columns that hold a sealed column's error codes, where errors are values.
CODE = "__code_"


@dataclass
class Metrics:
    """Counts that hooks add to; they never change results."""

    plaintext_reads: int = 0
    decrypt_errors: dict[str, int] = field(default_factory=dict)


#: Keys up to which a counted read tells its values by key, too.
COUNTED_KEYS = 32


class Counts:
    """What a counted read has seen, once an action over it has run: values by column and outcome, and by key.

    Outcomes are OK, PLAIN (what was passed through as it is), null and the codes of errors. They are observed in the stage
    that opens the values, per finished task: retried and speculative tasks count once where that stage is the action's last, as
    in a write of the opened rows.
    """

    def __init__(self, engine: Engine, columns: tuple[str, ...], keys: list[bytes]):
        self.engine, self.columns, self.keys, self.seen, self._told = engine, columns, keys, Observation(), False

    OUTCOMES = ("OK", "PLAIN", "null", *CODES)

    def watch(self, df: DataFrame, outcome: dict[str, SparkColumn], key: dict[str, SparkColumn]) -> DataFrame:
        count = lambda c: F.sum(F.when(c, 1).otherwise(0))
        sums = [count(outcome[n] == x).alias(f"{i} {x}") for i, n in enumerate(self.columns) for x in self.OUTCOMES]
        sums += [count((outcome[n] == "OK") & (key[n] == lit_bytes(k))).alias(f"{i} key {k.hex()}") for i, n in enumerate(self.columns) for k in self.keys]
        return df.observe(self.seen, *sums)

    def values(self) -> dict[str, dict[str, int]]:
        """By column, the values of each outcome that there is. The first call adds them to the engine's metrics."""
        got = self.seen.get
        out = {n: {x: got[f"{i} {x}"] for x in self.OUTCOMES if got[f"{i} {x}"]} for i, n in enumerate(self.columns)}
        if not self._told:
            self._told = True
            m = self.engine.metrics
            for own in out.values():
                for x, n in own.items():
                    if x == "PLAIN":
                        m.plaintext_reads += n
                    elif x not in ("OK", "null"):
                        m.decrypt_errors[x] = m.decrypt_errors.get(x, 0) + n
        return out

    def by_key(self) -> dict[str, dict[bytes, int]]:
        """By column, the values that each key has opened; empty where there are more than COUNTED_KEYS (see census.by_key)."""
        got = self.seen.get
        return {n: {k: got[f"{i} key {k.hex()}"] for k in self.keys if got[f"{i} key {k.hex()}"]} for i, n in enumerate(self.columns)}

    def rows(self) -> DataFrame:
        """column, outcome, n."""
        told = [(n, x, k) for n, own in self.values().items() for x, k in own.items()]
        return self.engine.spark.createDataFrame(told, "column string, outcome string, n long")


class Engine:
    """Read modes: 'strict' raises for what is no envelope, 'permissive' and 'readonly' pass it through; 'readonly' seals nothing."""

    def __init__(self, spark: SparkSession, provider: KeyProvider, *, mode: str = "strict", write_suite: int = suites.AES_GCM.id, allowed_suites: tuple[int, ...] = (suites.AES_GCM.id,), arm_provisional: bool = False, labels: Labels = Labels(), tables: tuple[Table, ...] = (), max_plaintext: int = suites.MAX_PLAINTEXT):
        if mode not in MODES:
            raise ConfigurationError(f"a read mode is one of {', '.join(MODES)}")
        for s in (write_suite, *allowed_suites):
            if not suites.suite(s).performable:
                raise ConfigurationError(f"suite {s:#06x} is registered and cannot be performed here")
        if not allowed_suites:
            raise ConfigurationError("at least one suite is allowed")
        self.spark, self.provider, self.mode, self.write_suite, self.allowed_suites, self.labels = spark, provider, mode, write_suite, tuple(allowed_suites), labels
        self.armed = arm_provisional is True or os.environ.get(ARM) == "1"
        self.tables = {t.name: t for t in tables}
        self.indexes = {f"{t.uuid.hex()}/{c.uuid.hex()}/{c.index.name}": c.index for t in tables for c in t.columns if c.index}
        self.metrics = Metrics()
        if not 0 < max_plaintext <= suites.MAX_PLAINTEXT:
            raise ConfigurationError("a plaintext has at most 2**31 - 1 bytes")
        self.max_plaintext = max_plaintext
        if mode != "strict":
            warnings.warn(f"read mode {mode}: values that are no envelopes are passed through", stacklevel=2)

    # gates

    def write_gate(self, operation: str) -> None:
        """In this order: mode, provisional suite."""
        if self.mode == "readonly":
            raise SealError("MODE_VIOLATION", f"{operation} in mode readonly")
        if suites.suite(self.write_suite).provisional and not self.armed:
            raise SealError("SUITE_PROVISIONAL", f"suite {self.write_suite:#06x} is provisional; set {ARM}=1 or arm_provisional=True to use it")

    def spread(self, df: DataFrame) -> DataFrame:
        """The rows in a few partitions for each core, where the optimizer knows them to be little: sealing and opening take far
        longer a row than reading, and a small file or row group is one partition. What is larger has its partitions from the scan."""
        cores = self.spark.sparkContext.defaultParallelism
        if df.isStreaming or cores < 2:
            return df
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size >= SMALL * cores:
            return df
        return df.repartition(cores if size < cores << 20 else PARTS * cores)

    # keys as rows

    def _scopes(self, df: DataFrame, table: Table) -> list[bytes]:
        """The tenants of a table: few distinct values, resolved on the driver."""
        if not table.tenant:
            return [b""]
        rows = df.select(tenant_bytes(df, table).alias("s")).distinct().collect()
        return [bytes(r["s"]) for r in rows if r["s"] is not None]

    def _small(self, rows: list[tuple], schema: str) -> DataFrame:
        out = self.spark.createDataFrame(rows, schema)
        return F.broadcast(out) if len(rows) <= BROADCAST_KEYS else out

    def write_keys(self, scopes: list[bytes], lenient: bool = False) -> DataFrame:
        """Each scope's active key. ``lenient``: a scope without one has no row, where otherwise it is an error."""
        self.provider.warm(scopes)
        keys = []
        for s in scopes:
            try:
                keys.append((bytearray(s), write_key(self.provider, s)))
            except SealError as e:
                if not lenient or e.code != "KEY_UNAVAILABLE":
                    raise
        return self._small([(s, bytearray(k.key_id), bytearray(k.dek)) for s, k in keys], "k_scope binary, k_id binary, k_dek binary")

    def index_pads(self, scopes: list[bytes], table: Table, c: Column, lenient: bool = False) -> DataFrame:
        """Per scope what an index value starts from: an HMAC's two pads, or a salt, and the bucket for unindexable values."""
        self.provider.warm(scopes)
        rows = []
        for s in scopes:
            try:
                key = self.index_key(table.binding(c, s if table.tenant else None), c.index)
            except SealError as e:
                if not lenient or e.code != "KEY_UNAVAILABLE":
                    raise
                continue
            ipad, opad = crypto.pads(key)
            rows.append((bytearray(s), bytearray(ipad), bytearray(opad), bytearray(self.salt(key))))
        return self._small(rows, "x_scope binary, x_ipad binary, x_opad binary, x_salt binary")

    def index_key(self, ctx: Binding, index: Index) -> bytes:
        return crypto.hkdf(self.provider.index_key(ctx.scope), self.labels.index, ctx.of_index(index.name).encoded(index.suite), 32)

    def salt(self, index_key: bytes) -> bytes:
        return crypto.hkdf(index_key, b"", self.labels.argon2_salt, 16)

    # one value at a time, on the driver

    def blind_index(self, value: str | bytes, ctx: Binding, index: Index) -> bytes:
        """A value's index bytes. Allowed in every mode, armed or not."""
        if not isinstance(value, (str, bytes)):
            raise InvalidArgument("an indexed value is text or bytes")
        message = N.normalize(index.form, value)
        if message is None:
            if not index.bucket:
                raise InvalidArgument("the value holds a code point that has no normal form")
            return self.unindexable_marker(ctx, index)
        return self._derive(message, ctx, index)

    def unindexable_marker(self, ctx: Binding, index: Index) -> bytes:
        if not index.bucket:
            raise ConfigurationError("the index has no bucket for unindexable values")
        return self._derive(self.labels.unindexable, ctx, index)

    def _derive(self, message: bytes, ctx: Binding, index: Index) -> bytes:
        import hmac

        key = self.index_key(ctx, index)
        raw = crypto.Argon2().raw(message, self.salt(key), index.slow.passes, index.slow.kib) if index.slow else hmac.digest(key, message, "sha512")
        return crypto.truncate(raw, index.bits)

    def encrypt(self, plaintext: bytes, ctx: Binding) -> bytes:
        """One envelope, by the same expressions as a table's."""
        self.write_gate("encrypt")
        _bytes(plaintext)
        if len(plaintext) > self.max_plaintext:
            raise SealError("LENGTH_EXCEEDED", f"a plaintext has at most {self.max_plaintext} bytes")
        self.provider.warm([ctx.scope])
        k = write_key(self.provider, ctx.scope)
        df = self.spark.createDataFrame([(bytearray(plaintext), bytearray(k.key_id), bytearray(k.dek))], "v binary, k binary, d binary")
        context = lit_bytes(ctx.encoded(self.write_suite))
        df = df.withColumn("r", envelope.drawn_keys(F.col("d"), F.col("k"), context, self.labels.commitment))
        return bytes(df.select(envelope.seal(F.col("v"), F.col("k"), F.col("r"), context).alias("e")).first()["e"])

    def status(self, blob: bytes, ctx: Binding) -> tuple[str, bytes | None]:
        """The outcome of opening one envelope, and its plaintext."""
        self.provider.warm([ctx.scope])
        named = [k for k in self.provider.data_keys(ctx.scope) if k.key_id == blob[3:19]]
        others = [k for k in self.provider.data_keys(ctx.scope) if k.key_id != blob[3:19]] if named else []
        deks = [bytearray(k.dek) for k in named + others]
        df = self.spark.createDataFrame([(bytearray(blob), deks or None)], "v binary, d array<binary>")
        got = df.select(envelope.open_envelope(F.col("v"), F.col("d"), len(deks), lit_bytes(ctx.encoded(self.write_suite)), self.labels.commitment, self.allowed_suites).alias("o")).first()["o"]
        return got["status"], None if got["plaintext"] is None else bytes(got["plaintext"])

    def decrypt(self, blob: bytes, ctx: Binding) -> bytes:
        _bytes(blob)
        status, plaintext = self.status(blob, ctx)
        if status == "NOT_CIPHERTEXT" and self.mode != "strict":
            self.metrics.plaintext_reads += 1
            return blob
        if status != "OK":
            self.metrics.decrypt_errors[status] = self.metrics.decrypt_errors.get(status, 0) + 1
            raise SealError(status, "an envelope could not be opened")
        return plaintext

    def rotate(self, blob: bytes, ctx: Binding) -> bytes:
        """An envelope's plaintext under the active key. What is no envelope is refused in every mode."""
        self.write_gate("rotate")
        _bytes(blob)
        status, plaintext = self.status(blob, ctx)
        if status != "OK":
            raise SealError(status, "an envelope could not be opened")
        return self.encrypt(plaintext, ctx)

    # whole tables

    def index_column(self, df: DataFrame, out: str, table: Table, c: Column, canonical_bytes: SparkColumn, scope: str, raises: bool = True) -> DataFrame:
        """Adds index values of a column: HMAC as expressions, argon2id once for each distinct value.

        ``raises=False``: a value without a normal form, or of a scope without an index key, has no index value; ``__<out>_bad`` says why.
        """
        index = c.index
        norm = N.normalize_col(index.form, df[c.name] if c.name in df.columns else canonical_bytes, canonical_bytes)
        if index.form in N.REFUSING:
            if index.bucket:
                norm = F.coalesce(norm, F.when(canonical_bytes.isNotNull(), lit_bytes(self.labels.unindexable)))
            elif raises:
                norm = F.when(canonical_bytes.isNotNull() & norm.isNull(), F.raise_error(F.lit("INVALID_ARGUMENT: a value has no normal form")).cast("binary")).otherwise(norm)
        df = df.withColumn(f"__{out}_n", norm)
        n = F.col(f"`__{out}_n`")
        pads = self.index_pads(self._scopes(df, table), table, c, lenient=not raises)
        if index.slow:
            each = df.select(F.col(scope).alias("v_scope"), n.alias("v_n")).filter(n.isNotNull()).distinct().join(pads, F.col("v_scope") == F.col("x_scope"))
            each = each.select("v_scope", "v_n", crypto.truncate_col(crypto.argon2_col(F.col("v_n"), F.col("x_salt"), index.slow.passes, index.slow.kib), index.bits).alias(out))
            df = df.join(each, (F.col(scope) == F.col("v_scope")) & (n == F.col("v_n")), "left").drop("v_scope", "v_n")
        else:
            df = df.join(pads, F.col(scope) == F.col("x_scope"), "left")
            raw = crypto.hmac_padded(F.col("x_ipad"), F.col("x_opad"), n)
            df = df.withColumn(out, F.when(n.isNotNull(), crypto.truncate_col(raw, index.bits))).drop("x_scope", "x_ipad", "x_opad", "x_salt")
        if index.as_hex:
            df = df.withColumn(out, F.lower(F.hex(F.col(f"`{out}`"))))
        if not raises:  # what has a normal form and yet no value met no key
            df = df.withColumn(f"__{out}_bad", F.when(canonical_bytes.isNotNull() & n.isNull(), "INVALID_ARGUMENT").when(n.isNotNull() & F.col(f"`{out}`").isNull(), "KEY_UNAVAILABLE"))
        return df.drop(f"__{out}_n")

    def seal(self, df: DataFrame, table: Table, columns: tuple[str, ...] | None = None, codes: bool = False) -> DataFrame:
        """Plain columns become envelopes, index siblings are added, declarations are put into the schema.

        Every row gets entropy of its own. The result draws anew each time it runs: write it before using it twice. ``codes``: a
        value that cannot be sealed is null, its error code in a column CODE + name, and no row fails another.
        """
        self.write_gate("seal")
        names = [c.name for c in table.columns if columns is None or c.name in columns]
        types = {n: df.schema[table.column(n).source or n].dataType for n in names}
        for n in names:
            got, want = codec.logical_type(types[n]), table.column(n).logical
            if got != want and not (want == "int" and got == "decimal" and types[n].scale == 0):
                raise ConfigurationError(f"{n}: a column of {types[n].simpleString()} is {got}, not {want}")
        df = with_scope(self.spread(df), table)
        keys = self.write_keys(self._scopes(df, table), lenient=codes)
        df = df.join(keys, F.col(SCOPE) == F.col("k_scope"), "left")
        for n in names:
            c = table.column(n)
            given = source = F.col(f"`{c.source or n}`")
            if c.logical in ("int", "decimal"):
                source = codec.fitting(source, types[n], c.spark_type, raises=not codes)
            plain = codec.render(source, T.StringType() if c.logical == "string" else types[n], raises=not codes)
            if c.logical == "int" and isinstance(types[n], T.DecimalType):
                plain = F.encode(source.cast("string"), "UTF-8")
            df = df.withColumn(f"__{n}_pt", plain)
            pt = F.col(f"`__{n}_pt`")
            if codes:
                df = df.withColumn(CODE + n, self._refused(table, given, pt))
                df = df.withColumn(f"__{n}_pt", F.when(F.col(CODE + n).isNull(), pt))
            elif self.max_plaintext < suites.MAX_PLAINTEXT:
                too_long = F.raise_error(F.lit(f"LENGTH_EXCEEDED: column {n}")).cast("binary")
                df = df.withColumn(f"__{n}_pt", F.when(F.octet_length(pt) > self.max_plaintext, too_long).otherwise(pt))
            if c.index:
                df = self.index_column(df, c.sibling, table, c, pt, SCOPE, raises=not codes)
            if codes:
                if c.index:
                    df = df.withColumn(CODE + n, F.coalesce(F.col(CODE + n), F.col(f"`__{c.sibling}_bad`"))).drop(f"__{c.sibling}_bad")
                    df = df.withColumn(c.sibling, F.when(F.col(CODE + n).isNull(), F.col(f"`{c.sibling}`")))
                ready = F.when(F.col(CODE + n).isNull(), pt)
            else:
                ready = F.when(pt.isNotNull() & F.col("k_id").isNull(), F.raise_error(F.lit("CONTEXT_UNAVAILABLE: a row without tenant")).cast("binary")).otherwise(pt)
            context = context_col(df, table, c, self.write_suite)
            df = df.withColumn(f"__{n}_r", envelope.drawn_keys(F.when(pt.isNotNull(), F.col("k_dek")), F.col("k_id"), context, self.labels.commitment))
            df = df.withColumn(n, envelope.seal(ready, F.col("k_id"), F.col(f"`__{n}_r`"), context))
            df = df.drop(f"__{n}_pt", f"__{n}_r")
            if c.storage == "base64":
                df = df.withColumn(n, F.base64(n))
            df = df.withMetadata(n, table.metadata(c))
        return df.drop(SCOPE, "k_scope", "k_id", "k_dek")

    def _refused(self, table: Table, given: SparkColumn, rendered: SparkColumn) -> SparkColumn:
        """Why a value cannot be sealed, in this order: no tenant, no canonical form, too long, no key. Null if it can."""
        scope = F.col(SCOPE)
        code = F.when(given.isNull(), F.lit(None).cast("string"))
        if table.tenant:
            code = code.when(scope.isNull() | (F.octet_length(scope) == 0), "CONTEXT_UNAVAILABLE")
        return code.when(rendered.isNull(), "RENDERING_REFUSED").when(F.octet_length(rendered) > self.max_plaintext, "LENGTH_EXCEEDED").when(F.col("k_id").isNull(), "KEY_UNAVAILABLE")

    def read_keys(self, scopes: list[bytes]) -> tuple[DataFrame, int]:
        """key_id -> candidate keys, the named one first; and the most candidates of any."""
        self.provider.warm(scopes)
        rows: dict[bytes, list] = {}
        for s in scopes:
            own = self.provider.data_keys(s)
            for k in own:
                rows.setdefault(k.key_id, []).extend([k.dek, *[o.dek for o in own if o is not k]])
        most = max(map(len, rows.values()), default=0)
        return self._small([(bytearray(i), [bytearray(d) for d in dict.fromkeys(deks)]) for i, deks in rows.items()], "r_id binary, r_deks array<binary>"), most

    def counted(self, df: DataFrame, table: Table, columns: tuple[str, ...], *, raw: bool = False) -> tuple[DataFrame, Counts]:
        """open(), and the counts of what it has read, which are there after one action. Errors are counted where they are values (raw)."""
        known = [k.key_id for s in self._scopes(df, table) for k in self._known(s)] if not table.tenant else []
        counts = Counts(self, tuple(columns), known if len(known) <= COUNTED_KEYS else [])
        return self.open(df, table, columns, raw=raw, counts=counts), counts

    def _known(self, scope: bytes):
        self.provider.warm([scope])
        return self.provider.data_keys(scope)

    def open(self, df: DataFrame, table: Table, columns: tuple[str, ...], *, raw: bool = False, counts: Counts | None = None) -> DataFrame:
        """Envelopes become values (raw: struct(status, plaintext)). Lazy: only these columns are opened."""
        check_metadata(df, table)
        df = with_scope(self.spread(df), table)
        keys, most = self.read_keys(self._scopes(df, table))
        outcome, key = {}, {}
        for n in columns:
            c = table.column(n)
            stored = F.unbase64(F.col(f"`{n}`")) if c.storage == "base64" else F.col(f"`{n}`")
            df = df.withColumn(f"__{n}_e", stored)
            e = F.col(f"`__{n}_e`")
            df = df.join(keys, F.substring(e, 4, 16) == F.col("r_id"), "left")
            found = envelope.open_envelope(e, F.col("r_deks"), most, context_col(df, table, c, self.write_suite), self.labels.commitment, self.allowed_suites)
            if counts is not None:  # bound to columns: what is observed is what is opened
                df = df.withColumn(f"__{n}_o", found)
                found = F.col(f"`__{n}_o`")
                passed = (found["status"] == "NOT_CIPHERTEXT") & F.lit(self.mode != "strict" and not raw)
                df = df.withColumn(f"__{n}_seen", F.when(e.isNull(), "null").when(passed, "PLAIN").otherwise(found["status"])).withColumn(f"__{n}_by", F.substring(e, 4, 16))
                outcome[n], key[n] = F.col(f"`__{n}_seen`"), F.col(f"`__{n}_by`")

            checked = self._checked(n, e)
            if not raw and c.logical == "float":  # its reader is no expression, and cannot stand inside one
                df = df.withColumn(f"__{n}_e", crypto.let(found, checked))
                value = codec.parse(F.col(f"`__{n}_e`"), c.logical, c.spark_type)
            else:
                value = found if raw else codec.parse(crypto.let(found, checked), c.logical, c.spark_type)
            df = df.withColumn(n, value).drop(f"__{n}_e", f"__{n}_o", "r_id", "r_deks")
        if counts is not None:
            df = counts.watch(df, outcome, key).drop(*[x for n in columns for x in (f"__{n}_seen", f"__{n}_by")])
        return df.drop(SCOPE)

    def _checked(self, n: str, stored: SparkColumn | None = None):
        """An outcome's plaintext, and an error for any outcome but OK; stored bytes pass where the mode lets them."""

        def checked(o: SparkColumn) -> SparkColumn:
            out = F.when(o["status"].isNull() | (o["status"] == "OK"), o["plaintext"])
            out = out if stored is None or self.mode == "strict" else out.when(o["status"] == "NOT_CIPHERTEXT", stored)
            return out.otherwise(F.raise_error(F.concat(o["status"], F.lit(f": column {n}"))).cast("binary"))

        return checked

    def values(self, raw: DataFrame, table: Table, n: str, out: str) -> DataFrame:
        """Adds the values of a column that open(raw=True) has opened, without opening it again. Other outcomes than OK are errors."""
        c = table.column(n)
        raw = raw.withColumn(f"__{n}_p", crypto.let(F.col(f"`{n}`"), self._checked(n)))
        return raw.withColumn(out, codec.parse(F.col(f"`__{n}_p`"), c.logical, c.spark_type)).drop(f"__{n}_p")

    def rotate_table(self, df: DataFrame, table: Table, columns: tuple[str, ...] | None = None, codes: bool = False) -> DataFrame:
        """Envelopes whose suite or key is not the active one are opened and sealed anew; the others stay byte for byte.

        ``codes``: so does what cannot be opened, with its error code in a column CODE + name.
        """
        self.write_gate("rotate")
        names = [c.name for c in table.columns if columns is None or c.name in columns]
        df = with_scope(self.spread(df), table)
        scopes = self._scopes(df, table)
        keys, most = self.read_keys(scopes)
        df = df.join(self.write_keys(scopes, lenient=codes), F.col(SCOPE) == F.col("k_scope"), "left")
        for n in names:
            c = table.column(n)
            e = F.unbase64(F.col(f"`{n}`")) if c.storage == "base64" else F.col(f"`{n}`")
            if codes and c.storage == "base64":
                e = F.try_to_binary(F.col(f"`{n}`"), F.lit("base64"))
            df = df.withColumn(f"__{n}_e", e)
            e = F.col(f"`__{n}_e`")
            current = is_current(e, F.col("k_id"), self.write_suite)
            df = df.join(keys, F.substring(e, 4, 16) == F.col("r_id"), "left")
            context = context_col(df, table, c, self.write_suite)
            df = df.withColumn(f"__{n}_o", envelope.open_envelope(F.when(~current, e), F.col("r_deks"), most, context, self.labels.commitment, self.allowed_suites))
            o = F.col(f"`__{n}_o`")
            plain = F.when(o["status"] == "OK", o["plaintext"])
            if codes:
                df = df.withColumn(CODE + n, F.when(F.col(f"`{n}`").isNotNull() & e.isNull(), "NOT_CIPHERTEXT").when(o["status"] != "OK", o["status"]).when(o["status"].isNotNull() & F.col("k_id").isNull(), "KEY_UNAVAILABLE"))
                plain = F.when(F.col(CODE + n).isNull(), plain)
                kept = current | e.isNull() | F.col(CODE + n).isNotNull()
            else:
                plain = plain.when(o["status"].isNotNull(), F.raise_error(F.concat(o["status"], F.lit(f": column {n}"))).cast("binary"))
                kept = current | e.isNull()
            df = df.withColumn(f"__{n}_r", envelope.drawn_keys(F.when(plain.isNotNull(), F.col("k_dek")), F.col("k_id"), context, self.labels.commitment))
            df = df.withColumn(f"__{n}_new", envelope.seal(plain, F.col("k_id"), F.col(f"`__{n}_r`"), context)).drop(f"__{n}_r")
            new = F.col(f"`__{n}_new`")
            df = df.withColumn(n, F.when(kept, F.col(f"`{n}`")).otherwise(F.base64(new) if c.storage == "base64" else new)).drop(f"__{n}_e", f"__{n}_o", f"__{n}_new", "r_id", "r_deks")
            df = df.withMetadata(n, table.metadata(c))
        return df.drop(SCOPE, "k_scope", "k_id", "k_dek")


def _bytes(x: object) -> None:
    if not isinstance(x, bytes):
        raise InvalidArgument("a value is bytes")


def is_current(e: SparkColumn, key_id: SparkColumn, suite_id: int) -> SparkColumn:
    """By the header alone."""
    return envelope.is_ciphertext_col(e) & F.coalesce((F.substring(e, 4, 16) == key_id) & (envelope.suite_id_col(e) == suite_id), F.lit(False))


def tenant_bytes(df: DataFrame, table: Table) -> SparkColumn:
    """A row's tenant as bytes: binary as it is, anything else as its text; null stays null."""
    t = F.col(f"`{table.tenant}`")
    return t if isinstance(df.schema[table.tenant].dataType, T.BinaryType) else F.encode(t.cast("string"), "UTF-8")


def with_scope(df: DataFrame, table: Table) -> DataFrame:
    return df.withColumn(SCOPE, tenant_bytes(df, table) if table.tenant else lit_bytes(b""))


def context_col(df: DataFrame, table: Table, c: Column, suite_id: int) -> SparkColumn:
    row = F.encode(F.col(f"`{table.row}`").cast("string"), "UTF-8") if table.row else None
    if table.tenant or row is not None:
        return encoded_col(table.binding(c), suite_id, tenant_bytes(df, table) if table.tenant else None, row)
    return lit_bytes(table.binding(c).encoded(suite_id))


def check_metadata(df: DataFrame, table: Table) -> None:
    """A column that was sealed under another declaration is refused."""
    for f in df.schema.fields:
        held = f.metadata.get(META)
        if held is not None and f.name in table.by_name and held != table.metadata(table.by_name[f.name])[META]:
            raise ConfigurationError(f"{f.name} was sealed under another declaration")
