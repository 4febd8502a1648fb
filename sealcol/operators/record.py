"""A MAC over all sealed fields of a record together: envelopes and index values, bound to the record's key.

An envelope alone tells that its own bytes are whole. It does not tell that a record's envelope was dropped, put into another
column of a table that allows it, or replaced by an older one of the same place. A record's tag holds a digest of every
field, present or not, and a MAC over these, the fields' ids, the tenant and the primary key, under a key of this one record. It
is checked before any column is opened, from stored bytes alone; where the tag is authentic, its digests tell what happened.

What a tag cannot tell: a whole record, with its tag, put back to an earlier state, or deleted. Tags are made anew with every write
of a record's fields (``attach``), also after a rotation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..engine import SCOPE, Engine, with_scope
from ..errors import ConfigurationError, InvalidArgument
from ..functions import crypto
from ..plans.context import lit_bytes, sized, sized_col
from ..plans.declare import Table
from .census import stored

#: Outcomes, the first that applies: no tag; a tag that is not this record's; then by field.
STATUSES = ("MAC_MISSING", "MAC_INVALID", "DROPPED", "ADDED", "SWAPPED", "REPLACED", "OK")
VERSION, DIGEST = 1, 32


@dataclass(frozen=True)
class Fields:
    """What a table's records have under their tag, in the order of the fields' ids."""

    table: Table

    def __post_init__(self):
        if not self.table.pk:
            raise ConfigurationError("a record's tag is bound to its primary key")

    @property
    def named(self) -> list[tuple[bytes, str]]:
        out = [(c.uuid + b"e", c.name) for c in self.table.columns]
        out += [(c.uuid + b"i" + c.index.name.encode(), c.sibling) for c in self.table.columns if c.index]
        return sorted(out)

    @property
    def size(self) -> int:
        return 1 + len(self.named) * (1 + DIGEST) + 32

    def bytes_of(self, df: DataFrame, name: str) -> Column:
        if name in self.table.by_name:
            return stored(self.table, name)
        c = F.col(f"`{name}`")
        return c if isinstance(df.schema[name].dataType, T.BinaryType) else F.encode(c, "UTF-8")

    def digest(self, df: DataFrame, name: str) -> Column:
        """33 bytes: whether the field is there, and the SHA-256 of its bytes."""
        return F.coalesce(F.concat(F.lit(b"\1"), F.unhex(F.sha2(self.bytes_of(df, name), 256))), lit_bytes(bytes(1 + DIGEST)))

    def row(self, df: DataFrame) -> Column:
        """The primary key, each column of it behind its length; a null is told from an empty text."""
        parts = []
        for k in self.table.pk:
            c = F.col(f"`{k}`")
            raw = c if isinstance(df.schema[k].dataType, T.BinaryType) else F.encode(c.cast("string"), "UTF-8")
            parts.append(F.coalesce(F.concat(F.lit(b"\1"), sized_col(raw)), F.lit(b"\0")))
        return F.concat(*parts)


def _keys(engine: Engine, scopes: list[bytes]) -> DataFrame:
    """Per scope the two pads under which records' keys are derived: HKDF's first step over the scope's index key."""
    engine.provider.warm(scopes)
    rows = []
    for s in scopes:
        inner, outer = crypto.pads(crypto.hmac.digest(engine.labels.record, engine.provider.index_key(s), "sha512"))
        rows.append((bytearray(s), bytearray(inner), bytearray(outer)))
    return engine._small(rows, "m_scope binary, m_ipad binary, m_opad binary")


def _mac(fields: Fields, df: DataFrame, manifest: Column) -> Column:
    """The MAC of a manifest, under the record's own key; null for a row without tenant."""
    t = fields.table
    head = bytes([VERSION]) + sized(t.uuid) + sized(b"".join(map(sized, (i for i, _ in fields.named))))
    info = F.concat(lit_bytes(head), sized_col(F.col(SCOPE)), fields.row(df), F.lit(b"\1"))
    key = F.substring(crypto.hmac_padded(F.col("m_ipad"), F.col("m_opad"), info), 1, 32)
    return F.substring(crypto.hmac_col(key, 32, manifest), 1, 32)


def attach(engine: Engine, sealed: DataFrame, table: Table, name: str = "record_mac") -> DataFrame:
    """Sealed rows with their tags in a column ``name``. Rows must be as they will be stored: seal, write, then attach."""
    engine.write_gate("attach a record's tag")
    if name in table.by_name:
        raise InvalidArgument(f"{name} is a sealed column")
    fields = Fields(table)
    df = with_scope(sealed.drop(name), table)
    df = df.join(_keys(engine, engine._scopes(df, table)), F.col(SCOPE) == F.col("m_scope"), "left")
    df = df.withColumn("__manifest", F.concat(lit_bytes(bytes([VERSION])), *[fields.digest(df, n) for _, n in fields.named]))
    tag = F.concat(F.col("__manifest"), _mac(fields, df, F.col("__manifest")))
    tag = F.when(F.col("m_scope").isNull(), F.raise_error(F.lit("CONTEXT_UNAVAILABLE: a row without tenant")).cast("binary")).otherwise(tag)
    return df.withColumn(name, tag).drop("__manifest", SCOPE, "m_scope", "m_ipad", "m_opad")


def with_status(engine: Engine, df: DataFrame, table: Table, name: str = "record_mac") -> DataFrame:
    """Adds ``<name>_status`` (one of STATUSES) and ``<name>_fields`` (columns that are not as they were). Nothing is opened.

    DROPPED: a field is gone; ADDED: one is there that was not; SWAPPED: a field holds what the tag has for another one;
    REPLACED: it holds bytes the tag knows nowhere, an older envelope say. Of several the first in this order is the status.
    """
    fields = Fields(table)
    out = with_scope(df, table)
    out = out.join(_keys(engine, engine._scopes(out, table)), F.col(SCOPE) == F.col("m_scope"), "left")
    tag, last = F.col(f"`{name}`"), fields.size - 32
    out = out.withColumn("__mac", _mac(fields, out, F.substring(tag, 1, last)))
    out = out.withColumn("__now", F.array(*[fields.digest(out, n) for _, n in fields.named]))
    out = out.withColumn("__then", F.array(*[F.substring(tag, 2 + k * (1 + DIGEST), 1 + DIGEST) for k in range(len(fields.named))]))
    gone, names = lit_bytes(bytes(1 + DIGEST)), F.array(*[F.lit(n) for _, n in fields.named])

    def told(k: Column) -> Column:
        now, then = F.get("__now", k), F.get("__then", k)
        return F.when(now == then, "OK").when(now == gone, "DROPPED").when(then == gone, "ADDED").when(F.array_contains(F.col("__then"), now), "SWAPPED").otherwise("REPLACED")

    out = out.withColumn("__told", F.transform(F.sequence(F.lit(0), F.lit(len(fields.named) - 1)), told))
    status = F.when(tag.isNull(), "MAC_MISSING").when((F.octet_length(tag) != fields.size) | ~F.coalesce(F.substring(tag, last + 1, 32) == F.col("__mac"), F.lit(False)), "MAC_INVALID")
    for s in STATUSES[2:-1]:
        status = status.when(F.array_contains("__told", s), s)
    out = out.withColumn(f"{name}_status", status.otherwise("OK"))
    bad = F.transform(F.filter(F.arrays_zip(F.col("__told").alias("s"), names.alias("n")), lambda x: x["s"] != "OK"), lambda x: x["n"])
    authentic = ~F.col(f"{name}_status").isin("MAC_MISSING", "MAC_INVALID")
    out = out.withColumn(f"{name}_fields", F.when(authentic, bad))
    return out.drop("__mac", "__now", "__then", "__told", SCOPE, "m_scope", "m_ipad", "m_opad")


def open_checked(engine: Engine, df: DataFrame, table: Table, columns: tuple[str, ...], name: str = "record_mac", raises: bool = True) -> DataFrame:
    """The columns of authentic records, opened. Of others nothing is opened: an error, or with ``raises=False`` nulls and the status."""
    out = with_status(engine, df, table, name)
    status = F.col(f"{name}_status")
    for n in columns:
        kind, value = out.schema[n].dataType, F.when(status == "OK", F.col(f"`{n}`"))
        if raises:
            value = value.otherwise(F.raise_error(F.concat(F.lit("AAD_MISMATCH: a record's tag says "), status)).cast(kind))
        out = out.withColumn(n, value).withMetadata(n, table.metadata(table.column(n)))
    return engine.open(out, table, columns)
