"""Prefix lookups: an inverted table of truncated keyed prefixes, beside a sealed table.

A declared prefix is a derived field: the first n characters of a value's normal form, for each declared n. Each length has
an index of its own, under a key of its own and subject to every rule of indexes; (token, length, primary key) rows are stored
ordered by token and key, so that a token that a large part of the table shares is spread over many files. A lookup takes the
longest length that its text has, reads that token's rows only, finds the table's rows by a semi-join, and verifies each.

Every length is one more channel that leaks: prefixes are fewer than values, and rows of one token share a beginning. A declaration
therefore needs a written acceptance, which reports carry.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import SCOPE, tenant_bytes, with_scope
from ..errors import ConfigurationError, NotSupported, SealError
from ..functions import codec, crypto
from ..functions import normalize as N
from ..plans.context import lit_bytes
from ..plans.declare import Index, Override
from .frame import SealedFrame, Verified


@dataclass(frozen=True)
class Prefix:
    """``lengths``: characters of the normal form, ascending. ``index``: bits, population and normal form of each length's index."""

    column: str
    lengths: tuple[int, ...]
    index: Index
    accepted: Override

    def __post_init__(self):
        if not isinstance(self.accepted, Override):
            raise ConfigurationError("a prefix index needs a record of who accepts its leakage")
        if not self.lengths or list(self.lengths) != sorted(set(self.lengths)) or not all(type(n) is int and n > 0 for n in self.lengths):
            raise ConfigurationError("lengths are ascending positive integers")
        if self.index.slow or self.index.as_hex:
            raise ConfigurationError("a prefix index is by HMAC, and stored as bytes")

    def of(self, length: int) -> Index:
        return replace(self.index, name=f"{self.index.name}-p{length}")

    def longest(self, text: str) -> int:
        """The length whose token a lookup of this text reads."""
        fit = [n for n in self.lengths if n <= len(text)]
        if not fit:
            raise NotSupported(f"{self.column}: the shortest declared prefix has {self.lengths[0]} characters; use the decrypted view")
        return fit[-1]


def _declared(frame: SealedFrame, prefix: Prefix):
    c = frame.table.column(prefix.column)
    if c.logical != "string":
        raise ConfigurationError(f"{c.name}: prefixes are of text")
    if not frame.table.pk:
        raise ConfigurationError("a prefix index needs a primary key")
    return c


def tokens(frame: SealedFrame, prefix: Prefix) -> DataFrame:
    """(token, prefix_length, primary key) of every value, one row per declared length that the value has."""
    engine, table, c = frame.engine, frame.table, _declared(frame, prefix)
    engine.write_gate("index prefixes")
    keep = list(dict.fromkeys([*table.pk, *([table.tenant] if table.tenant else []), *([table.row] if table.row else [])]))
    df = engine.open(frame.df.select(*keep, c.name), table, (c.name,))
    value = F.col(f"`{c.name}`")
    norm = N.normalize_col(prefix.index.form, value, codec.render(value, c.spark_type))
    df = with_scope(df.withColumn("__text", norm.cast("string")), table)
    of = F.array(*[F.struct(F.lit(n).alias("length"), F.when(F.char_length("__text") >= n, F.substring("__text", 1, n)).alias("text")) for n in prefix.lengths])
    df = df.select(*table.pk, SCOPE, F.explode(of).alias("p")).filter("p.text is not null").withColumn("__length", F.col("p.length"))
    scopes = engine._scopes(frame.df, table)
    engine.provider.warm(scopes)
    rows = []
    for s in scopes:
        for n in prefix.lengths:
            inner, outer = crypto.pads(engine.index_key(table.binding(c, s if table.tenant else None), prefix.of(n)))
            rows.append((bytearray(s), n, bytearray(inner), bytearray(outer)))
    pads = engine._small(rows, "x_scope binary, x_length int, x_ipad binary, x_opad binary")
    df = df.join(pads, (F.col(SCOPE) == F.col("x_scope")) & (F.col("__length") == F.col("x_length")))
    raw = crypto.hmac_padded(F.col("x_ipad"), F.col("x_opad"), F.encode("p.text", "UTF-8"))
    return df.select(crypto.truncate_col(raw, prefix.index.bits).alias("token"), F.col("__length").alias("prefix_length"), *table.pk)


def build(frame: SealedFrame, prefix: Prefix, path: str, files: int | None = None) -> PrefixFrame:
    """Writes the tokens of a table and gives the frame that looks them up."""
    rows = tokens(frame, prefix)
    order = ["prefix_length", "token", *frame.table.pk]
    spread = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.parquet(path)
    return PrefixFrame(frame, prefix, frame.engine.spark.read.parquet(path))


class PrefixFrame:
    """Prefix lookups over a sealed table and its stored tokens."""

    def __init__(self, frame: SealedFrame, prefix: Prefix, stored: DataFrame):
        self.column = _declared(frame, prefix)
        self.frame, self.prefix, self.stored = frame, prefix, stored

    def _norm(self, text: str) -> str:
        norm = N.normalize(self.prefix.index.form, text)
        if norm is None:
            raise SealError("INVALID_ARGUMENT", "a prefix to look up has no normal form")
        return norm.decode()

    def _asked(self, texts: tuple[str, ...], tenant: bytes | None) -> tuple[list[str], DataFrame]:
        """Normal forms, and primary keys of the rows with one of their tokens."""
        engine, table = self.frame.engine, self.frame.table
        norms = [self._norm(t) for t in texts]
        scopes = [tenant] if tenant is not None else engine._scopes(self.frame.df, table)
        engine.provider.warm(scopes)
        wanted: dict[int, dict[bytes, None]] = {}
        for text in norms:
            n = self.prefix.longest(text)
            for s in scopes:
                token = engine._derive(text[:n].encode(), table.binding(self.column, s if table.tenant else None), self.prefix.of(n))
                wanted.setdefault(n, {})[token] = None
        hit = F.lit(False)
        for n, found in wanted.items():
            hit = hit | ((F.col("prefix_length") == n) & F.col("token").isin(*[lit_bytes(t) for t in found]))
        return norms, self.stored.filter(hit).select(*table.pk)

    def candidates(self, *texts: str, tenant: bytes | None = None) -> DataFrame:
        """Rows whose token is asked for: a superset of the answer, as stored."""
        return self._found(self._asked(texts, tenant)[1], tenant)

    def _found(self, keys: DataFrame, tenant: bytes | None) -> DataFrame:
        table = self.frame.table
        df = self.frame.df.join(keys, list(table.pk), "left_semi")
        if tenant is not None and table.tenant:
            df = df.filter(tenant_bytes(df, table) == lit_bytes(tenant))
        return df

    def starts_with(self, *texts: str, tenant: bytes | None = None) -> Verified:
        """Exactly the rows whose normal form begins with that of one of the texts."""
        engine, table, c = self.frame.engine, self.frame.table, self.column
        norms, keys = self._asked(texts, tenant)
        opened = engine.open(self._found(keys, tenant).withColumn("__v", F.col(f"`{c.name}`")), table, (c.name,))
        value = F.col(f"`{c.name}`")
        norm = N.normalize_col(self.prefix.index.form, value, codec.render(value, c.spark_type)).cast("string")
        hit = F.lit(False)
        for text in norms:
            hit = hit | F.coalesce(norm.startswith(text), F.lit(False))
        out = opened.filter(hit).withColumn(c.name, F.col("__v")).drop("__v")
        return Verified(engine, out.withMetadata(c.name, table.metadata(c)), table)

    def over_fetch(self, *texts: str, tenant: bytes | None = None) -> DataFrame:
        """One row: rows that a lookup reads, rows that it answers with, and their ratio (null without answers)."""
        read = self.candidates(*texts, tenant=tenant).agg(F.count(F.lit(1)).alias("n_candidates"))
        answers = self.starts_with(*texts, tenant=tenant).df.agg(F.count(F.lit(1)).alias("n_answers"))
        return read.join(answers).select("n_candidates", "n_answers", F.try_divide("n_candidates", "n_answers").alias("ratio"))
