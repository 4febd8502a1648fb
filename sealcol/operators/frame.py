"""Sealed tables as frames: what an index answers is verified, what it cannot answer is refused or done on decrypted values.

``SealedFrame`` holds envelopes. ``filter`` gives a ``Verified`` frame: candidates by index value, then each row's normal form
compared. Verification is part of the plan, so limits, projections, aggregates and joins after it are exact (a widening: an
engine outside the database refuses them). ``decrypted`` is an ordinary lazy DataFrame on which every operation is exact.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..engine import SCOPE, Engine, tenant_bytes, with_scope
from ..errors import NotSupported, SealError
from ..functions import codec
from ..functions import normalize as N
from ..plans import lineage
from ..plans import predicates as P
from ..plans.context import lit_bytes
from ..plans.declare import Table
from ..plans.declare import Column as SealedColumn
from ..plans.keys import Labels  # noqa: F401  (part of the public face)


#: Index values up to which a lookup under many tenants is pushed to the scan as well.
PUSHED = 1000


class SealedFrame:
    def __init__(self, engine: Engine, df: DataFrame, table: Table):
        self.engine, self.df, self.table = engine, df, table

    # reading

    def decrypted(self, *columns: str) -> DataFrame:
        """The table with these sealed columns (or all) opened; index siblings and other sealed columns are left out."""
        names = columns or tuple(c.name for c in self.table.columns)
        sealed = {c.name for c in self.table.columns} - set(names) | {c.sibling for c in self.table.columns}
        return self.engine.open(self.df, self.table, names).drop(*sealed)

    def unsafe_raw(self) -> DataFrame:
        """The stored bytes, with nothing to keep them from being sorted or grouped."""
        return self.df

    # filters

    def _targets(self, term: P.In) -> tuple[SealedColumn, list[bytes], list[bytes]]:
        """A term's values, once: normal forms, and canonical bytes of values that have none."""
        c = self.table.column(term.column)
        values = [v for v in term.values if v is not None]
        if not values:
            return c, [], []
        rendered = [codec.canonical_bytes(v, c.logical) for v in values]
        norms, bare = [], []
        for raw in rendered:
            norm = N.normalize(c.index.form, raw)
            if norm is None and not c.index.bucket:
                raise SealError("INVALID_ARGUMENT", "a value to look up has no normal form")
            (bare if norm is None else norms).append(raw if norm is None else norm)
        return c, norms, bare

    def _candidates(self, df: DataFrame, term: P.In, tenant: bytes | None) -> DataFrame:
        c, norms, bare = self._targets(term)
        messages = list(dict.fromkeys(norms + ([self.engine.labels.unindexable] if bare else [])))
        if not messages:
            return df.filter(F.lit(False))
        index, sibling = c.index, F.col(f"`{c.sibling}`")
        if self.table.tenant and tenant is None:
            # every tenant has its own index key: the targets of each, once, meet the rows on tenant and index value
            if index.slow:
                raise NotSupported("an argon2id index of a table with tenants is asked for one tenant at a time")
            scopes = self.engine._scopes(df, self.table)
            self.engine.provider.warm(scopes)
            targets = [(s, b) for s in scopes for b in dict.fromkeys(self.engine._derive(m, self.table.binding(c, s), index) for m in messages)]
            told = list(dict.fromkeys(b for _, b in targets))
            if len(told) <= PUSHED:  # the scan leaves out what no tenant asks for
                df = df.filter(sibling.isin(*[b.hex() for b in told]) if index.as_hex else sibling.isin(*[lit_bytes(b) for b in told]))
            rows = [(bytearray(s), b.hex() if index.as_hex else bytearray(b)) for s, b in targets]
            asked = self.engine._small(rows, f"t_scope binary, t_index {'string' if index.as_hex else 'binary'}")
            df = with_scope(df, self.table)
            return df.join(asked, (F.col(SCOPE) == F.col("t_scope")) & (sibling == F.col("t_index")), "left_semi").drop(SCOPE)
        ctx = self.table.binding(c, tenant)
        found = list(dict.fromkeys(self.engine._derive(m, ctx, index) for m in messages))
        if self.table.tenant:
            df = df.filter(tenant_bytes(df, self.table) == lit_bytes(tenant))
        return df.filter(sibling.isin(*[b.hex() for b in found]) if index.as_hex else sibling.isin(*[lit_bytes(b) for b in found]))

    def _verify(self, df: DataFrame, term: P.In) -> DataFrame:
        """Rows whose own normal form is a target's; values without one are compared by their bytes."""
        c, norms, bare = self._targets(term)
        if not norms and not bare:
            return df.filter(F.lit(False))
        opened = self.engine.open(df.withColumn(f"__v_{c.name}", F.col(f"`{c.name}`")), self.table, (c.name,))
        plain = codec.render(F.col(f"`{c.name}`"), c.spark_type)
        norm = N.normalize_col(c.index.form, F.col(f"`{c.name}`"), plain)
        hit = F.lit(False)
        if norms:
            hit = hit | F.coalesce(norm.isin(*[lit_bytes(m) for m in norms]), F.lit(False))
        if bare:
            hit = hit | F.coalesce(norm.isNull() & plain.isin(*[lit_bytes(m) for m in bare]), F.lit(False))
        out = opened.filter(hit).withColumn(c.name, F.col(f"`__v_{c.name}`")).drop(f"__v_{c.name}")
        return out.withMetadata(c.name, self.table.metadata(c))

    def filter(self, predicate: P.Predicate, tenant: bytes | None = None) -> Verified:
        """Exact rows of a conjunction of index terms, null tests and plain conditions."""
        terms = P.conjuncts(predicate, self.table, verified=True)
        df = self.df
        for t in terms:
            if isinstance(t, P.Plain):
                lineage.guard_over(self.df.filter(t.condition), self.df, self.table, tests=False)
                df = df.filter(t.condition)
            elif isinstance(t, P.Null):
                e = F.col(f"`{t.column}`")
                df = df.filter(e.isNotNull() if t.negated else e.isNull())
            elif isinstance(t, P.In):
                df = self._candidates(df, t, tenant)
        for t in terms:
            if isinstance(t, P.In):
                df = self._verify(df, t)
        return Verified(self.engine, df, self.table)

    def filter_any(self, *parts: P.Predicate) -> Verified:
        """The exact union of several verified filters: what OR stands for. Needs a primary key."""
        found = [self.filter(p) for p in parts]
        return reduce(lambda a, b: a.union(b), found)

    def candidates(self, predicate: P.Predicate, tenant: bytes | None = None) -> Candidates:
        """A superset: rows whose index values match. Nothing is opened."""

        def walk(p: P.Predicate, df: DataFrame) -> DataFrame:
            if isinstance(p, P.Or):
                return reduce(lambda a, b: a.union(b), [walk(x, df) for x in p.parts]).dropDuplicates(list(self.table.pk) or None)
            for t in P.conjuncts(p, self.table, verified=False):
                if isinstance(t, P.Or):
                    df = walk(t, df)
                elif isinstance(t, P.Plain):
                    lineage.guard_over(self.df.filter(t.condition), self.df, self.table, tests=False)
                    df = df.filter(t.condition)
                elif isinstance(t, P.Null):
                    df = df.filter(F.col(f"`{t.column}`").isNotNull() if t.negated else F.col(f"`{t.column}`").isNull())
                else:
                    df = self._candidates(df, t, tenant)
            return df

        return Candidates(self.engine, walk(predicate, self.df), self.table)

    # shapes that need no key

    def count_nonnull(self, column: str) -> int:
        """Exact without opening anything."""
        self.table.column(column)
        return self.df.agg(F.count(F.col(f"`{column}`")).alias("n")).first()["n"]

    def group_count(self, by: Iterable[str], column: str) -> DataFrame:
        """Rows with a value of a sealed column, by plain columns."""
        names = list(by)
        self._plain_only(names)
        return self.df.groupBy(*names).agg(F.count(F.col(f"`{column}`")).alias("n"))

    def bucket_groups(self, column: str) -> DataFrame:
        """Rows by index value. Buckets hold several values: their count is no count of values."""
        c = self.table.column(column)
        return self.df.groupBy(F.col(f"`{c.sibling}`").alias(f"bucket_{column}")).agg(F.count(F.lit(1)).alias("bucket_rows"))

    def order_by_bucket(self, column: str) -> DataFrame:
        """A deterministic order without meaning."""
        return self.df.orderBy(self.table.column(column).sibling, *self.table.pk)

    # shapes that are refused on envelopes

    def _plain_only(self, names: Iterable[str]) -> None:
        for n in names:
            for c in self.table.columns:
                if n in (c.name, c.sibling):
                    raise NotSupported(f"{n} holds sealed bytes; use decrypted({c.name!r})")

    def order_by(self, *names: str) -> DataFrame:
        self._plain_only(names)
        return self.df.orderBy(*names)

    def group_by(self, *names: str):
        self._plain_only(names)
        return self.df.groupBy(*names)

    def distinct(self, *names: str) -> DataFrame:
        self._plain_only(names)
        return self.df.select(*names).distinct()

    def aggregate(self, **functions: Column) -> DataFrame:
        """Aggregates of plain columns, and counts of sealed ones."""
        return lineage.guard_over(self.df.agg(*[e.alias(k) for k, e in functions.items()]), self.df, self.table)

    def join(self, other: DataFrame | SealedFrame, on: str, how: str = "inner") -> DataFrame:
        """An equi-join on a plain key."""
        self._plain_only([on])
        if isinstance(other, SealedFrame):
            other._plain_only([on])
            other = other.df
        return self.df.join(other, on, how)

    def join_decrypted(self, column: str, other: SealedFrame, other_column: str) -> DataFrame:
        """An equi-join of two sealed columns on their opened values; index values of two columns are never comparable."""
        left, right = self.decrypted(column), other.decrypted(other_column)
        return left.join(right, left[column] == right[other_column])

    # writing

    def update(self, where: Verified, **values: Column) -> DataFrame:
        """The whole table with new values in the verified rows; sealed columns and their siblings are made anew together."""
        plain = {k: v for k, v in values.items() if k not in self.table.by_name}
        sealed = {k: v for k, v in values.items() if k in self.table.by_name}
        keys = list(self.table.pk)
        hit = where.df.select(*keys, F.lit(True).alias("__hit"))
        marked = self.df.join(hit, keys, "left")
        new = marked.filter("__hit").drop("__hit")
        for k, v in plain.items():
            new = new.withColumn(k, v)
        if sealed:
            for k in sealed:
                new = new.drop(self.table.column(k).sibling)
            for k, v in sealed.items():
                new = new.withColumn(k, v)
            new = self.engine.seal(new, self.table, tuple(sealed))
        return marked.filter("__hit is null").drop("__hit").unionByName(new)

    def upsert(self, rows: DataFrame) -> DataFrame:
        """The table with plain rows sealed and put in the place of those with their keys."""
        sealed = self.engine.seal(rows, self.table)
        return self.df.join(rows.select(*self.table.pk), list(self.table.pk), "left_anti").unionByName(sealed)

    def delete(self, where: Verified) -> DataFrame:
        """The table without verified rows."""
        return self.df.join(where.df.select(*self.table.pk), list(self.table.pk), "left_anti")

    def include(self, child: Verified | DataFrame, fk: str, name: str) -> DataFrame:
        """Rows with an array of their child rows; a verified child is nested after it is verified."""
        rows = child.df if isinstance(child, Verified) else child
        nested = rows.groupBy(fk).agg(F.collect_list(F.struct(*rows.columns)).alias(name))
        return self.df.join(nested.withColumnRenamed(fk, self.table.pk[0]), self.table.pk[0], "left")


class Verified(SealedFrame):
    """Exactly the rows that a filter asks for."""

    def count(self) -> int:
        return self.df.count()

    def exists(self) -> bool:
        return not self.df.isEmpty()

    def first(self, *order: str):
        """The first row by plain columns, or None."""
        self._plain_only(order)
        return Verified(self.engine, self.df.orderBy(*(order or self.table.pk)).limit(1), self.table).decrypted().first()

    def last(self, *order: str):
        self._plain_only(order)
        return Verified(self.engine, self.df.orderBy(*[F.desc(c) for c in order or self.table.pk]).limit(1), self.table).decrypted().first()

    def get(self):
        """The only row."""
        rows = Verified(self.engine, self.df.limit(2), self.table).decrypted().collect()
        if len(rows) != 1:
            raise LookupError("no row" if not rows else "more than one row")
        return rows[0]

    def limit(self, n: int, *order: str, offset: int = 0) -> Verified:
        self._plain_only(order)
        return Verified(self.engine, self.df.orderBy(*(order or self.table.pk)).offset(offset).limit(n), self.table)

    def _pks(self) -> list[str]:
        if not self.table.pk:
            raise NotSupported("set operations on verified rows need a primary key")
        return list(self.table.pk)

    def union(self, other: Verified) -> Verified:
        _same(self, other)
        return Verified(self.engine, self.df.unionByName(other.df).dropDuplicates(self._pks()), self.table)

    def intersect(self, other: Verified) -> Verified:
        _same(self, other)
        return Verified(self.engine, self.df.join(other.df.select(*self._pks()), self._pks(), "left_semi"), self.table)

    def difference(self, other: Verified) -> Verified:
        _same(self, other)
        return Verified(self.engine, self.df.join(other.df.select(*self._pks()), self._pks(), "left_anti"), self.table)

    def semi_join(self, df: DataFrame, fk: str) -> DataFrame:
        """Rows of another table that refer to these."""
        return df.join(self.df.select(F.col(self._pks()[0]).alias(fk)), fk, "left_semi")

    def anti_join(self, df: DataFrame, fk: str) -> DataFrame:
        return df.join(self.df.select(F.col(self._pks()[0]).alias(fk)), fk, "left_anti")


def _same(a: SealedFrame, b: SealedFrame) -> None:
    if not isinstance(b, Verified):
        raise NotSupported("only verified rows can be combined with verified rows")
    if a.table != b.table:
        raise NotSupported("both sides are rows of one table")


class Candidates:
    """Rows that may match. They can be narrowed, united and intersected; never negated, counted as answers, or limited."""

    def __init__(self, engine: Engine, df: DataFrame, table: Table):
        self.engine, self._df, self.table = engine, df, table

    def rows(self) -> DataFrame:
        """The candidates' stored bytes; a superset of the answer."""
        return self._df

    def filter(self, condition: Column) -> Candidates:
        return Candidates(self.engine, lineage.guard_over(self._df.filter(condition), self._df, self.table, tests=False), self.table)

    def union(self, other: Candidates) -> Candidates:
        return Candidates(self.engine, self._df.unionByName(other._df).dropDuplicates(list(self.table.pk) or None), self.table)

    def intersect(self, other: Candidates) -> Candidates:
        return Candidates(self.engine, self._df.join(other._df.select(*self.table.pk), list(self.table.pk), "left_semi"), self.table)

    def semi_join(self, df: DataFrame, fk: str) -> DataFrame:
        """A superset of the rows that refer to an answer."""
        return df.join(self._df.select(F.col(self.table.pk[0]).alias(fk)), fk, "left_semi")

    def __getattr__(self, name: str):
        raise NotSupported(f"{name} over unverified candidates would be a wrong answer; use filter()")
