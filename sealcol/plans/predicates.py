"""Predicates over sealed tables: what an index can answer, and the shapes that are refused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn

from ..errors import NotSupported
from .declare import Table

class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __xor__(self, other: Predicate) -> Predicate:
        return Xor((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class In(Predicate):
    """Equality with one of some values; None never matches."""

    column: str
    values: tuple


@dataclass(frozen=True)
class Null(Predicate):
    column: str
    negated: bool = False


@dataclass(frozen=True)
class Plain(Predicate):
    """A condition on plain columns."""

    condition: SparkColumn


@dataclass(frozen=True)
class Lookup(Predicate):
    column: str
    name: str
    value: object


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Xor(Predicate):
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


@dataclass(frozen=True)
class Ref:
    """A sealed column in a predicate: ref("email").eq("x")."""

    column: str

    def eq(self, value: object) -> Predicate:
        return Null(self.column) if value is None else In(self.column, (value,))

    def isin(self, *values: object) -> Predicate:
        return In(self.column, tuple(values))

    def is_null(self) -> Predicate:
        return Null(self.column)

    def is_not_null(self) -> Predicate:
        return Null(self.column, True)

    def lookup(self, name: str, value: object) -> Predicate:
        return Lookup(self.column, name, value)


def ref(column: str) -> Ref:
    return Ref(column)


def sealed_terms(p: Predicate) -> list[In]:
    """Equality terms over sealed columns, anywhere in a predicate."""
    if isinstance(p, In):
        return [p]
    parts = p.parts if isinstance(p, (And, Or, Xor)) else (p.part,) if isinstance(p, Not) else ()
    return [t for x in parts for t in sealed_terms(x)]


def conjuncts(p: Predicate, table: Table, verified: bool) -> list[Predicate]:
    """The terms of a conjunction. Everything that a bucketed index would answer wrongly is refused here, before any plan."""
    if isinstance(p, And):
        return [x for part in p.parts for x in conjuncts(part, table, verified)]
    if isinstance(p, In):
        if table.column(p.column).index is None:
            raise NotSupported(f"{p.column} has no index; filter its decrypted view")
        return [p]
    if isinstance(p, Null):
        table.column(p.column)
        return [p]
    if isinstance(p, Plain):
        return [p]
    if isinstance(p, Lookup):
        raise NotSupported(f"{p.name} on {p.column}: an index answers equality and membership only; use the decrypted view")
    if isinstance(p, Not):
        if isinstance(p.part, Null):
            return [Null(p.part.column, not p.part.negated)]
        if not sealed_terms(p) and isinstance(p.part, Plain):
            return [Plain(~p.part.condition)]
        raise NotSupported("a negated index term loses rows that share a bucket; use anti_join with the verified rows, or the decrypted view")
    if isinstance(p, Xor):
        raise NotSupported("XOR over an index term is never exact; use the decrypted view")
    if isinstance(p, Or):
        if verified and sealed_terms(p):
            raise NotSupported("OR over an index term is not verified term by term; use filter_any, or the decrypted view")
        for part in p.parts:
            conjuncts(part, table, verified)
        return [p]
    raise NotSupported(f"{type(p).__name__} is no predicate that an index answers")
