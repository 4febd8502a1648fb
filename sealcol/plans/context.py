"""What sealed bytes belong to, and how that is laid out.

A binding names a declared column of a table and what its bytes are for: envelopes, or the values of one of its indexes. Where
tables have tenants or bound rows, it names those too. Its layout is injective: a byte that tells which optional parts are
there, then each part behind its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigurationError, InvalidArgument
from .suites import FORMAT, suite

INDEX_NAME = re.compile(r"[a-z0-9-]{1,32}\Z")
#: Fixed values of the layout: what bytes are for.
FOR_ENVELOPES, FOR_INDEX = b"encrypt", b"index:"


def sized(b: bytes) -> bytes:
    return len(b).to_bytes(8, "big") + b


@dataclass(frozen=True)
class Binding:
    """``owner``: the ids of table and column, 32 bytes. ``index``: the name of one of its indexes, or None for its envelopes."""

    owner: bytes
    index: str | None = None
    tenant: bytes | None = None
    row: bytes | None = None

    def __post_init__(self):
        wrong = [type(x).__name__ for x in (self.owner, self.tenant, self.row) if not isinstance(x, (bytes, type(None)))]
        if wrong or self.owner is None or len(self.owner) != 32:
            raise InvalidArgument("a binding is of two ids of 16 bytes each; a tenant and a row are bytes")
        if self.index is not None and not INDEX_NAME.match(self.index):
            raise ConfigurationError("an index's name is 1 to 32 of a-z, 0-9 and '-'")

    @property
    def scope(self) -> bytes:
        """The tenant whose keys apply; empty where there are no tenants."""
        return self.tenant or b""

    def of_index(self, name: str) -> Binding:
        """The values of an index belong to no row."""
        return replace(self, index=name, row=None)

    def head(self, suite_id: int, tenant: bool, row: bool) -> bytes:
        """The layout up to the tenant."""
        there = sum(bit for bit, ok in ((1, tenant), (2, row)) if ok)
        return bytes([there]) + b"".join(map(sized, (suite(suite_id).id.to_bytes(2, "big"), self.owner[:16], self.owner[16:])))

    def tail(self) -> bytes:
        """The layout after the row."""
        return sized(FOR_ENVELOPES if self.index is None else FOR_INDEX + self.index.encode())

    def encoded(self, suite_id: int) -> bytes:
        optional = [sized(x) for x in (self.tenant, self.row) if x is not None]
        return self.head(suite_id, self.tenant is not None, self.row is not None) + b"".join(optional) + self.tail()


def lit_bytes(b: bytes) -> Column:
    return F.lit(bytearray(b))


def sized_col(c: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c).cast("long")), 16, "0")), c)


def encoded_col(binding: Binding, suite_id: int, tenant: Column | None = None, row: Column | None = None) -> Column:
    """encoded() per row: tenant and row, where given, are binary columns that are never null and stand for the binding's own."""
    parts = [sized_col(c) if c is not None else lit_bytes(sized(own)) for c, own in ((tenant, binding.tenant), (row, binding.row)) if c is not None or own is not None]
    head = binding.head(suite_id, tenant is not None or binding.tenant is not None, row is not None or binding.row is not None)
    return F.concat(lit_bytes(head), *parts, lit_bytes(binding.tail()))


def aad_col(key_id: Column, seed: Column, layout: Column) -> Column:
    return F.concat(lit_bytes(sized(bytes([FORMAT])) + (16).to_bytes(8, "big")), key_id, lit_bytes((32).to_bytes(8, "big")), seed, layout)
