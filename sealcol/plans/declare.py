"""Declarations of sealed columns and their blind indexes: validated when made, carried in column metadata."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from ..errors import ConfigurationError
from ..functions import normalize as N
from ..functions.codec import LOGICAL, opening_type
from .context import INDEX_NAME, Binding
from .suites import AES_GCM, suite

HMAC, ARGON2 = "hmac-sha512", "argon2id"
#: The least costs of argon2id, the population below which an index needs a recorded override.
LEAST_TIME, LEAST_MEMORY = 3, 32768
CARDINALITY_GATE = 1 << 10
PROCEDURE_VERSION = 3
META = "sealed"


@dataclass(frozen=True)
class Override:
    """Who allowed an exception, when and why."""

    reason: str
    approved_by: str
    date: str

    def __post_init__(self):
        if not all(isinstance(x, str) and x.strip() for x in (self.reason, self.approved_by, self.date)):
            raise ConfigurationError("an override has a reason, a name and a date")


@dataclass(frozen=True)
class Slow:
    """The cost of an argon2id index: passes, and KiB of memory."""

    passes: int = LEAST_TIME
    kib: int = LEAST_MEMORY


@dataclass(frozen=True)
class Index:
    """A blind index: how many leading bits of a keyed function of a value's normal form are stored.

    ``population`` is how many different values are expected in time. ``slow`` makes it argon2id instead of HMAC. ``few`` is
    the record that allows an index over few or skewed values, ``bucket`` the one that gives values without a normal form
    a bucket of their own, where they would be refused.
    """

    bits: int
    population: int
    suite: int = AES_GCM.id
    name: str = "exact"
    form: str = N.IDENTITY
    slow: Slow | None = None
    as_hex: bool = False
    skewed: bool = False
    few: Override | None = None
    bucket: Override | None = None

    def __post_init__(self):
        suite(self.suite)
        N.check(self.form)
        for problem in self._problems():
            raise ConfigurationError(f"index {self.name!r}: {problem}")

    def _problems(self):
        if not isinstance(self.name, str) or not INDEX_NAME.match(self.name):
            yield "a name is 1 to 32 of a-z, 0-9 and '-'"
        numbers = [self.bits, self.population, *([self.slow.passes, self.slow.kib] if self.slow else [])]
        if any(type(x) is not int for x in numbers):
            yield "bits, population and costs are integers"
        if self.slow and (self.slow.passes < LEAST_TIME or self.slow.kib < LEAST_MEMORY):
            yield f"argon2id takes at least {LEAST_TIME} passes and {LEAST_MEMORY} KiB"
        if self.population < 16 or not 1 <= self.bits <= 512:
            yield "a population is 16 at least, bits are 1 to 512"
        values = self.population / 2**self.bits
        if values < 2 or values * values >= self.population:
            yield f"{self.bits} bits leave {values:.3g} values a bucket, outside 2 <= P / 2**b < sqrt(P) for P = {self.population}"
        if (self.skewed or self.population < CARDINALITY_GATE) and not self.few:
            yield "few or skewed values need a record that allows them"
        if self.bucket and self.form not in N.REFUSING:
            yield "only a normal form that refuses values has a bucket for them"

    @property
    def function(self) -> str:
        return ARGON2 if self.slow else HMAC

    def recorded(self) -> dict:
        """What decides the stored bytes, under the fixed names of the configuration document."""
        costs = {"memory_kib": self.slow.kib, "time_cost": self.slow.passes} if self.slow else None
        return {"index_id": self.name, "idf": self.function, "argon2": costs, "normalize": self.form, "truncate_bits": self.bits, "on_unindexable": "bucket" if self.bucket else "refuse", "storage": "hex" if self.as_hex else "binary", "suite_id": self.suite}


def bits_for(population: int) -> int:
    """The most bits that leave two values a bucket on average."""
    return population.bit_length() - 2


@dataclass(frozen=True)
class Column:
    """A sealed column: its surrogate id, its logical type, its index, and where the envelope is stored.

    ``opens_as`` is the Spark type that an int or a decimal opens to, where it is wider than bigint or not decimal(38,18); what
    that type does not hold exactly is refused when it is sealed.
    """

    name: str
    uuid: bytes
    logical: str
    index: Index | None = None
    storage: str = "binary"
    source: str | None = None
    opens_as: str | None = None

    def __post_init__(self):
        if len(self.uuid) != 16:
            raise ConfigurationError(f"{self.name}: a column's id has 16 bytes")
        if self.logical not in LOGICAL:
            raise ConfigurationError(f"{self.name}: {self.logical!r} is none of {', '.join(LOGICAL)}")
        if self.storage not in ("binary", "base64"):
            raise ConfigurationError(f"{self.name}: storage is 'binary' or 'base64'")
        self.spark_type  # noqa: B018  (refuses what is no type for it)

    @property
    def spark_type(self):
        return opening_type(self.logical, self.opens_as)

    @property
    def sibling(self) -> str:
        return f"{self.name}_bidx"


@dataclass(frozen=True)
class Table:
    """A table with sealed columns. ``tenant`` names the plain column whose text is the tenant; ``row`` binds rows by a key."""

    name: str
    uuid: bytes
    columns: tuple[Column, ...]
    pk: tuple[str, ...] = ()
    tenant: str | None = None
    row: str | None = None
    by_name: dict[str, Column] = field(init=False, repr=False, compare=False, default_factory=dict)

    def __post_init__(self):
        if len(self.uuid) != 16:
            raise ConfigurationError("a table's id has 16 bytes")
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names) or len({c.uuid for c in self.columns}) != len(names):
            raise ConfigurationError("columns have names and ids of their own")
        self.by_name.update({c.name: c for c in self.columns})

    def column(self, name: str) -> Column:
        if name not in self.by_name:
            raise ConfigurationError(f"{name} is not a sealed column of {self.name}")
        return self.by_name[name]

    def binding(self, c: Column, tenant: bytes | None = None) -> Binding:
        return Binding(self.uuid + c.uuid, tenant=tenant)

    def metadata(self, c: Column) -> dict:
        """A column's declaration, as it travels in a schema; what it must equal when read again."""
        return {META: json.dumps({"table": self.uuid.hex(), "column": c.uuid.hex(), "logical": c.logical, "storage": c.storage, "tenant": self.tenant, "row": self.row, "index": c.index.recorded() if c.index else None, **({"opens_as": c.opens_as} if c.opens_as else {})}, sort_keys=True)}


def run_config(table: Table, job: str, write_suite: int = AES_GCM.id, cursor_types: dict[str, str] | None = None, tenant_type: str = "text") -> dict:
    """The inputs that decide the bytes a job writes."""
    tenant = {"column": table.tenant, "type": tenant_type} if table.tenant else None
    columns = [{"column_uuid": c.uuid.hex(), "logical_type": c.logical, "storage": c.storage, "source": c.source if job == "encrypt" else None, "indexes": [c.index.recorded()] if c.index and job == "encrypt" else [], "tenant": tenant} for c in sorted(table.columns, key=lambda c: c.uuid)]
    return {"procedure_version": PROCEDURE_VERSION, "job": job, "table_uuid": table.uuid.hex(), "write_suite": write_suite, "cursor": [{"name": k, "type": (cursor_types or {}).get(k, "int")} for k in table.pk], "columns": columns}


def config_hash(config: dict) -> str:
    """SHA-256 of the canonical ASCII JSON."""
    text = json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    if "\\" in text:
        raise ConfigurationError("names in a configuration are printable ASCII without quotes and backslashes")
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def leaves(config: object, at: str = "") -> set[tuple[str, str]]:
    """A document as (path, value) pairs; empty lists and objects are values."""
    inside = config.items() if isinstance(config, dict) else enumerate(config) if isinstance(config, list) else ()
    found = {x for k, v in inside for x in leaves(v, f"{at}/{k}")}
    return found or {(at, json.dumps(config))}


def changed_paths(stored: dict, live: dict) -> list[str]:
    """Where two documents do not hold the same."""
    return sorted({path for path, _ in leaves(stored) ^ leaves(live)})


def overrides(table: Table) -> list[dict]:
    """Exceptions on record, for reports."""
    return [{"column": c.name, "kind": kind, **asdict(o)} for c in table.columns if c.index for kind, o in (("cardinality", c.index.few), ("unindexable", c.index.bucket)) if o]
