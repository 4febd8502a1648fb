"""Keys: tenants' data and index keys, providers of them, and the relation that carries them to executors.

Keys are rows, never literals: literals are printed in plans. Providers work on the driver and do no I/O outside ``warm``.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from dataclasses import dataclass, field
from typing import Protocol

from ..errors import ConfigurationError, InvalidArgument, SealError
from ..functions.crypto import hkdf
from .context import sized
from .suites import KEY_ID_LEN

KEY_LEN = 32


@dataclass(frozen=True)
class Labels:
    """Fixed strings of the derivations. Data sealed by another implementation needs that implementation's own."""

    index: bytes = b"sealcol-index-v1"
    commitment: bytes = b"sealcol-commit-v1"
    argon2_salt: bytes = b"sealcol-argon2-salt-v1"
    unindexable: bytes = b"\xffsealcol-unindexable-v1"
    record: bytes = b"sealcol-record-v1"
    derived: bytes = b"sealcol-derived-provider-v1"
    derived_tag: bytes = b"SCDK"


@dataclass(frozen=True)
class DataKey:
    """One version of a tenant's data key."""

    scope: bytes
    version: int
    key_id: bytes
    dek: bytes = field(repr=False)
    active: bool = True

    def __post_init__(self):
        if len(self.key_id) != KEY_ID_LEN or len(self.dek) != KEY_LEN:
            raise ConfigurationError("a key id has 16 bytes and a data key 32")


class KeyProvider(Protocol):
    def warm(self, scopes: list[bytes]) -> None: ...
    def data_keys(self, scope: bytes) -> list[DataKey]: ...
    def index_key(self, scope: bytes) -> bytes: ...


def _active(keys: list[DataKey]) -> DataKey:
    found = [k for k in keys if k.active]
    if len(found) != 1:
        raise SealError("KEY_UNAVAILABLE", "a scope has no active key")
    return found[0]


class StaticKeyProvider:
    """One data key and one index key for every scope; for tests and single-tenant tables."""

    def __init__(self, dek: bytes, index_key: bytes, key_id: bytes = bytes(16), only_key_id: bool = True):
        if dek == index_key:
            raise ConfigurationError("the index key is a key of its own, not the data key")
        if len(index_key) != KEY_LEN:
            raise ConfigurationError("an index key has 32 bytes")
        self._key, self._index = DataKey(b"", 1, key_id, dek), index_key

    def warm(self, scopes: list[bytes]) -> None:
        pass

    def data_keys(self, scope: bytes) -> list[DataKey]:
        return [DataKey(scope, 1, self._key.key_id, self._key.dek)]

    def index_key(self, scope: bytes) -> bytes:
        return self._index


class DerivedKeyProvider:
    """Every scope's keys from one root secret. Versions are independent derivations; index keys know no version."""

    def __init__(self, root: bytes, versions: tuple[int, ...] = (1,), active: int | None = None, labels: Labels = Labels()):
        if not isinstance(root, bytes) or len(root) < 32:
            raise ConfigurationError("a root secret has at least 32 bytes")
        if not versions or len(set(versions)) != len(versions) or not all(isinstance(v, int) and 0 <= v < 2**32 for v in versions):
            raise ConfigurationError("versions are distinct integers below 2**32")
        self._root, self.versions, self.active, self.labels = root, tuple(versions), max(versions) if active is None else active, labels
        if self.active not in self.versions:
            raise ConfigurationError("the active version is one of the versions")

    def _derive(self, what: bytes, scope: bytes, n: int) -> bytes:
        return hkdf(self._root, self.labels.derived, what + sized(scope), n)

    def warm(self, scopes: list[bytes]) -> None:
        pass

    def key_id(self, scope: bytes, version: int) -> bytes:
        return self.labels.derived_tag + self._derive(b"scope-tag", scope, 8) + version.to_bytes(4, "big")

    def data_keys(self, scope: bytes) -> list[DataKey]:
        order = sorted(self.versions, key=lambda v: v != self.active)
        return [DataKey(scope, v, self.key_id(scope, v), self._derive(b"dek" + v.to_bytes(4, "big"), scope, 32), v == self.active) for v in order]

    def index_key(self, scope: bytes) -> bytes:
        return self._derive(b"index-key", scope, 32)


class Wrapper(Protocol):
    def unwrap(self, wrapped: bytes) -> bytes: ...


@dataclass(frozen=True)
class WrappedKey:
    scope: bytes
    version: int
    key_id: bytes
    wrapped_dek: bytes
    active: bool = True


class KeyDirectory:
    """Wrapped keys by scope. Key ids are unique, and a scope has exactly one active version."""

    def __init__(self, keys: list[WrappedKey], index_keys: dict[bytes, bytes]):
        if len({k.key_id for k in keys}) != len(keys):
            raise ConfigurationError("key ids are unique")
        self.keys: dict[bytes, list[WrappedKey]] = {}
        for k in keys:
            self.keys.setdefault(k.scope, []).append(k)
        for scope, own in self.keys.items():
            if sum(k.active for k in own) != 1 or len({k.version for k in own}) != len(own):
                raise ConfigurationError("a scope has one active key and distinct versions")
            if scope not in index_keys:
                raise ConfigurationError("a scope has an index key of its own")
        self.index_keys = dict(index_keys)


class KeyCache:
    """Unwrapped keys with an age, a number of uses and a capacity; the least recently used goes first, wiped."""

    def __init__(self, max_age: float = 300.0, max_uses: int | None = None, capacity: int = 1000, clock=time.monotonic):
        if max_age <= 0 or capacity < 1 or (max_uses is not None and max_uses < 1):
            raise ConfigurationError("a cache's bounds are positive")
        self.max_age, self.max_uses, self.capacity, self._clock = max_age, max_uses, capacity, clock
        self._held: OrderedDict[tuple, list] = OrderedDict()
        self.hits = self.misses = self.evictions = 0

    def _drop(self, name: tuple) -> None:
        held = self._held.pop(name)
        held[0][:] = bytes(len(held[0]))
        self.evictions += 1

    def put(self, name: tuple, key: bytes, keep: set[tuple] = frozenset()) -> None:
        """Those in ``keep`` make no room: a job's own keys, which may be more than the capacity until the next job."""
        if name in self._held:
            self._drop(name)
        if len(self._held) >= self.capacity:
            self.trim(self.capacity - 1, keep)
        self._held[name] = [bytearray(key), self._clock(), 0]

    def trim(self, size: int, keep: set[tuple] = frozenset()) -> None:
        for name in [n for n in self._held if n not in keep][: max(0, len(self._held) - size)]:
            self._drop(name)

    def peek(self, name: tuple) -> bool:
        held = self._held.get(name)
        return held is not None and self._clock() - held[1] < self.max_age

    def get(self, name: tuple, uses: int = 1) -> bytes | None:
        """The key, charged with ``uses``: a job charges the rows it seals."""
        held = self._held.get(name)
        if held is not None and (self._clock() - held[1] >= self.max_age or (self.max_uses is not None and held[2] + uses > self.max_uses)):
            self._drop(name)
            held = None
        if held is None:
            self.misses += 1
            return None
        held[2] += uses
        self.hits += 1
        self._held.move_to_end(name)
        return bytes(held[0])

    def evict(self, name: tuple) -> None:
        if name in self._held:
            self._drop(name)

    def clear(self) -> None:
        for name in list(self._held):
            self._drop(name)


class EnvelopeKeyProvider:
    """Keys of a directory, unwrapped in ``warm`` only and cached; a scope that is not warm has no keys."""

    def __init__(self, directory: KeyDirectory, wrapper: Wrapper, cache: KeyCache | None = None):
        self.directory, self.wrapper, self.cache = directory, wrapper, cache or KeyCache()

    def warm(self, scopes: list[bytes]) -> None:
        """Unwraps what a job needs. All of it stays until the next job is warmed, however many scopes there are."""
        wrapped = {}
        for scope in dict.fromkeys(scopes):
            wrapped |= {("dek", k.key_id): k.wrapped_dek for k in self.directory.keys.get(scope, [])}
            if scope in self.directory.index_keys:
                wrapped["index", scope] = self.directory.index_keys[scope]
        own = set(wrapped)
        self.cache.trim(self.cache.capacity, own)
        for name, key in wrapped.items():
            if not self.cache.peek(name):
                self.cache.put(name, self.wrapper.unwrap(key), own)

    def data_keys(self, scope: bytes) -> list[DataKey]:
        own = sorted(self.directory.keys.get(scope, []), key=lambda k: not k.active)
        found = [(k, self.cache.get(("dek", k.key_id))) for k in own]
        return [DataKey(scope, k.version, k.key_id, dek, k.active) for k, dek in found if dek is not None]

    def index_key(self, scope: bytes) -> bytes:
        key = self.cache.get(("index", scope))
        if key is None:
            raise SealError("KEY_UNAVAILABLE", "a scope's index key is not warm")
        return key


def write_key(provider: KeyProvider, scope: bytes) -> DataKey:
    return _active(provider.data_keys(scope))


def check_scope(scope: object) -> bytes:
    if not isinstance(scope, bytes):
        raise InvalidArgument("a scope is bytes")
    return scope
