"""HMAC-SHA-512 and HKDF, on the driver and as Catalyst expressions.

An HMAC key column is XORed with its pads as text of one character a byte, by translate(); all else is sha2 over concatenations.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError
from ..plans.context import lit_bytes

BLOCK = 128
IPAD, OPAD = 0x36, 0x5C


def hkdf(ikm: bytes, salt: bytes, info: bytes, length: int) -> bytes:
    prk = hmac.digest(salt or bytes(64), ikm, "sha512")
    out, t, i = b"", b"", 1
    while len(out) < length:
        t = hmac.digest(prk, t + info + bytes([i]), "sha512")
        out, i = out + t, i + 1
    return out[:length]


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The two blocks that an HMAC under this key hashes first."""
    key = (hashlib.sha512(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    return bytes(b ^ IPAD for b in key), bytes(b ^ OPAD for b in key)


def let(value: Column, f) -> Column:
    """f(value) with the value bound once: when Catalyst inlines what it pushes down, the expression stays of linear size."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def sha512(c: Column) -> Column:
    return F.unhex(F.sha2(c, 512))


#: A character a byte. translate() drops what it maps to NUL, so another character stands for it on the way.
LATIN, BYTES, NUL = "ISO-8859-1", "".join(map(chr, range(256))), chr(256)


def _block(key: Column, size: int, pad: int) -> Column:
    to = "".join(chr(b ^ pad) if b != pad else NUL for b in range(256))
    turned = F.translate(F.decode(key, LATIN), BYTES, to)
    return F.concat(F.encode(F.replace(turned, F.lit(NUL), F.lit("\0")), LATIN), lit_bytes(bytes([pad]) * (BLOCK - size)))


def hmac_padded(ipad: Column, opad: Column, message: Column) -> Column:
    return sha512(F.concat(opad, sha512(F.concat(ipad, message))))


def hmac_col(key: Column, size: int, message: Column) -> Column:
    """HMAC under a key column of ``size`` bytes, up to 128."""
    return let(key, lambda k: hmac_padded(_block(k, size, IPAD), _block(k, size, OPAD), message))


def extract_col(salt: Column, size: int, ikm: Column) -> Column:
    return hmac_col(salt, size, ikm)


def extract_zero_col(ikm: Column) -> Column:
    """HKDF's first step with no salt."""
    return hmac_padded(lit_bytes(bytes([IPAD]) * BLOCK), lit_bytes(bytes([OPAD]) * BLOCK), ikm)


def expand_col(prk: Column, info: Column, length: int = 32) -> Column:
    """HKDF's second step for up to 64 bytes."""
    return F.substring(hmac_col(prk, 64, F.concat(info, lit_bytes(b"\1"))), 1, length)


def truncate(raw: bytes, bits: int) -> bytes:
    n = -(-bits // 8)
    out = bytearray(raw[:n])
    if bits % 8:
        out[-1] &= 0xFF << (8 - bits % 8) & 0xFF
    return bytes(out)


def truncate_col(raw: Column, bits: int) -> Column:
    """The leading bits, MSB first, the last byte's rest zero."""
    n, rest = -(-bits // 8), bits % 8
    if not rest:
        return F.substring(raw, 1, n)
    last = F.conv(F.hex(F.substring(raw, n, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xFF << (8 - rest) & 0xFF))
    last = F.unhex(F.lpad(F.hex(last.cast("long")), 2, "0"))
    return last if n == 1 else F.concat(F.substring(raw, 1, n - 1), last)


#: 44 bytes a row from the JVM's SecureRandom: three random UUIDs hold 366 random bits. The expression is
#: nondeterministic, so Catalyst neither folds nor copies it. For plans without Python; sealing draws in envelope.drawn_keys().
def entropy_col() -> Column:
    u = [F.java_method(F.lit("java.util.UUID"), F.lit("randomUUID")) for _ in range(3)]
    return F.substring(sha512(F.concat(*u).cast("binary")), 1, 44)


class Argon2:
    """Argon2id by the system's libargon2; version 0x13, one lane, 64 bytes."""

    def __init__(self):
        name = ctypes.util.find_library("argon2") or "libargon2.so.1"
        try:
            self.call = ctypes.CDLL(name).argon2id_hash_raw
        except OSError as e:
            raise ConfigurationError("argon2id needs libargon2 on every executor") from e

    def raw(self, message: bytes, salt: bytes, time_cost: int, memory_kib: int) -> bytes:
        out = ctypes.create_string_buffer(64)
        code = self.call(ctypes.c_uint32(time_cost), ctypes.c_uint32(memory_kib), ctypes.c_uint32(1), message, ctypes.c_size_t(len(message)), salt, ctypes.c_size_t(len(salt)), out, ctypes.c_size_t(64))
        if code:
            raise RuntimeError(f"argon2 failed with {code}")
        return out.raw


def argon2_col(message: Column, salt: Column, time_cost: int, memory_kib: int) -> Column:
    """Argon2id of a message under a salt column; some 50 ms a row: call it on distinct values."""

    @F.pandas_udf(T.BinaryType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        argon = Argon2()
        for m, s in parts:
            yield pd.Series([None if a is None or b is None else argon.raw(bytes(a), bytes(b), time_cost, memory_kib) for a, b in zip(m, s)])

    return run(message, salt)
