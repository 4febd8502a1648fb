"""Envelopes as column expressions: recognition, sealing, opening. Keys come as columns."""

from __future__ import annotations

import hmac
import os
from hashlib import sha512
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.context import aad_col, lit_bytes
from ..plans.suites import AES_GCM, FORMAT, REGISTRY, RESERVED_FORMAT, RESERVED_LEAST
from .crypto import BLOCK, IPAD, OPAD, expand_col, extract_col, extract_zero_col, let

#: An HMAC key's bytes under both pads, by bytes.translate().
INNER, OUTER = (bytes(b ^ pad for b in range(256)) for pad in (IPAD, OPAD))
#: Bytes of a seed and a nonce.
DRAWN = 44


def kind_col(x: Column) -> Column:
    """'envelope', 'reserved' or 'plain'; null for null."""
    first, n = F.substring(x, 1, 1), F.octet_length(x)
    known = F.lit(False)
    for s in REGISTRY.values():
        known = known | ((F.substring(x, 1, 3) == lit_bytes(s.prefix)) & (n >= s.overhead))
    return F.when(x.isNull(), F.lit(None).cast("string")).when(known, "envelope").when((first == lit_bytes(bytes([RESERVED_FORMAT]))) & (n >= RESERVED_LEAST), "reserved").otherwise("plain")


def is_ciphertext_col(x: Column) -> Column:
    """Total: false for null."""
    return F.coalesce(kind_col(x) == "envelope", F.lit(False))


def suite_id_col(x: Column) -> Column:
    return F.conv(F.hex(F.substring(x, 2, 2)), 16, 10).cast("int")


def header_col(x: Column) -> Column:
    """suite_id and key_id of an envelope, null for anything else; no key is needed."""
    return F.when(is_ciphertext_col(x), F.struct(suite_id_col(x).alias("suite_id"), F.substring(x, 4, 16).alias("key_id")))


def implied_plaintext_len_col(x: Column) -> Column:
    overhead = F.lit(None).cast("int")
    for s in REGISTRY.values():
        overhead = F.when(F.substring(x, 1, 3) == lit_bytes(s.prefix), F.lit(s.overhead)).otherwise(overhead)
    return F.when(is_ciphertext_col(x), F.octet_length(x) - overhead)


def record_key(dek: Column, key_id: Column, seed: Column, context: Column) -> Column:
    return expand_col(extract_col(F.concat(key_id, seed), 48, dek), context)


def commitment(key: Column, label: bytes) -> Column:
    return expand_col(extract_zero_col(key), lit_bytes(label))


def _deriver(label: bytes):
    """record_key and commitment of a row, in Python: there XORing a key with a pad is one call, in expressions a call a character."""
    inner_pad, outer_pad = bytes([IPAD]), bytes([OPAD])
    # HKDF's first step with no salt, the pads after a hash as a key, and what the second step ends with
    zero_in, zero_out = inner_pad * BLOCK, outer_pad * BLOCK
    rest_in, rest_out = inner_pad * (BLOCK - 64), outer_pad * (BLOCK - 64)
    closing = rest_in + label + b"\1"

    def derive(dek: bytes, key_id: bytes, seed: bytes, context: bytes) -> tuple[bytes, bytes]:
        salt = key_id + seed
        prk = sha512(salt.translate(OUTER).ljust(BLOCK, outer_pad) + sha512(salt.translate(INNER).ljust(BLOCK, inner_pad) + dek).digest()).digest()
        key = sha512(prk.translate(OUTER) + rest_out + sha512(prk.translate(INNER) + rest_in + context + b"\1").digest()).digest()[:32]
        prk = sha512(zero_out + sha512(zero_in + key).digest()).digest()
        return key, sha512(prk.translate(OUTER) + rest_out + sha512(prk.translate(INNER) + closing).digest()).digest()[:32]

    return derive


def _items(x: pa.Array) -> list[bytes | None]:
    """A binary array's values, cut from its buffer: to_pylist() makes a scalar of each and takes as long as a hash."""
    offsets, raw = x.buffers()[1:]
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(x.type) else np.int32)[x.offset :][: len(x) + 1].tolist() if len(x) else []
    raw = raw.to_pybytes() if raw else b""
    out = [raw[a:b] for a, b in zip(ends, ends[1:])]
    for i in np.flatnonzero(x.is_null().to_numpy(zero_copy_only=False)).tolist() if x.null_count else ():
        out[i] = None
    return out


def _lists(x: pa.Array) -> list[list[bytes | None] | None]:
    """The values of an array of lists of bytes."""
    own, ends = _items(x.values), x.offsets.tolist()
    return [own[a:b] if there else None for a, b, there in zip(ends, ends[1:], x.is_valid().to_pylist() if x.null_count else repeat(True))]


def derived_keys(dek: Column, key_id: Column, seed: Column, context: Column, label: bytes) -> Column:
    """record_key and its commitment, 64 bytes; null where any input is."""

    @F.arrow_udf(T.BinaryType())
    def run(dek: pa.Array, key_id: pa.Array, seed: pa.Array, context: pa.Array) -> pa.Array:
        derive = _deriver(label)
        return pa.array([None if None in row else b"".join(derive(*row)) for row in zip(*map(_items, (dek, key_id, seed, context)))], pa.binary())

    return run(dek, key_id, seed, context)


def drawn_keys(dek: Column, key_id: Column, context: Column, label: bytes) -> Column:
    """A fresh seed (32 bytes) and nonce (12) from the system, then record_key and its commitment; null where any input is.

    Nondeterministic, so that Catalyst does not copy it.
    """

    @F.arrow_udf(T.BinaryType())
    def run(dek: pa.Array, key_id: pa.Array, context: pa.Array) -> pa.Array:
        derive, fresh, out = _deriver(label), os.urandom(DRAWN * len(dek)), []
        for i, (d, k, c) in enumerate(zip(*map(_items, (dek, key_id, context)))):
            own = fresh[DRAWN * i : DRAWN * (i + 1)]
            out.append(None if d is None or k is None or c is None else own + b"".join(derive(d, k, own[:32], c)))
        return pa.array(out, pa.binary())

    return run.asNondeterministic()(dek, key_id, context)


def committed_key(deks: Column, key_id: Column, seed: Column, context: Column, held: Column, label: bytes) -> Column:
    """The first key, of candidates by preference, whose commitment is the one held; null if there is none."""

    @F.arrow_udf(T.BinaryType())
    def run(deks: pa.Array, key_id: pa.Array, seed: pa.Array, context: pa.Array, held: pa.Array) -> pa.Array:
        derive, out = _deriver(label), []
        for own, *rest, there in zip(_lists(deks), *map(_items, (key_id, seed, context, held))):
            found = None
            if own and there is not None and None not in rest:
                for dek in own:
                    if dek is not None:
                        key, c = derive(dek, *rest)
                        if hmac.compare_digest(c, there):
                            found = key
                            break
            out.append(found)
        return pa.array(out, pa.binary())

    return run(deks, key_id, seed, context, held)


def seal(plaintext: Column, key_id: Column, drawn: Column, context: Column) -> Column:
    """Envelopes of plaintexts, null for null. drawn: a column of drawn_keys() that is used for nothing else."""
    seed, nonce, key, commitment = (F.substring(drawn, a, n) for a, n in ((1, 32), (33, 12), (45, 32), (77, 32)))
    body = F.aes_encrypt(plaintext, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, aad_col(key_id, seed, context))
    return F.when(plaintext.isNotNull(), F.concat(lit_bytes(bytes([FORMAT]) + AES_GCM.id.to_bytes(2, "big")), key_id, seed, body, commitment))


def open_envelope(e: Column, deks: Column, versions: int, context: Column, label: bytes, allowed: tuple[int, ...]) -> Column:
    """struct(status, plaintext). deks: candidate keys by preference, up to ``versions``, null if there are none.

    The order of outcomes is fixed by one CASE: recognition, allowed suite, key, commitment, tag. No key opens an envelope
    whose commitment it does not reproduce. Keys are derived for envelopes of an allowed suite only.
    """
    seed, key_id = F.substring(e, 20, 32), F.substring(e, 4, 16)
    body, held = F.substring(e, F.lit(52), F.octet_length(e) - 83), F.substring(e, F.octet_length(e) - 31, F.lit(32))

    def outcome(status: str | Column, plaintext: Column | None = None) -> Column:
        return F.struct((F.lit(status) if isinstance(status, str) else status).alias("status"), (F.lit(None).cast("binary") if plaintext is None else plaintext).alias("plaintext"))

    def opened(key: Column) -> Column:
        tried = F.try_aes_decrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"), aad_col(key_id, seed, context))
        return F.when(key.isNull(), outcome("COMMITMENT_INVALID")).otherwise(let(tried, lambda p: F.when(p.isNull(), outcome("TAG_INVALID")).otherwise(outcome("OK", p))))

    kind = kind_col(e)
    fit = (kind == "envelope") & F.substring(e, 2, 2).isin(*[lit_bytes(i.to_bytes(2, "big")) for i in allowed])
    key = committed_key(F.when(fit, F.slice(deks, 1, versions)), key_id, seed, context, held, label) if versions else F.lit(None).cast("binary")
    # outside of a lambda, where expressions are compiled; Spark calls one Python function on one input once
    return (
        F.when(fit & (F.size(deks) > 0), opened(key))
        .when(kind.isNull(), outcome(F.lit(None).cast("string")))
        .when(kind == "reserved", outcome("UNKNOWN_FORMAT_VERSION"))
        .when(kind == "plain", outcome("NOT_CIPHERTEXT"))
        .when(~fit, outcome("SUITE_NOT_ALLOWED"))
        .otherwise(outcome("KEY_UNAVAILABLE"))
    )
