import glob
import hashlib
import hmac
import json
import os

import pytest
from pyspark.sql import functions as F

from sealcol.errors import ConfigurationError
from sealcol.functions import crypto
from sealcol.functions.envelope import commitment, header_col, implied_plaintext_len_col, is_ciphertext_col, kind_col, open_envelope, record_key
from sealcol.plans import suites
from sealcol.plans.context import Binding, encoded_col, lit_bytes

CTX = Binding(bytes(range(32)), tenant=b"t")


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(bytearray(v) if v is not None else None for v in values.values())], ", ".join(f"{k} binary" for k in values))
    got = df.select(column.alias("x")).first()["x"]
    return bytes(got) if isinstance(got, (bytes, bytearray)) else got


def test_hmac_and_hkdf_columns_equal_the_library(spark):
    key, message = bytes(range(64)), b"message"
    assert one(spark, crypto.hmac_col(F.col("k"), 64, F.col("m")), k=key, m=message) == hmac.digest(key, message, "sha512")
    ikm, salt, info = b"i" * 32, bytes(range(48)), b"info"
    col = crypto.expand_col(crypto.extract_col(F.col("s"), 48, F.col("i")), lit_bytes(info))
    assert one(spark, col, s=salt, i=ikm) == crypto.hkdf(ikm, salt, info, 32)
    assert one(spark, crypto.expand_col(crypto.extract_zero_col(F.col("i")), lit_bytes(info)), i=ikm) == crypto.hkdf(ikm, b"", info, 32)
    ipad, opad = crypto.pads(b"k" * 200)
    assert one(spark, crypto.hmac_padded(F.col("a"), F.col("b"), F.col("m")), a=ipad, b=opad, m=message) == hmac.digest(b"k" * 200, message, "sha512")


@pytest.mark.parametrize("bits", [1, 7, 8, 9, 12, 15, 16, 21, 512])
def test_truncation(spark, bits):
    raw = hashlib.sha512(b"x").digest()
    want = crypto.truncate(raw, bits)
    assert len(want) == -(-bits // 8) and int.from_bytes(want, "big") >> (8 * len(want) - bits) == int.from_bytes(raw, "big") >> (512 - bits)
    assert one(spark, crypto.truncate_col(F.col("r"), bits), r=raw) == want


def test_contexts_are_told_apart(spark):
    variants = [CTX, Binding(CTX.owner), Binding(CTX.owner, tenant=b""), Binding(CTX.owner, row=b"t"), CTX.of_index("exact")]
    assert len({c.encoded(0xFF01) for c in variants} | {CTX.encoded(0xFF02)}) == 6
    assert one(spark, encoded_col(Binding(CTX.owner), 0xFF01, F.col("t"), F.col("r")), t=b"t", r=b"row") == Binding(CTX.owner, tenant=b"t", row=b"row").encoded(0xFF01)
    with pytest.raises(ConfigurationError):
        Binding(CTX.owner, "UPPER")


SHAPES = [b"", b"\x01", b"\x01\xff\x01" + bytes(107), b"\x01\xff\x01" + bytes(108), b"\x01\xff\x02" + bytes(119), b"\x01\xff\x02" + bytes(120), b"\x02" + bytes(109), b"\x02" + bytes(110), b"\x00" * 200, b"\x01\xff\x03" + bytes(200)]


def test_recognition(spark):
    kinds = ["plain", "plain", "plain", "envelope", "plain", "envelope", "plain", "reserved", "plain", "plain"]
    df = spark.createDataFrame([(bytearray(s),) for s in SHAPES] + [(None,)], "x binary")
    got = df.select(kind_col(F.col("x")).alias("k"), is_ciphertext_col(F.col("x")).alias("c"), header_col(F.col("x")).alias("h"), implied_plaintext_len_col(F.col("x")).alias("n")).collect()
    assert [r["k"] for r in got] == kinds + [None] and [suites.recognize(s) for s in SHAPES] == kinds
    assert [r["c"] for r in got] == [k == "envelope" for k in kinds] + [False]
    assert [r["h"] and (r["h"]["suite_id"], bytes(r["h"]["key_id"])) for r in got[:-1]] == [suites.read_header(s) and tuple(suites.read_header(s).values()) for s in SHAPES]
    assert got[3]["n"] == 0 and not suites.is_ciphertext("text") and suites.split(SHAPES[3])["commitment"] == bytes(32)


def test_argon2(spark):
    try:
        argon = crypto.Argon2()
    except ConfigurationError:
        pytest.skip("no libargon2")
    raw = argon.raw(b"m", b"s" * 16, 3, 32768)
    assert len(raw) == 64 and raw != argon.raw(b"m", b"t" * 16, 3, 32768)
    assert one(spark, crypto.argon2_col(F.col("m"), F.col("s"), 3, 32768), m=b"m", s=b"s" * 16) == raw


def test_entropy_differs_by_row(spark):
    rows = spark.range(200).withColumn("e", crypto.entropy_col()).collect()
    assert len({bytes(r["e"]) for r in rows}) == 200 and all(len(r["e"]) == 44 for r in rows)


def _vectors():
    """Pinned derivations and outcomes of another implementation, as JSON files in the folder that SEALCOL_VECTORS names."""
    found = glob.glob(os.path.join(os.environ.get("SEALCOL_VECTORS", "/nonexistent"), "**", "*.json"), recursive=True)
    return [v for f in found for v in json.load(open(f)).get("vectors", [])]


def _context(v):
    c = v["context"]
    b = lambda x: None if x is None else bytes.fromhex(x)
    return Binding(b(c["table_uuid"]) + b(c["column_uuid"]), c["purpose"].partition(":")[2] or None, b(c["tenant_id"]), b(c["row_id"]))


def test_pinned_vectors(spark):
    vectors = _vectors()
    if not vectors:
        pytest.skip("SEALCOL_VECTORS is not set")
    label = next(bytes.fromhex(v["expected"]["info"]) for v in vectors if "commitment" in v.get("expected", {}) and "info" in v["expected"])
    ran = 0
    for v in vectors:
        want, get = v.get("expected") or {}, lambda k, v=v: bytes.fromhex(v[k])
        if "record_key" in want:
            ctx = _context(v).encoded(int(v["suite_id"], 16))
            assert ctx.hex() == want["info"]
            assert one(spark, record_key(F.col("d"), F.col("k"), F.col("s"), lit_bytes(ctx)), d=get("tenant_dek"), k=get("key_id"), s=get("msg_seed")).hex() == want["record_key"]
        elif "index_key" in want:
            ctx = _context(v).of_index(v["index_id"]).encoded(int(v["suite_id"], 16))
            assert ctx.hex() == want["info"] and crypto.hkdf(get("tenant_index_key"), bytes.fromhex(want["salt"]), ctx, 32).hex() == want["index_key"]
        elif "commitment" in want:
            assert one(spark, commitment(F.col("k"), label), k=get("record_key")).hex() == want["commitment"]
        elif "raw" in want and "idf_params" in v:
            p = v["idf_params"]
            raw = crypto.Argon2().raw(get("plaintext"), bytes.fromhex(p["salt"]), p["time_cost"], p["memory_kib"])
            assert raw.hex() == want["raw"] and crypto.truncate(raw, v["truncate_bits"]).hex() == want["index"]
        elif v.get("operation") == "decrypt":
            allowed = tuple(int(s, 16) for s in v["config"]["allowed_suites"])
            deks = F.when(F.substring("e", 4, 16) == F.col("k"), F.array("d"))
            got = one(spark, open_envelope(F.col("e"), deks, 1, lit_bytes(_context(v).encoded(0xFF01)), label, allowed), e=get("input"), k=get("key_id"), d=get("tenant_dek"))
            expected = want.get("error", "OK" if "plaintext" in want else "NOT_CIPHERTEXT")
            assert got["status"] == expected, v["id"]
            if "plaintext" in want:
                assert bytes(got["plaintext"]).hex() == want["plaintext"]
        else:
            continue
        ran += 1
    assert ran > 40
