"""The closed registry of cipher suites and the layout of an envelope."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import ConfigurationError, InvalidArgument

FORMAT, RESERVED_FORMAT = 0x01, 0x02
KEY_ID_LEN, SEED_LEN = 16, 32
HEADER_LEN = 1 + 2 + KEY_ID_LEN + SEED_LEN
MAX_PLAINTEXT = 2**31 - 1
#: The least length of an envelope in a future format.
RESERVED_LEAST = 111


@dataclass(frozen=True)
class Suite:
    id: int
    name: str
    key_len: int
    nonce_len: int
    tag_len: int
    commitment_len: int
    provisional: bool
    performable: bool

    @property
    def overhead(self) -> int:
        return HEADER_LEN + self.nonce_len + self.tag_len + self.commitment_len

    @property
    def prefix(self) -> bytes:
        return bytes([FORMAT]) + self.id.to_bytes(2, "big")


AES_GCM = Suite(0xFF01, "AES-256-GCM / HKDF-SHA-512", 32, 12, 16, 32, provisional=True, performable=True)
XCHACHA = Suite(0xFF02, "XChaCha20-Poly1305 / HKDF-SHA-512", 32, 24, 16, 32, provisional=True, performable=False)
REGISTRY = {s.id: s for s in (AES_GCM, XCHACHA)}


def suite(suite_id: int) -> Suite:
    if isinstance(suite_id, bool) or not isinstance(suite_id, int):
        raise InvalidArgument("a suite id is an integer")
    if suite_id not in REGISTRY:
        raise ConfigurationError(f"suite {suite_id:#06x} is not registered")
    return REGISTRY[suite_id]


def implied_plaintext_len(envelope_len: int, s: Suite) -> int:
    return envelope_len - s.overhead


def serialize_header(suite_id: int, key_id: bytes, seed: bytes) -> bytes:
    if len(key_id) != KEY_ID_LEN or len(seed) != SEED_LEN:
        raise InvalidArgument("a key id has 16 bytes and a seed 32")
    return suite(suite_id).prefix + key_id + seed


def recognize(x: bytes) -> str:
    """'envelope', 'reserved' (a future format) or 'plain'."""
    if not isinstance(x, (bytes, bytearray)):
        raise InvalidArgument("an envelope is bytes")
    if x[:1] == bytes([RESERVED_FORMAT]) and len(x) >= RESERVED_LEAST:
        return "reserved"
    s = REGISTRY.get(int.from_bytes(x[1:3], "big")) if x[:1] == bytes([FORMAT]) and len(x) >= 3 else None
    return "envelope" if s and len(x) >= s.overhead else "plain"


def is_ciphertext(x: object) -> bool:
    """Total: False for anything that is not an envelope, whatever its type."""
    return isinstance(x, (bytes, bytearray)) and recognize(x) == "envelope"


def read_header(x: bytes) -> dict | None:
    if not is_ciphertext(x):
        return None
    return {"suite_id": int.from_bytes(x[1:3], "big"), "key_id": bytes(x[3:19])}


def split(x: bytes) -> dict | None:
    """The parts of an envelope."""
    head = read_header(x)
    if head is None:
        return None
    s = REGISTRY[head["suite_id"]]
    body = x[HEADER_LEN:]
    end = len(body) - s.commitment_len
    return head | {"msg_seed": bytes(x[19:51]), "nonce": bytes(body[: s.nonce_len]), "ciphertext": bytes(body[s.nonce_len : end - s.tag_len]), "tag": bytes(body[end - s.tag_len : end]), "commitment": bytes(body[end:])}
