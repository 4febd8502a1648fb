"""Normal forms that blind indexes are taken of: a closed set."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError

IDENTITY, DIGITS, CASEFOLD = "identity", "digits-only-v1", "nfc-casefold-v1"
NORMALIZERS = (IDENTITY, DIGITS, CASEFOLD)
#: Those that refuse some values that can be stored.
REFUSING = frozenset({CASEFOLD})


def first_unassigned(text: str) -> int | None:
    """The place of the first code point that this interpreter's Unicode tables do not know, or a lone surrogate."""
    return next((i for i, c in enumerate(text) if unicodedata.category(c) in ("Cn", "Cs")), None)


def casefold(text: str) -> str | None:
    """NFC, full case folding, NFC; None where a code point is unassigned."""
    if any(unicodedata.category(c) in ("Cn", "Cs") for c in set(text)):
        return None
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())


def normalize(name: str, value: str | bytes) -> bytes | None:
    """A value's normal form in bytes, or None if it has none."""
    check(name)
    if name == IDENTITY:
        return value.encode() if isinstance(value, str) else bytes(value)
    if name == DIGITS:
        raw = value.encode() if isinstance(value, str) else bytes(value)
        return bytes(b for b in raw if 0x30 <= b <= 0x39)
    try:
        folded = casefold(value if isinstance(value, str) else value.decode())
    except UnicodeDecodeError:
        return None
    return None if folded is None else folded.encode()


def check(name: str) -> None:
    if name not in NORMALIZERS:
        raise ConfigurationError(f"{name!r} is no normal form; they are {', '.join(NORMALIZERS)}")


#: Texts that are folded before they leave Python's memory, but for a longer one bytes of them.
TEXTS, BYTES = 512, 4 << 20


def _folded(texts: pa.Array) -> pa.Array:
    """casefold() of an array, a text at a time: besides the two arrays a few texts are held."""
    out, held, size = [], [], 0
    for x in texts:
        text = x.as_py()
        folded = None if text is None else casefold(text)
        held.append(None if folded is None else folded.encode())
        size += len(held[-1] or b"")
        if len(held) >= TEXTS or size >= BYTES:
            out.append(pa.array(held, pa.binary()))
            held, size = [], 0
    return pa.concat_arrays([*out, pa.array(held, pa.binary())])


@F.arrow_udf(T.BinaryType())
def _casefold(texts: pa.Array) -> pa.Array:
    return _folded(texts)


def normalize_col(name: str, value: Column, canonical: Column) -> Column:
    """The normal form of a column, whose canonical bytes are given too; null where there is none."""
    check(name)
    if name == IDENTITY:
        return canonical
    text = canonical.cast("string")
    if name == DIGITS:
        return F.encode(F.regexp_replace(text, "[^0-9]", ""), "UTF-8")
    plain = text.rlike(r"^[\x00-\x7F]*$")
    # the interpreter gets the other rows' texts only
    return F.when(plain, F.encode(F.lower(text), "UTF-8")).otherwise(_casefold(F.when(~plain & F.is_valid_utf8(text), text)))
