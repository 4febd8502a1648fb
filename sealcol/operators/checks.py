"""Checks of a catalog of tables before anything runs: coded issues, errors first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import ConfigurationError
from ..functions.codec import logical_type
from ..plans.declare import META, Table


@dataclass(frozen=True)
class Issue:
    code: str
    where: str
    message: str


def validate(tables: list[Table], frames: dict[str, DataFrame] | None = None) -> list[Issue]:
    """E: refused. W: allowed, worth a look."""
    out: list[Issue] = []
    seen: dict[bytes, str] = {}
    for t in tables:
        if t.uuid in seen:
            out.append(Issue("E001", t.name, f"has the id of {seen[t.uuid]}"))
        seen[t.uuid] = t.name
        names = {c.name for c in t.columns}
        if not t.pk:
            out.append(Issue("W001", t.name, "has no primary key: jobs and set operations are refused"))
        for k in (*t.pk, *([t.tenant] if t.tenant else []), *([t.row] if t.row else [])):
            if k in names:
                out.append(Issue("E002", f"{t.name}.{k}", "is a key or a tenant and cannot be sealed"))
        for c in t.columns:
            where = f"{t.name}.{c.name}"
            if c.sibling in names:
                out.append(Issue("E003", where, "its index column is sealed itself"))
            if c.index and c.index.bucket:
                out.append(Issue("W002", where, "unindexable values share one bucket that is known by its frequency"))
            if c.index and c.index.few:
                out.append(Issue("W003", where, "is indexed under an override: few or skewed values"))
            if c.index and c.index.slow and t.tenant:
                out.append(Issue("W004", where, "costs one argon2id call for each value and tenant"))
            if c.storage == "base64":
                out.append(Issue("W005", where, "takes a third more room as text"))
        df = (frames or {}).get(t.name)
        if df is None:
            continue
        for c in t.columns:
            where, name = f"{t.name}.{c.name}", c.source or c.name
            if name not in df.columns:
                out.append(Issue("E004", where, "is no column of the table"))
                continue
            f = df.schema[name]
            held = f.metadata.get(META)
            if held is not None:
                if held != t.metadata(c)[META]:
                    out.append(Issue("E005", where, "was sealed under another declaration"))
                if c.index and c.sibling not in df.columns:
                    out.append(Issue("E006", where, "has no index column"))
                continue
            try:
                kind = logical_type(f.dataType)
            except ConfigurationError as e:
                out.append(Issue("E007", where, str(e)))
                continue
            if kind != c.logical and not isinstance(f.dataType, (T.BinaryType, T.DecimalType)):
                out.append(Issue("E008", where, f"is {kind}, declared {c.logical}"))
    return sorted(out, key=lambda i: (i.code, i.where))
