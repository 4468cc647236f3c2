"""Canonical JSON and the hashes that rest on it.

Byte-exact canonicalisation needs NFC normalisation, code point key order and integers of
any size, which Spark's JSON functions do not give; so the text is produced by Python in
Arrow batches, and hashing stays in the JVM.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Canonical text of parameters may have this many characters; beyond the second a warning is due.
PARAMS_MOST, PARAMS_LARGE = 50_000, 10_000
HASH_PREFIX = "sha256:"


def _strict(value: Any) -> Any:
    """Values as variant A sees them: NFC text, no floats, text keys that stay distinct."""
    if value is None or isinstance(value, (bool, int)):
        return value
    if isinstance(value, float):
        raise ValueError("floats have no canonical form here; use text or a scaled integer")
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if isinstance(value, (list, tuple)):
        return [_strict(x) for x in value]
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            if not isinstance(k, str):
                raise ValueError(f"keys must be text, not {type(k).__name__}")
            k = unicodedata.normalize("NFC", k)
            if k in out:
                raise ValueError(f"keys are equal after normalisation: {k}")
            out[k] = _strict(v)
        return out
    raise ValueError(f"no canonical form for {type(value).__name__}")


def _set_key(value: Any) -> tuple[int, str]:
    kinds = (type(None), bool, int, str, dict, list)
    kind = next(i for i, t in enumerate(kinds) if isinstance(value, t))
    if kind == 2:
        return kind, f"{value:+0500d}" if abs(value) < 10**490 else str(value)
    return kind, value if isinstance(value, str) else plain(value)


def plain(value: Any) -> str:
    """Variant B: sorted keys, no white space, non-ASCII kept, floats allowed."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def strict(value: Any, array_as_set: bool = False) -> str:
    """Variant A: as B, but NFC-normalised and without floats; a top-level list may count as a set."""
    value = _strict(value)
    if array_as_set and isinstance(value, list):
        value = sorted(value, key=lambda v: (_set_key(v)[0], v) if isinstance(v, (bool, int, str)) else _set_key(v))
    return plain(value)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def params_hash(value: Any) -> str:
    """Hash of parameters; none at all hash like an empty object."""
    return HASH_PREFIX + sha256(strict({} if value is None else value))


def digest(value: Any) -> str:
    """Report digest over variant B."""
    return HASH_PREFIX + sha256(plain(value))


def short_digest(value: Any) -> str:
    return sha256(plain(value))[:8]


def file_hash(path: str, content: bytes) -> str:
    """Bare hex hash of a file: of its canonical JSON for .json files, of its bytes otherwise."""
    if path.endswith(".json"):
        return sha256(plain(json.loads(content)))
    return hashlib.sha256(content).hexdigest()


@F.pandas_udf(StringType())
def canonical_a(texts: pd.Series) -> pd.Series:
    """Variant A of JSON text; null stays null, what has no canonical form fails the query."""
    return texts.map(lambda t: None if t is None else strict(json.loads(t)))


@F.pandas_udf(StringType())
def canonical_b(texts: pd.Series) -> pd.Series:
    """Variants B and C of JSON text."""
    return texts.map(lambda t: None if t is None else plain(json.loads(t)))


@F.pandas_udf(StringType())
def canonical_file(texts: pd.Series) -> pd.Series:
    """Variant C of a file's text; null for what is no JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else plain(json.loads(t))
        except ValueError:
            return None

    return texts.map(one)


@F.pandas_udf(StringType())
def canonical_or_error(texts: pd.Series) -> pd.Series:
    """Variant A, or ``!`` and the reason why there is none."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return strict(json.loads(t))
        except ValueError as e:
            return f"!{e}"

    return texts.map(one)


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """NFC form of text."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def params_hash_of(params: Column) -> Column:
    """Hash of parameters given as JSON text."""
    return F.concat(F.lit(HASH_PREFIX), F.sha2(canonical_a(F.coalesce(params, F.lit("{}"))), 256))


def file_hash_of(path: Column, content: Column) -> Column:
    """As :func:`file_hash`, for a ``binaryFile`` table; what is named .json and is none counts by its bytes."""
    as_json = canonical_file(F.when(path.endswith(".json"), content.cast("string")))
    return F.coalesce(F.sha2(as_json, 256), F.sha2(content, 256))


def normalised_digest(value: Column) -> Column:
    """A 64-digit hex digest in lower case; the hash of anything else."""
    return F.when(value.rlike("^[0-9a-fA-F]{64}$"), F.lower(value)).otherwise(F.sha2(value, 256))
