"""Content identifiers and digests. Bytes and hexadecimal forms are built in the JVM; base32 and base58 text in Arrow batches."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Version 1, codec, sha2-256 and its length, as multiformats prescribe.
RAW, DAG_CBOR = "01551220", "01711220"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def cid_hex(data: Column, prefix: str = RAW) -> Column:
    """Hexadecimal CIDv1 of bytes."""
    return F.concat(F.lit(prefix), F.sha2(data, 256))


def cid_bytes(data: Column, prefix: str = RAW) -> Column:
    return F.unhex(cid_hex(data, prefix))


@F.pandas_udf(T.StringType())
def cid_text(raw: pd.Series) -> pd.Series:
    """Base32 text (leading b) of CID bytes."""
    return raw.map(lambda b: None if b is None else "b" + base64.b32encode(b).decode().lower().rstrip("="))


@F.pandas_udf(T.BinaryType())
def cid_parse(text: pd.Series) -> pd.Series:
    """CID bytes of base32 text; null where it isn't a version 1 CID of 36 bytes."""

    def one(t):
        try:
            b = base64.b32decode(t[1:].upper() + "=" * (-len(t[1:]) % 8))
        except (ValueError, TypeError):
            return None
        return b if t[0] == "b" and len(b) == 36 and b[0] == 1 else None

    return text.map(one, na_action="ignore")


def cid_codec(raw: Column) -> Column:
    return F.conv(F.hex(F.substring(raw, 2, 1)), 16, 10).cast("int")


def cid_digest(raw: Column) -> Column:
    return F.lower(F.substring(F.hex(raw), 9, 64))


def cid_verifies(raw: Column, data: Column) -> Column:
    return cid_digest(raw) == F.sha2(data, 256)


def pseudo_cid(json: Column) -> Column:
    """The catalog's identifier of an entity or edge: bafk and half of the JSON's digest."""
    return F.concat(F.lit("bafk"), F.substring(F.sha2(json.cast("binary"), 256), 1, 32))


def message_id(source: Column, ts: Column, payload_json: Column) -> Column:
    """Half of the digest of source, time and canonical payload."""
    return F.substring(F.sha2(F.concat(source, ts.cast("string"), payload_json).cast("binary"), 256), 1, 32)


def cache_key(query: Column, scope: Column, limit: int) -> Column:
    """Half of the digest of query, scope and limit (four bytes, little-endian), without separators."""
    tail = F.unhex(F.lit(int(limit).to_bytes(4, "little").hex()))
    return F.substring(F.sha2(F.concat(query.cast("binary"), scope.cast("binary"), tail), 256), 1, 32)


def space_key(path: Column) -> Column:
    return F.sha2(path.cast("binary"), 256)


def base58_bytes(text: str) -> bytes:
    number = 0
    for c in text:
        number = number * 58 + BASE58.index(c)
    body = number.to_bytes((number.bit_length() + 7) // 8, "big")
    return b"\0" * (len(text) - len(text.lstrip("1"))) + body


def base58_text(raw: bytes) -> str:
    number, out = int.from_bytes(raw, "big"), ""
    while number:
        number, digit = divmod(number, 58)
        out = BASE58[digit] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out
