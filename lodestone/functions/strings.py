"""Text, path, topic and identifier functions."""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ids import base58_bytes, base58_text

# File extensions by language, catalog enumerations, error codes with HTTP status.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java",
    "go": "go", "rb": "ruby", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "ex": "elixir",
    "exs": "elixir", "html": "html", "htm": "html", "php": "php", "sol": "solidity",
}
MARKDOWN = ["md", "markdown", "mdx"]
ENTITY_TYPES = ["document", "person", "concept", "date", "location"]
EDGE_TYPES = ["mentions", "created_by", "related_to", "part_of", "occurred_on", "located_in"]
TOPICS = {"tasks": "/tasks", "agent_status": "/agents/status", "compute_offers": "/compute/offers", "announcements": "/announcements", "content_announcements": "/content/announcements", "search": "/search"}
ERRORS = {
    "INVALID_QUERY": 400, "INVALID_SCOPE": 400, "VALIDATION_ERROR": 400, "EMBEDDING_ERROR": 500, "QDRANT_ERROR": 500, "NETWORK_ERROR": 500,
    "SERIALIZATION_ERROR": 500, "DESERIALIZATION_ERROR": 500, "NETWORK_UNAVAILABLE": 503, "TIMEOUT": 504, "INTERNAL_ERROR": 500,
}


_KEY = T.StructType([T.StructField(n, T.StringType()) for n in ("purpose", "type", "key")])
PEER = T.StructType([T.StructField("numalgo", T.IntegerType()), T.StructField("keys", T.ArrayType(_KEY)), T.StructField("services", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def derive_name(path: Column, key: Column) -> Column:
    """The path's last segment; the key's first 8 characters where there is none."""
    name = F.trim(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1))
    return F.when(F.length(name) > 0, name).otherwise(F.substring(key, 1, 8))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def detect_language(path: Column) -> Column:
    return literal_map(LANGUAGES)[extension(path)]


def is_markdown(path: Column) -> Column:
    return extension(path).isin(MARKDOWN)


def is_binary(text: Column) -> Column:
    """Holds a NUL, or over 30 % of its characters are neither ASCII graphic nor white space."""
    odd = F.length(F.regexp_replace(text, r"[\x21-\x7E\p{IsWhite_Space}]", ""))
    return F.when(F.contains(text, F.lit("\0")), True).when(F.length(text) == 0, False).otherwise(odd / F.length(text) > 0.3)


def excluded(path: Column, patterns: list[str]) -> Column:
    """The first pattern that the path contains, null if none."""
    return F.coalesce(*(F.when(F.contains(path, F.lit(p)), F.lit(p)) for p in patterns), F.lit(None).cast("string"))


def indexable(content_type: Column, size: Column | None = None, rule: str = "announcement") -> Column:
    """announcement: prefixes with PDF up to 100 MiB; remote: prefixes without PDF; published: text/ or exactly JSON or Markdown."""
    if rule == "published":
        return content_type.startswith("text/") | content_type.isin("application/json", "application/markdown")
    prefixes = ["text/", "application/json", "application/markdown"] + ["application/pdf"] * (rule == "announcement")
    out = F.lit(False)
    for p in prefixes:
        out = out | content_type.startswith(p)
    return out & (size <= 100 * 1024 * 1024) if rule == "announcement" else out


def truncated(text: Column, most: int = 4000) -> Column:
    return F.substring(text, 1, most)


def snippet(text: Column, most: int = 150) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def clean_json(response: Column) -> Column:
    """The text from the first [ to the last ], else the text without its fence."""
    trimmed = F.trim(response)
    bracketed = F.regexp_extract(trimmed, r"(?s)\[.*\]", 0)
    return F.when(F.length(bracketed) > 0, bracketed).otherwise(F.trim(F.regexp_replace(F.regexp_replace(trimmed, "^```(json)?", ""), "```$", "")))


def parse_entities(response: Column) -> Column:
    """Entities of a model's answer: known types, trimmed names that aren't empty, confidence from 0 to 1."""
    raw = F.from_json(clean_json(response), "array<struct<type:string,name:string,confidence:double>>")
    known = F.filter(raw, lambda e: F.lower(e["type"]).isin(ENTITY_TYPES) & (F.length(F.trim(e["name"])) > 0))
    return F.transform(known, lambda e: F.struct(F.lower(e["type"]).alias("type"), F.trim(e["name"]).alias("name"), F.least(F.greatest(e["confidence"], F.lit(0.0)), F.lit(1.0)).alias("confidence")))


def parse_enum(value: Column, domain: list[str]) -> Column:
    """The value in lower case where the domain has it, else null."""
    low = F.lower(value)
    return F.when(low.isin(domain), low)


def topic_string(kind: Column, name: Column, prefix: str) -> Column:
    fixed = literal_map({k: prefix + v for k, v in TOPICS.items()})[kind]
    return F.when(kind == "updates", F.concat(F.lit(f"{prefix}/updates/"), name)).when(kind == "custom", F.concat(F.lit(f"{prefix}/custom/"), name)).otherwise(fixed)


def topic_parse(topic: Column, prefix: str) -> Column:
    """struct<kind, name> of a topic string; null where it isn't one."""
    rest = F.substring(topic, len(prefix) + 1, 1 << 20)
    fixed = literal_map({v: k for k, v in TOPICS.items()})[rest]
    kind = F.when(rest.startswith("/updates/"), F.lit("updates")).when(rest.startswith("/custom/"), F.lit("custom")).otherwise(fixed)
    name = F.when(rest.startswith("/updates/"), F.substring(rest, 10, 1 << 20)).when(rest.startswith("/custom/"), F.substring(rest, 9, 1 << 20))
    return F.when(topic.startswith(prefix) & kind.isNotNull(), F.struct(kind.alias("kind"), name.alias("name")))


def did_method(did: Column) -> Column:
    return F.regexp_extract(did, "^did:([a-z0-9]+):", 1)


def did_web_url(did: Column) -> Column:
    """https URL of a did:web; null for another method or an unfit authority or segment."""
    parts = F.transform(F.split(F.substring(did, 9, 1 << 20), ":"), lambda p: F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))))
    authority, path = parts[0], F.slice(parts, 2, 1000)
    fit = (F.length(authority) > 0) & ~F.contains(authority, F.lit("/")) & ~F.contains(authority, F.lit("@")) & ~F.exists(path, lambda p: p.isin(".", ".."))
    tail = F.when(F.size(path) == 0, F.lit(".well-known/did.json")).otherwise(F.concat(F.array_join(path, "/"), F.lit("/did.json")))
    return F.when(did.startswith("did:web:") & fit, F.concat(F.lit("https://"), authority, F.lit("/"), tail))


def did_cache_seconds(method: Column) -> Column:
    """Keys never change; a web document may."""
    return F.when(method.isin("key", "jwk", "peer"), F.lit(86400)).when(method == "web", F.lit(300)).otherwise(F.lit(3600))


@F.pandas_udf(PEER)
def did_peer_parse(dids: pd.Series) -> pd.DataFrame:
    """Keys and services of did:peer 0 and 2; error: format, numalgo, key or encoding."""
    kinds = {b"\xed\x01": "Ed25519", b"\xec\x01": "X25519", b"\xe7\x01": "Secp256k1", b"\x80\x24": "P256"}
    purposes = {"V": "verification", "E": "encryption", "A": "assertion", "D": "delegation", "I": "invocation"}

    def key(encoded: str, purpose: str) -> dict:
        raw = base58_bytes(encoded[1:]) if encoded[:1] == "z" else b""
        if raw[:2] not in kinds:
            raise LookupError("key")
        return {"purpose": purpose, "type": kinds[raw[:2]], "key": raw[2:].hex()}

    rows = []
    for did in dids:
        row = {"numalgo": None, "keys": [], "services": [], "error": None}
        try:
            if not did or not did.startswith("did:peer:") or not did[9:10].isdigit():
                raise LookupError("format")
            row["numalgo"] = int(did[9])
            if did[9] == "0":
                row["keys"] = [key(did[10:], "verification")]
            elif did[9] == "2":
                for part in did[10:].split("."):
                    if part[:1] == "S":
                        raw = base64.urlsafe_b64decode(part[1:] + "=" * (-len(part[1:]) % 4)).decode()
                        row["services"].append(json.dumps(json.loads(raw), sort_keys=True))
                    elif part[:1] in purposes:
                        row["keys"].append(key(part[1:], purposes[part[0]]))
            else:
                raise LookupError("numalgo")
        except LookupError as e:
            row["error"] = str(e).strip("'")
        except ValueError:
            row["error"] = "encoding"
        rows.append(row)
    return pd.DataFrame(rows, columns=["numalgo", "keys", "services", "error"])


@F.pandas_udf(T.StringType())
def multikey(hexadecimal: pd.Series) -> pd.Series:
    """Base58 text (leading z) of bytes in hexadecimal, the codec's prefix first."""
    return hexadecimal.map(lambda h: None if h is None else "z" + base58_text(bytes.fromhex(h)))
