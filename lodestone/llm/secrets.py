"""Secret scans: three fixed patterns, and strings of sensitive context that zstandard can't compress.

A candidate's novelty is the number of bytes it adds to its surroundings, compressed with a dictionary of code
identifiers, over its length. Text that resembles its surroundings or known identifiers adds few bytes; keys and tokens
add nearly their entropy.

A candidate starts within 80 characters after a sensitive word, on its line or a later one, or on the line after another
candidate's end.

Defined cases: a null or empty text has no spans; spans count code points, end exclusive; added spans never overlap base
ones; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import doc_blocks, raw_text, released, texts

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile(r"(?=(secret|passw|token|credential|bearer|private|api.?key|access.?key|auth|signature|client.?id))", re.I | re.A)
HINTS = ("secret", "passw", "token", "credential", "bearer", "private", "api", "access", "auth", "signature", "client")
LEAST, REACH = 20, 80  # characters of a candidate; characters after a sensitive word within which it starts
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
WRAP = re.compile(r"[\x20\t]*\r?\n[\x20\t]*")
AROUND, NOVEL = 256, 0.55

# Identifiers and words common in code and configuration.
IDENTIFIERS = """
access_token refresh_token client_id client_secret api_key apiKey secret_key private_key public_key password username
authorization Authorization Bearer Basic signature credential credentials certificate fingerprint configuration
environment application connection connectionString database_url DATABASE_URL hostname localhost 127.0.0.1 endpoint
function return import export class public private protected static final const let var def self this null None true
false True False string integer boolean number object array request response session cookie header content-type
application/json text/html https:// http:// .example.com .example.org localhost:8080 abcdefghijklmnopqrstuvwxyz
ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef getElementById addEventListener createTextNode toString
com.example.service.impl org.apache.commons java.util.concurrent node_modules package.json requirements.txt
-----BEGIN PRIVATE KEY----- -----END PRIVATE KEY----- ssh-rsa xxxxxxxxxxxxxxxxxxxxxxxx aaaaaaaaaaaaaaaaaaaaaaaa
"""


class Novelty:
    """Marginal compressed bytes of a string against its surroundings and the identifier dictionary."""

    def __init__(self, dictionary: str = IDENTIFIERS, level: int = 6):
        held = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False).compress

    def __call__(self, text: str, start: int, end: int) -> float:
        around = text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]
        base = around.encode("utf-8", "replace")
        added = len(self.compress(base + text[start:end].encode())) - len(self.compress(base))
        return added / (end - start)


def mixed(candidate: str) -> bool:
    """Has a digit and a letter; words and rules of one kind of character are no keys."""
    return any(c.isdigit() for c in candidate) and any(c.isalpha() for c in candidate)


def base_spans(text: str, lowered: str) -> list[tuple[int, int, int]]:
    found = []
    if "passw" in lowered or "secret" in lowered or "token" in lowered or "api" in lowered:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def novel_spans(text: str, lowered: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    if not any(h in lowered for h in HINTS):
        return []
    out: dict[int, int] = {}
    refused, done = set(), 0
    for word in SENSITIVE.finditer(text):
        # Every word has a window of its own, over line ends; a value wrapped over lines is followed to its last one.
        at, end = max(done, word.start()), word.end(1) + REACH
        while m := CANDIDATE.search(text, at, end + LEAST - 1):
            m = CANDIDATE.match(text, m.start())
            at = m.end()
            if m.start() in refused:
                continue
            clear = all(m.end() <= s or e <= m.start() for s, _, e in base)
            if clear and mixed(m[0]) and novelty(text, m.start(), m.end()) >= NOVEL:
                out[m.start()] = done = m.end()
                if wrap := WRAP.match(text, at):
                    end = max(end, wrap.end() + 1)
            else:
                refused.add(m.start())
    return [(s, 3, e) for s, e in out.items()]


def spans_of(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) as (start, kind's place in KINDS, end), by start and kind."""
    lowered = text.lower()
    base = base_spans(text, lowered)
    return base, sorted(base + novel_spans(text, lowered, base, novelty))


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per text: numbers of base spans by kind, the digest of the base spans, and all spans."""

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            rows = []
            _, offsets = raw_text(batch.column(1))
            for low, high in doc_blocks(offsets):
                for text in texts(batch.column(1).slice(low, high - low)):
                    base, both = spans_of(text, novelty)
                    kinds = [k for _, k, _ in base]
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(said(base).encode()).hexdigest(), said(both)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The same rows, each span replaced by [kind]; of overlapping spans the first and longest names the whole run. n_chars follows the text where the table has it."""
    names = docs.columns
    spot, counts = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def clean(text: str | None, novelty: Novelty) -> str | None:
        if not text:
            return text
        _, spans = spans_of(text, novelty)
        out, at = [], 0
        for start, kind, end in sorted(spans, key=lambda s: (s[0], -s[2])):
            if start >= at:
                out += [text[at:start], f"[{KINDS[kind]}]"]
            at = max(at, end)
        return "".join([*out, text[at:]]) if out else text

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            _, offsets = raw_text(batch.column(spot))
            for low, high in doc_blocks(offsets):
                part = batch.slice(low, high - low)
                columns, was = part.columns, part.column(spot).to_pylist()
                cleaned = [clean(t, novelty) for t in was]
                if counts is not None:
                    columns[counts] = pa.array([n if a == b else len(b) for a, b, n in zip(was, cleaned, columns[counts].to_pylist(), strict=True)], columns[counts].type)
                columns[spot] = pa.array(cleaned, columns[spot].type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(released(run), docs.schema)
