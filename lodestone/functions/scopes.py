"""Chunks of code and Markdown along their scopes: no chunk cuts a scope that fits into one.

A scan tells code from strings and comments and gives each line a level: how many brackets are open before it, or how far
it is indented where indentation counts; a Markdown line's level is its heading's. Lines of a level with the deeper ones
below them are a scope. Scopes that follow each other are packed up to the limit; one beyond it is cut into what it
consists of, down to lines; a line beyond the limit is cut between characters. The chunks of a text, put together, are the
text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

DEEP = 1 << 20  # the level of text below Markdown headings


@dataclass(frozen=True)
class Language:
    """How a scan reads a language: line comments, block comments, strings over lines, strings within one."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    long: tuple[str, ...] = ()
    short: tuple[str, ...] = ('"', "'")
    indented: bool = False
    lead: tuple[str, ...] = ("@", "#[")  # what stands before what it belongs to
    quote: bool = False  # whether ' also stands before names

    def pattern(self) -> re.Pattern:
        parts = [f"{re.escape(a)}.*?(?:{re.escape(b)}|\\Z)" for a, b in self.block]
        parts += [f"{re.escape(q)}(?:\\\\.|(?!{re.escape(q)}).)*(?:{re.escape(q)}|\\Z)" for q in self.long]
        parts += [f"{re.escape(c)}[^\\n]*" for c in self.line]
        parts += [r"'(?:\\[^\n]+?|[^\\'\n])'" if q == "'" and self.quote else f"{q}(?:\\\\[^\\n]|[^{q}\\\\\\n])*{q}?" for q in self.short]
        return re.compile(f"(?P<skip>{'|'.join(parts)})|(?P<open>[\\[({{])|(?P<close>[\\])}}])", re.S)


BRACES = Language(long=("`",))
PYTHON = Language(line=("#",), block=(), long=('"""', "'''"), indented=True, lead=("@",))
HASH = Language(line=("#",), block=(), indented=True, lead=())
LANGUAGES = dict.fromkeys(["js", "jsx", "ts", "tsx", "go"], BRACES) | dict.fromkeys(["java", "c", "h", "cc", "cpp", "hpp", "cs", "kt", "scala", "swift", "php", "css", "json"], Language()) | {"rs": Language(quote=True), "py": PYTHON, "pyi": PYTHON} | dict.fromkeys(["sh", "rb", "yaml", "yml", "toml"], HASH)
MARKDOWN = ("md", "markdown", "mdx")


@dataclass
class Lines:
    """A text's lines: where each starts, its level, whether it goes on from the one before, closes a scope, or leads to the next."""

    text: str
    starts: list[int]
    level: list[int] = field(default_factory=list)
    joined: list[bool] = field(default_factory=list)
    closes: list[bool] = field(default_factory=list)
    leads: list[bool] = field(default_factory=list)


def _starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text) if m.end() < len(text))] if text else []


def code_lines(text: str, language: Language) -> Lines:
    out = Lines(text, _starts(text))
    n = len(out.starts)
    depth_at, inside, before = [0] * n, [False] * n, 0
    events = [(m.start(), m.end(), m.lastgroup) for m in language.pattern().finditer(text)]
    depth, line = 0, 0
    for start, end, kind in events:
        while line + 1 < n and out.starts[line + 1] <= start:
            line += 1
            depth_at[line] = depth
        if kind == "skip":
            while line + 1 < n and out.starts[line + 1] < end:  # lines that begin within a string or comment
                line += 1
                depth_at[line], inside[line] = depth, True
        else:
            depth = depth + 1 if kind == "open" else max(0, depth - 1)
    for rest in range(line + 1, n):
        depth_at[rest] = depth
    for i in range(n):
        row = text[out.starts[i] : out.starts[i + 1] if i + 1 < n else len(text)]
        body = row.strip()
        closing = 0 if inside[i] else len(body) - len(body.lstrip("])}"))
        level = max(0, depth_at[i] - closing)
        if language.indented:
            width = len(row) - len(row.lstrip(" \t")) if body else before
            level = level * 4096 + (width if not depth_at[i] else before)
            before = width if body and not depth_at[i] and not inside[i] else before
        out.level.append(level)
        out.joined.append(inside[i] or not body)
        out.closes.append(closing > 0)
        out.leads.append(bool(body) and not inside[i] and body.startswith((*language.line, *(a for a, _ in language.block), *language.lead)))
    return out


def markdown_lines(text: str) -> Lines:
    """Headings by their number of #, or underlined; a fenced block, and a paragraph, is one piece."""
    out, fence, before = Lines(text, _starts(text)), None, True
    n = len(out.starts)
    rows = [text[a : out.starts[i + 1] if i + 1 < n else len(text)] for i, a in enumerate(out.starts)]
    for i, row in enumerate(rows):
        body = row.strip()
        mark = re.match(r"(`{3,}|~{3,})", body)
        heading = re.match(r"(#{1,6})(\s|$)", row)
        under = i + 1 < n and body and not heading and re.fullmatch(r"=+|-{2,}", rows[i + 1].strip())
        if fence:
            level, joined = DEEP, True
            fence = None if body.startswith(fence) and not body.strip(fence[0]) else fence
            before = fence is None
        elif mark:
            fence, level, joined, before = mark[1], DEEP, False, False
        elif heading:
            level, joined, before = len(heading[1]), False, True
        elif under and before:
            level, joined, before = (1 if rows[i + 1].strip()[0] == "=" else 2), False, False
        else:
            level, joined = DEEP, not body or not before
            before = not body
        out.level.append(level)
        out.joined.append(joined)
        out.closes.append(False)
        out.leads.append(False)
    return out


def children(lines: Lines, a: int, b: int) -> list[tuple[int, int]]:
    """The scopes that lines a to b consist of, each from its first line to its end."""
    least = min(lines.level[i] for i in range(a, b) if not lines.joined[i] or i == a)
    out: list[tuple[int, int]] = []
    start, leading, opened = a, False, False  # opened: the part at work begins at this level, so what closes it belongs to it
    for i in range(a, b):
        if i > a and (lines.joined[i] or lines.level[i] != least):
            leading = leading and lines.joined[i]
            continue
        if not leading and i > start and not (lines.closes[i] and opened):
            out.append((start, i))
            start = i
        leading, opened = lines.leads[i], lines.level[i] == least
    out.append((start, b))
    return out


def cuts(lines: Lines, most: int) -> list[int]:
    """Where chunks of at most `most` bytes end, as places in the text."""
    text, n = lines.text, len(lines.starts)
    if not n:
        return []
    edge = [*lines.starts, len(text)]
    total, sizes = [0], []
    for i in range(n):
        sizes.append(len(text[edge[i] : edge[i + 1]].encode()))
        total.append(total[-1] + sizes[-1])
    ends: list[int] = []
    held: list[int] = [0, 0]  # lines of the chunk at work

    def flush() -> None:
        if held[1] > held[0]:
            ends.append(edge[held[1]])
        held[0] = held[1]

    work = [(0, n, False)]  # and whether what is held leads to it
    while work:
        a, b, led = work.pop()
        if total[b] - total[a] <= most:
            if total[b] - total[held[0]] > most:
                flush()
            held[1] = b
            continue
        if not led:
            flush()
        parts = children(lines, a, b) if b - a > 1 else []
        if len(parts) > 1:
            work += [(x, y, False) for x, y in reversed(parts)]
        elif b - a > 1:  # one scope: its first line, then the rest
            work += [(a + 1, b, lines.leads[a]), (a, a + 1, False)]
        else:
            flush()
            place = edge[a]
            while len(rest := text[place : edge[b]].encode()) > most:
                place += len(rest[:most].decode(errors="ignore")) or 1
                ends.append(place)
            held[0] = held[1] = b
            if place < edge[b]:
                ends.append(edge[b])
    flush()
    return ends


def chunks(text: str, extension: str, most: int) -> list[str]:
    """By the kind of file; unknown kinds are text, whose paragraphs are its scopes."""
    if not text:
        return []
    extension = extension.lower().lstrip(".")
    lines = code_lines(text, LANGUAGES[extension]) if extension in LANGUAGES else markdown_lines(text) if extension in MARKDOWN else text_lines(text)
    ends = cuts(lines, most)
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def text_lines(text: str) -> Lines:
    out, before = Lines(text, _starts(text)), True
    for i, a in enumerate(out.starts):
        blank = not text[a : out.starts[i + 1] if i + 1 < len(out.starts) else len(text)].strip()
        out.level.append(0)
        out.joined.append(blank or not before)
        out.closes.append(False)
        out.leads.append(False)
        before = blank
    return out


def scoped(files: DataFrame, most: int) -> DataFrame:
    """(doc_id, idx, offset, chunk): the chunks of texts (doc_id, extension, text) by their extension; offset: in characters. Null texts have none."""

    def run(batches):
        for batch in batches:
            docs, idx, places, out = [], [], [], []
            for doc, extension, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = 0
                for i, chunk in enumerate(chunks(text or "", extension or "", most)):
                    docs.append(doc)
                    idx.append(i)
                    places.append(place)
                    out.append(chunk)
                    place += len(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(idx, pa.int64()), pa.array(places, pa.int64()), pa.array(out, pa.string())], ["doc_id", "idx", "offset", "chunk"])

    return files.select("doc_id", "extension", "text").mapInArrow(run, f"doc_id {dict(files.dtypes)['doc_id']}, idx long, offset long, chunk string")

