"""Chunks along scopes: the text comes back, no scope that fits is cut, strings and comments aren't code."""

import random

import pytest

from lodestone.functions import scopes

WORDS = ["alpha", "beta", "gamma(1)", "x = [1, 2]", "call({a: 1})", "é = 'ü'"]


def braces(rng, depth, indent=""):
    """Code and the (start, end) of its scopes."""
    text, found = "", []
    for k in range(rng.randrange(1, 5)):
        if depth and rng.random() < 0.5:
            inner, below = braces(rng, depth - 1, indent + "  ")
            lead = rng.choice(["", f"{indent}// note }} {{\n", f"{indent}@mark\n"])
            whole = f"{lead}{indent}fn f{k}() {{\n{inner}{indent}}}\n"
            shift = len(text) + len(lead) + len(f"{indent}fn f{k}() {{\n")
            found += [(len(text), len(text) + len(whole)), *((a + shift, b + shift) for a, b in below)]
            text += whole
        else:
            text += indent + rng.choice([*WORDS, 'say("}}}{")', "/* } */ y()", "`{`", "// ]]"]) + ";\n"
    return text, found


def indented(rng, depth, indent=""):
    text, found = "", []
    for k in range(rng.randrange(1, 5)):
        if depth and rng.random() < 0.5:
            inner, below = indented(rng, depth - 1, indent + "    ")
            lead = rng.choice(["", f"{indent}@mark\n", f"{indent}# note\n"])
            whole = f"{lead}{indent}def f{k}():\n{inner}"
            shift = len(text) + len(whole) - len(inner)
            found += [(len(text), len(text) + len(whole)), *((a + shift, b + shift) for a, b in below)]
            text += whole
        else:
            text += indent + rng.choice([*WORDS, "s = '''\nnot indented {\n'''", "v = [\n1,\n  2]", "# only a note"]) + "\n"
    return text, found


def headed(rng, depth, level=1):
    text, found = "", []
    for k in range(rng.randrange(1, 4)):
        para = rng.choice(["Some words\nover lines.\n\n", "```\n# no heading\n\ncode\n```\n\n", "One.\n\n"])
        inner, below = headed(rng, depth - 1, level + 1) if depth else ("", [])
        whole = f"{'#' * level} Head {k}\n\n{para}{inner}"
        shift = len(text) + len(whole) - len(inner)
        found += [(len(text), len(text) + len(whole)), *((a + shift, b + shift) for a, b in below)]
        text += whole
    return text, found


@pytest.mark.parametrize(("make", "extension"), [(braces, "ts"), (braces, "js"), (indented, "py"), (headed, "md")])
def test_no_scope_that_fits_is_cut(make, extension):
    rng = random.Random(5)
    for _ in range(150):
        text, found = make(rng, 4)
        for most in (40, 90, 300, 5000):
            parts = scopes.chunks(text, extension, most)
            assert "".join(parts) == text
            assert all(len(p.encode()) <= most for p in parts)
            ends, place = [], 0
            for p in parts:
                place += len(p)
                ends.append(place)
            for a, b in found:
                if len(text[a:b].encode()) <= most:
                    assert not any(a < e < b for e in ends), (most, text[a:b], parts)


def test_packing():
    """Small scopes share a chunk; a large one is cut into its parts, and its first line stays with what leads to it."""
    text = "a();\nb();\n// about f\nfn f() {\n  one();\n  two();\n}\nc();\n"
    assert scopes.chunks(text, "rs", 1000) == [text]
    assert scopes.chunks(text, "rs", 49) == ["a();\nb();\n", "// about f\nfn f() {\n  one();\n  two();\n}\nc();\n"]
    assert scopes.chunks("x" * 100, "py", 30) == ["x" * 30] * 3 + ["x" * 10]
    assert scopes.chunks("é" * 10, "txt", 3) == ["é"] * 10
    assert scopes.chunks("", "py", 10) == [] and scopes.chunks("\n\n\n", "rs", 2) == ["\n", "\n\n"]


@pytest.mark.parametrize("text", ["'a {\n b }\n", '"unclosed {\n x }\n', "/* unclosed {\n{{{", "}}}}\n{{{{\n", "fn a<'x>(b: &'x str) {\n c('{');\n}\n", "```\nopen {", "if (a) {\n b\n} else {\n c\n}\nd\n"])
@pytest.mark.parametrize("extension", ["rs", "js", "py", "md", "txt", "", "json"])
def test_odd_texts(text, extension):
    for most in (1, 5, 12, 100):
        assert "".join(scopes.chunks(text * 3, extension, most)) == text * 3


def test_levels():
    lines = scopes.code_lines("if (a) {\n b('{', \"}\");\n} else {\n c\n}\nd /* {\n{ */\n", scopes.LANGUAGES["ts"])
    assert lines.level == [0, 1, 0, 1, 0, 0, 0] and lines.closes == [False, False, True, False, True, False, False] and lines.joined[-1]
    rust = scopes.code_lines("fn a<'x>(b: &'x str) {\n c('{');\n}\n", scopes.LANGUAGES["rs"])
    assert rust.level == [0, 1, 0]


def test_scoped(spark):
    df = spark.createDataFrame([(1, "py", "def a():\n    b\nc\n"), (2, None, "x\n\ny"), (3, "md", None), (4, "rs", "")], "doc_id long, extension string, text string")
    got = [(r.doc_id, r.idx, r.offset, r.chunk) for r in scopes.scoped(df, 16).orderBy("doc_id", "idx").collect()]
    assert got == [(1, 0, 0, "def a():\n    b\n"), (1, 1, 15, "c\n"), (2, 0, 0, "x\n\ny")]
