"""Compiled schemas against a plain validator."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import jsonschema


def kind(x):
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(x), "number")


def same(a, b):
    return kind(a) == kind(b) and json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True) or kind(a) == kind(b) == "number" and a == b


def plain(s, x, path="", root=None):
    """The first breach, by the same order."""
    root = s if root is None else root
    if s is True or s == {}:
        return None
    if s is False:
        return path + " false"
    if "$ref" in s:
        at = root
        for key in s["$ref"][2:].split("/"):
            at = at[key]
        return plain(at, x, path, root) or plain({k: v for k, v in s.items() if k != "$ref"}, x, path, root)
    k = kind(x)
    types = [s["type"]] if isinstance(s.get("type"), str) else s.get("type")
    if types and k not in types and not ("integer" in types and k == "number" and x == math.floor(x)):
        return path + " type"
    if "enum" in s and not any(same(v, x) for v in s["enum"]):
        return path + " enum"
    if "const" in s and not same(s["const"], x):
        return path + " const"
    if k == "number":
        for word, bad in (("minimum", lambda n: x < n), ("maximum", lambda n: x > n), ("exclusiveMinimum", lambda n: x <= n), ("exclusiveMaximum", lambda n: x >= n), ("multipleOf", lambda n: abs(x / n - round(x / n)) > 1e-9)):
            if word in s and bad(s[word]):
                return f"{path} {word}"
    if k == "string":
        for word, bad in (("minLength", lambda n: len(x) < n), ("maxLength", lambda n: len(x) > n), ("pattern", lambda p: not re.search(p, x))):
            if word in s and bad(s[word]):
                return f"{path} {word}"
    if k == "array":
        texts = [json.dumps(e, sort_keys=True) for e in x]
        for word, bad in (("minItems", lambda n: len(x) < n), ("maxItems", lambda n: len(x) > n), ("uniqueItems", lambda n: n and len({*texts}) < len(texts))):
            if word in s and bad(s[word]):
                return f"{path} {word}"
        lead = s.get("prefixItems", [])
        for i, e in enumerate(x):
            if b := plain(lead[i] if i < len(lead) else s.get("items", True), e, f"{path}/{i}", root):
                return b
        if "contains" in s and all(plain(s["contains"], e, "", root) for e in x):
            return path + " contains"
    if k == "object":
        if "minProperties" in s and len(x) < s["minProperties"]:
            return path + " minProperties"
        if "maxProperties" in s and len(x) > s["maxProperties"]:
            return path + " maxProperties"
        for key in s.get("required", []):
            if key not in x:
                return f"{path}{jsonschema.pointer(key)} required"
        named, patterns = s.get("properties", {}), s.get("patternProperties", {})
        for key, part in named.items():
            if key in x and (b := plain(part, x[key], path + jsonschema.pointer(key), root)):
                return b
        for pattern, part in patterns.items():
            for key in sorted(x):
                if re.search(pattern, key) and (b := plain(part, x[key], path + jsonschema.pointer(key), root)):
                    return b
        rest = s.get("additionalProperties", True)
        for key in sorted(x):
            if key not in named and not any(re.search(p, key) for p in patterns):
                if rest is False:
                    return f"{path}{jsonschema.pointer(key)} additionalProperties"
                if b := plain(rest, x[key], path + jsonschema.pointer(key), root):
                    return b
    for part in s.get("allOf", []):
        if b := plain(part, x, path, root):
            return b
    if "anyOf" in s and all(plain(p, x, path, root) for p in s["anyOf"]):
        return path + " anyOf"
    if "oneOf" in s and sum(plain(p, x, path, root) is None for p in s["oneOf"]) != 1:
        return path + " oneOf"
    if "not" in s and plain(s["not"], x, path, root) is None:
        return path + " not"
    if "if" in s:
        return plain(s.get("else" if plain(s["if"], x, path, root) else "then", True), x, path, root)
    return None


SCHEMAS = [
    {"type": "object", "required": ["a", "b/c"], "properties": {"a": {"type": "integer", "minimum": 2, "multipleOf": 2}, "b/c": {"type": ["string", "null"], "minLength": 1, "pattern": "^x"}, "l": {"type": "array", "items": {"type": "object", "required": ["k"], "properties": {"k": {"enum": [1, "s", None, True, [1, 2]]}}}, "minItems": 1, "uniqueItems": True}}, "additionalProperties": False},
    {"$defs": {"small": {"type": "number", "exclusiveMaximum": 3}}, "type": "object", "properties": {"a": {"$ref": "#/$defs/small"}, "l": {"contains": {"type": "object"}, "maxItems": 2}}, "patternProperties": {"^b": {"type": "string", "maxLength": 2}}, "additionalProperties": {"type": ["array", "number"]}, "minProperties": 1, "maxProperties": 4},
    {"anyOf": [{"type": "array", "prefixItems": [{"type": "number"}, {"const": "s"}], "items": False}, {"type": "object", "oneOf": [{"required": ["a"]}, {"required": ["l"]}]}], "not": {"properties": {"a": {"const": 4}}, "required": ["a"]}},
    {"if": {"type": "object", "required": ["a"]}, "then": {"properties": {"a": {"type": "number", "maximum": 3, "exclusiveMinimum": 0}}}, "else": {"allOf": [{"type": ["array", "string", "object"]}, {"maxItems": 2}]}},
    {}, False, {"title": "only words"},
]


def value(rng, depth=0):
    pick = rng.randrange(9 if depth < 3 else 6)
    if pick < 6:
        return [None, True, rng.randrange(6), rng.choice([1.5, 2.0, -3.25]), rng.choice(["s", "", "x1", "xyz"]), "x"][pick]
    if pick == 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {k: value(rng, depth + 1) for k in rng.sample(["a", "b/c", "l", "k", "b1", "~z"], rng.randrange(5))}


@pytest.mark.parametrize("number", range(len(SCHEMAS)))
def test_breach(spark, number):
    rng = random.Random(number)
    values = [value(rng) for _ in range(400)] + [{"a": 4, "b/c": "xa", "l": [{"k": x}]} for x in (1, 1.0, "s", None, True, [1, 2], 2, False)]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame([*rows, (-1, "{nope"), (-2, None)], "i int, j string")
    got = {r.i: r.b for r in df.select("i", jsonschema.breach(SCHEMAS[number], F.col("j")).alias("b")).collect()}
    assert got.pop(-1) == got.pop(-2) == "not JSON"
    assert got == {i: plain(SCHEMAS[number], v) for i, v in enumerate(values)}


def test_deep_schemas_stay_small(spark):
    """Twelve levels deep: each binds its value once, so the expression follows the schema."""
    schema, held = {"type": "integer", "minimum": 3}, 2
    for _ in range(12):
        schema, held = {"type": "object", "required": ["n"], "properties": {"n": schema}, "minProperties": 1}, {"n": held}
    df = spark.createDataFrame([(json.dumps(held),)], "j string").select(jsonschema.breach(schema, F.col("j")).alias("b"))
    assert df.first().b == "/n" * 12 + " minimum"


def test_registry(spark):
    held = jsonschema.SchemaRegistry().register({"title": "t", "version": 1, "type": "object", "required": ["a"]}).register(json.dumps({"title": "t", "version": 2}))
    rows = [("t", 1, "{}"), ("t", 1, '{"a":1}'), ("t", 2, "{}"), ("t", 3, "{}"), ("u", 1, "{}"), (None, 1, "{}"), ("t", 1, None)]
    df = spark.createDataFrame(rows, "k string, v int, p string").select(held.error(F.col("k"), F.col("v"), F.col("p")).alias("e"))
    assert [r.e for r in df.collect()] == ["/a required", None, None, "schema not found", "schema not found", "schema not found", "not JSON"]
    for bad in ({"version": 1}, {"title": "t"}, {"title": "t", "version": -1}, {"title": "t", "version": 1, "type": "thing"}, {"title": "t", "version": 1, "$ref": "#"}, {"title": "t", "version": 1, "$ref": "#/$defs/x"}, {"title": "t", "version": 1, "unevaluatedProperties": False}):
        with pytest.raises(ValueError):
            jsonschema.SchemaRegistry().register(bad)
