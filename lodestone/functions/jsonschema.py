"""JSON Schema compiled to expressions over Variant columns: a payload's first breach, found inside the JVM.

A schema becomes one expression, whose size follows the schema's: every level binds its value once. Keywords: type, enum,
const, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minLength, maxLength, pattern, items, prefixItems,
contains, minItems, maxItems, uniqueItems, required, properties, patternProperties, additionalProperties, minProperties,
maxProperties, allOf, anyOf, oneOf, not, if/then/else, and $ref into the schema itself, as long as it isn't recursive.
Others that would assert something are an error when a schema is compiled; annotations are passed over.

A breach is "path keyword", the path a JSON pointer. Values are checked in the order of the list above, depth first.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("object", "array", "string", "number", "integer", "boolean", "null")
UNSUPPORTED = ("$dynamicRef", "dependencies", "dependentRequired", "dependentSchemas", "propertyNames", "unevaluatedItems", "unevaluatedProperties", "maxContains", "minContains")
ASSERTING = {
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "items", "prefixItems", "contains", "minItems", "maxItems", "uniqueItems",
    "required", "properties", "patternProperties", "additionalProperties", "minProperties", "maxProperties", "allOf", "anyOf", "oneOf", "not", "if", "$ref", *UNSUPPORTED,
}
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}  # other names are numbers'


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is computed once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def pointer(key: str) -> str:
    return "/" + key.replace("~", "~0").replace("/", "~1")


def asserts(schema: dict | bool) -> bool:
    """Whether a schema may refuse a value."""
    return schema is False or isinstance(schema, dict) and any(k in schema for k in ASSERTING)


class Compiler:
    def __init__(self, schema: dict | bool):
        self.root = schema

    def breach(self, schema: dict | bool, value: Column, path: Column, within: tuple[str, ...] = ()) -> Column | None:
        """The first breach of a Variant value, null if it fits; None if every value fits."""
        if schema is True or schema == {}:
            return None
        if schema is False:
            return F.concat(path, F.lit(" false"))
        if not isinstance(schema, dict):
            raise ValueError(f"a schema is an object or a boolean, not {schema!r}")
        if odd := [k for k in UNSUPPORTED if k in schema]:
            raise ValueError(f"unsupported keyword: {odd[0]}")
        if "$ref" in schema:
            if schema["$ref"] in within:
                raise ValueError(f"recursive reference: {schema['$ref']}")
            rest = {k: v for k, v in schema.items() if k != "$ref"}
            return self.first(self.breach(self.target(schema["$ref"]), value, path, (*within, schema["$ref"])), self.breach(rest, value, path, within))
        word = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
        kind = F.when(word.isin(*KINDS), F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), word)).otherwise("number")
        if not asserts(schema):
            return None
        none = F.lit(None).cast("string")
        return bound(F.struct(value.alias("x"), kind.alias("k")), lambda v: F.coalesce(*self.checks(schema, v["x"], v["k"], path, within), none))

    @staticmethod
    def first(*parts: Column | None) -> Column | None:
        real = [p for p in parts if p is not None]
        return F.coalesce(*real) if real else None

    def target(self, ref: str) -> dict | bool:
        if not ref.startswith("#"):
            raise ValueError(f"reference out of the schema: {ref}")
        at = self.root
        for key in filter(None, ref[1:].split("/")):
            key = key.replace("~1", "/").replace("~0", "~")
            at = at[int(key)] if isinstance(at, list) else at.get(key) if isinstance(at, dict) else None
            if at is None:
                raise ValueError(f"no such reference: {ref}")
        return at

    def checks(self, s: dict, x: Column, kind: Column, path: Column, within: tuple[str, ...]) -> list[Column]:
        out: list[Column] = []
        number = F.when(kind == "number", F.try_variant_get(x, "$", "double"))
        text = F.when(kind == "string", F.try_variant_get(x, "$", "string"))

        def fail(keyword: str, when: Column) -> None:
            out.append(F.when(when, F.concat(path, F.lit(f" {keyword}"))))

        if "type" in s:
            wanted = [s["type"]] if isinstance(s["type"], str) else list(s["type"])
            if odd := [t for t in wanted if t not in TYPES]:
                raise ValueError(f"no such type: {odd[0]}")
            fits = kind.isin(*[t for t in wanted if t != "integer"]) if wanted != ["integer"] else F.lit(False)
            fail("type", ~(fits | F.coalesce(number == F.floor(number), F.lit(False)) if "integer" in wanted else fits))
        if "enum" in s:
            fail("enum", ~self.among(s["enum"], x, kind, number, text))
        if "const" in s:
            fail("const", ~self.among([s["const"]], x, kind, number, text))
        for keyword, test in (("minimum", lambda n: number < n), ("maximum", lambda n: number > n), ("exclusiveMinimum", lambda n: number <= n), ("exclusiveMaximum", lambda n: number >= n)):
            if keyword in s:
                fail(keyword, test(float(s[keyword])))
        if "multipleOf" in s:
            share = number / F.lit(float(s["multipleOf"]))
            fail("multipleOf", F.abs(share - F.round(share)) > 1e-9)
        if "minLength" in s:
            fail("minLength", F.char_length(text) < s["minLength"])
        if "maxLength" in s:
            fail("maxLength", F.char_length(text) > s["maxLength"])
        if "pattern" in s:
            fail("pattern", ~text.rlike(s["pattern"]))
        self.array_checks(s, F.when(kind == "array", F.try_variant_get(x, "$", "array<variant>")), path, within, out, fail)
        self.object_checks(s, F.when(kind == "object", F.try_variant_get(x, "$", "map<string,variant>")), path, within, out, fail)
        for part in s.get("allOf", []):
            if (b := self.breach(part, x, path, within)) is not None:
                out.append(b)
        for keyword, test in (("anyOf", lambda n, k: n == 0), ("oneOf", lambda n, k: n != 1)):
            if keyword in s:
                found = [self.breach(part, x, path, within) for part in s[keyword]]
                fitting = sum((F.lit(1) if b is None else b.isNull().cast("int") for b in found), F.lit(0))
                fail(keyword, test(fitting, len(found)))
        if "not" in s:
            b = self.breach(s["not"], x, path, within)
            fail("not", F.lit(True) if b is None else b.isNull())
        if "if" in s:
            b = self.breach(s["if"], x, path, within)
            then, other = (self.breach(s.get(k, True), x, path, within) for k in ("then", "else"))
            none = F.lit(None).cast("string")
            then, other = (none if p is None else p for p in (then, other))
            out.append(then if b is None else F.when(b.isNull(), then).otherwise(other))
        return out

    def array_checks(self, s: dict, items: Column, path: Column, within: tuple[str, ...], out: list[Column], fail: Callable) -> None:
        place = lambda i: F.concat(path, F.lit("/"), i.cast("string"))
        if "minItems" in s:
            fail("minItems", F.size(items) < s["minItems"])
        if "maxItems" in s:
            fail("maxItems", F.size(items) > s["maxItems"])
        if s.get("uniqueItems"):
            texts = F.transform(items, lambda e: F.to_json(e))
            fail("uniqueItems", F.size(F.array_distinct(texts)) < F.size(texts))
        leading = s.get("prefixItems", [])
        for i, part in enumerate(leading):
            if (b := self.breach(part, F.get(items, F.lit(i)), place(F.lit(i)), within)) is not None:
                out.append(F.when(F.size(items) > i, b))
        if asserts(s.get("items", True)):
            found = F.transform(items, lambda e, i: F.when(i >= len(leading), self.breach(s["items"], e, place(i), within)))
            out.append(F.get(F.filter(found, lambda b: b.isNotNull()), F.lit(0)))
        if "contains" in s:
            fits = lambda e: self.breach(s["contains"], e, path, within).isNull() if asserts(s["contains"]) else F.lit(True)
            fail("contains", ~F.exists(items, fits))

    def object_checks(self, s: dict, fields: Column, path: Column, within: tuple[str, ...], out: list[Column], fail: Callable) -> None:
        keys = F.map_keys(fields)
        if "minProperties" in s:
            fail("minProperties", F.size(keys) < s["minProperties"])
        if "maxProperties" in s:
            fail("maxProperties", F.size(keys) > s["maxProperties"])
        for key in s.get("required", []):
            out.append(F.when(~F.array_contains(keys, key), F.concat(path, F.lit(f"{pointer(key)} required"))))
        named, patterns, rest = s.get("properties", {}), s.get("patternProperties", {}), s.get("additionalProperties", True)
        for key, part in named.items():
            if (b := self.breach(part, F.element_at(fields, key), F.concat(path, F.lit(pointer(key))), within)) is not None:
                out.append(F.when(F.array_contains(keys, key), b))
        place = lambda k: F.concat(path, F.lit("/"), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))

        def each(part: dict | bool, of: Callable[[Column], Column]) -> None:
            if asserts(part):
                found = F.transform(F.filter(F.map_entries(fields), lambda e: of(e["key"])), lambda e: self.breach(part, e["value"], place(e["key"]), within))
                out.append(F.get(F.filter(found, lambda b: b.isNotNull()), F.lit(0)))

        for pattern, part in patterns.items():
            each(part, lambda k, p=pattern: k.rlike(p))
        other = lambda k: ~k.isin(*named) if named else F.lit(True)
        extra = lambda k: [other(k), *(~k.rlike(p) for p in patterns)]
        all_of = lambda parts: parts[0] if len(parts) == 1 else parts[0] & all_of(parts[1:])
        if rest is False:
            odd = F.get(F.array_sort(F.filter(keys, lambda k: all_of(extra(k)))), F.lit(0))
            out.append(F.when(odd.isNotNull(), F.concat(place(odd), F.lit(" additionalProperties"))))
        else:
            each(rest, lambda k: all_of(extra(k)))

    @staticmethod
    def among(values: list, x: Column, kind: Column, number: Column, text: Column) -> Column:
        """Whether a value is one of some JSON values."""
        out = F.lit(False)
        for v in values:
            if v is None:
                own = kind == "null"
            elif isinstance(v, bool):
                own = (kind == "boolean") & (F.to_json(x) == json.dumps(v))
            elif isinstance(v, int | float):
                own = number == float(v)
            elif isinstance(v, str):
                own = text == v
            else:
                own = F.to_json(x) == F.to_json(F.parse_json(F.lit(json.dumps(v))))
            out = out | F.coalesce(own, F.lit(False))
        return out


def breach(schema: dict | bool | str, payload: Column) -> Column:
    """The first breach of a JSON text, null if it fits; "not JSON" for a text that is none, or for null."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    found = Compiler(schema).breach(schema, F.try_parse_json(payload), F.lit(""))
    fits = F.lit(None).cast("string")
    return F.when(F.try_parse_json(payload).isNull(), "not JSON").otherwise(fits if found is None else found)


class SchemaRegistry:
    """Compiled schemas by title and version."""

    def __init__(self):
        self.held: dict[tuple[str, int], dict] = {}

    def register(self, schema: dict | str) -> SchemaRegistry:
        schema = json.loads(schema) if isinstance(schema, str) else schema
        if not isinstance(schema.get("title"), str):
            raise ValueError("a schema has a title")
        if not isinstance(schema.get("version"), int) or isinstance(schema["version"], bool) or schema["version"] < 0:
            raise ValueError("a schema has a version, a whole number")
        Compiler(schema).breach(schema, F.lit(None), F.lit(""))  # an error now rather than in a query
        self.held[schema["title"], schema["version"]] = schema
        return self

    def error(self, kind: Column, version: Column, payload: Column) -> Column:
        """Null for a payload that fits the schema of its type and version; the first breach; "schema not found"."""
        out, missing = None, F.lit("schema not found")
        for (title, number), schema in self.held.items():
            own, found = (kind == title) & (version == number), breach(schema, payload)
            out = F.when(own, found) if out is None else out.when(own, found)
        return missing if out is None else out.otherwise(missing)
