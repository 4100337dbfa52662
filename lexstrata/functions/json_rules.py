"""JSON answers: extraction from prose, decoding, and a JSON-Schema subset as columns.

A schema is compiled to one array expression of messages; nothing is parsed more than once.
Supported: const (but null), enum, type (one or several), allOf, anyOf and oneOf (as anyOf),
required, additionalProperties false (where properties are named), properties, minItems, maxItems,
items, minLength, maxLength, pattern, format date, minimum, maximum. Other keywords pass. An empty
object and an empty list are one value, whose schema decides what it is.
"""

from __future__ import annotations

import functools
import json
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

MAX_MESSAGES = 20


def json_candidate(content: Column) -> Column:
    """The fenced block of an answer, else its first ``{`` to its last ``}``."""
    fenced = F.nullif(F.regexp_extract(content, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(content, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(fenced, bare)


def decoded(content: Column) -> Column:
    """The answer as VARIANT; null unless it is an object."""
    value = F.try_parse_json(json_candidate(content))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def _kind(value: Column) -> Column:
    """object, array, string, integer, number, boolean or null (JSON null or absent). A number
    written with a fraction, an exponent, or beyond 64 bits is no integer."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (name == "VOID"), "null").when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "BIGINT", "integer").otherwise("number")
    )


def _no_messages() -> Column:
    return F.array().cast("array<string>")


def schema_errors(value: Column, schema: dict, path: str = "$") -> Column:
    """Messages for a VARIANT, at most ``MAX_MESSAGES``, in the order of the checks."""
    return F.slice(_errors(value, schema, F.lit(path)), 1, MAX_MESSAGES)


def registry_errors(value: Column, name: Column, version: Column, registry: dict[tuple[str, int], dict]) -> Column:
    """Messages by the schema that a row names; rows of all schemas and versions at once.

    ``registry`` holds schemas by name and version; each is compiled once. A null version
    stands for the latest. A schema that is not there is itself a message.
    """
    latest: dict[str, int] = {}
    for known, v in registry:
        latest[known] = max(v, latest.get(known, v))
    newest = F.create_map(*[F.lit(x) for item in latest.items() for x in item]) if latest else None
    asked = F.coalesce(version.cast("int"), F.try_element_at(newest, name)) if newest is not None else version.cast("int")
    label = F.concat(F.coalesce(name, F.lit("null")), F.lit(" "), F.coalesce(asked.cast("string"), F.lit("?")))
    found = F.lit(None).cast("array<string>")
    for (known, v), schema in sorted(registry.items(), key=lambda x: x[0], reverse=True):
        found = F.when((name == known) & (asked == v), schema_errors(value, schema)).otherwise(found)
    return F.coalesce(found, F.array(F.concat(F.lit("There is no schema "), label, F.lit("."))))


def schema_version(schema: dict) -> int:
    """The version a schema states; 1 where it states none."""
    version = schema.get("version")
    return int(float(version)) if isinstance(version, (int, float, str)) and re.match(r"\s*[+-]?\d+(\.\d+)?\s*$", str(version)) else 1


def _message(test: Column, path: Column, what: str) -> Column:
    """One message where ``test`` is true; null tests pass."""
    return F.when(F.coalesce(test, F.lit(False)), F.array(F.concat(path, F.lit(f" {what}")))).otherwise(_no_messages())


def _errors(value: Column, schema: dict, path: Column) -> Column:
    facts = F.struct(value.alias("value"), _kind(value).alias("kind"))

    def with_keys(x: Column) -> Column:
        keys = F.when(x["kind"] == "object", F.json_object_keys(F.to_json(x["value"])))
        return let(F.struct(x["value"].alias("value"), x["kind"].alias("kind"), keys.alias("keys")), lambda y: _found(y["value"], y["kind"], y["keys"], schema, path))

    return let(facts, with_keys)


def _described(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False).replace("/", "\\/")


def _same(value: Column, kind: Column, wanted) -> Column:
    """Equal in value and kind: 1 is not 1.0."""
    if isinstance(wanted, float):
        return (kind == "number") & (F.try_variant_get(value, "$", "double") == wanted)
    if wanted is None:
        return kind == "null"
    return F.coalesce((F.to_json(value) == json.dumps(wanted, separators=(",", ":"), ensure_ascii=False)) & (kind != "number"), F.lit(False))


def _found(value: Column, kind: Column, keys: Column, schema: dict, path: Column) -> Column:
    """Constants, then the type (what follows depends on it), then shapes, then the parts."""
    first, then = [], []
    items = F.when(kind == "array", F.try_variant_get(value, "$", "array<variant>"))
    empty = F.coalesce((F.size(keys) == 0) & (kind == "object") | (F.size(items) == 0) & (kind == "array"), F.lit(False))  # {} and [] are one value
    if schema.get("const") is not None:
        first.append(_message(~_same(value, kind, schema["const"]), path, f"must be {_described(schema['const'])}."))
    if isinstance(schema.get("enum"), list):
        fits = [_same(value, kind, x) for x in schema["enum"]]
        first.append(_message(~functools.reduce(operator.or_, fits, F.lit(False)), path, f"must be one of {', '.join(map(_described, schema['enum']))}."))
    wrong = F.lit(False)
    if schema.get("type") is not None:
        types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        accepted = [*types, *(["integer"] if "number" in types else [])]
        if all(t in ("object", "array", "string", "integer", "number", "boolean", "null") for t in types):
            wrong = ~(kind.isin(accepted) | (empty & F.lit(bool({"object", "array"} & set(types)))))
            given = F.when(empty, "array").otherwise(kind)
            message = F.concat(path, F.lit(f" must be of type {'|'.join(types)}, "), given, F.lit(" given."))
            first.append(F.when(wrong, F.array(message)).otherwise(_no_messages()))
    for inner in schema.get("allOf") or []:
        then.append(_errors(value, inner, path))
    for key in ("anyOf", "oneOf"):
        if schema.get(key):
            fits = [F.size(_errors(value, s, path)) == 0 for s in schema[key]]
            then.append(_message(~functools.reduce(operator.or_, fits), path, f"does not match any of the allowed shapes ({key})."))
    as_object = schema.get("type") == "object" or "properties" in schema or "required" in schema
    then.append(F.when((kind == "object") & ~empty | empty & F.lit(as_object), _object_errors(value, keys, schema, path)).otherwise(_no_messages()))
    then.append(F.when((kind == "array") & ~empty | empty & F.lit(not as_object), _array_errors(items, schema, path)).otherwise(_no_messages()))
    then += _scalar_errors(value, kind, schema, path)
    rest = F.concat(*then)
    return F.concat(*first, F.when(wrong, _no_messages()).otherwise(rest)) if first else rest


def _object_errors(value: Column, keys: Column, schema: dict, path: Column) -> Column:
    held, found, properties = F.coalesce(keys, _no_messages()), [], schema.get("properties") or {}
    for name in schema.get("required") or []:
        found.append(_message(~F.array_contains(held, name), path, f'is missing the required property "{name}".'))
    if schema.get("additionalProperties") is False and properties:
        extra = F.array_except(held, F.array(*map(F.lit, properties)))
        found.append(F.transform(extra, lambda k: F.concat(path, F.lit(' has the unexpected property "'), k, F.lit('".'))))
    for name, inner in properties.items():
        part = F.try_variant_get(value, f'$["{name}"]', "variant")
        found.append(F.when(F.array_contains(held, name), _errors(part, inner, F.concat(path, F.lit(f".{name}")))).otherwise(_no_messages()))
    return F.concat(*found) if found else _no_messages()


def _array_errors(items: Column, schema: dict, path: Column) -> Column:
    found, n = [], F.coalesce(F.size(items), F.lit(0))
    if schema.get("minItems") is not None:
        found.append(_message(n < schema["minItems"], path, f"must have at least {schema['minItems']} items."))
    if schema.get("maxItems") is not None:
        found.append(_message(n > schema["maxItems"], path, f"must have at most {schema['maxItems']} items."))
    if isinstance(schema.get("items"), dict):
        each = F.transform(items, lambda x, i: _errors(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.coalesce(F.flatten(each), _no_messages()))
    return F.concat(*found) if found else _no_messages()


def _scalar_errors(value: Column, kind: Column, schema: dict, path: Column) -> list[Column]:
    number, text = F.when(kind.isin("integer", "number"), F.try_variant_get(value, "$", "double")), F.when(kind == "string", F.try_variant_get(value, "$", "string"))
    checks = (
        ("minLength", lambda n: F.length(text) < n, "must be at least {} characters long."), ("maxLength", lambda n: F.length(text) > n, "must be at most {} characters long."),
        ("pattern", lambda p: ~text.rlike(p), "must match the pattern {}."), ("format", lambda f: ~text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.lit(f == "date"), "must be a date in YYYY-MM-DD form."),
        ("minimum", lambda n: number < n, "must be at least {}."), ("maximum", lambda n: number > n, "must be at most {}."),
    )
    return [_message(test(schema[key]), path, what.format(schema[key])) for key, test, what in checks if schema.get(key) is not None]
