"""JSON Schema: the first fault of a value, in the order in which validators look for it."""

from __future__ import annotations

import re

KINDS = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
}


def same(a, b) -> bool:
    """Equality of JSON values: true is no 1."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def pointer(part: str) -> str:
    return part.replace("~", "~0").replace("/", "~1")


def fault(value, schema: dict, at: str = "") -> tuple[str, str] | None:
    """(JSON pointer, keyword) of the first fault, or None.

    Types come first, then limits of numbers and texts, const and enum, alternatives, arrays and objects. Of
    alternatives that all fail, the first one's fault is told.
    """
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(KINDS[k](value) for k in kinds):
        return at, "type"
    return numbers(value, schema, at) or texts(value, schema, at) or choices(value, schema, at) or items(value, schema, at) or members(value, schema, at)


def numbers(value, schema: dict, at: str) -> tuple[str, str] | None:
    if not KINDS["number"](value):
        return None
    if value > schema.get("maximum", value):
        return at, "maximum"
    if value < schema.get("minimum", value):
        return at, "minimum"
    if "multipleOf" in schema and not (value / schema["multipleOf"]).is_integer():
        return at, "multipleOf"
    return None


def texts(value, schema: dict, at: str) -> tuple[str, str] | None:
    if not isinstance(value, str):
        return None
    if len(value) > schema.get("maxLength", len(value)):
        return at, "maxLength"
    if len(value) < schema.get("minLength", 0):
        return at, "minLength"
    if "pattern" in schema and not re.search(schema["pattern"], value):
        return at, "pattern"
    return None


def choices(value, schema: dict, at: str) -> tuple[str, str] | None:
    if "const" in schema and not same(value, schema["const"]):
        return at, "const"
    if "enum" in schema and not any(same(value, e) for e in schema["enum"]):
        return at, "enum"
    for keyword in ("anyOf", "oneOf"):
        if keyword in schema:
            found = [fault(value, s, at) for s in schema[keyword]]
            good = found.count(None)
            if not good:
                return found[0]
            if keyword == "oneOf" and good > 1:
                return at, keyword
    return None


def items(value, schema: dict, at: str) -> tuple[str, str] | None:
    if not isinstance(value, list):
        return None
    if len(value) > schema.get("maxItems", len(value)):
        return at, "maxItems"
    if len(value) < schema.get("minItems", 0):
        return at, "minItems"
    if schema.get("uniqueItems") and any(same(a, b) for i, a in enumerate(value) for b in value[:i]):
        return at, "uniqueItems"
    return next((x for i, v in enumerate(value) if (x := fault(v, schema.get("items", {}), f"{at}/{i}"))), None)


def members(value, schema: dict, at: str) -> tuple[str, str] | None:
    if not isinstance(value, dict):
        return None
    if any(k not in value for k in schema.get("required", [])):
        return at, "required"
    known = schema.get("properties", {})
    if schema.get("additionalProperties", True) is False and any(k not in known for k in value):
        return at, "additionalProperties"
    return next((x for k, s in known.items() if k in value and (x := fault(value[k], s, f"{at}/{pointer(k)}"))), None)
