"""JSON texts against a JSON schema (X4): a schema is compiled to one expression over variant values; no Python runs on rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is checked, and what only describes.
CHECKED = frozenset({"type", "const", "enum", "minimum", "maximum", "minItems", "maxItems", "pattern", "format", "properties", "required", "additionalProperties", "items"})
DESCRIBING = frozenset({"$schema", "$id", "$comment", "title", "description", "examples", "default"})
#: JSON's types by the names that variants give them.
_KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING", "boolean": "^BOOLEAN", "null": "^VOID", "number": "^(BIGINT|DOUBLE|DECIMAL|FLOAT)"}
_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"

Check = Callable[[Column, Column], Column]


def _none() -> Column:
    return F.array().cast("array<string>")


def _is(value: Column, kind: str) -> Column:
    if kind == "integer":
        number = F.try_variant_get(value, "$", "double")
        # An infinite number (1e999 is one) is no integer.
        return _is(value, "number") & (F.abs(number) < float("inf")) & (number == F.rint(number))
    return F.schema_of_variant(value).rlike(_KINDS[kind])


def _equals(value: Column, literal: object) -> Column:
    """Equal in type and value: true is not 1."""
    if literal is None:
        return _is(value, "null")
    kind, held = ("boolean", "boolean") if isinstance(literal, bool) else ("string", "string") if isinstance(literal, str) else ("number", "double")
    return _is(value, kind) & (F.try_variant_get(value, "$", held) == F.lit(float(literal) if kind == "number" else literal))


def compiled(schema: dict, place: str = "$") -> Check:
    """A function of a variant and its place that gives the `place: keyword` of each fault; a schema with other keywords is an error now."""
    unknown = sorted(set(schema) - CHECKED - DESCRIBING)
    if unknown:
        raise ValueError(f"{place}: keywords that are not checked: {', '.join(unknown)}")
    kinds = schema.get("type", ())
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    if bad := [k for k in kinds if k != "integer" and k not in _KINDS]:
        raise ValueError(f"{place}: no types of JSON: {', '.join(bad)}")
    literals = [*schema.get("enum", ()), *([schema["const"]] if "const" in schema else [])]
    if any(isinstance(x, dict | list) for x in literals):
        raise ValueError(f"{place}: const and enum of objects or arrays are not checked")
    if schema.get("format", "date-time") != "date-time" or not isinstance(schema.get("additionalProperties", True), bool) or not isinstance(schema.get("items", {}), dict):
        raise ValueError(f"{place}: format is date-time, additionalProperties true or false, items one schema")
    known = {name: compiled(held, f"{place}.{name}") for name, held in schema.get("properties", {}).items()}
    item = compiled(schema["items"], f"{place}[]") if "items" in schema else None

    def limits(value: Column) -> list[tuple[str, Column]]:
        """Keyword and whether a value breaks it; a keyword for one type says nothing of others."""
        number, text, length = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string"), F.size(F.try_variant_get(value, "$", "array<variant>"))
        rules = {
            "const": lambda v: ~_equals(value, v), "enum": lambda v: ~_any([_equals(value, x) for x in v]), "minimum": lambda v: _is(value, "number") & (number < v), "maximum": lambda v: _is(value, "number") & (number > v),
            "minItems": lambda v: _is(value, "array") & (length < v), "maxItems": lambda v: _is(value, "array") & (length > v), "pattern": lambda v: _is(value, "string") & ~text.rlike(v), "format": lambda v: _is(value, "string") & ~(text.rlike(_TIME) & text.try_cast("timestamp").isNotNull()),
        }
        return [(word, rule(schema[word])) for word, rule in rules.items() if word in schema]

    def check(value: Column, at: Column) -> Column:
        told = lambda bad, what: F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(at, F.lit(what)))).otherwise(_none())
        found = [told(bad, f": {word}") for word, bad in limits(value)]
        if known or "required" in schema or schema.get("additionalProperties") is False:
            held = F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
            here = _is(value, "object")
            found += [told(here & ~F.map_contains_key(held, name), f".{name}: required") for name in schema.get("required", ())]
            for name, inner in known.items():
                found.append(F.when(here & F.map_contains_key(held, name), _of_one(F.try_element_at(held, F.lit(name)), inner, F.concat(at, F.lit(f".{name}")))).otherwise(_none()))
            if schema.get("additionalProperties") is False:
                extra = F.filter(F.map_keys(held), lambda k: ~k.isin(*known)) if known else F.map_keys(held)
                found.append(F.transform(F.array_sort(extra), lambda k: F.concat(at, F.lit("."), k, F.lit(": additionalProperties"))))
        if item is not None:
            items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
            found.append(F.flatten(F.transform(items, lambda x, i: item(x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))))
        every = F.concat(*found) if found else _none()
        if not kinds:
            return every
        return F.when(_any([_is(value, k) for k in kinds]), every).otherwise(F.array(F.concat(at, F.lit(": type"))))

    return check


def _of_one(value: Column, check: Check, at: Column) -> Column:
    """A check of a value that is found once, however often the check looks at it."""
    return F.get(F.transform(F.array(value), lambda x: check(x, at)), F.lit(0))


def _any(hits: list[Column]) -> Column:
    found = F.lit(False)
    for hit in hits:
        found = found | hit
    return found


def schema_faults(text: Column, schema: dict) -> Column:
    """The faults of each JSON text; `$: json` where it is none (or names a key twice), null for null."""
    check = compiled(schema)
    # In brackets, so that text after the value is not overlooked.
    values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    found = F.get(F.transform(values, lambda x: check(x, F.lit("$"))), F.lit(0))
    return F.when(text.isNull(), None).when(F.coalesce(F.size(values) == 1, F.lit(False)), found).otherwise(F.array(F.lit("$: json")))
