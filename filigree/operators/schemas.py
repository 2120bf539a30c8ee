"""A JSON schema compiled once into Columns that name every violation in a text of JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each type's beginning in the name that Spark gives the type of a variant.
KINDS = {
    "object": r"^OBJECT<", "array": r"^ARRAY<", "string": r"^STRING$", "boolean": r"^BOOLEAN$", "null": r"^VOID$",
    "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$", "number": r"^(BIGINT|DECIMAL\(.*|DOUBLE|FLOAT)$",
}
#: Words that are compiled; others that would restrict a value are an error, so that no rule is passed over.
RULES = {"const", "enum", "oneOf", "type", "minLength", "pattern", "format", "minimum", "minItems", "uniqueItems", "items", "properties", "required", "additionalProperties"}
NOTES = {"$schema", "$id", "title", "description", "$comment", "examples", "default"}


def _none() -> Column:
    return F.array().cast("array<string>")


def _when(broken: Column, path: Column, rule: str) -> Column:
    """The violation in an array, or an empty one."""
    return F.when(F.coalesce(broken, F.lit(False)), F.array(F.concat(path, F.lit(f":{rule}")))).otherwise(_none())


def _with(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: a lambda's variable, which no optimizer rule spreads over its uses."""
    return F.flatten(F.transform(F.array(x), then))


def _is(named: Column, kind: str) -> Column:
    return F.coalesce(named.rlike(KINDS[kind]), F.lit(False))


def _as(value: Column, to: str) -> Column:
    return F.try_variant_get(value, "$", to)


def _equals(value: Column, named: Column, other: object) -> Column:
    """Whether a value is the given text, number, truth value or null."""
    if other is None:
        return _is(named, "null")
    if isinstance(other, bool):
        return _is(named, "boolean") & (_as(value, "boolean") == other)
    if isinstance(other, (int, float)):
        return _is(named, "number") & (_as(value, "double") == float(other))
    if isinstance(other, str):
        return _is(named, "string") & (_as(value, "string") == other)
    raise ValueError("const and enum take texts, numbers, truth values and null")


def _string(text: Column, schema: dict, path: Column) -> list[Column]:
    out = []
    if "minLength" in schema:
        out.append(_when(F.length(text) < schema["minLength"], path, "minLength"))
    if "pattern" in schema:
        out.append(_when(~text.rlike(rf"\A(?:{schema['pattern']})\z"), path, "pattern"))
    if "format" in schema:
        day, time = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[Tt ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?([Zz]|[+-][0-9]{2}:?[0-9]{2})?"
        right = {"date": lambda: text.rlike(day + r"\z") & text.try_cast("date").isNotNull(), "date-time": lambda: text.rlike(day + time + r"\z") & text.try_cast("timestamp").isNotNull()}
        if schema["format"] not in right:
            raise ValueError(f"format {schema['format']} is not known")
        out.append(_when(~right[schema["format"]](), path, schema["format"]))
    return out


def _object(fields: Column, schema: dict, path: Column) -> list[Column]:
    known = schema.get("properties", {})
    held = F.map_keys(fields)
    inside = lambda key: F.concat(path, F.lit(f".{key}"))
    out = [_when(~F.array_contains(held, key), inside(key), "required") for key in schema.get("required", [])]
    if schema.get("additionalProperties") is False:
        strange = F.array_sort(F.array_except(held, F.array(*[F.lit(k) for k in known]).cast("array<string>")))
        out.append(F.transform(strange, lambda k: F.concat(path, F.lit("."), k, F.lit(":unknown"))))
    for key, child in known.items():
        out.append(F.when(F.array_contains(held, key), _check(F.try_element_at(fields, F.lit(key)), child, inside(key))).otherwise(_none()))
    return out


def _array(items: Column, schema: dict, path: Column) -> list[Column]:
    out = []
    if "minItems" in schema:
        out.append(_when(F.size(items) < schema["minItems"], path, "minItems"))
    if schema.get("uniqueItems"):
        # a variant keeps the keys of an object in order, so equal items have equal texts
        out.append(_when(F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < F.size(items), path, "uniqueItems"))
    if "items" in schema:
        out.append(F.flatten(F.transform(items, lambda x, i: _check(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    return out


def _check(value: Column, schema: dict, path: Column) -> Column:
    """All violations of one value, which is computed once and its type named once."""
    both = F.struct(value.alias("v"), F.schema_of_variant(value).alias("t"))
    return _with(both, lambda b: _checked(b["v"], b["t"], schema, path))


def _checked(value: Column, named: Column, schema: dict, path: Column) -> Column:
    """Const, enum, oneOf and type end the search, the rules of its type add up."""
    if unknown := sorted(set(schema) - RULES - NOTES):
        raise ValueError(f"the schema uses {', '.join(unknown)}")
    steps: list[tuple[Column, Callable[[], Column]]] = []
    if "const" in schema:
        steps.append((~_equals(value, named, schema["const"]), lambda: _when(F.lit(True), path, "const")))
    if "enum" in schema:
        steps.append((~reduce(or_, [_equals(value, named, e) for e in schema["enum"]], F.lit(False)), lambda: _when(F.lit(True), path, "enum")))
    if "oneOf" in schema:
        branches = [_check(value, b, path) for b in schema["oneOf"]]
        fits = reduce(or_, [F.size(b) == 0 for b in branches], F.lit(False))
        # one branch without violations settles the value
        steps.append((fits, _none))
        steps.append((F.lit(True), lambda: F.concat(_when(F.lit(True), path, "oneOf"), *branches)))
    else:
        if "type" in schema:
            kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            steps.append((reduce(and_, [~_is(named, k) for k in kinds]), lambda: _when(F.lit(True), path, "type")))
        by_kind = []
        for kind, to, words, rules in (
            ("string", "string", {"minLength", "pattern", "format"}, _string),
            ("array", "array<variant>", {"minItems", "uniqueItems", "items"}, _array),
            ("object", "map<string,variant>", {"required", "additionalProperties", "properties"}, _object),
        ):
            if words & set(schema):
                held = _with(_as(value, to), lambda x: F.concat(_none(), *rules(x, schema, path)))  # called at once
                by_kind.append(F.when(_is(named, kind), held).otherwise(_none()))
        if "minimum" in schema:
            by_kind.append(_when(_is(named, "number") & (_as(value, "double") < float(schema["minimum"])), path, "minimum"))
        steps.append((F.lit(True), lambda: F.concat(_none(), *by_kind)))
    out = None
    for broken, found in steps:
        out = F.when(broken, found()) if out is None else out.when(broken, found())
    return out


def schema_violations(records: DataFrame, text: str, schema: dict | str) -> DataFrame:
    """One row per violation: the records' columns, ``path`` (from ``$``) and ``rule``.

    ``schema`` is a JSON schema with const, enum, oneOf (the first fitting branch settles a value), type, minLength,
    pattern (of the whole text), format date and date-time, minimum, minItems, uniqueItems, items, properties,
    required and additionalProperties false; any other restricting word raises ValueError. A truth value is no
    number; 3.0 is an integer, a number with an exponent is none. A text that is null or no JSON has the one violation ``json``. The schema is compiled
    into one expression, so a table is checked in one pass without a shuffle or a Python worker.
    """
    schema = json.loads(schema) if isinstance(schema, str) else schema
    found = _with(F.try_parse_json(F.col(text)), lambda v: F.when(v.isNull(), F.array(F.lit("$:json"))).otherwise(_check(v, schema, F.lit("$"))))
    each = records.select(*records.columns, F.explode(found).alias("_v"))
    # a rule has no colon, a path may
    return each.withColumns({"path": F.regexp_extract("_v", r"(?s)^(.*):[^:]*$", 1), "rule": F.regexp_extract("_v", r"([^:]*)\z", 1)}).drop("_v")
