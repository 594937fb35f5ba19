"""JSON Schema (draft 7) compiled to one expression over a parsed document.

A document is a VARIANT, so whatever it holds can be looked at: keys that no schema names, values of any type, at
any depth. What stands at a fixed path is looked up by it in plain expressions, so that its tests are conditions for which
Spark generates code and which share what they look up; higher-order functions, which Spark evaluates without
generated code, walk only arrays and free keys, and name the keys that are missing or too many. Nothing leaves the
JVM and no row is shuffled. References are resolved when the schema is compiled. The expression is written as SQL
text and handed over whole: built call by call, a schema of some seventy nodes takes tens of thousands of calls
between Python and the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords without a check of their own.
_NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "format", "definitions", "$defs", "readOnly", "writeOnly"}
#: Keywords that say nothing about what a value holds.
_FLAT = {"type", "enum", "const", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"}
_KNOWN = _FLAT | {
    "required", "properties", "patternProperties", "additionalProperties", "minProperties", "maxProperties", "propertyNames",
    "items", "additionalItems", "minItems", "maxItems", "uniqueItems", "contains", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "$ref",
}
_NONE = "cast(array() AS array<struct<path:string,rule:string>>)"


def compile_schema(schema: dict | bool) -> Callable[[str], Column]:
    """A function of a VARIANT (a column's name or SQL) that yields its broken rules: array of struct(path, rule); empty for a valid document.

    Paths are those of JSON Pointers without the first slash (``evidences/0/page_start``), the root's is empty. Rules
    are the keywords that fail. Unknown keywords and references that lead into themselves raise ValueError.
    """
    return lambda value: F.expr(_joined(_Compiler(schema).node(_Value(value), "''", schema, ())))


def violations(docs: DataFrame, schema: dict, key: str, json: str = "json") -> DataFrame:
    """The key, path and rule of all that documents (text in ``json``) break; a text that is no JSON breaks ``malformed``, a null one ``missing``."""
    parsed = docs.select(key, F.col(json).isNull().alias("_absent"), F.try_parse_json(json).alias("_document"))
    one = lambda test, rule: F.when(test, F.array(F.struct(F.lit("").alias("path"), F.lit(rule).alias("rule")))).otherwise(F.expr(_NONE))
    # an absent document breaks none of the schema's rules; beside each other, not one in the other, the tests share what they fetch
    broken = F.concat(one(F.col("_absent"), "missing"), one(~F.col("_absent") & F.col("_document").isNull(), "malformed"), compile_schema(schema)("_document"))
    # a column of its own, as a generator's argument gets no generated code; outer, as Spark would else test the sizes by working all out a second time
    rows = parsed.select(key, broken.alias("_broken")).select(key, F.explode_outer("_broken").alias("_b"))
    return rows.where(F.col("_b").isNotNull()).select(key, "_b.path", "_b.rule")


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _texts(values) -> str:
    return f"cast(array({', '.join(map(_text, values))}) AS array<string>)"


def _below(path: str, step: str) -> str:
    return f"concat({path}, if({path} = '', '', '/'), {step})" if path != "''" else step


def _joined(parts: list[str]) -> str:
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0] if parts else _NONE


def _if(test: str, found: str) -> str:
    return f"CASE WHEN {test} THEN {found} ELSE {_NONE} END"


def _broken(path: str, rule: str, test: str) -> str:
    return _if(test, f"array(named_struct('path', {path}, 'rule', {_text(rule)}))")


class _Value(NamedTuple):
    """A VARIANT: SQL of one, and the path of keys and positions from there. Maps are costlier: all that an object holds is copied for one."""

    base: str
    steps: str = ""

    @property
    def sql(self) -> str:
        return f"try_variant_get({self.base}, '${self.steps}', 'variant')" if self.steps else self.base

    @property
    def object(self) -> str:
        return f"try_cast({self.sql} AS map<string,variant>)"

    @property
    def keys(self) -> str:
        """Null for all that is no object."""
        return f"map_keys({self.object})"

    @property
    def list(self) -> str:
        return f"try_cast({self.sql} AS array<variant>)"

    def at(self, key: str) -> _Value:
        if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", key):  # paths don't take every key
            return _Value(self.base, f"{self.steps}.{key}")
        return _Value(f"try_element_at({self.object}, {_text(key)})")


class _Compiler:
    def __init__(self, root: dict | bool):
        self.root, self.names = root, count()

    def name(self) -> str:
        """A variable's name that no other has."""
        return f"x{next(self.names)}"

    def resolved(self, schema: dict | bool, within: tuple[str, ...]) -> tuple[dict | bool, tuple[str, ...]]:
        while isinstance(schema, dict) and "$ref" in schema:
            reference = schema["$ref"]
            if reference in within:
                raise ValueError(f"the schema leads into itself: {reference}")
            if not reference.startswith("#"):
                raise ValueError(f"not a reference within the schema: {reference}")
            schema, within = self.root, (*within, reference)
            for step in reference[1:].split("/")[1:]:
                schema = schema[step.replace("~1", "/").replace("~0", "~")]
        return schema, within

    def node(self, value: _Value, path: str, schema: dict | bool, within: tuple[str, ...]) -> list[str]:
        """Rules that ``value`` breaks, as SQL of arrays; one that is absent, SQL null, breaks none."""
        schema, within = self.resolved(schema, within)
        if schema is True or schema == {}:
            return []
        if schema is False:
            return [_broken(path, "false", f"{value.sql} IS NOT NULL")]
        if unknown := set(schema) - _KNOWN - _NOTES:
            raise ValueError(f"unknown keywords: {sorted(unknown)}")
        own = [*self.flat(value, schema), *self.whole(value, schema, within)]
        return [*(_broken(path, rule, f"{value.sql} IS NOT NULL AND {test}") for rule, test in own), *self.parts(value, path, schema, within)]

    def breaks(self, value: _Value, schema: dict | bool, within: tuple[str, ...]) -> str:
        return f"size({_joined(self.node(value, chr(39) * 2, schema, within))}) > 0"

    def guarded(self, values: str, x: str, value: _Value, schema: dict | bool, within: tuple[str, ...], found: str) -> str:
        """``found`` where one of ``values`` (bound to ``x``, its VARIANT is ``value``) may break a rule: of schemas of single values this test is much less work."""
        schema, _ = self.resolved(schema, within)
        if not isinstance(schema, dict) or not set(schema) <= _FLAT | _NOTES:
            return found
        return _if(f"exists({values}, {x} -> {value.sql} IS NOT NULL AND ({' OR '.join(f'({test})' for _, test in self.flat(value, schema)) or 'false'}))", found)

    def flat(self, value: _Value, schema: dict) -> Iterator[tuple[str, str]]:
        """(keyword, condition under which it is broken) of what a value itself is."""
        v = value.sql
        kind = f"schema_of_variant({v})"  # costly for objects and arrays, whose types are told by casts
        number, text = f"try_cast({v} AS double)", f"try_cast({v} AS string)"
        is_text = f"{kind} = 'STRING'"
        is_number = f"({kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {kind} LIKE 'DECIMAL%')"
        of_kind = {
            "string": is_text, "boolean": f"{kind} = 'BOOLEAN'", "null": f"{kind} = 'VOID'", "number": is_number, "object": f"{value.keys} IS NOT NULL", "array": f"{value.list} IS NOT NULL",
            "integer": f"({kind} = 'BIGINT' OR ({is_number} AND {number} = floor({number})))",  # however it is written
        }
        if "type" in schema:
            wanted = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            yield "type", f"NOT ({' OR '.join(of_kind[w] for w in wanted)})"
        for word in ("enum", "const"):
            if word in schema:
                allowed = schema[word] if word == "enum" else [schema[word]]
                if any(isinstance(a, (list, dict)) for a in allowed):
                    raise ValueError("enumerations of objects or arrays are not compiled")
                tests = ["false"]
                if strings := [_text(a) for a in allowed if isinstance(a, str)]:
                    tests.append(f"({is_text} AND {text} IN ({', '.join(strings)}))")
                if numbers := [f"{float(a)!r}D" for a in allowed if isinstance(a, (int, float)) and not isinstance(a, bool)]:
                    tests.append(f"({is_number} AND {number} IN ({', '.join(numbers)}))")
                tests += [f"({of_kind['boolean']} AND try_cast({v} AS boolean) = {str(a).lower()})" for a in allowed if isinstance(a, bool)]
                tests += [of_kind["null"]] if None in allowed else []
                yield word, f"NOT ({' OR '.join(tests)})"
        texts = {"minLength": "length({}) < {}", "maxLength": "length({}) > {}"}
        numbers = {"minimum": "{} < {}D", "maximum": "{} > {}D", "exclusiveMinimum": "{} <= {}D", "exclusiveMaximum": "{} >= {}D", "multipleOf": "{0} / {1}D <> floor({0} / {1}D)"}
        for word, form in texts.items():
            if word in schema:
                yield word, f"{is_text} AND {form.format(text, int(schema[word]))}"
        if "pattern" in schema:
            yield "pattern", f"{is_text} AND NOT regexp_like({text}, {_text(schema['pattern'])})"
        for word, form in numbers.items():
            if word in schema:
                yield word, f"{is_number} AND {form.format(number, repr(float(schema[word])))}"

    def whole(self, value: _Value, schema: dict, within: tuple[str, ...]) -> Iterator[tuple[str, str]]:
        """As ``flat``, of what a value holds altogether."""
        sizes = {"minItems": (value.list, "<"), "maxItems": (value.list, ">"), "minProperties": (value.keys, "<"), "maxProperties": (value.keys, ">")}
        for word, (part, sign) in sizes.items():
            if word in schema:
                yield word, f"{part} IS NOT NULL AND size({part}) {sign} {int(schema[word])}"
        x = self.name()
        if schema.get("uniqueItems"):
            yield "uniqueItems", f"{value.list} IS NOT NULL AND size(array_distinct(transform({value.list}, {x} -> to_json({x})))) < size({value.list})"
        if "contains" in schema:
            yield "contains", f"{value.list} IS NOT NULL AND NOT exists({value.list}, {x} -> NOT ({self.breaks(_Value(x), schema['contains'], within)}))"
        if "anyOf" in schema:
            yield "anyOf", " AND ".join(self.breaks(value, s, within) for s in schema["anyOf"])
        if "oneOf" in schema:
            yield "oneOf", " + ".join(f"int(NOT ({self.breaks(value, s, within)}))" for s in schema["oneOf"]) + " <> 1"
        if "not" in schema:
            yield "not", f"NOT ({self.breaks(value, schema['not'], within)})"

    def parts(self, value: _Value, path: str, schema: dict, within: tuple[str, ...]) -> list[str]:
        """Broken rules below a value, and those that name one of its keys."""
        named, patterns, required = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("required", [])
        out = []

        def keyed(found: str, rule: str) -> str:
            k = self.name()
            return f"coalesce(transform({found}, {k} -> named_struct('path', {_below(path, k)}, 'rule', {_text(rule)})), {_NONE})"

        def each(entries: str, below: dict | bool) -> str:
            e, one = self.name(), self.name()
            return self.guarded(entries, one, _Value(f"{one}.value"), below, within, f"coalesce(flatten(transform({entries}, {e} -> {_joined(self.node(_Value(f'{e}.value'), _below(path, f'{e}.key'), below, within))})), {_NONE})")

        if required:
            absent = " OR ".join(f"{value.at(n).sql} IS NULL" for n in required)
            out.append(_if(f"{value.keys} IS NOT NULL AND ({absent})", keyed(f"array_except({_texts(required)}, {value.keys})", "required")))
        for n, below in named.items():
            out += self.node(value.at(n), _below(path, _text(n)), below, within)
        k = self.name()
        out += [each(f"filter(map_entries({value.object}), {k} -> regexp_like({k}.key, {_text(p)}))", below) for p, below in patterns.items()]
        other = schema.get("additionalProperties", True)
        if other is not True and other != {}:
            free = lambda key: " AND ".join([f"NOT array_contains({_texts(named)}, {key})", *(f"NOT regexp_like({key}, {_text(p)})" for p in patterns)])
            entries = f"filter(map_entries({value.object}), {k} -> {free(f'{k}.key')})" if named or patterns else f"map_entries({value.object})"
            more = f"array_except({value.keys}, {_texts(named)})"
            if other is not False:
                out.append(each(entries, other))
            else:
                out.append(_if(f"size({more}) > 0", keyed(f"filter({value.keys}, {k} -> {free(k)})" if patterns else more, "additionalProperties")))
        if "propertyNames" in schema:
            as_value = _Value(f"try_cast(parse_json(to_json(array({k}))) AS array<variant>)[0]")
            out.append(keyed(f"filter({value.keys}, {k} -> {self.breaks(as_value, schema['propertyNames'], within)})", "propertyNames"))
        items = schema.get("items", True)
        first = len(items) if isinstance(items, list) else 0
        if first:
            for i, below in enumerate(items):
                out += self.node(value._replace(steps=f"{value.steps}[{i}]"), _below(path, f"'{i}'"), below, within)
        rest = schema.get("additionalItems", True) if isinstance(items, list) else items
        if rest is not True and rest != {}:
            x, i, one = self.name(), self.name(), self.name()
            walked = _joined(self.node(_Value(x), _below(path, f"cast({i} AS string)"), rest, within))
            walked = _if(f"{i} >= {first}", walked) if first else walked
            out.append(self.guarded(value.list, one, _Value(one), rest, within, f"coalesce(flatten(transform({value.list}, ({x}, {i}) -> {walked})), {_NONE})"))
        for s in schema.get("allOf", []):
            out += self.node(value, path, s, within)
        if "if" in schema:
            then, otherwise = (_joined(self.node(value, path, schema.get(w, True), within)) for w in ("then", "else"))
            out.append(f"CASE WHEN {self.breaks(value, schema['if'], within)} THEN {otherwise} ELSE {then} END")
        return out
