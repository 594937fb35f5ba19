"""JSON Schema keywords one by one, the shapes of the dataset's documents, and the null walk."""

import json

import pytest
from pyspark.sql import functions as F

from letterloom.functions import schemas
from letterloom.operators import checks
from letterloom.operators.json_schema import compile_schema, violations

CASES = [
    ({"type": "integer"}, 1, []), ({"type": "integer"}, 1.0, []), ({"type": "integer"}, 1.5, [("", "type")]), ({"type": "integer"}, "1", [("", "type")]),
    ({"type": "number"}, 1e30, []), ({"type": ["string", "null"]}, None, []), ({"type": ["string", "null"]}, True, [("", "type")]),
    ({"type": "object"}, [], [("", "type")]), ({"type": "array"}, [], []), ({"type": "boolean"}, "true", [("", "type")]),
    ({"enum": ["a", 2, None, True]}, 2.0, []), ({"enum": ["a", 2, None, True]}, False, [("", "enum")]), ({"enum": ["a"]}, None, [("", "enum")]), ({"const": "it's"}, "it's", []),
    ({"minLength": 2}, "é", [("", "minLength")]), ({"maxLength": 1}, "ab", [("", "maxLength")]), ({"minLength": 2}, 5, []), ({"pattern": r"^a\d'$"}, "a1'", []), ({"pattern": "b"}, "ac", [("", "pattern")]),
    ({"minimum": 1}, 0.5, [("", "minimum")]), ({"exclusiveMinimum": 1}, 1, [("", "exclusiveMinimum")]), ({"maximum": 1}, 1, []), ({"exclusiveMaximum": 1}, 1, [("", "exclusiveMaximum")]), ({"multipleOf": 3}, 7, [("", "multipleOf")]),
    ({"required": ["a", "b"]}, {"a": None}, [("b", "required")]), ({"required": ["a"]}, 3, []),
    ({"properties": {"a": {"properties": {"b": {"items": {"type": "string"}}}}}}, {"a": {"b": ["x", 1, None]}}, [("a/b/1", "type"), ("a/b/2", "type")]),
    ({"properties": {"a": {}}, "patternProperties": {"^p": {"type": "string"}}, "additionalProperties": False}, {"a": 1, "p": 2, "q": 3}, [("p", "type"), ("q", "additionalProperties")]),
    ({"additionalProperties": {"maximum": 1}}, {"k": 2, "l": 0}, [("k", "maximum")]), ({"minProperties": 1}, {}, [("", "minProperties")]), ({"maxProperties": 0}, {"a": 1}, [("", "maxProperties")]),
    ({"propertyNames": {"pattern": "^a"}}, {"ab": 1, "ba": 1}, [("ba", "propertyNames")]),
    ({"items": [{"type": "string"}], "additionalItems": {"type": "integer"}}, [1, 2, "x"], [("0", "type"), ("2", "type")]), ({"items": False}, [1], [("0", "false")]), ({"items": {}}, [None], []),
    ({"minItems": 1}, [], [("", "minItems")]), ({"maxItems": 1}, [1, 2], [("", "maxItems")]), ({"uniqueItems": True}, [{"a": 1}, {"a": 1}], [("", "uniqueItems")]), ({"uniqueItems": True}, [1, "1"], []),
    ({"contains": {"const": 1}}, [2, 1], []), ({"contains": {"const": 1}}, [2], [("", "contains")]),
    ({"allOf": [{"type": "string"}, {"minLength": 2}]}, "a", [("", "minLength")]), ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, 2, [("", "anyOf")]), ({"oneOf": [{"minimum": 1}, {"minimum": 2}]}, 3, [("", "oneOf")]),
    ({"not": {"type": "null"}}, None, [("", "not")]), ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 5}}, "a", [("", "minLength")]), ({"if": {"type": "string"}, "else": {"minimum": 5}}, 4, [("", "minimum")]),
    ({"definitions": {"p": {"minimum": 1}, "a/b": {"$ref": "#/definitions/p"}}, "items": {"$ref": "#/definitions/a~1b"}}, [0], [("0", "minimum")]), (True, 1, []), (False, 1, [("", "false")]),
]


def test_keywords(spark):
    docs = [spark.createDataFrame([(i, json.dumps(d))], "id int, json string").select("id", F.explode(compile_schema(s)("parse_json(json)")).alias("b")) for i, (s, d, _) in enumerate(CASES)]
    frame = docs[0]
    for d in docs[1:]:
        frame = frame.unionByName(d)
    found = {}
    for r in frame.collect():
        found.setdefault(r["id"], []).append(tuple(r["b"]))
    assert {i: sorted(found.get(i, [])) for i in range(len(CASES))} == {i: sorted(want) for i, (_, _, want) in enumerate(CASES)}


def test_whole_documents(spark):
    docs = [(1, '{"innovation_id":"i","manifest_version":"1","evidences":[{"evidence_id":"e","filename":"f","indicator_id":"IND-01"},{"evidence_id":"e","indicator_id":"IND-1"}]}'), (2, "{"), (3, None), (4, "[]")]
    got = violations(spark.createDataFrame(docs, "id int, json string"), schemas.MANIFEST, "id").collect()
    assert sorted(map(tuple, got)) == [(1, "evidences/1/filename", "required"), (1, "evidences/1/indicator_id", "pattern"), (2, "", "malformed"), (3, "", "missing"), (4, "", "type")]


def test_schemas_that_are_not_compiled():
    loop = {"definitions": {"a": {"items": {"$ref": "#/definitions/a"}}}, "$ref": "#/definitions/a"}
    for schema in (loop, {"$ref": "http://elsewhere"}, {"items": {"colour": 1}}, {"enum": [[1]]}):
        with pytest.raises(ValueError):
            compile_schema(schema)("v")


def test_null_walk(spark):
    kind = "a struct<b: array<struct<c: int, d: map<string, array<int>>>>, e: string>, f: array<array<int>>, g: map<int, string>, h: int"
    rows = [
        (({"b": [{"c": 1, "d": {"k": [1, None]}}, {"c": None, "d": None}], "e": None}), [[1], None, [None]], {7: None}, None),
        (({"b": [], "e": ""}), [], {}, 0), (None, None, None, 1),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(checks.null_paths(spark.createDataFrame(rows, kind).schema)).collect()]
    assert list(map(sorted, got)) == [sorted(["a.e", "a.b[0].d.k[1]", "a.b[1].c", "a.b[1].d", "f[1]", "f[2][0]", "g.7", "h"]), [], ["a", "f", "g"]]


def test_blanks_without_reason(spark):
    kind = "filename string, metadata struct<x: string, y: string, flag: boolean>, missing_reasons map<string, string>"
    rows = [("1", ("", "v", False), {}), ("2", ("", "", True), {"x": "scan", "y": "none"}), ("3", ("a", "", True), None), ("4", (None, "b", None), {})]
    got = {r["filename"]: (r["nulls"], r["unexplained"]) for r in checks.nulls_and_blanks(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"1": ([], ["x"]), "3": (["missing_reasons"], ["y"]), "4": (["metadata.x", "metadata.flag"], [])}


def test_generated_code_does_the_checks(spark):
    """A generator's argument is worked out node by node, without generated code; so a column holds it, and values at fixed paths need no lambda."""
    found = violations(spark.createDataFrame([(1, "{}")], "id int, json string"), schemas.RECORD, "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(_broken" in plan
    flat = {"type": "object", "properties": {"a": {"type": "object", "properties": {"b": {"type": "integer", "minimum": 1}}, "required": ["b"]}}}
    shallow = violations(spark.createDataFrame([(1, '{"a": {"b": 0}}'), (2, '{"a": {}}'), (3, '{"a": {"b": 1}}')], "id int, json string"), flat, "id")
    assert sorted(map(tuple, shallow.collect())) == [(1, "a/b", "minimum"), (2, "a/b", "required")]
