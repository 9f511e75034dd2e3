import copy
import json
import random
import re

import pytest

from loomspan.operators import json_schema

SCHEMA = {
    "$schema": "x", "type": "object", "additionalProperties": False, "required": ["v", "head", "rows"],
    "properties": {
        "v": {"const": "0.1.0"}, "n": {"type": ["integer", "null"], "minimum": -2, "maximum": 5}, "ratio": {"type": "number"}, "flag": {"enum": [True, None, 3, "x"]},
        "head": {"$ref": "#/$defs/head"}, "at": {"type": "string", "format": "date-time"}, "it's": {"type": "boolean"},
        "rows": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"anyOf": [{"type": "string"}, {"$ref": "#/$defs/row"}]}},
        "deep": {"type": "array", "items": {"type": "array", "items": {"$ref": "#/$defs/row"}}},
        "more": {"type": "object", "minProperties": 1, "additionalProperties": {"type": "integer"}}, "never": {"not": {"type": "string"}},
    },
    "$defs": {
        "head": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-zé]+$"}}, "additionalProperties": False},
        "row": {"allOf": [{"type": "object", "required": ["a"]}, {"properties": {"a": {"type": "integer", "minimum": 0}}}]},
    },
}
GOOD = {"v": "0.1.0", "n": 3, "ratio": 1.5, "flag": None, "head": {"id": "abé"}, "at": "2024-02-03T04:05:06.789Z", "it's": True, "rows": ["s", {"a": 1}],
        "deep": [[{"a": 0}], [], [{"a": 2}, {"a": 3}]], "more": {"k": 1}, "never": 1}


def is_type(x, name):
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    return {"object": isinstance(x, dict), "array": isinstance(x, list), "string": isinstance(x, str), "boolean": isinstance(x, bool), "null": x is None,
            "number": number, "integer": number and x == int(x)}[name]


def check(schema, x, path=""):
    """A plain validator, value by value."""
    if "$ref" in schema:
        yield from check(SCHEMA["$defs"][schema["$ref"].rsplit("/", 1)[1]], x, path)
    text, number = isinstance(x, str), is_type(x, "number")
    kinds = schema.get("type", [])
    rules = {
        "type": "type" in schema and not any(is_type(x, t) for t in ([kinds] if isinstance(kinds, str) else kinds)),
        "const": "const" in schema and not (x == schema["const"] and type(x) is type(schema["const"])),
        "enum": "enum" in schema and not any(x == y and isinstance(x, bool) == isinstance(y, bool) for y in schema["enum"]),
        "minimum": number and x < schema.get("minimum", x), "maximum": number and x > schema.get("maximum", x),
        "pattern": text and not re.search(schema.get("pattern", ""), x), "minLength": text and len(x) < schema.get("minLength", 0), "maxLength": text and len(x) > schema.get("maxLength", 99),
        "format": text and "format" in schema and not re.search(json_schema.DATE_TIME, x),
        "minItems": isinstance(x, list) and len(x) < schema.get("minItems", 0), "maxItems": isinstance(x, list) and len(x) > schema.get("maxItems", 99),
        "uniqueItems": isinstance(x, list) and schema.get("uniqueItems") and len({json.dumps(y, sort_keys=True) for y in x}) < len(x),
        "minProperties": isinstance(x, dict) and len(x) < schema.get("minProperties", 0),
        "not": "not" in schema and not list(check(schema["not"], x)), "anyOf": "anyOf" in schema and all(list(check(s, x)) for s in schema["anyOf"]),
    }
    yield from ((path, k) for k, bad in rules.items() if bad)
    for s in schema.get("allOf", []):
        yield from check(s, x, path)
    if isinstance(x, dict):
        yield from ((f"{path}/{k}", "required") for k in schema.get("required", []) if k not in x)
        for k, y in x.items():
            if k in schema.get("properties", {}):
                yield from check(schema["properties"][k], y, f"{path}/{k}")
            elif schema.get("additionalProperties") is False:
                yield f"{path}/{k}", "additionalProperties"
            elif "additionalProperties" in schema:
                yield from check(schema["additionalProperties"], y, f"{path}/{k}")
    if isinstance(x, list) and "items" in schema:
        for i, y in enumerate(x):
            yield from check(schema["items"], y, f"{path}/{i}")


def places(x, at=()):
    yield at
    for k, y in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        yield from places(y, (*at, k))


def mutated(rng):
    x = copy.deepcopy(GOOD)
    for _ in range(rng.randrange(1, 4)):
        *way, last = rng.choice([p for p in places(x) if p])
        y = x
        for k in way:
            y = y[k]
        if rng.random() < 0.25:
            del y[last]
        elif rng.random() < 0.2 and isinstance(y, dict):
            y[rng.choice(["zz", "a", "id"])] = rng.choice([1, "b"])
        else:
            y[last] = rng.choice([None, True, 0, -7, 2.0, 2.5, 9, "", "x", "abcde", "AB", "0.1.0", "2024-13-01T00:00:00Z", [], {}, [1, 1], ["s", "s"], {"a": -1}, [[{"a": "q"}]], {"id": "ab", "k": 1.5}])
    return x


def test_violations_equal_a_plain_validator(spark):
    rng = random.Random(11)
    docs = [GOOD] + [mutated(rng) for _ in range(400)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)], "id long, body string")
    found = sorted(map(tuple, json_schema.violations(df, "id", "body", SCHEMA).collect()))
    want = sorted((i, p, k) for i, x in enumerate(docs) for p, k in check(SCHEMA, x))
    assert found == want and not [r for r in found if r[0] == 0]
    assert {k for _, _, k in want} >= {"type", "required", "enum", "const", "minimum", "pattern", "additionalProperties", "anyOf", "minItems", "uniqueItems", "format"}


def test_text_that_is_no_json(spark):
    df = spark.createDataFrame([(1, "{"), (2, None), (3, '{"a": 1, "a": 2}'), (4, "3")], "id long, body string")
    assert sorted(map(tuple, json_schema.violations(df, "id", "body", {"type": "integer"}).collect())) == [(1, "", "json"), (2, "", "json"), (3, "", "json")]


@pytest.mark.parametrize("schema", [{"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}, {"dependentRequired": {}}, {"$ref": "other.json"}, {"enum": [[1]]}])
def test_schemas_that_are_refused(spark, schema):
    with pytest.raises(ValueError):
        json_schema.compiled(schema, json_schema.F.col("x"))
