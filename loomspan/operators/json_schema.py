"""JSON Schema as expressions over VARIANT: every violation with the path it is at.

A schema is compiled once, on the driver, to one Column; documents are parsed once and checked inside Spark.  A path is
a JSON pointer; `required` and `additionalProperties` point at the property.  Keywords that the compiler does not
know are refused, and so are references that lead back to themselves.  Patterns are Java's, searched anywhere.
Text that is no JSON, or has an object with a repeated key, violates `json` at the empty path; null documents violate it too.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PASSED = {"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "$comment"}
_EMPTY = "array<struct<path: string, keyword: string>>"
#: date-time, as RFC 3339 has it.
DATE_TIME = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def _get(v: Column, name: str) -> Column:
    quote = "'" if "'" not in name else '"'
    if quote in name:
        return F.try_element_at(_object(v), F.lit(name))
    return F.try_variant_get(v, f"$[{quote}{name}{quote}]", "variant")


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string, variant>")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, or the name of a scalar's type; VOID is null."""
    return F.when(_object(v).isNotNull(), "OBJECT").when(_items(v).isNotNull(), "ARRAY").otherwise(F.schema_of_variant(v))


def _number(v: Column) -> Column:
    return F.when(_kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _is(v: Column, name: str) -> Column:
    if name == "number":
        return _number(v).isNotNull()
    if name == "integer":
        return F.coalesce(_number(v) == F.floor(_number(v)), F.lit(False))
    return _kind(v) == {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[name]


def _equals(v: Column, value: Any) -> Column:
    if value is None:
        return _kind(v) == "VOID"
    if isinstance(value, bool):
        return F.coalesce((_kind(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == value), F.lit(False))
    if isinstance(value, (int, float)):
        return F.coalesce(_number(v) == float(value), F.lit(False))
    if isinstance(value, str):
        return F.coalesce(_text(v) == value, F.lit(False))
    raise ValueError(f"only scalars can be compared, not {value!r}")


class _Compiler:
    def __init__(self, root: dict):
        self.root = root

    def _resolve(self, pointer: str, seen: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
        if not pointer.startswith("#") or pointer in seen:
            raise ValueError(f"reference {pointer} is outside the schema or leads back to itself")
        found = self.root
        for step in pointer[1:].split("/")[1:]:
            found = found[step.replace("~1", "/").replace("~0", "~")]
        return found, (*seen, pointer)

    def check(self, schema: dict | bool, v: Column, path: Column, seen: tuple[str, ...] = ()) -> Column:
        """The violations of a value that is there; v is null where it is not."""
        if isinstance(schema, bool):
            schema = {} if schema else {"not": {}}
        ones: list[Column] = []
        many: list[Column] = []

        def fail(condition: Column, keyword: str, at: Column = path) -> None:
            ones.append(F.when(condition, F.struct(at.alias("path"), F.lit(keyword).alias("keyword"))))

        def measured(value: Column, keyword: str, bad: Column) -> None:
            fail(value.isNotNull() & bad, keyword)

        for keyword, told in schema.items():
            match keyword:
                case "$ref":
                    target, way = self._resolve(told, seen)
                    many.append(self.check(target, v, path, way))
                case "type":
                    names = told if isinstance(told, list) else [told]
                    good = _is(v, names[0])
                    for name in names[1:]:
                        good = good | _is(v, name)
                    fail(~good, keyword)
                case "required":
                    for name in told:
                        fail(_object(v).isNotNull() & _get(v, name).isNull(), keyword, F.concat(path, F.lit("/" + name)))
                case "properties":
                    many += [self.check(sub, _get(v, name), F.concat(path, F.lit("/" + name)), seen) for name, sub in told.items()]
                case "additionalProperties":
                    many.append(self._additional(told, list(schema.get("properties", {})), v, path, seen))
                case "items":
                    inner = F.transform(_items(v), lambda x, i: self.check(told, x, F.concat(path, F.lit("/"), i.cast("string")), seen))
                    many.append(F.flatten(inner))
                case "enum":
                    good = F.lit(False)
                    for value in told:
                        good = good | _equals(v, value)
                    fail(~good, keyword)
                case "const":
                    fail(~_equals(v, told), keyword)
                case "pattern":
                    measured(_text(v), keyword, ~_text(v).rlike(told))
                case "format" if told == "date-time":
                    measured(_text(v), keyword, ~_text(v).rlike(DATE_TIME))
                case "minLength":
                    measured(_text(v), keyword, F.char_length(_text(v)) < told)
                case "maxLength":
                    measured(_text(v), keyword, F.char_length(_text(v)) > told)
                case "minimum":
                    measured(_number(v), keyword, _number(v) < told)
                case "maximum":
                    measured(_number(v), keyword, _number(v) > told)
                case "minItems":
                    measured(_items(v), keyword, F.size(_items(v)) < told)
                case "maxItems":
                    measured(_items(v), keyword, F.size(_items(v)) > told)
                case "minProperties":
                    measured(_object(v), keyword, F.size(F.map_keys(_object(v))) < told)
                case "uniqueItems" if isinstance(told, bool):
                    texts = F.transform(_items(v), lambda x: F.to_json(x))
                    measured(_items(v), keyword, F.lit(told) & (F.size(F.array_distinct(texts)) < F.size(texts)))
                case "not":
                    fail(F.size(self.check(told, v, path, seen)) == 0, keyword)
                case "allOf":
                    many += [self.check(sub, v, path, seen) for sub in told]
                case "anyOf":
                    good = F.lit(False)
                    for sub in told:
                        good = good | (F.size(self.check(sub, v, path, seen)) == 0)
                    fail(~good, keyword)
                case _ if keyword not in _PASSED:
                    raise ValueError(f"unknown keyword {keyword}: {told!r}")
        none = F.array().cast(_EMPTY)
        lists = [F.coalesce(x, none) for x in many] + ([F.array_compact(F.array(*ones)).cast(_EMPTY)] if ones else [])
        return F.when(v.isNotNull(), F.concat(none, *lists)).otherwise(none)

    def _additional(self, told: dict | bool, known: list[str], v: Column, path: Column, seen: tuple[str, ...]) -> Column:
        more = F.filter(F.map_entries(_object(v)), lambda e: ~e["key"].isin(known) if known else F.lit(True))
        if told is False:
            return F.transform(more, lambda e: F.struct(F.concat(path, F.lit("/"), e["key"]).alias("path"), F.lit("additionalProperties").alias("keyword"))).cast(_EMPTY)
        return F.flatten(F.transform(more, lambda e: self.check(told, e["value"], F.concat(path, F.lit("/"), e["key"]), seen)))


def compiled(schema: dict, document: Column) -> Column:
    """The violations of a VARIANT document, an array of (path, keyword)."""
    return _Compiler(schema).check(schema, document, F.lit(""))


def violations(documents: DataFrame, record_id: str, text: str, schema: dict) -> DataFrame:
    """(record_id, path, keyword) of every violation in documents that are JSON texts."""
    parsed = documents.select(F.col(record_id).alias("record_id"), F.try_parse_json(F.col(text)).alias("document"))
    broken = F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("keyword"))).cast(_EMPTY)
    found = F.when(F.col("document").isNull(), broken).otherwise(compiled(schema, F.col("document")))
    return parsed.select("record_id", F.explode(found).alias("v")).select("record_id", "v.path", "v.keyword")
