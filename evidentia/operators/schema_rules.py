"""JSON Schema checks compiled into Columns over VARIANT values.

A schema becomes one array expression of (pointer, message); a value of the wrong type gets no further checks.
The keywords are const, type, enum, pattern, format (date, date-time, uri), minLength, minimum, maximum,
minItems, maxItems, items, required, properties and additionalProperties.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBLEMS = "array<struct<pointer:string,message:string>>"
# Shapes of the formats.
FORMATS = {"date": r"^\d{4}-\d{2}-\d{2}$", "date-time": r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$", "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"}
TYPES = {"string": "^STRING", "boolean": "^BOOLEAN", "null": "^VOID", "array": "^ARRAY", "object": "^OBJECT", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"}


def _none() -> Column:
    return F.array().cast(PROBLEMS)


def _problem(bad: Column, pointer: Column, message: str) -> Column:
    one = F.array(F.struct(pointer.alias("pointer"), F.lit(message).alias("message"))).cast(PROBLEMS)
    return F.when(F.coalesce(bad, F.lit(False)), one).otherwise(_none())


def _member(value: Column, members: Column, name: str) -> Column:
    """A member of an object, null where it is missing (a JSON null is there); names that a path can't spell are looked up."""
    return F.try_element_at(members, F.lit(name)) if set(name) & set("'?\\") or not name else F.try_variant_get(value, f"$['{name}']", "variant")


def problems(value: Column, schema: dict, pointer: Column | None = None) -> Column:
    """What is wrong with a VARIANT value by ``schema``. The value and its kind are found once and given a name, however many checks read them; of a missing one nothing is wrong."""
    pointer = F.lit("") if pointer is None else pointer
    named = F.array(F.struct(value.alias("value"), F.schema_of_variant(value).alias("kind")))
    return F.get(F.transform(named, lambda x: F.when(x["value"].isNull(), _none()).otherwise(_problems(x["value"], x["kind"], schema, pointer))), F.lit(0))


def _problems(value: Column, kind: Column, schema: dict, pointer: Column) -> Column:
    text = lambda: F.try_variant_get(value, "$", "string")
    number = lambda: F.try_variant_get(value, "$", "double")
    is_string, is_number, is_array, is_object = (kind.rlike(TYPES[t]) for t in ("string", "number", "array", "object"))
    found = []
    if "const" in schema:
        found.append(_problem(F.to_json(value) != json.dumps(schema["const"]), pointer, f"must be {schema['const']!r}"))
    if "enum" in schema:
        found.append(_problem(~F.to_json(value).isin([json.dumps(x, ensure_ascii=False) for x in schema["enum"]]), pointer, "not one of " + ", ".join(map(str, schema["enum"]))))
    if "pattern" in schema:
        found.append(_problem(is_string & ~text().rlike(schema["pattern"]), pointer, f"does not match {schema['pattern']}"))
    if schema.get("format") in FORMATS:
        found.append(_problem(is_string & ~text().rlike(FORMATS[schema["format"]]), pointer, f"not a valid {schema['format']}"))
    if "minLength" in schema:
        found.append(_problem(is_string & (F.length(text()) < schema["minLength"]), pointer, f"shorter than {schema['minLength']}"))
    for word, bad in (("minimum", lambda x: number() < x), ("maximum", lambda x: number() > x)):
        if word in schema:
            found.append(_problem(is_number & bad(schema[word]), pointer, f"beyond the {word} {schema[word]}"))
    items = F.try_variant_get(value, "$", "array<variant>")
    for word, bad in (("minItems", lambda x: F.size(items) < x), ("maxItems", lambda x: F.size(items) > x)):
        if word in schema:
            found.append(_problem(is_array & bad(schema[word]), pointer, f"beyond {word} {schema[word]}"))
    if "items" in schema:
        each = F.flatten(F.transform(items, lambda x, i: problems(x, schema["items"], F.concat(pointer, F.lit("/"), i.cast("string")))))
        found.append(F.coalesce(F.when(is_array, each), _none()))
    members = F.when(is_object, F.try_variant_get(value, "$", "map<string,variant>"))
    fields = F.map_keys(members)
    member = lambda name: _member(value, members, name)
    for name in schema.get("required", []):
        found.append(_problem(is_object & member(name).isNull(), pointer, f"missing '{name}'"))
    props = schema.get("properties", {})
    for name, inner in props.items():
        found.append(problems(member(name), inner, F.concat(pointer, F.lit(f"/{name}"))))  # only objects have members
    extra = schema.get("additionalProperties", True)
    others = F.array_except(fields, F.array(*map(F.lit, props)) if props else F.array().cast("array<string>"))
    if extra is False:
        found.append(F.coalesce(F.transform(others, lambda k: F.struct(F.concat(pointer, F.lit("/"), k).alias("pointer"), F.lit("unexpected property").alias("message"))).cast(PROBLEMS), _none()))
    elif isinstance(extra, dict):
        members = F.map_entries(F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, v: F.array_contains(others, k)))
        found.append(F.coalesce(F.when(is_object, F.flatten(F.transform(members, lambda e: problems(e["value"], extra, F.concat(pointer, F.lit("/"), e["key"]))))), _none()))
    checked = F.concat(*found) if found else _none()
    if "type" in schema:
        wanted = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        ok = F.lit(False)
        for t in wanted:
            ok = ok | kind.rlike(TYPES[t])
        return F.when(~ok, _problem(F.lit(True), pointer, "expected " + " or ".join(wanted))).otherwise(checked)
    return checked


def validate(records: DataFrame, schema: dict, json_col: str = "json", subject_col: str = "subject") -> DataFrame:
    """(subject, pointer, message) of JSON records; what can't be parsed is a problem at the root."""
    parsed = records.select(F.col(subject_col).alias("subject"), F.try_parse_json(json_col).alias("v"))
    found = F.when(F.col("v").isNull(), F.array(F.struct(F.lit("").alias("pointer"), F.lit("not JSON").alias("message"))).cast(PROBLEMS)).otherwise(problems(F.col("v"), schema))
    return parsed.select("subject", F.explode(found).alias("p")).select("subject", "p.pointer", "p.message")
