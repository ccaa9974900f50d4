"""User-defined extraction schemas: flattened rows, Spark types, JSON Schema, validation. All driver-side and small."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MAX_DEPTH, MAX_FIELDS = 4, 80
SPARK_TYPES = {
    "text": T.StringType(), "email": T.StringType(), "phone": T.StringType(), "number": T.DoubleType(),
    "currency": T.DoubleType(), "date": T.DateType(), "boolean": T.BooleanType(),
}
JSON_TYPES = {"number": "number", "currency": "number", "boolean": "boolean", "list": "array", "table": "array", "object": "object"}


@dataclass(frozen=True)
class Field:
    """A field of an extraction schema; lists of objects and objects have children."""

    key: str
    type: str = "text"
    label: str = ""
    description: str = ""
    required: bool = False
    children: tuple[Field, ...] = field(default_factory=tuple)


def to_struct(fields: tuple[Field, ...], depth: int = 0) -> T.StructType:
    """The Spark type of values extracted under the schema."""
    return T.StructType([T.StructField(f.key, _kind(f, depth), True) for f in fields])


def _kind(f: Field, depth: int) -> T.DataType:
    if f.type in SPARK_TYPES or depth >= MAX_DEPTH:
        return SPARK_TYPES.get(f.type, T.StringType())
    if f.type == "object":
        return to_struct(f.children, depth + 1) if f.children else T.MapType(T.StringType(), T.StringType())
    if f.children:
        return T.ArrayType(to_struct(f.children, depth + 1))
    return T.ArrayType(T.MapType(T.StringType(), T.StringType()) if f.type == "table" else T.StringType())


def to_json_schema(fields: tuple[Field, ...], query: str = "") -> dict:
    """A JSON Schema of the fields; a query hint goes to the end of every description."""

    def one(f: Field) -> dict:
        out: dict = {"type": JSON_TYPES.get(f.type, "string"), "description": " ".join(x for x in (f.description or f.label or f.key, query) if x)}
        if f.type == "object":
            out |= to_json_schema(f.children, query)
        elif f.type in ("list", "table"):
            out["items"] = to_json_schema(f.children, query) if f.children else {"type": "object" if f.type == "table" else "string"}
        return out

    return {"type": "object", "properties": {f.key: one(f) for f in fields}, "required": [f.key for f in fields if f.required]}


def nullable(schema: dict) -> dict:
    """The same JSON Schema with every value nullable, every key required and no others allowed."""
    out = dict(schema)
    if "properties" in out:
        out["properties"] = {k: nullable(v) for k, v in out["properties"].items()}
        out |= {"required": [*out["properties"]], "additionalProperties": False}
    if "items" in out:
        out["items"] = nullable(out["items"])
    if "type" in out:
        out["type"] = [out["type"], "null"]
    return out


def schema_errors(schema: dict) -> list[str]:
    """Why a JSON Schema can't be extracted with; none if it can."""
    if schema.get("type") != "object":
        return ["Schema type must be object"]
    properties = schema.get("properties")
    if not isinstance(properties, dict) or not properties:
        return ["Schema needs properties"]
    return [f"Required field is not a property: {k}" for k in schema.get("required", []) if k not in properties]


def flatten(spark: SparkSession, fields: tuple[Field, ...]) -> DataFrame:
    """(field_path, parent, depth, label, type, description, required): one row a field, children below dotted paths.

    A schema of more than MAX_FIELDS fields, children counted, is refused; children below MAX_DEPTH are left out.
    """
    rows: list[tuple] = []

    def walk(items: tuple[Field, ...], parent: str, depth: int) -> None:
        for f in items if depth <= MAX_DEPTH else ():
            if len(rows) >= MAX_FIELDS:
                raise ValueError(f"a schema has at most {MAX_FIELDS} fields, at all depths together")
            path = f"{parent}.{f.key}" if parent else f.key
            rows.append((path, parent or None, depth, f.label or f.key.replace("_", " "), f.type, f.description or None, f.required))
            walk(f.children, path, depth + 1)

    walk(fields, "", 0)
    return spark.createDataFrame(rows, "field_path string, parent string, depth int, label string, type string, description string, required boolean")
