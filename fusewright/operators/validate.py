"""Checks of canonical records and of projections."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusewright.functions.text import truthy
from fusewright.operators.project import Cell, compile_config

LOW = 0.5
#: Fixed values, as are the texts of errors below: (name of the check, column, text of the error or None where its absence is no error)
CHECKS = (
    ("candidate_id_present", "candidate_id", "Missing candidate_id"),
    ("name_present", "full_name", "Missing full_name"),
    ("email_present", "emails", "Missing emails"),
    ("phone_present", "phones", "Missing phones"),
    ("skills_present", "skills", "Missing skills"),
    ("experience_present", "experience", None),
    ("education_present", "education", None),
)


def _there(frame: DataFrame, column: str) -> Column:
    if column not in frame.columns:
        return F.lit(False)
    kind = frame.schema[column].dataType
    value = F.size(column) > 0 if isinstance(kind, T.ArrayType) else truthy(F.col(column)).isNotNull()
    return F.coalesce(value, F.lit(False))


def report(errors: Column, checks: Column) -> Column:
    status = F.when(F.size(errors) == 0, "PASS").otherwise("FAIL")
    return F.struct(status.alias("status"), checks.alias("checks"), F.size(errors).alias("error_count"), errors.alias("errors"))


def validate(frame: DataFrame) -> DataFrame:
    """``frame`` with a column ``validation``: status, checks, error_count, errors."""
    tests = {name: _there(frame, column) for name, column, _ in CHECKS}
    confidence = F.coalesce("overall_confidence", F.lit(0.0)) if "overall_confidence" in frame.columns else F.lit(0.0)
    found = [F.when(~tests[name], F.lit(text)) for name, _, text in CHECKS if text]
    found.append(F.when(confidence < LOW, F.concat(F.lit("Low profile confidence: "), confidence.cast("string"), F.lit(f" < {LOW}"))))
    errors = F.filter(F.array(*found), lambda e: e.isNotNull())
    return frame.withColumn("validation", report(errors, F.struct(*[c.alias(name) for name, c in tests.items()])))


def _type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "str"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, T.ArrayType):
        return "list"
    return "dict" if isinstance(kind, T.StructType | T.MapType) else "float"


def _type_error(cell: Cell) -> Column | None:
    """The error of a value of another type than the configured one; types are known when the configuration is compiled."""
    kind, path = cell.kind, cell.path
    number, objects = isinstance(kind, T.NumericType | T.BooleanType), isinstance(kind, T.StructType | T.MapType)
    item = kind.elementType if isinstance(kind, T.ArrayType) else None
    whole = lambda x: F.exists(cell.value, lambda v: v.isNull())
    match cell.wanted:
        case "string" if not isinstance(kind, T.StringType):
            text = f"Projected field '{path}' should be string, got {_type_name(kind)}."
        case "number" if not number:
            text = f"Projected field '{path}' should be number, got {_type_name(kind)}."
        case "object" if not objects:
            text = f"Projected field '{path}' should be object, got {_type_name(kind)}."
        case "string[]" | "object[]":
            right = isinstance(item, T.StringType) if cell.wanted == "string[]" else isinstance(item, T.StructType | T.MapType)
            text = f"Projected field '{path}' should be a list of {cell.wanted[:-2]}s."
            if right:
                return F.when(~cell.missing() & whole(cell), F.lit(text))
        case _:
            return None
    return F.when(~cell.missing(), F.lit(text))


def projected_errors(schema: T.StructType, config: dict) -> Column:
    """Errors of the projection of a record with that schema: required fields that are missing, and types."""
    declared = {f["path"] for f in config.get("fields", [])}
    found = []
    for cell in compile_config(schema, config):
        if cell.path not in declared:
            continue
        if cell.required:
            found.append(F.when(cell.missing(), F.lit(f"Projected field '{cell.path}' is required but missing or empty.")))
        if cell.value is not None and cell.wanted and (wrong := _type_error(cell)) is not None:
            found.append(wrong)
    return F.filter(F.array(*found), lambda e: e.isNotNull()) if found else F.array().cast("array<string>")


def validate_projected(frame: DataFrame, config: dict) -> DataFrame:
    """Canonical records with the errors of their projection in ``projection_errors``."""
    return frame.withColumn("projection_errors", projected_errors(frame.schema, config))


def accepted(frame: DataFrame, config: dict) -> DataFrame:
    """Validated records that may be written: all, or with on_missing "error" those without errors."""
    return frame.where(F.size("projection_errors") == 0) if config.get("on_missing") == "error" else frame
