"""Projection by a configuration that is only known at run time, compiled to a ``select``."""
from __future__ import annotations

import json

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusewright.functions.normalize import NORMALIZERS
from fusewright.functions.text import truthy
from fusewright.schema import PROVENANCE

INDEX = re.compile(r"(\w+)\[(\d+)\]")
LIST = re.compile(r"(\w+)\[\]\.(\w+)")


@dataclass
class Cell:
    """A field of the output: its expression and type, both null where the path leads nowhere."""

    path: str
    value: Column | None
    kind: T.DataType | None
    required: bool
    wanted: str | None

    def missing(self) -> Column:
        if self.value is None:
            return F.lit(True)
        return self.value.isNull() | (F.size(self.value) == 0 if isinstance(self.kind, T.ArrayType) else F.lit(False))


def resolve(schema: T.StructType, path: str | None) -> tuple[Column | None, T.DataType | None]:
    """The column of ``a``, ``a[2]``, ``a[].b`` or ``a.b.c``; nothing for any other path."""
    if not path:
        return None, None
    kinds = {f.name: f.dataType for f in schema.fields}
    if m := INDEX.fullmatch(path):
        kind = kinds.get(m[1])
        return (F.get(F.col(m[1]), int(m[2])), kind.elementType) if isinstance(kind, T.ArrayType) else (None, None)
    if m := LIST.fullmatch(path):
        kind = kinds.get(m[1])
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and m[2] in kind.elementType.names:
            items = F.transform(F.col(m[1]), lambda x: x[m[2]])
            return F.when(F.size(items) > 0, items), T.ArrayType(kind.elementType[m[2]].dataType)
        return None, None
    first, *rest = path.split(".")
    if first not in kinds:
        return None, None
    value, kind = F.col(first), kinds[first]
    for name in rest:
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None, None
        value, kind = value[name], kind[name].dataType
    return value, kind


def apply_normalizer(value: Column, kind: T.DataType, name: str) -> Column:
    f: Callable[[Column], Column] | None = NORMALIZERS.get(name)
    if f is None:
        return value
    if isinstance(kind, T.StringType):
        return f(value)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.transform(value, f)
    return value


def _shape(value: Column, fields: dict[str, Callable[[Column], Column]]) -> Column:
    return F.struct(*[f(value[k]).alias(k) for k, f in fields.items()])


_LIST = lambda c: F.coalesce(c, F.array().cast("array<string>"))
_TEXT = lambda c: F.coalesce(c, F.lit(""))
_YEAR = lambda c: F.nullif(c, F.lit(0))
_KEEP = truthy
SHAPES: dict[str, tuple[bool, dict[str, Callable[[Column], Column]]]] = {
    "location": (False, {"city": _KEEP, "region": _KEEP, "country": _KEEP}),
    "links": (False, {"linkedin": _KEEP, "github": _KEEP, "portfolio": _KEEP, "other": _LIST}),
    "skills": (True, {"name": _TEXT, "confidence": lambda c: F.coalesce(c, F.lit(0.0)), "sources": _LIST}),
    "experience": (True, {k: _KEEP for k in ("company", "title", "start", "end", "summary")}),
    "education": (True, {"institution": _KEEP, "degree": _KEEP, "field": _KEEP, "end_year": _YEAR}),
    "provenance": (True, {k: _TEXT for k in ("field", "source", "method")}),
}


def enforce_shape(path: str, value: Column, kind: T.DataType) -> Column:
    """The canonical shape of an output field of that name; values of another kind stay as they are."""
    if path not in SHAPES:
        return value
    many, fields = SHAPES[path]
    inner = kind.elementType if many and isinstance(kind, T.ArrayType) else kind if not many else None
    if not isinstance(inner, T.StructType):
        return value
    have = {k: f for k, f in fields.items() if k in inner.names}
    lacking = [F.lit(None).cast("string").alias(k) for k in fields if k not in inner.names]
    one = lambda x: F.struct(*[f(x[k]).alias(k) for k, f in have.items()], *lacking)
    return F.transform(value, one) if many else F.when(value.isNotNull(), one(value))


def compile_config(schema: T.StructType, config: dict) -> list[Cell]:
    """The output's cells in order; of fields with the same path the last counts, at the place of the first."""
    cells: dict[str, Cell] = {}
    for field in config.get("fields", []):
        path = field["path"]
        value, kind = resolve(schema, field.get("from", path))
        if value is not None:
            if "normalize" in field:
                value = apply_normalizer(value, kind, field["normalize"])
            value = enforce_shape(path, value, kind)
        cells[path] = Cell(path, value, kind, bool(field.get("required", False)), field.get("type"))
    names = {f.name for f in schema.fields}
    if config.get("include_confidence", False) and "overall_confidence" not in cells:
        value = F.coalesce("overall_confidence", F.lit(0.0)) if "overall_confidence" in names else F.lit(0.0)
        cells["overall_confidence"] = Cell("overall_confidence", value, T.DoubleType(), False, None)
    if config.get("include_provenance", False) and "provenance" not in cells:
        none = F.array().cast(PROVENANCE)
        value = enforce_shape("provenance", F.coalesce("provenance", none), schema["provenance"].dataType) if "provenance" in names else none
        cells["provenance"] = Cell("provenance", value, T.ArrayType(T.StructType()), False, None)
    return list(cells.values())


def missing_errors(cells: list[Cell]) -> Column:
    """Errors of a strict projection: required fields that are missing."""
    found = [F.when(c.missing(), F.lit(f"Required projected field '{c.path}' is missing.")) for c in cells if c.required]
    return F.filter(F.array(*found), lambda e: e.isNotNull()) if found else F.array().cast("array<string>")


def _out(cell: Cell, keep_empty: bool) -> Column:
    if cell.value is None:
        return F.lit(None).cast("string")
    return cell.value if keep_empty else F.when(~cell.missing(), cell.value)


def project(frame: DataFrame, config: dict, keep: tuple[str, ...] = ("candidate_key",), strict: bool = False) -> DataFrame:
    """The configured columns after those to keep. Missing values and empty lists are null.

    With on_missing "error", rows that lack a required field have it in ``_errors``; with ``strict`` the job fails on the first.
    """
    cells = compile_config(frame.schema, config)
    appended = {"overall_confidence", "provenance"} - {f["path"] for f in config.get("fields", [])}
    columns = [_out(c, c.path in appended).alias(c.path) for c in cells]
    kept = [F.col(k) for k in keep if k in frame.columns and k not in {c.path for c in cells}]
    if config.get("on_missing", "null") != "error":
        return frame.select(*kept, *columns)
    errors = missing_errors(cells)
    if strict:
        guard = F.when(F.size(errors) > 0, F.raise_error(F.get(errors, 0)).cast("array<string>")).otherwise(errors)
        return frame.select(*kept, *columns, guard.alias("_errors"))
    return frame.select(*kept, *columns, errors.alias("_errors"))


def project_json(frame: DataFrame, config: dict, keep: tuple[str, ...] = ("candidate_key",)) -> DataFrame:
    """(kept columns, projected JSON). With on_missing "null" missing keys are null; with "omit" or "error" they are absent.

    With "error", rows that lack a required field have a null JSON and their ``_errors``.
    """
    cells = compile_config(frame.schema, config)
    policy = config.get("on_missing", "null")
    appended = {"overall_confidence", "provenance"} - {f["path"] for f in config.get("fields", [])}
    parts = []
    for c in cells:
        quoted = json.dumps(c.path, ensure_ascii=False) + ":"
        if c.value is None:
            text = F.lit("null")
        else:
            # one member, so that nulls inside the value stay whatever happens to the field itself
            whole = F.to_json(F.struct(c.value.alias("v")), {"ignoreNullFields": "false"})
            text = F.substring(whole, F.lit(6), F.length(whole) - 6)
        member = F.concat(F.lit(quoted), text)
        if c.path not in appended:
            absent = F.lit(quoted + "null") if policy == "null" else F.lit(None).cast("string")
            member = F.when(c.missing(), absent).otherwise(member)
        parts.append(member)
    body = F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), ","), F.lit("}")) if parts else F.lit("{}")
    kept = [F.col(k) for k in keep if k in frame.columns]
    if policy != "error":
        return frame.select(*kept, body.alias("projected"))
    errors = missing_errors(cells)
    return frame.select(*kept, F.when(F.size(errors) == 0, body).alias("projected"), errors.alias("_errors"))
