"""What all sources share: tagging and the profile's columns."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusewright.schema import PROFILE_FIELDS
from fusewright.settings import Settings


def tagged(value: Column, confidence: float, source: str | Column) -> Column:
    """struct(value, confidence, source), null for a null value."""
    name = F.lit(source) if isinstance(source, str) else source
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(float(confidence)).alias("confidence"), name.alias("source")))


def skill_claims(names: Column, confidence: float, source: str | Column) -> Column:
    name = F.lit(source) if isinstance(source, str) else source
    claims = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(float(confidence)).alias("confidence"), name.alias("source")))
    return F.when(F.size(names) > 0, claims)


def not_empty(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def job(company: Column, title: Column, start: Column, end: Column, summary: Column) -> Column:
    parts = {"company": company, "title": title, "start": start, "end": end, "summary": summary}
    return F.struct(*[c.cast("string").alias(k) for k, c in parts.items()])


def school(institution: Column, degree: Column, field: Column, end_year: Column) -> Column:
    return F.struct(institution.cast("string").alias("institution"), degree.cast("string").alias("degree"), field.cast("string").alias("field"), end_year.cast("int").alias("end_year"))


def profiles(frame: DataFrame, key: str, source: str | Column, order: int, parts: dict[str, Column], error: Column | None = None) -> DataFrame:
    """The source's rows with every column of a profile; parts that it lacks are null."""
    name = F.lit(source) if isinstance(source, str) else source
    cells = [parts[k].cast(kind).alias(k) if k in parts else F.lit(None).cast(kind).alias(k) for k, kind in PROFILE_FIELDS.items()]
    fault = F.lit(None).cast("string") if error is None else error
    return frame.select(F.col(key).cast("string").alias("candidate_key"), name.alias("source"), F.lit(order).alias("source_ord"), *cells, fault.alias("error"))


def has_any_field() -> Column:
    """Whether a profile holds anything."""
    return reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in PROFILE_FIELDS])


def union_sources(*sources: DataFrame) -> DataFrame:
    """All source profiles together, in no order: ``source_ord`` has it."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def quarantine(all_profiles: DataFrame) -> DataFrame:
    """(candidate_key, source, error) of inputs that could not be read."""
    return all_profiles.where("error is not null").select("candidate_key", "source", "error")
