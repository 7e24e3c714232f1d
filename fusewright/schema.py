"""Types of the records, as DDL."""
from __future__ import annotations

from pyspark.sql import types as T

LOCATION = "struct<city:string,region:string,country:string>"
LINKS = "struct<linkedin:string,github:string,portfolio:string,other:array<string>>"
EXPERIENCE = "array<struct<company:string,title:string,start:string,end:string,summary:string>>"
EDUCATION = "array<struct<institution:string,degree:string,field:string,end_year:int>>"
SKILL_CLAIMS = "array<struct<name:string,confidence:double,source:string>>"
SKILLS = "array<struct<name:string,confidence:double,sources:array<string>>>"
PROVENANCE = "array<struct<field:string,source:string,method:string>>"


def tagged_type(value: str) -> str:
    return f"struct<value:{value},confidence:double,source:string>"


#: One source's view of one candidate; any part may be null.
PROFILE_FIELDS = {
    "full_name": tagged_type("string"),
    "headline": tagged_type("string"),
    "years_experience": tagged_type("double"),
    "location": tagged_type(LOCATION),
    "links": tagged_type(LINKS),
    "emails": tagged_type("array<string>"),
    "phones": tagged_type("array<string>"),
    "skills": SKILL_CLAIMS,
    "experience": EXPERIENCE,
    "education": EDUCATION,
}
PROFILE = "candidate_key string, source string, source_ord int, " + ", ".join(f"{k} {v}" for k, v in PROFILE_FIELDS.items()) + ", error string"

CANONICAL_FIELDS = {
    "candidate_id": "string",
    "full_name": "string",
    "emails": "array<string>",
    "phones": "array<string>",
    "location": LOCATION,
    "links": LINKS,
    "headline": "string",
    "years_experience": "double",
    "skills": SKILLS,
    "experience": EXPERIENCE,
    "education": EDUCATION,
    "provenance": PROVENANCE,
    "overall_confidence": "double",
}
CANONICAL = "candidate_key string, " + ", ".join(f"{k} {v}" for k, v in CANONICAL_FIELDS.items())


def parsed(ddl: str) -> T.DataType:
    return T._parse_datatype_string(ddl)
