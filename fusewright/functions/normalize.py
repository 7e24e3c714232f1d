"""Normalisers. ``NORMALIZERS`` maps the names that a projection may use to functions of a string column."""
from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusewright.functions.phones import normalize_phone
from fusewright.functions.text import let, strip_ws, truthy
from fusewright.settings import Settings

#: Skill aliases and what they stand for.
SKILLS = {
    "py": "Python",
    "python": "Python",
    "python3": "Python",
    "sql": "SQL",
    "mysql": "MySQL",
    "git": "Git",
    "github": "GitHub",
    "java": "Java",
    "html": "HTML",
    "css": "CSS",
    "html5": "HTML",
    "css3": "CSS",
    "js": "JavaScript",
    "javascript": "JavaScript",
    "cloud computing": "Cloud Computing",
    "oop": "OOP",
    "object-oriented programming": "OOP",
}
#: Country names and their two-letter codes.
COUNTRIES = {
    "india": "IN",
    "united states": "US",
    "usa": "US",
    "united kingdom": "GB",
    "uk": "GB",
    "germany": "DE",
    "singapore": "SG",
    "canada": "CA",
    "australia": "AU",
}
#: Month names by their first letters, and forms of years and month numbers.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
YEAR = r"\b(20\d{2}|19\d{2})\b"
MONTH_NUMBER = r"\b(0?[1-9]|1[0-2])\b"


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*table.items())])[key]


def normalize_email(c: Column) -> Column:
    return F.lower(strip_ws(c))


def normalize_skill(c: Column) -> Column:
    return F.coalesce(lookup(SKILLS, F.lower(strip_ws(c))), strip_ws(c))


def normalize_country(c: Column) -> Column:
    given = truthy(c)
    return F.when(given.isNotNull(), F.coalesce(lookup(COUNTRIES, F.lower(strip_ws(given))), F.substring(F.upper(given), 1, 2)))


def _present(low: Column) -> Column:
    return F.contains(low, F.lit("present")) | F.contains(low, F.lit("current"))


def _month(low: Column) -> Column:
    """The first month of the calendar that is named, else the first number from 1 to 12, else 1."""
    found = F.when(F.contains(low, F.lit(MONTHS[0])), F.lit(1))
    for k, name in enumerate(MONTHS[1:], 2):
        found = found.when(F.contains(low, F.lit(name)), F.lit(k))
    return F.coalesce(found, F.regexp_extract(low, MONTH_NUMBER, 1).try_cast("int"), F.lit(1))


def _dated(c: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of(text, year)`` of the lower-cased text and the first year in it, which is empty if there is none."""
    return let(F.lower(strip_ws(truthy(c))), lambda low: let(F.regexp_extract(low, YEAR, 1), lambda year: of(low, year)))


def normalize_date(c: Column) -> Column:
    """``YYYY-MM``, ``Present``, or the lower-cased text where no year stands in it."""
    month = lambda low: F.lpad(_month(low).cast("string"), 2, "0")
    return _dated(c, lambda low, year: F.when(_present(low), F.lit("Present")).when(year == "", low).otherwise(F.concat(year, F.lit("-"), month(low))))


def month_index(c: Column, settings: Settings) -> Column:
    """Months since year 0; null where no year stands. ``Present`` is the month of the settings."""
    now = F.lit(settings.present_year * 12 + settings.present_month - 1)
    return _dated(c, lambda low, year: F.when(_present(low), now).otherwise(year.try_cast("int") * 12 + _month(low) - 1))


def tenure_years(experience: Column, settings: Settings) -> Column:
    """Distinct calendar months of all jobs, over twelve, to two places; an interval without both ends, or backwards, adds none."""

    def months(job: Column) -> Column:
        ends = F.struct(month_index(job["start"], settings).alias("a"), month_index(job["end"], settings).alias("b"))
        return let(ends, lambda e: F.when(e["a"] <= e["b"], F.sequence(e["a"], e["b"])).otherwise(F.array().cast("array<int>")))

    return F.round(F.size(F.array_distinct(F.flatten(F.transform(F.coalesce(experience, F.array().cast(experience_type())), months)))) / 12, 2)


def experience_type():
    from fusewright.schema import EXPERIENCE

    return EXPERIENCE


NORMALIZERS = {"E164": normalize_phone, "canonical": normalize_skill, "upper": F.upper, "lower": F.lower}


def normalize_profile(profiles: DataFrame) -> DataFrame:
    """Emails, phones, skill names, countries and dates of source profiles in their normal forms."""
    each = lambda c, f: F.when(c.isNotNull(), F.struct(F.transform(c["value"], f).alias("value"), c["confidence"].alias("confidence"), c["source"].alias("source")))
    at = F.col("location.value")
    location = F.when(at.isNotNull(), F.struct(F.struct(at["city"].alias("city"), at["region"].alias("region"), normalize_country(at["country"]).alias("country")).alias("value"), F.col("location.confidence").alias("confidence"), F.col("location.source").alias("source")))
    skill = lambda s: F.struct(normalize_skill(s["name"]).alias("name"), s["confidence"].alias("confidence"), s["source"].alias("source"))
    job = lambda e: F.struct(e["company"].alias("company"), e["title"].alias("title"), normalize_date(e["start"]).alias("start"), normalize_date(e["end"]).alias("end"), e["summary"].alias("summary"))
    return profiles.withColumns({
        "emails": each(F.col("emails"), normalize_email),
        "phones": each(F.col("phones"), normalize_phone),
        "location": location,
        "skills": F.transform("skills", skill),
        "experience": F.transform("experience", job),
    })
