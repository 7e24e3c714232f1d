"""Text: trimming, case, and extraction of emails, phones, links and locations.

Patterns that begin with a run of characters are tied to the run's start by a look behind it, or to the end of the match before (``\\G``), and
their runs give nothing back. A run that leads to no match is then read once, not from each of its characters: time grows with a text's length, not with its square.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


#: White space (Unicode's) at either end.
EDGES = r"(?U)^\s+|(?<!\s)\s++$"


def strip_ws(c: Column) -> Column:
    """Without white space (Unicode's) at either end."""
    return F.regexp_replace(c, EDGES, "")


def truthy(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def first_truthy(*cs: Column) -> Column:
    return F.coalesce(*[truthy(c) for c in cs])


def collapse_ws(c: Column) -> Column:
    return strip_ws(F.regexp_replace(c, r"(?U)\s+", " "))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group, which holds a character at least; null without a match."""
    return let(F.regexp_extract(c, pattern, group), lambda found: F.when(found != "", found))


def title_case(c: Column) -> Column:
    """Upper case after every character that is no letter, lower case elsewhere."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("letter"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.when(s["letter"], F.lower(x)).otherwise(F.upper(x))).alias("out"), x.rlike(r"\p{L}").alias("letter"))
    return F.aggregate(F.split(c, ""), start, step, lambda s: s["out"])


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**30)))


def strip_bullet(c: Column) -> Column:
    return strip_ws(F.regexp_replace(c, r"(?U)^[*\-•\s]+", ""))


def lines_of(text: Column) -> Column:
    """The stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), strip_ws), lambda x: x != "")


#: Top-level domains before which white space around a dot is closed up.
TLDS = "com|org|net|edu|gov|in|io|co|info|me"
#: Fixed character classes: of the part before the @, and of the domain, which are also characters of the part before.
EMAIL = r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def extract_emails(text: Column) -> Column:
    """Distinct addresses in order of first appearance; white space around @ and before common domains is closed up."""
    closed = F.regexp_replace(text, r"(?U)(?:\G|(?<!\s))\s*+@\s*+", "@")
    closed = F.regexp_replace(closed, rf"(?iU)(?:\G|(?<!\s))\s*+\.\s*+({TLDS})\b", ".$1")
    found = F.array_distinct(F.regexp_extract_all(closed, F.lit(EMAIL), F.lit(0)))
    # most texts have none, and need not be rewritten to see it
    return F.when(~F.contains(text, F.lit("@")), F.array().cast("array<string>")).otherwise(found)


#: Fixed pattern.
PHONE = r"\+?\d[\d\s\-().]{8,14}\d"


def extract_phones(text: Column) -> Column:
    """Phone-like runs of 10 to 15 digits (a plus counts), as they stand in the text."""
    found = F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))
    return F.transform(F.filter(found, lambda p: F.length(F.regexp_replace(p, r"[^\d+]", "")).between(10, 15)), strip_ws)


#: Fixed forms of links.
URL = r"https?://[^\s|]+|(?<![a-zA-Z0-9.-])[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}/[^\s|]+"
PROFILE_URL = r"\b(?:github\.com/[^\s|]+|linkedin\.com/in/[^\s|]+)\b"


def extract_links(text: Column) -> Column:
    """struct(linkedin, github, portfolio, other): the first link of each site, the rest in order; portfolio stays null."""
    both = F.array_union(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), F.regexp_extract_all(text, F.lit(PROFILE_URL), F.lit(0)))
    return let(F.transform(both, lambda u: F.rtrim(u, F.lit(".,;|)"))), _classified)


def _classified(clean: Column) -> Column:
    linkedin = lambda u: F.contains(F.lower(u), F.lit("linkedin.com"))
    github = lambda u: F.contains(F.lower(u), F.lit("github.com")) & ~linkedin(u)
    mail = lambda u: F.contains(F.lower(u), F.lit("gmail.com")) | F.contains(F.lower(u), F.lit("email.com"))
    other = F.array_distinct(F.filter(clean, lambda u: ~linkedin(u) & ~github(u) & ~mail(u)))
    return F.struct(F.get(F.filter(clean, linkedin), 0).alias("linkedin"), F.get(F.filter(clean, github), 0).alias("github"), F.lit(None).cast("string").alias("portfolio"), other.alias("other"))


def any_link(links: Column) -> Column:
    return F.coalesce(links["linkedin"], links["github"], links["portfolio"]).isNotNull() | (F.size(links["other"]) > 0)


#: Fixed form of a place.
PLACE = r"(?U)^([A-Za-z\s]++),\s*+([A-Za-z\s]++)$"
#: Countries that are looked for anywhere in a text.
COUNTRIES = "India|USA|United States|UK|United Kingdom|Germany|Singapore|Canada|Australia"
#: The city begins at the first word boundary of a run of letters and white space, be that its start or the end of its first word or gap.
PLACE_ANYWHERE = rf"(?iU)(?<![A-Za-z\s])(?:\b|[A-Za-z]++|\s++)([A-Za-z\s]++),\s*+({COUNTRIES})\b"


def place(city: Column, country: Column, region: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(city.alias("city"), (nothing if region is None else region).alias("region"), country.alias("country"))


def extract_location(text: Column) -> Column:
    """``City, Country`` as a part of one of the first five lines, else before a known country anywhere; null if neither."""
    lines = F.slice(F.split(text, "\n"), 1, 5)
    parts = F.flatten(F.transform(lines, lambda x: F.when(F.contains(x, F.lit("|")), F.transform(F.split(x, r"\|"), strip_ws)).otherwise(F.array(strip_ws(x)))))
    at = lambda c, pattern, k: strip_ws(F.regexp_extract(c, pattern, k))
    far = let(first_match(text, PLACE_ANYWHERE, 1), lambda city: F.when(city.isNotNull(), place(strip_ws(city), at(text, PLACE_ANYWHERE, 2))))
    return let(F.get(F.filter(parts, lambda p: p.rlike(PLACE)), 0), lambda near: F.when(near.isNotNull(), place(at(near, PLACE, 1), at(near, PLACE, 2))).otherwise(far))


def split_place(c: Column) -> Column:
    """``a, …, z`` as city a and country z; without a comma the whole is the city."""
    whole = F.when(c.isNotNull(), place(c, F.lit(None).cast("string")))
    return let(F.transform(F.split(c, ","), strip_ws), lambda parts: F.when(F.size(parts) >= 2, place(F.get(parts, 0), F.get(parts, F.size(parts) - 1))).otherwise(whole))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
