"""Recruiter notes: free text with labelled lines."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.functions import text as X
from fusewright.functions.phones import find_phones
from fusewright.plans.staging import spread
from fusewright.settings import Settings
from fusewright.sources.profile import not_empty, profiles, skill_claims, tagged

SOURCE = "recruiter_notes"
#: Fixed patterns.
NAME = r"(?i)(?:Candidate|Name|Notes on):\s*([^\n\r]+)"
HEADLINE = r"(?i)(?:Current Role|Headline|Role|Title):\s*([^\n]+)"
SKILLS = r"(?i)(?:Skills|Technologies):\s*([^\n]+)"
YEARS = r"(?i)(\d+(?:\.\d+)?)\s*(?:years|yrs)\s+of\s+experience"


def parse_notes(frame: DataFrame, text: str = "text", key: str = "candidate_key", settings: Settings | None = None) -> DataFrame:
    settings = settings or Settings()
    # rows are spread before, and values are columns of their own, as tags name them again
    frame = spread(frame.select(F.col(key).alias("candidate_key"), F.col(text).alias("text")))
    t = F.col("text")
    first = F.get(X.lines_of(t), 0)
    name = F.coalesce(X.strip_ws(X.first_match(t, NAME, 1)), F.when(X.word_count(first) < 5, first))
    skills = F.filter(F.transform(F.split(X.first_match(t, SKILLS, 1), "[,|&]"), X.strip_ws), lambda s: s != "")
    values = {
        "name": name,
        "role": X.strip_ws(X.first_match(t, HEADLINE, 1)),
        "years": X.first_match(t, YEARS, 1).try_cast("double"),
        "place": X.extract_location(t),
        "urls": X.extract_links(t),
        "mails": X.extract_emails(t),
        "numbers": find_phones(t),
        "names": skills,
    }
    frame = frame.select("candidate_key", "text", *[v.alias(k) for k, v in values.items()])
    links = F.col("urls")
    tag = lambda v: tagged(v, settings.recruiter_notes_confidence, SOURCE)
    parts = {
        "full_name": tag(F.col("name")),
        "headline": tag(F.col("role")),
        "years_experience": tag(F.col("years")),
        "location": tag(F.col("place")),
        "links": tag(F.when(X.any_link(links), links)),
        "emails": tag(not_empty(F.col("mails"))),
        "phones": tag(not_empty(F.col("numbers"))),
        "skills": skill_claims(F.col("names"), settings.recruiter_notes_confidence, SOURCE),
    }
    return profiles(frame, "candidate_key", SOURCE, settings.ord(SOURCE), parts, F.when(t.isNull(), F.lit("no text")))
