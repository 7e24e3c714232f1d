"""Resumes as text."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.functions import text as X
from fusewright.functions.normalize import tenure_years
from fusewright.functions.phones import find_phones
from fusewright.operators import sections as S
from fusewright.plans.staging import spread
from fusewright.settings import Settings
from fusewright.sources.profile import not_empty, profiles, skill_claims, tagged


def resume_name(line):
    """The first header line as a name: null if too long or a title such as RESUME, title-cased if all in capitals."""
    shouted = (F.upper(line) == line) & (F.lower(line) != line)
    rejected = (X.word_count(line) > 6) | (shouted & (F.contains(line, F.lit("RESUME")) | F.contains(line, F.lit("CURRICULUM"))))
    return F.when(rejected, None).when(shouted, X.title_case(line)).otherwise(line)


def parse_resumes(frame: DataFrame, text: str = "text", ext: str = "ext", key: str = "candidate_key", settings: Settings | None = None) -> DataFrame:
    """Profiles of resumes' texts. The source is ``resume_`` and the extension; an ``error`` column of the reader is kept."""
    settings = settings or Settings()
    conf, source = settings.resume_confidence, F.concat(F.lit("resume_"), F.col(ext))
    t = F.col(text)
    error = F.col("error") if "error" in frame.columns else F.when(t.isNull(), F.lit("no text"))
    # rows are spread before, and each step is a projection of its own, so that nothing is worked out twice where tags name it again
    frame = spread(frame.select(F.col(key).alias("candidate_key"), F.col(ext).alias("ext"), t.alias("text"), error.alias("fault")))
    frame = frame.select("*", S.segment(F.col("text")).alias("blocks"))
    t, source = F.col("text"), F.concat(F.lit("resume_"), F.col("ext"))
    blocks = F.col("blocks")
    frame = frame.select("candidate_key", "ext", "text", "fault", *[section.alias(k) for k, section in {
        "header": S.section(blocks, "HEADER"),
        "listed": S.first_section(blocks, "TECHNICAL SKILLS", "SKILLS"),
        "worked": S.first_section(blocks, "INTERNSHIP EXPERIENCE", "WORK EXPERIENCE", "EXPERIENCE", "INTERNSHIPS"),
        "learnt": S.section(blocks, "EDUCATION"),
    }.items()])
    header = F.col("header")
    values = {
        "name": resume_name(F.get(header, 0)),
        "place": X.extract_location(t),
        "urls": X.extract_links(t),
        "mails": X.extract_emails(t),
        "numbers": find_phones(t),
        "listed": S.parse_skills(F.col("listed")),
        "jobs": S.parse_experience(F.col("worked")),
        "schools": S.parse_education(F.col("learnt")),
    }
    frame = frame.select("candidate_key", "ext", "text", "fault", "header", *[v.alias(k) for k, v in values.items()])
    more = {"jobs": not_empty(F.col("jobs")), "names": F.coalesce(not_empty(F.col("listed")), S.skills_in(t)), "years": tenure_years(F.col("jobs"), settings)}
    frame = frame.select("candidate_key", "ext", "fault", "header", "name", "place", "urls", "mails", "numbers", "schools", *[v.alias(k) for k, v in more.items()])
    years, links = F.col("years"), F.col("urls")
    tag = lambda v: tagged(v, conf, source)
    parts = {
        "full_name": tag(F.col("name")),
        "headline": tag(F.get(header, 1)),
        "years_experience": tag(F.when(years > 0, years)),
        "location": tag(F.col("place")),
        "links": tag(F.when(X.any_link(links), links)),
        "emails": tag(not_empty(F.col("mails"))),
        "phones": tag(not_empty(F.col("numbers"))),
        "skills": skill_claims(F.col("names"), conf, source),
        "experience": F.col("jobs"),
        "education": not_empty(F.col("schools")),
    }
    return profiles(frame, "candidate_key", source, settings.ord("resume"), parts, F.col("fault"))
