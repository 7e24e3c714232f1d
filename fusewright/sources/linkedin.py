"""LinkedIn addresses: a name from the slug, and the link. Nothing is fetched."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.functions.text import first_match, title_case, truthy
from fusewright.settings import Settings
from fusewright.sources.profile import profiles, tagged

SOURCE = "linkedin_profile"
SLUG = r"(?iU)linkedin\.com/in/([\w\-]+)"


def name_from_slug(slug):
    """Title-cased parts of a slug without those that hold digits; null if none is left."""
    parts = F.filter(F.split(slug, "-"), lambda p: ~p.rlike(r"\d"))
    return truthy(F.array_join(F.transform(parts, title_case), " "))


def parse_linkedin(frame: DataFrame, url: str = "url", key: str = "candidate_key", settings: Settings | None = None) -> DataFrame:
    settings = settings or Settings()
    slug = first_match(F.col(url), SLUG, 1)
    none = F.lit(None).cast("string")
    links = F.struct(F.col(url).alias("linkedin"), none.alias("github"), none.alias("portfolio"), F.array().cast("array<string>").alias("other"))
    parts = {
        "full_name": tagged(name_from_slug(slug), settings.linkedin_name_confidence, SOURCE),
        "links": tagged(F.when(slug.isNotNull(), links), settings.linkedin_confidence, SOURCE),
    }
    return profiles(frame, key, SOURCE, settings.ord(SOURCE), parts)
