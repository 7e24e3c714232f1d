"""What a dashboard shows: texts for cards, percentages, a history numbered backwards, and pages of a grid."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusewright.functions.text import truthy
from fusewright.sources.store import iso_utc, location_text

DASH = "—"


def percent(confidence: Column) -> Column:
    """Whole per cent, cut off."""
    return (confidence * 100).cast("int")


def cards(fused: DataFrame) -> DataFrame:
    """One card per record."""
    city = truthy(F.col("location.city"))
    years = lambda e: F.concat_ws(" – ", F.coalesce(e["start"], F.lit("")), F.coalesce(e["end"], F.lit("Present")))
    return fused.select(
        "candidate_id",
        F.coalesce("full_name", F.lit(DASH)).alias("name"),
        F.when(city.isNotNull(), location_text(F.col("location"))).otherwise(DASH).alias("place"),
        percent(F.coalesce("overall_confidence", F.lit(0.0))).alias("confidence_percent"),
        F.coalesce("years_experience", F.lit(0.0)).alias("years"),
        F.transform("experience", lambda e: F.concat_ws(" · ", e["title"], e["company"], years(e))).alias("jobs"),
        F.transform("education", lambda e: F.concat_ws(" · ", e["degree"], e["institution"], F.when(e["end_year"].isNotNull(), F.concat(F.lit("Graduated "), e["end_year"].cast("string"))))).alias("schools"),
        F.transform("skills", lambda s: F.concat(s["name"], F.lit(" "), percent(s["confidence"]).cast("string"), F.lit("%"))).alias("skills"),
    )


class Session:
    """The results of one user's runs, newest first; only results that hold something are kept."""

    def __init__(self):
        self.runs: list[dict] = []

    def append(self, result: dict | None) -> None:
        if result:
            self.runs.append(result)

    def clear(self) -> None:
        self.runs.clear()

    def newest_first(self) -> list[tuple[int, dict]]:
        """(number, result): the first run has number 1."""
        return list(enumerate(self.runs, 1))[::-1]


def history(session: DataFrame, seq: str = "seq") -> DataFrame:
    """A session's runs as a frame, newest first, each with its number. A session is one user's; it is ordered in one task."""
    return session.withColumn("number", F.row_number().over(Window.orderBy(seq))).orderBy(F.desc(seq))


def grid(page: DataFrame, order: str = "id", width: int = 3, limit: int = 200) -> DataFrame:
    """A page of at most ``limit`` rows (see CandidateStore.latest), newest first, with the line of the grid each is on."""
    place = F.row_number().over(Window.orderBy(F.desc(order))) - 1
    page = page.orderBy(F.desc(order)).limit(limit)
    return page.withColumn("line", F.floor(place / width)).withColumn("processed_on", F.substring(iso_utc(F.col("processed_at")), 1, 10))
