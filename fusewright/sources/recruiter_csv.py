"""Recruiter exports: CSV with a header, a candidate a row."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusewright.functions.text import first_truthy, strip_ws, truthy
from fusewright.settings import Settings
from fusewright.sources.profile import job, profiles, tagged

SOURCE = "recruiter_csv"
SYNTHESIZED = "Synthesized from Recruiter CSV Row"


POSITION = "_position"


def read_csv(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    """The rows as strings (no type inference, which would read the file twice); with ``position`` also their place: file, then row.

    Quoted line breaks keep a file in one piece, so its rows are numbered in the file's order.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumn(POSITION, F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))) if position else rows


def parse_csv(rows: DataFrame, key: str | None = None, settings: Settings | None = None) -> DataFrame:
    """Profiles of rows; column names count lower-cased and stripped. Without ``key`` it is the email, else the name."""
    settings = settings or Settings()
    given = rows.toDF(*[c if c == key else c.lower().strip() for c in rows.columns])
    pick = lambda *names: strip_ws(first_truthy(*([F.col(f"`{n}`").cast("string") for n in names if n in given.columns] or [F.lit(None).cast("string")])))
    name, email, phone = pick("name", "candidate_name", "full_name"), pick("email", "mail", "email_address"), pick("phone", "mobile", "contact")
    company, title, none = pick("current_company", "company"), pick("title", "role"), F.lit(None)
    tag = lambda v: tagged(v, settings.csv_confidence, SOURCE)
    parts = {
        "full_name": tag(name),
        "headline": tag(title),
        "emails": tag(F.when(email.isNotNull(), F.array(email))),
        "phones": tag(F.when(phone.isNotNull(), F.array(phone))),
        "experience": F.when(F.coalesce(company, title).isNotNull(), F.array(job(company, title, none, none, F.lit(SYNTHESIZED)))),
    }
    if key is None:
        key = "candidate_key"
        given = given.withColumn(key, F.coalesce(F.lower(truthy(email)), F.lower(name)))
    return profiles(given, key, SOURCE, settings.ord(SOURCE), parts)


def first_row(rows: DataFrame) -> DataFrame:
    """The first data row only (a limit is the feature here: one export describes one candidate).

    By position where the rows have one, see ``read_csv``; otherwise whichever comes first, as of a frame that has no order.
    """
    if POSITION not in rows.columns:
        return rows.limit(1)
    return rows.orderBy(POSITION).limit(1).drop(POSITION)
