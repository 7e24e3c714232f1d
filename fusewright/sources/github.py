"""GitHub profiles from staged API payloads: a table of users and one of repositories. Executors make no requests."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusewright.functions.text import first_match, split_place, truthy
from fusewright.settings import Settings
from fusewright.sources.profile import not_empty, profiles, skill_claims, tagged

SOURCE = "github_api"
USERNAME = r"(?iU)github\.com/([\w\-]+)"
REPOS = 10
USER = "login string, name string, bio string, email string, location string, blog string"


def first_repos(repos: DataFrame, limit: int = REPOS) -> DataFrame:
    """(login, languages) of each user's first repositories by ``position``, distinct languages in their order (a top-k)."""
    order = Window.partitionBy("login").orderBy("position")
    top = repos.select(F.lower("login").alias("login"), "position", "language").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    languages = F.transform(F.array_sort(F.collect_list(F.struct("position", "language"))), lambda r: r["language"])
    return top.where("language is not null and language <> ''").groupBy("login").agg(F.array_distinct(languages).alias("languages"))


def parse_github(frame: DataFrame, users: DataFrame, repos: DataFrame, url: str = "url", key: str = "candidate_key", settings: Settings | None = None) -> DataFrame:
    """Profiles for addresses. ``users`` has the columns of USER, ``repos`` login, position and language.

    An address without a staged user keeps just its link, as when the service can't be reached.
    """
    settings = settings or Settings()
    named = frame.select(F.col(key).alias("candidate_key"), first_match(F.col(url), USERNAME, 1).alias("username"))
    known = users.select(F.lower("login").alias("login"), *[truthy(F.col(c)).alias(c) for c in ("name", "bio", "email", "location", "blog")]).dropDuplicates(["login"])
    joined = named.withColumn("login", F.lower("username")).join(known, "login", "left").join(first_repos(repos), "login", "left")
    link = F.concat(F.lit("https://github.com/"), F.col("username"))
    links = F.struct(F.lit(None).cast("string").alias("linkedin"), link.alias("github"), F.col("blog").alias("portfolio"), F.array().cast("array<string>").alias("other"))
    tag = lambda v: tagged(v, settings.github_confidence, SOURCE)
    parts = {
        "full_name": tag(F.col("name")),
        "headline": tag(F.col("bio")),
        "emails": tag(F.when(F.col("email").isNotNull(), F.array("email"))),
        "location": tag(split_place(F.col("location"))),
        "links": tag(F.when(F.col("username").isNotNull(), links)),
        "skills": skill_claims(not_empty(F.col("languages")), settings.github_confidence, SOURCE),
    }
    return profiles(joined, "candidate_key", SOURCE, settings.ord(SOURCE), parts)


def discovered_urls(resumes: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(candidate_key, github, linkedin): the given address, else the one found in the resume, with a scheme."""
    found = resumes.select("candidate_key", F.col("links.value.github").alias("found_github"), F.col("links.value.linkedin").alias("found_linkedin"))
    with_scheme = lambda c: F.when(c.startswith("http"), c).otherwise(F.concat(F.lit("https://"), c))
    if given is None:
        return found.select("candidate_key", with_scheme(F.col("found_github")).alias("github"), with_scheme(F.col("found_linkedin")).alias("linkedin"))
    both = found.join(given.select("candidate_key", "github", "linkedin"), "candidate_key", "full")
    return both.select("candidate_key", *[F.coalesce(truthy(F.col(c)), with_scheme(F.col(f"found_{c}"))).alias(c) for c in ("github", "linkedin")])
