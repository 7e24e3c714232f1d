"""Fusion of source profiles into one record per candidate.

Profiles are read once, as a long table of claims (``operators.claims``), and three exchanges of combined rows lead to the records: one by
fact, one that brings a skill's sources together, one by candidate. Only the skill boost depends on the order of sources; it is folded
over one entry per source.

``entries`` has what a record lists as rows with numbers, for candidates of any size; ``records`` puts them into arrays.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusewright.functions.text import strip_ws, truthy
from fusewright.operators.claims import FIELDS, KINDS, LISTS, SITES, claims, combine
from fusewright.plans.staging import staged
from fusewright.schema import CANONICAL_FIELDS, EDUCATION, EXPERIENCE, LINKS, SKILLS
from fusewright.settings import Settings

HIGHEST, PRIMARY = "highest_confidence", "highest_confidence_primary"


def skill_fold(claimed: Column, bonus: float) -> Column:
    """Confidence of a skill from its claims, one a source, in the order of sources: the greater of both, plus the bonus, at most 1."""
    step = lambda s, c: F.when(s.isNull(), c).otherwise(F.least(F.lit(1.0), F.greatest(s, c) + F.lit(float(bonus))))
    return F.aggregate(F.transform(claimed, lambda c: c["c"]), F.lit(None).cast("double"), step)


def together(combined: DataFrame, settings: Settings) -> DataFrame:
    """Combined claims with a skill's sources in one row: ``skill`` has its confidence and sources, ``first`` its first place."""
    claim = F.struct("first.ord", "first.pos", "first.c", F.col("sub").alias("source"))
    cells = [k for k in combined.columns if k not in ("candidate_key", "kind", "a", "b", "alone", "sub")]
    # all but skills have one row of their name already, which passes as it is
    gathered = combined.groupBy("candidate_key", "kind", "a", "b", "alone").agg(F.array_sort(F.collect_list(F.when(F.col("kind") == "skill", claim))).alias("claims"), *[F.min(k).alias(k) for k in cells])
    skill = F.struct(F.col("a").alias("name"), skill_fold(F.col("claims"), settings.agreement_bonus).alias("confidence"), F.transform("claims", lambda c: c["source"]).alias("sources"))
    return gathered.withColumn("skill", F.when(F.col("kind") == "skill", skill)).drop("claims")


def _entry(kind: str) -> Column:
    """What a row of ``together`` adds to the record's list of its kind."""
    long = lambda k: F.col(f"long{k}.v")
    return {
        "skill": F.col("skill"),
        "other": F.col("a"),
        "experience": F.struct(F.col("first.x").alias("company"), F.col("first.y").alias("title"), long(1).alias("start"), long(2).alias("end"), long(3).alias("summary")),
        "education": F.struct(F.col("first.x").alias("institution"), F.col("first.y").alias("degree"), long(1).alias("field"), F.col("top").alias("end_year")),
    }[kind]


def _sorted(kind: str) -> Column:
    """The list of a kind in the record's order: skills by confidence, equal ones and all else by first appearance."""
    entry = F.struct((-F.col("skill.confidence") if kind == "skill" else F.lit(0.0)).alias("c"), F.col("first").alias("place"), F.col("a"), _entry(kind).alias("e"))
    return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry)))


_LISTED = {"skill": SKILLS, "experience": EXPERIENCE, "education": EDUCATION, "other": "array<string>"}


def _facts(profiles: DataFrame, kind: str, settings: Settings) -> DataFrame:
    """Rows of one kind for a list. But for skills, whose sources are still to meet, combined claims have one row of their name and move once."""
    rows = claims(profiles, (kind,))
    return together(combine(rows), settings) if kind == "skill" else combine(rows, ("candidate_key", "a", "b", "alone")).withColumn("kind", F.lit(kind))


def _listed(profiles: DataFrame, kind: str, name: str, settings: Settings, *more: Column) -> DataFrame:
    rows = _facts(profiles, kind, settings)
    return rows.groupBy("candidate_key").agg(_sorted(kind).alias("l")).select("candidate_key", F.transform("l", lambda x: x["e"]).cast(_LISTED[kind]).alias(name), *more)


def _skill_mean() -> Column:
    """Mean confidence of the skills in ``l``, added up in the order of their first appearance."""
    ordered = F.array_sort(F.transform("l", lambda x: F.struct(x["place"].alias("place"), x["e"]["confidence"].alias("c"))))
    return F.aggregate(ordered, F.lit(0.0), lambda t, x: t + x["c"]) / F.nullif(F.size("l"), F.lit(0))


def fuse_skills(profiles: DataFrame, settings: Settings) -> DataFrame:
    """(candidate_key, skills, skill_mean): by name the boosted confidence and sources; by confidence, equal ones by first appearance."""
    return _listed(profiles, "skill", "skills", settings, _skill_mean().alias("skill_mean"))


def fuse_experience(profiles: DataFrame) -> DataFrame:
    """(candidate_key, experience): jobs of the same company and title become one, with the longest dates and summary."""
    return _listed(profiles, "experience", "experience", Settings())


def fuse_education(profiles: DataFrame) -> DataFrame:
    """(candidate_key, education): schools of the same institution and degree become one, with the longest field and last year."""
    return _listed(profiles, "education", "education", Settings())


def fuse_other_links(profiles: DataFrame) -> DataFrame:
    """(candidate_key, other): the distinct further links in order of first appearance."""
    return _listed(profiles, "other", "other", Settings())


def entries(profiles: DataFrame, kind: str, settings: Settings | None = None) -> DataFrame:
    """(candidate_key, position, entry): a list of the records as rows, numbered from 0 within a candidate, however many there are.

    ``kind`` is one of ``claims.LISTS``; the order is that of the record's array. Rows are sorted by ranges of candidate and place, so that a hot
    candidate lies in several partitions; a row's number is its number in its partition and what the partitions before hold of
    the candidate.
    """
    if kind not in LISTS:
        raise ValueError(f"kind must be one of {LISTS}")
    rows = _facts(profiles, kind, settings or Settings())
    c = -F.col("skill.confidence") if kind == "skill" else F.lit(0.0)
    order = ["candidate_key", "c", "place", "a"]
    flat = rows.select("candidate_key", c.alias("c"), F.col("first").alias("place"), "a", _entry(kind).alias("entry"))
    ranged = staged(flat.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}))
    runs = ranged.groupBy("candidate_key", "part").agg(F.min("row").alias("low"), F.count("*").alias("n"))
    before = Window.partitionBy("candidate_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("candidate_key").alias("k"), F.col("part").alias("p"), "low", "before")
    both = ranged.join(runs, F.col("candidate_key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")))
    return both.select("candidate_key", (F.col("row") - F.col("low") + F.col("before")).alias("position"), "entry")


def mean_of(*terms: Column) -> Column:
    """Mean of the terms that are not null; null if none is."""
    there = F.filter(F.array(*terms), lambda t: t.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, t: s + t) / F.size(there))


def hundredths(mean: Column) -> Column:
    """To two places, as databases round doubles: the product by 100 to a whole number. Rounding by decimal digits takes 0.575, whose product lies below 57.5, the other way."""
    return F.round(mean * 100) / 100


def candidate_id(email: Column, name: Column) -> Column:
    return F.coalesce(F.md5(F.lower(strip_ws(F.coalesce(truthy(email), truthy(name))))), F.lit("unknown"))


def records(rows: DataFrame) -> DataFrame:
    """One canonical record per candidate from rows of ``together``."""
    best = {k: F.max(F.when(F.col("kind") == k, F.col("best"))).alias(f"w_{k}") for k in (*FIELDS, *SITES)}
    lists = [_sorted(k).alias(f"l_{k}") for k in LISTS]
    counts = [F.max(k).alias(m) for k, m in (("n", "sources_attempted"), ("used", "sources_used"))]
    has_links = F.max(F.when(F.col("kind") == "profile", F.col("top"))).alias("has_links")
    joined = rows.groupBy("candidate_key").agg(*best.values(), *lists, *counts, has_links).where("sources_used > 0")

    w = lambda k: F.col(f"w_{k}")
    listed = lambda k: F.transform(f"l_{k}", lambda x: x["e"]).cast(_LISTED[k])
    primary = lambda k: F.when(w(k).isNotNull(), F.array(F.get(w(k)["list"], 0))).otherwise(F.array().cast("array<string>"))
    links = F.when(F.col("has_links") > 0, F.struct(*[w(k)["text"].alias(k) for k in SITES], listed("other").alias("other")))
    entry = lambda k, field, method: F.when(w(k).isNotNull(), F.struct(F.lit(field).alias("field"), w(k)["source"].alias("source"), F.lit(method).alias("method")))
    trail = [entry(k, k, HIGHEST) for k in ("full_name", "headline", "years_experience", "location")]
    trail += [entry(k, f"links.{k}", HIGHEST) for k in SITES]
    trail += [entry(k, k, PRIMARY) for k in ("emails", "phones")]
    confidence = lambda k: w(k)["c"]
    link_mean = mean_of(*[confidence(k) for k in SITES])
    overall = mean_of(*[confidence(k) for k in ("full_name", "headline", "years_experience", "location")], link_mean, confidence("emails"), confidence("phones"), F.col("skill_mean"))
    cells = {
        "candidate_id": candidate_id(F.get(w("emails")["list"], 0), w("full_name")["text"]),
        "full_name": w("full_name")["text"],
        "emails": primary("emails"),
        "phones": primary("phones"),
        "location": w("location")["at"],
        "links": links.cast(LINKS),
        "headline": w("headline")["text"],
        "years_experience": w("years_experience")["number"],
        "skills": listed("skill"),
        "experience": listed("experience"),
        "education": listed("education"),
        "provenance": F.filter(F.array(*trail), lambda p: p.isNotNull()),
        "overall_confidence": F.coalesce(hundredths(overall), F.lit(0.0)),
    }
    scored = joined.withColumn("l", F.col("l_skill")).withColumn("skill_mean", _skill_mean())
    return scored.select("candidate_key", *[cells[k].cast(kind).alias(k) for k, kind in CANONICAL_FIELDS.items()], "sources_attempted", "sources_used")


def fuse(profiles: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One canonical record (``schema.CANONICAL``) per candidate_key, with sources_attempted and sources_used.

    Empty profiles count as attempted only; a candidate without any other has no record. A null key is a key like any other. A record
    holds its lists as arrays, in one task; ``entries`` has them as rows.
    """
    return records(together(combine(claims(profiles, KINDS)), settings or Settings()))
