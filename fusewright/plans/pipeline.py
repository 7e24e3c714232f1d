"""From sources to records: parse, normalise, fuse, validate, project."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from fusewright.functions.normalize import normalize_profile
from fusewright.operators.fuse import fuse
from fusewright.operators.project import project, project_json
from fusewright.operators.validate import accepted, validate, validate_projected
from fusewright.plans.staging import release, staged
from fusewright.settings import Settings
from fusewright.sources.ats import parse_ats
from fusewright.sources.github import discovered_urls, parse_github
from fusewright.sources.linkedin import parse_linkedin
from fusewright.sources.notes import parse_notes
from fusewright.sources.profile import quarantine, union_sources
from fusewright.sources.recruiter_csv import parse_csv
from fusewright.sources.resume import parse_resumes


@dataclass
class Inputs:
    """Raw frames by source; any may be missing. All but ``csv`` (see parse_csv) hold candidate_key.

    ats: raw. resumes: text, ext (error). csv: the file's columns (candidate_key). notes: text. urls: github, linkedin, which go before those
    found in resumes. github_users and github_repos: staged payloads.
    """

    ats: DataFrame | None = None
    resumes: DataFrame | None = None
    csv: DataFrame | None = None
    notes: DataFrame | None = None
    urls: DataFrame | None = None
    github_users: DataFrame | None = None
    github_repos: DataFrame | None = None
    lenient: bool = False


@dataclass
class Outcome:
    profiles: DataFrame
    quarantined: DataFrame
    fused: DataFrame
    validated: DataFrame
    projected: DataFrame
    projected_json: DataFrame

    def close(self) -> None:
        """Deletes what was staged; the frames cannot be read after that. Otherwise it goes when the application ends."""
        release(self.profiles, self.fused)


def source_profiles(inputs: Inputs, settings: Settings | None = None, held: list[DataFrame] | None = None) -> DataFrame:
    """The normalised profiles of all sources. Frames that are staged for them are added to ``held``."""
    settings = settings or Settings()
    found = []
    if inputs.ats is not None:
        found.append(parse_ats(inputs.ats, settings=settings, lenient=inputs.lenient))
    # resumes are read again for the addresses found in them
    resumes = staged(parse_resumes(inputs.resumes, settings=settings)) if inputs.resumes is not None else None
    if resumes is not None:
        found.append(resumes)
        if held is not None:
            held.append(resumes)
    if inputs.csv is not None:
        found.append(parse_csv(inputs.csv, "candidate_key" if "candidate_key" in inputs.csv.columns else None, settings))
    if inputs.notes is not None:
        found.append(parse_notes(inputs.notes, settings=settings))
    urls = discovered_urls(resumes, inputs.urls) if resumes is not None else inputs.urls
    if urls is not None:
        github = urls.where("github is not null").select("candidate_key", "github")
        spark = github.sparkSession
        users = inputs.github_users if inputs.github_users is not None else spark.createDataFrame([], "login string, name string, bio string, email string, location string, blog string")
        repos = inputs.github_repos if inputs.github_repos is not None else spark.createDataFrame([], "login string, position int, language string")
        found.append(parse_github(github, users, repos, url="github", settings=settings))
        found.append(parse_linkedin(urls.where("linkedin is not null"), url="linkedin", settings=settings))
    if not found:
        raise ValueError("No candidate sources are given")
    return normalize_profile(union_sources(*found))


def run(inputs: Inputs, config: dict, settings: Settings | None = None) -> Outcome:
    """All of it. With on_missing "error", records whose projection has errors are not projected.

    Sources are parsed once and records fused once: both are staged, since validation and projection both read the records, and what
    could not be parsed is told from the profiles.
    """
    held: list[DataFrame] = []
    profiles = staged(source_profiles(inputs, settings, held))
    release(*held)
    fused = staged(fuse(profiles.where("error is null"), settings))
    validated = validate_projected(validate(fused), config)
    good = accepted(validated, config).drop("validation", "projection_errors")
    return Outcome(profiles, quarantine(profiles), fused, validated, project(good, config), project_json(good, config))
