"""Settings of the fusion: confidences per source, agreement bonus, the month that "Present" stands for, and the order of sources."""
from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

#: Orders in which sources are told apart when confidences tie.
CLI_ORDER = ("ats_json", "resume", "recruiter_csv", "recruiter_notes", "github_api", "linkedin_profile")
UI_ORDER = ("ats_json", "recruiter_csv", "resume", "recruiter_notes", "github_api", "linkedin_profile")


@dataclass(frozen=True)
class Settings:
    ats_confidence: float = 0.85
    resume_confidence: float = 0.75
    csv_confidence: float = 0.80
    recruiter_notes_confidence: float = 0.70
    github_confidence: float = 0.80
    linkedin_confidence: float = 0.80
    linkedin_name_confidence: float = 0.40
    agreement_bonus: float = 0.10
    present_year: int = 2026
    present_month: int = 6
    order: tuple[str, ...] = CLI_ORDER

    def ord(self, source: str) -> int:
        return self.order.index(source)


def load_settings(path: str | None = None) -> Settings:
    """Settings from a flat JSON file; a default for whatever is missing, for all of it if the file can't be read.

    ``order`` may be "cli", "ui" or a list of all sources.
    """
    try:
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        names = {f.name for f in dataclasses.fields(Settings)}
        known = {k: v for k, v in given.items() if k in names}
        if "order" in known:
            order = {"cli": CLI_ORDER, "ui": UI_ORDER}.get(known["order"]) if isinstance(known["order"], str) else tuple(known["order"])
            if order is None or sorted(order) != sorted(CLI_ORDER):
                raise ValueError("order must name every source once")
            known["order"] = order
        return Settings(**known)
    except (OSError, TypeError, ValueError, AttributeError):
        return Settings()
