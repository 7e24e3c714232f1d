"""Resume text into sections, jobs and schools.

Lines are arrays of their document, and every step is an expression on arrays: no shuffle and no Python, whatever the number of
documents. Carrying a header forward, opening a new job, and looking ahead for a school are expressed by the places of the lines that
have a flag, between which arrays are cut.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fusewright.functions import text as X
from fusewright.functions.normalize import MONTHS, YEAR, normalize_date
from fusewright.sources.profile import job, school

#: Section headers, in the order in which they are tried.
HEADERS = (
    "PROFESSIONAL SUMMARY",
    "SUMMARY",
    "TECHNICAL SKILLS",
    "SKILLS",
    "INTERNSHIP EXPERIENCE",
    "WORK EXPERIENCE",
    "EXPERIENCE",
    "INTERNSHIPS",
    "PROJECTS",
    "PROJECT",
    "EDUCATION",
    "CERTIFICATIONS",
    "ACHIEVEMENTS",
    "LANGUAGES",
    "DECLARATION",
)
#: Words of job titles, degrees and well-known skills, and how spans and scores are written.
JOB_WORDS = ("intern", "developer", "engineer", "designer", "analyst", "lead", "manager", "architect", "specialist", "consultant", "ambassador", "executive")
DEGREE_WORDS = ("b.tech", "b.e", "b.sc", "bachelor", "master", "phd", "intermediate", "secondary", "class xii", "class x", "cbse", "icse", "school")
SKILL_WORDS = ("python", "java", "mysql", "html", "css", "git", "github", "javascript", "cloud computing", "oop", "docker")
_MONTH = "(?:" + "|".join(m.capitalize() for m in MONTHS) + r")[a-z]*\s+\d{4}"
MONTH_SPAN = rf"(?i)\b{_MONTH}\s*(?:-|–|to)\s*(?:{_MONTH}|Present|Current)\b"
YEAR_SPAN = r"(?i)\b(?:20\d{2}|19\d{2})\s*(?:-|–|to)\s*(?:20\d{2}|19\d{2}|Present|Current)\b"
ONE_MONTH = rf"(?i)\b{_MONTH}\b"
SCORE_TAIL = r"(?i)\s*(?:CGPA|%|Percent|Score|Grade).*$"
BARE_NUMBER = r"\s*\b\d+(?:\.\d+)?%?\b"


def header_of(line: Column, headers=HEADERS) -> Column:
    """The header that a line is, else null."""
    shouted = (F.length(line) < 30) & (F.upper(line) == line) & (F.lower(line) != line)

    def of(upper: Column, shouted: Column) -> Column:
        found = None
        for h in headers:
            is_h = (upper == h) | upper.startswith(h + " ") | upper.endswith(" " + h) | (shouted & F.contains(upper, F.lit(h)))
            found = F.when(is_h, F.lit(h)) if found is None else found.when(is_h, F.lit(h))
        # most lines hold none of them anywhere
        return F.when(X.any_of(*[F.contains(upper, F.lit(h)) for h in roots]), found)

    roots = [h for h in headers if not any(other != h and other in h for other in headers)]
    return X.let(F.struct(F.upper(line).alias("upper"), shouted.alias("shouted")), lambda v: of(v["upper"], v["shouted"]))


def cut_at(lines: Column, label) -> Column:
    """array<struct<name, body>>: the lines after each labelled one up to the next; those before the first are ``HEADER``.

    ``label`` gives a line's label or null. The labelled line itself is left out.
    """

    def cut(lines: Column) -> Column:
        places = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), label(x).alias("name"))), lambda p: p["name"].isNotNull())
        heads = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit("HEADER").alias("name"))), places)
        return X.let(heads, lambda hs: between(lines, hs, lambda h, body: F.struct(h["name"].alias("name"), body.alias("body"))))

    return X.let(lines, cut)


def between(lines: Column, heads: Column, make) -> Column:
    """``make(head, lines after it up to the next head)`` of each head; heads have a place ``i``."""
    end = lambda k: F.coalesce(F.get(heads, k + 1)["i"], F.size(lines))
    return F.transform(heads, lambda h, k: X.let(F.slice(lines, h["i"] + 2, end(k) - h["i"] - 1), lambda body: make(h, body)))


def segment(text: Column) -> Column:
    """The blocks of a resume's lines; of a repeated header the last block counts, see ``section``."""
    return cut_at(X.lines_of(text), header_of)


def section(blocks: Column, name: str) -> Column:
    """The last block of that name; null if there is none or it is empty."""
    last = F.get(F.reverse(F.filter(blocks, lambda b: b["name"] == name)), 0)["body"]
    return X.let(last, lambda body: F.when(F.size(body) > 0, body))


def first_section(blocks: Column, *names: str) -> Column:
    return F.coalesce(*[section(blocks, n) for n in names])


def parse_skills(lines: Column) -> Column:
    """Distinct skills of a section's lines: what follows a colon or dash, split at commas, bars, ampersands and parentheses."""

    def of_line(x: Column) -> Column:
        after = F.when(F.contains(x, F.lit(":")), F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)).when(F.contains(x, F.lit("—")), F.regexp_extract(x, r"(?s)^[^—]*—(.*)$", 1)).otherwise(x)
        items = F.transform(F.split(F.translate(after, "()", ",,"), "[,|&—]"), X.strip_ws)
        return F.transform(F.filter(items, lambda s: (s != "") & (F.length(s) < 40)), X.strip_bullet)

    return F.array_distinct(F.filter(F.flatten(F.transform(lines, of_line)), lambda s: s != ""))


def skills_in(text: Column) -> Column:
    """Well-known skills named anywhere in a text."""
    named = [F.when(F.regexp_like(text, F.lit(rf"(?i)\b{w}\b")), F.lit("OOP" if w == "oop" else w.capitalize())) for w in SKILL_WORDS]
    return F.filter(F.array(*named), lambda s: s.isNotNull())


def date_span(line: Column) -> Column:
    return F.coalesce(X.first_match(line, MONTH_SPAN), X.first_match(line, YEAR_SPAN))


def is_bullet(line: Column) -> Column:
    return F.substring(line, 1, 1).isin("-", "•", "*")


def opens_job(line: Column) -> Column:
    named = X.let(F.lower(line), lambda low: X.any_of(*[F.contains(low, F.lit(w)) for w in JOB_WORDS]))
    return F.contains(line, F.lit("|")) | (~is_bullet(line) & ((named & (X.word_count(line) < 8)) | date_span(line).isNotNull()))


def _span_dates(span: Column) -> Column:
    """struct(start, end) of a span's two dates; a span without a second one lasts."""
    wide = F.split(span, r"\s*(?:–|—|\bto\b)\s*|\s+-\s+")
    parts = X.let(wide, lambda w: F.when(F.size(w) == 1, F.split(span, "-", 2)).otherwise(w))
    date = lambda p, k: normalize_date(X.strip_ws(F.get(p, k)))
    return X.let(parts, lambda p: F.struct(date(p, 0).alias("start"), F.when(F.size(p) == 1, F.lit("Present")).otherwise(date(p, 1)).alias("end")))


def _opening(line: Column) -> Column:
    """struct(title, company, start, end) of the line that opens a job."""

    def of(f: Column) -> Column:
        span, single = f["span"], f["single"]
        without = lambda c: F.when(span.isNotNull(), X.strip_ws(F.replace(c, span, F.lit("")))).otherwise(c)
        part = lambda k: X.strip_ws(F.get(F.split(line, r"\|"), k))
        barred = F.contains(line, F.lit("|"))
        before = X.strip_ws(F.call_function("substring_index", line, span, F.lit(1)))
        title = F.when(barred, without(part(0))).when(span.isNotNull() & ~is_bullet(line), before).otherwise(line)
        dates = F.when(span.isNotNull(), _span_dates(span)).when(single.isNotNull(), F.struct(normalize_date(single).alias("start"), F.lit("Present").alias("end")))
        return F.struct(X.truthy(X.collapse_ws(title)).alias("title"), X.truthy(X.collapse_ws(F.when(barred, without(part(1))))).alias("company"), dates.alias("dates"))

    return X.let(F.struct(date_span(line).alias("span"), X.first_match(line, ONE_MONTH).alias("single")), of)


def _job(line: Column, rest: Column) -> Column:
    """A job from the line that opens it and the lines that follow."""
    places = F.transform(rest, lambda x, i: F.struct(i.alias("i"), x.alias("x"), X.first_match(x, ONE_MONTH).alias("date")))

    def of(o: Column, ps: Column) -> Column:
        unnamed, undated = F.coalesce(o["company"], F.lit("Unknown")) == "Unknown", X.truthy(o["dates"]["start"]).isNull()
        named = F.get(F.filter(ps, lambda p: unnamed & (X.word_count(p["x"]) < 5) & ~is_bullet(p["x"]) & p["date"].isNull()), 0)
        dated = F.get(F.filter(ps, lambda p: undated & p["date"].isNotNull()), 0)
        return X.let(F.struct(named.alias("named"), dated.alias("dated")), lambda n: whole(o, ps, n["named"], n["dated"]))

    def whole(o: Column, ps: Column, named: Column, dated: Column) -> Column:
        left = F.filter(ps, lambda p: ~p["i"].eqNullSafe(named["i"]) & ~p["i"].eqNullSafe(dated["i"]))
        return job(
            F.coalesce(named["x"], o["company"], F.lit("Unknown")),
            F.coalesce(o["title"], F.lit("Unknown")),
            F.coalesce(dated["date"], o["dates"]["start"]),
            F.when(dated["date"].isNotNull(), F.lit("Present")).otherwise(o["dates"]["end"]),
            F.regexp_replace(F.array_join(F.transform(left, lambda p: X.strip_bullet(p["x"])), "\n"), r"^\n+", ""),
        )

    return X.let(F.struct(_opening(line).alias("o"), places.alias("ps")), lambda v: of(v["o"], v["ps"]))


def parse_experience(lines: Column) -> Column:
    """Jobs of a section's lines; lines before the first job are left out."""

    def jobs(lines: Column) -> Column:
        places = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"), opens_job(x).alias("opens"))), lambda p: p["opens"])
        return X.let(places, lambda ps: between(lines, ps, lambda p, rest: _job(p["x"], rest)))

    return X.let(lines, jobs)


def is_degree(line: Column) -> Column:
    return X.let(F.lower(line), lambda low: X.any_of(*[F.contains(low, F.lit(w)) for w in DEGREE_WORDS]))


def lookahead(lines: Column, flag) -> Column:
    """array<struct<line, next>> of the flagged lines, each of which consumes the line after it.

    In a run of flagged lines those at odd places start an entry, the others are consumed. The flags are one text, in which pairs are
    replaced from the left: one pass over the lines, however many.
    """

    def entries(lines: Column) -> Column:
        flags = F.array_join(F.transform(lines, lambda x: F.when(flag(x), "1").otherwise("0")), "")
        return X.let(F.split(F.replace(flags, F.lit("11"), F.lit("10")), ""), lambda starts: chosen(lines, starts))

    def chosen(lines: Column, starts: Column) -> Column:
        pairs = F.transform(lines, lambda x, i: F.when(F.get(starts, i) == "1", F.struct(x.alias("line"), F.get(lines, i + 1).alias("next"))))
        return F.filter(pairs, lambda p: p.isNotNull())

    return X.let(lines, entries)


def _clean(c: Column) -> Column:
    return X.collapse_ws(F.regexp_replace(X.strip_ws(F.regexp_replace(c, SCORE_TAIL, "")), BARE_NUMBER, ""))


def _last_year(c: Column) -> Column:
    return F.get(F.reverse(F.regexp_extract_all(c, F.lit(YEAR), F.lit(1))), 0).cast("int")


def _school(line: Column, after: Column) -> Column:
    part = lambda sep, k: F.get(F.split(line, rf"\{sep}", 2), k)
    by = lambda k: F.when(F.contains(line, F.lit("–")), part("–", k)).when(F.contains(line, F.lit("-")), part("-", k)).when(F.contains(line, F.lit("|")), part("|", k))
    degree, field = F.coalesce(X.strip_ws(by(0)), line), by(1)
    return school(X.strip_ws(F.get(F.split(after, r"\|"), 0)), _clean(degree), _clean(field), F.coalesce(_last_year(line), _last_year(after)))


def parse_education(lines: Column) -> Column:
    return F.transform(lookahead(lines, is_degree), lambda e: _school(e["line"], e["next"]))
