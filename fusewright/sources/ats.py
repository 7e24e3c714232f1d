"""ATS exports: one JSON object per candidate, under many aliases."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusewright.functions.text import EDGES
from fusewright.plans.staging import spread
from fusewright.settings import Settings
from fusewright.sources.profile import profiles, skill_claims, tagged

SOURCE = "ats_json"
#: The names under which a field may stand, in order.
ALIASES = {
    "full_name": ["candidate_name", "name", "full_name"],
    "emails": ["mail", "email", "email_address", "emails"],
    "phones": ["mobile", "phone", "contact", "phones"],
    "skills": ["skills", "skill_set", "technologies"],
    "location": ["location", "address", "city"],
    "links": ["links", "urls", "github", "linkedin"],
    "headline": ["headline", "title", "designation"],
    "years_experience": ["years_experience", "experience_years", "exp_years"],
    "experience": ["experience", "work_history", "history"],
    "education": ["education", "academic_history"],
}
#: Objects whose fields are hoisted, and the summary of a job made of root fields.
HOISTED = ("contact", "urls", "personal_info", "candidate_info", "profile")
SYNTHESIZED = "Synthesized from root fields"


def clean_json(raw: Column) -> Column:
    """The text without comments and trailing commas; what stands in strings, such as ``https://``, is left alone."""
    string = r'("(?:[^"\\]|\\.)*")'
    bare = F.regexp_replace(raw, rf"(?s){string}|/\*.*?\*/|//[^\n]*", "$1")
    return F.regexp_replace(bare, rf"(?s){string}|,(?=\s*[}}\]])", "$1")


# Expressions are put together as SQL texts: they name the same values often, and a text is read by Spark at once, while a column of
# as many parts takes a call for each of them. Names of lambda variables are those of the helpers' own.


def _let(value: str, name: str, body: str) -> str:
    """``body`` with the value worked out once under a name."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _is(v: str, kind: str) -> str:
    return f"coalesce(regexp_extract(schema_of_variant({v}), '^[A-Z]+', 0) = '{kind}', false)"


def _map(v: str) -> str:
    return f"try_variant_get({v}, '$', 'map<string,variant>')"


def _list(v: str) -> str:
    return f"try_variant_get(CASE WHEN {_is(v, 'ARRAY')} THEN {v} END, '$', 'array<variant>')"


#: The text of a scalar ``v``; null for lists, objects and nulls, and for what counts as false.
_SCALAR = """get(transform(array(named_struct('kind', regexp_extract(schema_of_variant(v), '^[A-Z]+', 0), 'text', try_variant_get(v, '$', 'string'))), x ->
    CASE WHEN x.kind NOT IN ('ARRAY', 'OBJECT', 'VOID') AND NOT coalesce(x.kind = 'BOOLEAN' AND x.text = 'false' OR x.kind <> 'STRING' AND try_cast(x.text AS DOUBLE) = 0, false) THEN nullif(x.text, '') END), 0)"""


def _text(v: str) -> str:
    return f"get(transform(array({v}), v -> {_SCALAR}), 0)"


def _scalars(m: str) -> str:
    """The texts of a map's scalars, each worked out once, by name."""
    return f"transform_values({m}, (k, v) -> {_SCALAR})"


def _stated(values: str) -> str:
    return f"filter(transform({values}, v -> {_SCALAR}), s -> s IS NOT NULL)"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, r'{EDGES}', '')"


def _some(array: str) -> str:
    return _let(array, "some", "CASE WHEN size(some) > 0 THEN some END")


def _texts(v: str) -> str:
    """A string, or another scalar, as a list of one; a list without what is empty; all stripped."""
    every = f"CASE WHEN {_is(v, 'ARRAY')} THEN {_list(v)} ELSE array({v}) END"
    return _some(f"transform({_stated(every)}, s -> {_strip('s')})")


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', CAST({v} AS STRING)" for k, v in fields.items()) + ")"


def _first(texts: str, *names: str) -> str:
    return "coalesce(" + ", ".join(f"{texts}['{n}']" for n in names) + ")"


def _by_presence(m: str, field: str) -> str:
    """The first alias that is present, even if its value is null."""
    return "CASE " + " ".join(f"WHEN map_contains_key({m}, '{a}') THEN {m}['{a}']" for a in ALIASES[field]) + " END"


def _flat(m: str) -> str:
    """Hoists nested objects; what stands at the root, or was hoisted before, is not overwritten."""
    for n, name in enumerate(HOISTED):
        have = f"have{n}"
        at = f"{have}['{name}']"
        lacking = f"map_concat({have}, map_filter(more, (k, v) -> NOT map_contains_key({have}, k)))"
        inner = _map(f"CASE WHEN {_is(at, 'OBJECT')} THEN {at} END")
        m = _let(m, have, _let(inner, "more", f"CASE WHEN more IS NOT NULL THEN {lacking} ELSE {have} END"))
    return m


def _location(v: str) -> str:
    inside = f"CASE WHEN size(t) > 0 THEN {_struct(city=_first('t', 'city', 'town'), region=_first('t', 'region', 'state'), country="t['country']")} END"
    parts = f"transform(split(s, ','), part -> {_strip('part')})"
    split = f"CASE WHEN size(parts) >= 2 THEN {_struct(city='get(parts, 0)', region='NULL', country='get(parts, size(parts) - 1)')} WHEN s IS NOT NULL THEN {_struct(city='s', region='NULL', country='NULL')} END"
    return f"CASE WHEN {_is(v, 'OBJECT')} THEN {_let(_scalars(_map(v)), 't', inside)} WHEN {_is(v, 'STRING')} THEN {_let(_text(v), 's', _let(parts, 'parts', split))} END"


def _links(v: str, t: str) -> str:
    def build(linkedin: str, github: str, portfolio: str, other: str) -> str:
        return f"named_struct('linkedin', {linkedin}, 'github', {github}, 'portfolio', CAST({portfolio} AS STRING), 'other', {other})"

    none = "CAST(array() AS ARRAY<STRING>)"
    linkedin, github = "contains(u, 'linkedin.com')", "contains(u, 'github.com')"
    last = lambda which: f"get(reverse(filter(l, u -> {which})), 0)"
    listed = build(last(linkedin), last(f"{github} AND NOT {linkedin}"), "NULL", f"filter(l, u -> NOT {linkedin} AND NOT {github})")
    other = _stated(_list("o['other']"))
    stated = _let(_scalars("o"), "s", build("s['linkedin']", "s['github']", "s['portfolio']", f"coalesce({other}, {none})"))
    root = f"named_struct('l', {_first(t, 'linkedin', 'linkedin_url')}, 'g', {_first(t, 'github', 'github_url')})"
    of_root = _let(root, "r", f"CASE WHEN coalesce(r.l, r.g) IS NOT NULL THEN {build('r.l', 'r.g', 'NULL', none)} END")
    return f"CASE WHEN {_is(v, 'OBJECT')} THEN {_let(_map(v), 'o', stated)} WHEN {_is(v, 'ARRAY')} THEN {_let(_stated(_list(v)), 'l', listed)} ELSE {of_root} END"


def _experience(v: str, t: str) -> str:
    one = _struct(company=_first("e", "company", "employer"), title=_first("e", "title", "role"), start=_first("e", "start", "start_date"), end=_first("e", "end", "end_date"), summary=_first("e", "summary", "description"))
    jobs = _some(f"transform(filter(l, j -> {_is('j', 'OBJECT')}), j -> {_let(_scalars(_map('j')), 'e', one)})")
    root = f"named_struct('c', {_first(t, 'current_company', 'company')}, 't', {_first(t, 'title', 'role')})"
    made = f"array({_struct(company='r.c', title='r.t', start='NULL', end='NULL', summary=repr(SYNTHESIZED))})"
    of_root = _let(root, "r", f"CASE WHEN coalesce(r.c, r.t) IS NOT NULL THEN {made} END")
    return _let(_list(v), "l", f"CASE WHEN size(l) > 0 THEN {jobs} ELSE {of_root} END")


def _education(v: str) -> str:
    at = "m['end_year']"
    year = f"CASE WHEN {_is(at, 'STRING')} THEN try_cast({_strip(_text(at))} AS INT) ELSE CAST(try_variant_get({at}, '$', 'double') AS INT) END"
    names = {"institution": _first("t", "institution", "school", "college"), "degree": "t['degree']", "field": _first("t", "field", "major", "field_of_study")}
    one = "named_struct(" + ", ".join(f"'{k}', {x}" for k, x in names.items()) + f", 'end_year', {year})"
    return _some(f"transform(filter({_list(v)}, j -> {_is('j', 'OBJECT')}), j -> {_let(_map('j'), 'm', _let(_scalars('m'), 't', one))})")


def _number(v: str) -> str:
    text = _strip(f"try_variant_get({v}, '$', 'string')")
    return f"CASE WHEN regexp_extract(schema_of_variant({v}), '^[A-Z]+', 0) NOT IN ('ARRAY', 'OBJECT', 'VOID') THEN try_cast({text} AS DOUBLE) END"


def parse_ats(frame: DataFrame, raw: str = "raw", key: str = "candidate_key", settings: Settings | None = None, lenient: bool = False) -> DataFrame:
    """Profiles of JSON texts in the column ``raw``; ``lenient`` also takes comments and trailing commas."""
    settings = settings or Settings()
    # rows are spread before they are parsed
    frame = spread(frame.select(F.col(key).alias("key"), F.col(raw).alias("raw")))
    text = clean_json(F.col("raw")) if lenient else F.col("raw")
    # each step is a projection of its own, so that nothing is parsed or looked up twice
    parsed = frame.select("key", F.try_parse_json(text).alias("json")).selectExpr("key", f"{_map('json')} AS root").selectExpr("key", "root", f"{_flat('root')} AS m")
    found = parsed.selectExpr("key", "root", f"{_scalars('m')} AS texts", *[f"{_by_presence('m', f)} AS at_{f}" for f in ALIASES])
    split = f"filter(transform(split({_text('at_skills')}, ','), part -> {_strip('part')}), part -> part <> '')"
    values = {
        "full_name": _text("at_full_name"),
        "headline": _text("at_headline"),
        "years_experience": _number("at_years_experience"),
        "location": _location("at_location"),
        "links": _links("at_links", "texts"),
        "emails": _texts("at_emails"),
        "phones": f"CASE WHEN NOT {_is('at_phones', 'OBJECT')} THEN {_texts('at_phones')} END",
        "names": f"CASE WHEN {_is('at_skills', 'STRING')} THEN {split} ELSE {_stated(_list('at_skills'))} END",
        "experience": _experience("at_experience", "texts"),
        "education": _education("at_education"),
    }
    found = found.selectExpr("key", "root", *[f"{v} AS {k}" for k, v in values.items()])
    conf = settings.ats_confidence
    tag = lambda v: tagged(v, conf, SOURCE)
    parts = {k: tag(F.col(k)) for k in ("full_name", "headline", "years_experience", "location", "links", "emails", "phones")}
    parts |= {"skills": skill_claims(F.col("names"), conf, SOURCE), "experience": F.col("experience"), "education": F.col("education")}
    error = F.when(F.col("root").isNull(), F.lit("not a JSON object"))
    return profiles(found, "key", SOURCE, settings.ord(SOURCE), parts, error)
