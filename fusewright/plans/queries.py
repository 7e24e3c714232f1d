"""The driver's queries for the fusion operators, over its tables, with the same in SQL for DuckDB.

"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fusewright.functions import normalize as N
from fusewright.functions import phones as P
from fusewright.functions import text as X
from fusewright.operators import fuse as FU
from fusewright.operators import sections as S
from fusewright.operators.project import project, project_json
from fusewright.operators.validate import accepted, validate, validate_projected
from fusewright.plans.display import cards, grid, percent
from fusewright.plans.staging import new_folder
from fusewright.schema import EDUCATION, PROFILE_FIELDS
from fusewright.settings import Settings
from fusewright.sources import store
from fusewright.sources.ats import clean_json, parse_ats
from fusewright.sources.github import discovered_urls, parse_github
from fusewright.sources.linkedin import parse_linkedin
from fusewright.sources.notes import parse_notes
from fusewright.sources.profile import job, profiles, school, skill_claims, tagged, union_sources
from fusewright.sources.recruiter_csv import parse_csv
from fusewright.sources.resume import parse_resumes

SETTINGS = Settings()
EVENTS = ("click", "error", "purchase", "signup", "view")
QUERIES: dict[str, object] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def joined(c: Column, separator: str = "|") -> Column:
    return F.array_join(c, separator)


# ---------------------------------------------------------------------------------------------- text and normalisers

CLOSED = r"""regexp_replace(regexp_replace(text, '\s*@\s*', '@', 'g'), '(?i)\s*\.\s*(com|org|net|edu|gov|in|io|co|info|me)\b', '.\1', 'g')"""


@query("extract_emails", rf"""
SELECT doc_id, array_to_string(list_sort(list_distinct(e)), '|') AS emails
FROM (SELECT doc_id, regexp_extract_all({CLOSED}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}') AS e FROM documents) WHERE len(e) > 0
""")
def extract_emails(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", X.extract_emails(F.col("text")).alias("e"))
    return found.where(F.size("e") > 0).select("doc_id", joined(F.array_sort("e")).alias("emails"))


@query("extract_phones", r"""
SELECT doc_id, array_to_string(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), '|') AS phones
FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '\+?\d[\d\s\-().]{8,14}\d'),
  lambda x: length(regexp_replace(x, '[^\d+]', '', 'g')) BETWEEN 10 AND 15) AS p FROM documents) WHERE len(p) > 0
""")
def extract_phones(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", X.extract_phones(F.col("text")).alias("p"))
    return found.where(F.size("p") > 0).select("doc_id", joined(F.col("p")).alias("phones"))


@query("extract_links", r"""
WITH u AS (SELECT page_id, list_transform(list_concat(regexp_extract_all(url, 'https?://[^\s|]+|[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}/[^\s|]+'),
  []::VARCHAR[]), lambda x: rtrim(x, '.,;|)')) AS l FROM (SELECT page_id, url || ' https://www.linkedin.com/in/p' || page_id || ', github.com/u' || page_id AS url FROM pages))
SELECT page_id, list_filter(l, lambda x: contains(lower(x), 'linkedin.com'))[1] AS linkedin,
  list_filter(l, lambda x: contains(lower(x), 'github.com'))[1] AS github,
  array_to_string(list_filter(l, lambda x: NOT contains(lower(x), 'linkedin.com') AND NOT contains(lower(x), 'github.com')), '|') AS other FROM u
""")
def extract_links(spark, sf):
    text = F.concat("url", F.lit(" https://www.linkedin.com/in/p"), "page_id", F.lit(", github.com/u"), "page_id")
    found = table(spark, sf, "pages").select("page_id", X.extract_links(text).alias("l"))
    return found.select("page_id", "l.linkedin", "l.github", joined(F.col("l.other")).alias("other"))


PHONE_INPUT = "CASE c_custkey % 5 WHEN 0 THEN '98' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 1 THEN '91 98' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 2 THEN '+44 (20) 7' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') WHEN 3 THEN '098-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') ELSE CAST(c_custkey AS VARCHAR) END"


@query("normalize_phone", rf"""
WITH p AS (SELECT c_custkey, {PHONE_INPUT} AS raw FROM customer), k AS (SELECT *, regexp_replace(raw, '[^\d+]', '', 'g') AS d FROM p)
SELECT c_custkey, CASE WHEN d LIKE '+44%' AND length(d) BETWEEN 9 AND 16 THEN d WHEN regexp_matches(d, '^0[6-9]\d{{9}}$') THEN '+91' || substr(d, 2)
  WHEN d LIKE '91%' AND length(d) = 12 THEN '+' || d WHEN length(d) = 10 THEN '+91' || d ELSE raw END AS phone FROM k
""")
def normalize_phone(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", N.normalize_phone(F.expr(PHONE_INPUT.replace("VARCHAR", "STRING"))).alias("phone"))


PLAN_SQL = "plan(code, least, most, leads) AS (VALUES " + ", ".join("('{}', {}, {}, '{}')".format(*row.split()) for row in P.PLAN.strip().splitlines()) + ")"


def e164_sql(given: str) -> str:
    """CTEs from ``given`` (id, i, j, raw) to ``numbered`` (the same and e164), by the table of the plan."""
    fits = lambda code, national: f"length({national}) BETWEEN coalesce(p.least, 5) AND coalesce(p.most, 12) AND contains(coalesce(p.leads, '0123456789'), substr({national}, 1, 1))"
    return rf"""
k AS (SELECT *, regexp_replace(raw, '[^\d+]', '', 'g') AS kept FROM {given}),
a AS (SELECT *, CASE WHEN regexp_matches(kept, '^\+\d+$') THEN substr(kept, 2) WHEN regexp_matches(kept, '^00\d+$') THEN substr(kept, 3) END AS abroad, CASE WHEN regexp_matches(kept, '^\d+$') AND NOT kept LIKE '00%' THEN kept END AS home FROM k),
c AS (SELECT *, regexp_extract(abroad, '^(?:{P.CALLING_CODE})') AS code FROM a),
r AS (SELECT *, CASE WHEN code <> '39' AND substr(abroad, length(code) + 1, 1) = '0' THEN substr(abroad, length(code) + 2) ELSE substr(abroad, length(code) + 1) END AS rest, CASE WHEN home LIKE '0%' THEN substr(home, 2) ELSE home END AS near FROM c),
numbered AS (SELECT id, i, j, raw, CASE WHEN abroad IS NOT NULL THEN CASE WHEN r.code <> '' AND {fits("r.code", "rest")} AND (r.code <> '1' OR (regexp_matches(rest, '^[2-9]\d\d[2-9]\d{{6}}$') AND substr(rest, 2, 2) <> '11' AND substr(rest, 1, 3) <> '555' AND substr(rest, 5, 2) <> '11')) THEN '+' || r.code || rest END
  WHEN regexp_matches(near, '^[1-9]\d{{9}}$') THEN '+91' || near WHEN regexp_matches(home, '^91[1-9]\d{{9}}$') THEN '+' || home END AS e164 FROM r LEFT JOIN plan p ON p.code = r.code)"""


PLAN_INPUT = (
    "CASE c_custkey % 9 WHEN 0 THEN concat('+1 (', 200 + c_custkey % 700, ') ', 100 + c_custkey % 899, '-', 1000 + c_custkey % 9000) WHEN 1 THEN concat('0044 20 7', 1000000 + c_custkey) WHEN 2 THEN concat('+65 ', 10000000 + c_custkey * 577) "
    "WHEN 3 THEN concat('0', 22000 + c_custkey % 60000, '-', 10000 + c_custkey % 89999) WHEN 4 THEN concat('+49 (0)30 ', c_custkey) WHEN 5 THEN concat('+', c_custkey * 7919, '12345') WHEN 6 THEN concat('91', 9000000000 + c_custkey) WHEN 7 THEN concat('+39 0', 100000 + c_custkey) ELSE concat('x', c_custkey) END"
)


@query("phone_plan", rf"""
WITH {PLAN_SQL}, given AS (SELECT c_custkey AS id, 0 AS i, 0 AS j, {PLAN_INPUT} AS raw FROM customer), {e164_sql("given")}
SELECT id AS c_custkey, raw, e164 IS NOT NULL AS valid,
  coalesce(e164, CASE WHEN d LIKE '91%' AND length(d) = 12 THEN '+' || d WHEN length(d) = 10 THEN '+91' || d ELSE raw END) AS phone FROM (SELECT *, regexp_replace(raw, '[^\d+]', '', 'g') AS d FROM numbered)
""")
def phone_plan(spark, sf):
    given = table(spark, sf, "customer").select("c_custkey", F.expr(PLAN_INPUT).alias("raw"))
    return given.select("c_custkey", "raw", P.e164(F.col("raw")).isNotNull().alias("valid"), N.normalize_phone(F.col("raw")).alias("phone"))


@query("match_phones", rf"""
WITH {PLAN_SQL}, runs AS (SELECT doc_id, regexp_extract_all(text, '{P.CANDIDATE}', 2) AS r, regexp_extract_all(text, '{P.CANDIDATE}', 3) AS after FROM documents),
one AS (SELECT doc_id AS id, i, r[i] AS run FROM (SELECT doc_id, r, after, unnest(range(1, len(r) + 1)) AS i FROM runs) WHERE after[i] = ''),
given AS (SELECT id, i, 0 AS j, run AS raw FROM one UNION ALL SELECT id, i, j, s[j] FROM (SELECT id, i, s, unnest(range(1, len(s) + 1)) AS j FROM (SELECT id, i, regexp_split_to_array(run, ' +') AS s FROM one))), {e164_sql("given")},
v AS (SELECT id, i, j, e164, bool_or(j = 0) OVER (PARTITION BY id, i) AS whole FROM numbered WHERE e164 IS NOT NULL),
f AS (SELECT id, e164, min(i * 1000 + j) AS place FROM v WHERE j = 0 OR NOT whole GROUP BY ALL)
SELECT id AS doc_id, string_agg(e164, '|' ORDER BY place) AS phones FROM f GROUP BY id
""")
def match_phones(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", P.matched_phones(F.col("text")).alias("p"))
    return found.where(F.size("p") > 0).select("doc_id", joined(F.col("p")).alias("phones"))


DATE_INPUT = "CASE o_orderkey % 7 WHEN 0 THEN {month} WHEN 1 THEN {slash} WHEN 2 THEN {year} WHEN 3 THEN 'Currently here' WHEN 4 THEN ' soon ' WHEN 5 THEN {day} ELSE '' END"
NORMAL_DATE = r"""CASE WHEN raw = '' THEN NULL WHEN contains(d, 'present') OR contains(d, 'current') THEN 'Present' WHEN y = '' THEN d
  ELSE y || '-' || lpad(coalesce(CAST((SELECT min(i) FROM range(1, 13) r(i) WHERE contains(d, ['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'][i])) AS VARCHAR),
    nullif(ltrim(regexp_extract(d, '\b(0?[1-9]|1[0-2])\b', 1), '0'), ''), '1'), 2, '0') END"""


@query("normalize_date", rf"""
WITH i AS (SELECT o_orderkey, {DATE_INPUT.format(month="strftime(o_orderdate, '%b %Y')", slash="strftime(o_orderdate, '%m/%Y')", year="strftime(o_orderdate, '%Y')", day="strftime(o_orderdate, '%d/%m/%Y')")} AS raw FROM orders),
d AS (SELECT *, trim(lower(raw)) AS d, regexp_extract(lower(raw), '\b(20\d{{2}}|19\d{{2}})\b', 1) AS y FROM i)
SELECT o_orderkey, {NORMAL_DATE} AS normal FROM d
""")
def normalize_date(spark, sf):
    raw = DATE_INPUT.format(month="date_format(o_orderdate, 'MMM yyyy')", slash="date_format(o_orderdate, 'MM/yyyy')", year="date_format(o_orderdate, 'yyyy')", day="date_format(o_orderdate, 'dd/MM/yyyy')")
    return table(spark, sf, "orders").select("o_orderkey", N.normalize_date(F.expr(raw)).alias("normal"))


SKILL_INPUT = "CASE p_partkey % 6 WHEN 0 THEN ' PY ' WHEN 1 THEN 'html5' WHEN 2 THEN 'Object-Oriented Programming' WHEN 3 THEN 'JS' ELSE concat(' ', p_name) END"


@query("normalize_skill", f"SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Python' WHEN 1 THEN 'HTML' WHEN 2 THEN 'OOP' WHEN 3 THEN 'JavaScript' ELSE trim(p_name) END AS skill FROM (SELECT *, {SKILL_INPUT} AS raw FROM part)")
def normalize_skill(spark, sf):
    return table(spark, sf, "part").select("p_partkey", N.normalize_skill(F.expr(SKILL_INPUT)).alias("skill"))


@query("normalize_country", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'IN' WHEN 1 THEN 'GB' WHEN 2 THEN 'NA' ELSE NULL END AS country FROM nation")
def normalize_country(spark, sf):
    raw = F.expr("CASE n_nationkey % 4 WHEN 0 THEN ' India ' WHEN 1 THEN 'uk' WHEN 2 THEN lower(n_name) ELSE '' END")
    return table(spark, sf, "nation").select("n_nationkey", N.normalize_country(raw).alias("country"))


@query("candidate_id", "SELECT c_custkey, md5(lower(trim(c_name))) AS candidate_id FROM customer")
def candidate_id(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", FU.candidate_id(F.lit(None).cast("string"), F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("candidate_id"))


@query("title_case", r"""SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || '''' || 'Neil-Smith ' || 'X2Y' AS title,
  upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS capital FROM customer""")
def title_case(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.title_case(F.concat("c_mktsegment", F.lit("'NEIL-smith x2y"))).alias("title"), X.capitalize(F.col("c_mktsegment")).alias("capital"))


@query("ui_percent", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_discount * 100) AS INTEGER) AS pct FROM lineitem")
def ui_percent(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", percent(F.col("l_discount")).alias("pct"))


# ---------------------------------------------------------------------------------------------------------- sources


@query("source_ats", r"""SELECT CAST(c_custkey AS VARCHAR) AS candidate_key, c_name AS full_name, lower(c_mktsegment) || '@x.com' AS email, '+9198' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS phone,
  CASE WHEN c_custkey % 2 = 0 THEN 'Pune' ELSE 'Berlin' END AS city, CASE WHEN c_custkey % 2 = 0 THEN 'IN' ELSE 'DE' END AS country,
  c_acctbal AS years, CASE WHEN c_custkey % 2 = 0 THEN 'Python,SQL' ELSE 'Java,Rust' END AS skills, c_mktsegment AS company, 'Synthesized from root fields' AS summary FROM customer""")
def source_ats(spark, sf):
    even = F.col("c_custkey") % 2 == 0
    raw = F.concat(
        F.lit('{ // a comment, and https://x.y in a string below\n "name":"'), "c_name", F.lit('", "site":"https://x.y", "contact":{"mail":"'), "c_mktsegment", F.lit('@X.com","mobile":"98'), F.lpad(F.col("c_custkey").cast("string"), 8, "0"),
        F.lit('"},"years_experience":'), F.col("c_acctbal").cast("decimal(20,2)").cast("string"), F.lit(',"company":"'), "c_mktsegment",
        F.when(even, F.lit('","location":"Pune, India","skills":["py","sql"],}')).otherwise(F.lit('","location":{"town":"Berlin","country":"germany"},"skills":"java, Rust"}')),
    )
    found = N.normalize_profile(parse_ats(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("candidate_key"), raw.alias("raw")), lenient=True))
    first = F.get("experience", 0)
    return found.select("candidate_key", F.col("full_name.value").alias("full_name"), F.get("emails.value", 0).alias("email"), F.get("phones.value", 0).alias("phone"), F.col("location.value.city").alias("city"), F.col("location.value.country").alias("country"), F.col("years_experience.value").alias("years"), joined(F.transform("skills", lambda s: s["name"]), ",").alias("skills"), first["company"].alias("company"), first["summary"].alias("summary"))


@query("source_csv", "SELECT CAST(s_suppkey AS VARCHAR) AS candidate_key, s_name AS full_name, 's' || s_suppkey || '@x.com' AS email, CASE WHEN s_suppkey % 3 > 0 THEN 'N' || s_nationkey END AS headline, CASE WHEN s_suppkey % 3 > 0 THEN 'N' || s_nationkey END AS title, 'C' || s_nationkey AS company FROM supplier")
def source_csv(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("candidate_key"), F.lit("").alias(" Name "), F.col("s_name").alias("Full_Name"), F.concat(F.lit(" s"), "s_suppkey", F.lit("@x.com ")).alias("EMAIL"), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("N"), "s_nationkey")).otherwise("").alias("title"), F.concat(F.lit("C"), "s_nationkey").alias("current_company"))
    found = parse_csv(rows, "candidate_key")
    first = F.get("experience", 0)
    return found.select("candidate_key", F.col("full_name.value").alias("full_name"), F.get("emails.value", 0).alias("email"), F.col("headline.value").alias("headline"), first["title"].alias("title"), first["company"].alias("company"))


@query("source_notes", """SELECT CAST(c_custkey AS VARCHAR) AS candidate_key, c_name AS full_name, lower(c_mktsegment) || ' lead' AS headline, 'Chennai' AS city, 'India' AS country, CAST(c_nationkey AS DOUBLE) + 0.5 AS years,
  'Python|Go|' || c_mktsegment AS skills, 'c' || c_custkey || '@x.org' AS email FROM customer""")
def source_notes(spark, sf):
    text = F.concat(F.lit("Candidate: "), "c_name", F.lit("\nCurrent Role: "), F.lower("c_mktsegment"), F.lit(" lead\nLocation: Chennai, India\nEmail: c"), "c_custkey", F.lit(" @ x . org\nSkills: Python, Go & "), "c_mktsegment", F.lit("\nExperience: "), "c_nationkey", F.lit(".5 years of experience."))
    found = parse_notes(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("candidate_key"), text.alias("text")))
    return found.select("candidate_key", F.col("full_name.value").alias("full_name"), F.col("headline.value").alias("headline"), F.substring_index(F.col("location.value.city"), "\n", -1).alias("city"), F.col("location.value.country").alias("country"), F.col("years_experience.value").alias("years"), joined(F.transform("skills", lambda s: s["name"])).alias("skills"), F.get("emails.value", 0).alias("email"))


@query("source_linkedin", "SELECT CAST(s_suppkey AS VARCHAR) AS candidate_key, CASE WHEN s_suppkey % 4 > 0 THEN 'Jane Q Doe' END AS full_name, CASE WHEN s_suppkey % 4 > 0 THEN 0.4 END AS confidence, CASE WHEN s_suppkey % 4 > 0 THEN 'https://LinkedIn.com/in/jane-q-doe-b' || s_suppkey END AS linkedin FROM supplier")
def source_linkedin(spark, sf):
    url = F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("https://LinkedIn.com/in/jane-q-doe-b"), "s_suppkey")).otherwise(F.lit("https://example.com/in/jane"))
    found = parse_linkedin(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("candidate_key"), url.alias("url")))
    return found.select("candidate_key", F.col("full_name.value").alias("full_name"), F.col("full_name.confidence").cast("decimal(2,1)").alias("confidence"), F.col("links.value.linkedin").alias("linkedin"))


@query("source_github", """
WITH r AS (SELECT l_suppkey, l_returnflag || l_linestatus AS language, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem),
s AS (SELECT l_suppkey, array_to_string(list_sort(list_distinct(list(language))), '|') AS skills FROM r WHERE n <= 10 GROUP BY 1)
SELECT CAST(s_suppkey AS VARCHAR) AS candidate_key, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS full_name, 'https://github.com/user' || s_suppkey AS github, skills FROM supplier LEFT JOIN s ON l_suppkey = s_suppkey
""")
def source_github(spark, sf):
    supplier = table(spark, sf, "supplier")
    login = F.concat(F.lit("User"), "s_suppkey")
    users = supplier.where("s_suppkey % 3 > 0").select(login.alias("login"), F.col("s_name").alias("name"), *[F.lit("").alias(c) for c in ("bio", "email", "location", "blog")])
    order = F.col("l_orderkey") * 10**9 + F.col("l_linenumber") * 10**8 + F.col("l_partkey")
    repos = table(spark, sf, "lineitem").select(F.concat(F.lit("user"), "l_suppkey").alias("login"), order.alias("position"), F.concat("l_returnflag", "l_linestatus").alias("language"))
    found = parse_github(supplier.select(F.col("s_suppkey").cast("string").alias("candidate_key"), F.concat(F.lit("https://github.com/user"), "s_suppkey").alias("url")), users, repos)
    skills = F.when(F.col("skills").isNotNull(), joined(F.array_sort(F.transform("skills", lambda s: s["name"]))))
    return found.select("candidate_key", F.col("full_name.value").alias("full_name"), F.col("links.value.github").alias("github"), skills.alias("skills"))


@query("json_cleanup", """SELECT c_custkey, '{"u":"https://x/*y*/","n":[' || c_custkey || ']}' AS cleaned FROM customer""")
def json_cleanup(spark, sf):
    raw = F.concat(F.lit('{"u":"https://x/*y*/",/* a\nb */"n":['), "c_custkey", F.lit(",],}// end"))
    return table(spark, sf, "customer").select("c_custkey", clean_json(raw).alias("cleaned"))


@query("resume_profile", """
SELECT CAST(c_custkey AS VARCHAR) AS candidate_key, 'resume_txt' AS source, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Doe' AS full_name, 'Engineer ' || c_nationkey AS headline,
  'c' || c_custkey || '@x.com' AS email, 'Pune' AS city, 'IN' AS country, 'Python|SQL|T' || c_nationkey AS skills, 'Acme ' || c_custkey AS company, '2020-0' || (1 + c_custkey % 9) AS start,
  round((12 - c_custkey % 9) / 12.0, 2) AS years, 'College ' || c_nationkey AS institution, 'B.Tech' AS degree, 'Physics' AS field, CAST(2000 + c_custkey % 20 AS INTEGER) AS end_year FROM customer
""")
def resume_profile(spark, sf):
    text = F.concat(
        F.upper("c_mktsegment"), F.lit(" DOE\nEngineer "), "c_nationkey", F.lit("\nPune, India | c"), "c_custkey", F.lit("@x.com\n\nSkills\nLanguages: python, sql & T"), "c_nationkey",
        F.lit("\nWORK EXPERIENCE\nData Analyst | Acme "), "c_custkey", F.lit(" | "), F.element_at(F.array(*[F.lit(m) for m in ("Jan", "Feb", "March", "Apr", "May", "June", "Jul", "Aug", "Sep")]), (F.col("c_custkey") % 9 + 1).cast("int")),
        F.lit(" 2020 - Dec 2020\n- did things\nEDUCATION\nB.Tech - Physics CGPA 8.1\nCollege "), "c_nationkey", F.lit(" | 1990 - "), (F.lit(2000) + F.col("c_custkey") % 20).cast("string"), F.lit("\n"),
    )
    raw = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("candidate_key"), text.alias("text"), F.lit("txt").alias("ext"))
    found = N.normalize_profile(parse_resumes(raw))
    job_, school_ = F.get("experience", 0), F.get("education", 0)
    return found.select(
        "candidate_key", "source", F.col("full_name.value").alias("full_name"), F.col("headline.value").alias("headline"), F.get("emails.value", 0).alias("email"), F.col("location.value.city").alias("city"), F.col("location.value.country").alias("country"),
        joined(F.transform("skills", lambda s: s["name"])).alias("skills"), job_["company"].alias("company"), job_["start"].alias("start"), F.col("years_experience.value").alias("years"), school_["institution"].alias("institution"), school_["degree"].alias("degree"), school_["field"].alias("field"), school_["end_year"].alias("end_year"),
    )


@query("display_cards", "SELECT md5(c_name) AS candidate_id, coalesce(nullif(c_name, 'Customer#000000003'), '—') AS name, CASE WHEN c_custkey % 3 > 0 THEN 'City' || c_nationkey ELSE '—' END AS place, CAST(trunc(c_nationkey / 100.0::DOUBLE * 100) AS INTEGER) AS confidence_percent FROM customer")
def display_cards(spark, sf):
    return cards(customer_records(spark, sf).withColumns({"years_experience": F.lit(None).cast("double"), "education": F.array().cast(EDUCATION)})).select("candidate_id", "name", "place", "confidence_percent")


# --------------------------------------------------------------------------------------------------------- sections

LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query("section_segment", rf"""
WITH l AS (SELECT doc_id, unnest({LINES}) AS x, generate_subscripts({LINES}, 1) AS i FROM documents),
f AS (SELECT *, CASE WHEN length(x) < 40 THEN 'SHORT' WHEN contains(x, '|') THEN 'BARS' END AS name FROM l),
g AS (SELECT *, count(name) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM f),
b AS (SELECT doc_id, block, max(name) AS name, count(*) FILTER (WHERE name IS NULL) AS n, md5(coalesce(string_agg(x, '~' ORDER BY i) FILTER (WHERE name IS NULL), '')) AS digest FROM g GROUP BY ALL)
SELECT doc_id, CAST(block AS BIGINT) AS block, coalesce(name, 'HEADER') AS name, n AS n_lines, digest FROM b WHERE n > 0
""")
def section_segment(spark, sf):
    label = lambda x: F.when(F.length(x) < 40, "SHORT").when(F.contains(x, F.lit("|")), "BARS")
    lines = table(spark, sf, "documents").select("doc_id", X.lines_of(F.col("text")).alias("l"))
    blocks = lines.select("doc_id", F.posexplode(S.cut_at(F.col("l"), label)).alias("block", "b"))
    return blocks.where(F.size("b.body") > 0).select("doc_id", F.col("block").cast("long").alias("block"), "b.name", F.size("b.body").cast("long").alias("n_lines"), F.md5(joined(F.col("b.body"), "~")).alias("digest"))


def _whole_talks(spark, sf) -> DataFrame:
    """(conv_id, lines): each turn's role and whole text, in order; a missing role or text is empty."""
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("x")
    turns = table(spark, sf, "conversations").select("conv_id", F.struct("turn", line).alias("t"))
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["x"]).alias("l"))


@query("experience_sessionize_whole", """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') || ' ' || coalesce(text, '') AS x, coalesce(role = 'user', false) AS opens FROM conversations),
g AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn, x ROWS UNBOUNDED PRECEDING) AS entry FROM t)
SELECT conv_id, CAST(entry AS BIGINT) AS entry, max(x) FILTER (WHERE opens) AS first, count(*) FILTER (WHERE NOT opens) AS n_rest, coalesce(string_agg(x, '~' ORDER BY turn, x) FILTER (WHERE NOT opens), '') AS rest
FROM g WHERE entry > 0 GROUP BY ALL
""")
def experience_sessionize_whole(spark, sf):
    label = lambda x: F.when(x.startswith("user "), x)
    blocks = _whole_talks(spark, sf).select("conv_id", F.posexplode(S.cut_at(F.col("l"), label)).alias("entry", "b")).where("entry > 0")
    return blocks.select("conv_id", F.col("entry").cast("long").alias("entry"), F.col("b.name").alias("first"), F.size("b.body").cast("long").alias("n_rest"), joined(F.col("b.body"), "~").alias("rest"))


@query("education_lookahead_whole", """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') || ' ' || coalesce(text, '') AS x, coalesce(role <> 'assistant', true) AS flag FROM conversations),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, x) AS i FROM t),
r AS (SELECT *, i - max(CASE WHEN NOT flag THEN i ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS k, lead(x) OVER (PARTITION BY conv_id ORDER BY i) AS after FROM i)
SELECT conv_id, x AS line, after FROM r WHERE flag AND k % 2 = 1
""")
def education_lookahead_whole(spark, sf):
    found = _whole_talks(spark, sf).select("conv_id", F.explode(S.lookahead(F.col("l"), lambda x: ~x.startswith("assistant "))).alias("e"))
    return found.select("conv_id", "e.line", F.col("e.next").alias("after"))


@query("parse_skills_section", "SELECT p_partkey, 'Java|' || p_name || '|CSS|' || p_brand AS skills FROM part")
def parse_skills_section(spark, sf):
    line = F.concat(F.lit("Languages: Java, "), "p_name", F.lit(" (CSS) | * "), "p_brand", F.lit(" & Java"))
    return table(spark, sf, "part").select("p_partkey", joined(S.parse_skills(F.array(line, F.lit("—")))).alias("skills"))


@query("parse_experience_section", """
SELECT o_orderkey, 'Data Analyst' AS title, 'Acme ' || o_custkey AS company, strftime(o_orderdate, '%Y-%m') AS start, 'Present' AS end_, 'built ' || o_orderpriority || chr(10) || 'ran ' || o_orderstatus AS summary, 2 AS n FROM orders
""")
def parse_experience_section(spark, sf):
    month = F.date_format("o_orderdate", "MMMM yyyy")
    lines = F.array(F.lit("left out"), F.concat(F.lit("Data   Analyst "), month, F.lit(" – Present")), F.concat(F.lit("Acme "), "o_custkey"), F.concat(F.lit("• built "), "o_orderpriority"), F.concat(F.lit("- ran "), "o_orderstatus"), F.lit("Intern | Beta | 2019 - 2020"))
    found = table(spark, sf, "orders").select("o_orderkey", S.parse_experience(lines).alias("e")).select("o_orderkey", F.get("e", 0).alias("j"), F.size("e").alias("n"))
    return found.select("o_orderkey", "j.title", "j.company", "j.start", F.col("j.end").alias("end_"), "j.summary", "n")


# ----------------------------------------------------------------------------------------------------------- fusion


def event_profiles(spark, sf) -> DataFrame:
    """A profile per user and event type: the type is the source, the number of events decides the rest."""
    rows = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("v"))
    source, n = F.col("event_type"), F.col("n")
    conf = (F.lit(50) + n % 5 * 10) / F.lit(100.0)
    order = (F.array_position(F.array(*[F.lit(e) for e in EVENTS]), source) - 1).cast("int")
    tag = lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), conf.alias("confidence"), source.alias("source")))
    claim = lambda k: F.struct(F.concat(F.lit("skill"), ((n + k) % 7).cast("string")).alias("name"), conf.alias("confidence"), source.alias("source"))
    text = lambda prefix: F.concat(F.lit(prefix), source, n.cast("string"))
    none = F.lit(None).cast("string")
    links = F.struct(F.when(n % 2 == 0, text("in/")).alias("linkedin"), F.when(n % 3 == 0, text("gh/")).alias("github"), none.alias("portfolio"), F.array(F.concat(F.lit("o"), (n % 3).cast("string"))).alias("other"))
    parts = {
        "full_name": tag(text("")),
        "headline": tag(F.when(n % 3 > 0, text("h"))),
        "years_experience": tag(F.round("v", 1)),
        "emails": tag(F.array(F.concat(source, n.cast("string"), F.lit("@x.com")), F.lit("b@x.com"))),
        "links": tag(links),
        "skills": F.array(claim(0), claim(1)),
    }
    cells = [parts[k].cast(kind).alias(k) if k in parts else F.lit(None).cast(kind).alias(k) for k, kind in PROFILE_FIELDS.items()]
    return rows.select(F.col("user_id").cast("string").alias("candidate_key"), source.alias("source"), order.alias("source_ord"), *cells, none.alias("error"))


EVENT_SQL = """
WITH e AS (SELECT user_id, event_type AS s, count(*) AS n, max(value) AS v FROM events GROUP BY ALL),
p AS (SELECT CAST(user_id AS VARCHAR) AS k, s, n, round(v, 1) AS v, (50 + n % 5 * 10) / 100.0::DOUBLE AS c, list_position(['click','error','purchase','signup','view'], s) AS o FROM e),
w AS (SELECT k, arg_max({'t': s || n, 's': s, 'c': c, 'v': v, 'e': s || n || '@x.com'}, c * 1000 - o) AS top, arg_max({'t': 'h' || s || n, 's': s, 'c': c}, c * 1000 - o) FILTER (WHERE n % 3 > 0) AS head,
  arg_max({'t': 'in/' || s || n, 's': s, 'c': c}, c * 1000 - o) FILTER (WHERE n % 2 = 0) AS li, arg_max({'t': 'gh/' || s || n, 's': s, 'c': c}, c * 1000 - o) FILTER (WHERE n % 3 = 0) AS gh, count(*) AS used FROM p GROUP BY k),
x AS (SELECT k, s, o, c, unnest([{'name': 'skill' || (n % 7), 'pos': 0}, {'name': 'skill' || ((n + 1) % 7), 'pos': 1}], recursive := true) FROM p),
y AS (SELECT k, name, list(c ORDER BY o, pos) AS cs, array_to_string(list(s ORDER BY o, pos), '+') AS sources, min(o * 10 + pos) AS place FROM x GROUP BY ALL),
z AS (SELECT k, name, CASE WHEN len(cs) = 1 THEN cs[1] ELSE list_reduce(cs, lambda a, b: least(1.0::DOUBLE, greatest(a, b) + 0.1::DOUBLE)) END AS c, sources, place FROM y),
m AS (SELECT k, list_reduce(list(c ORDER BY place), lambda a, b: a + b) / count(*) AS mean FROM z GROUP BY k)
"""


@query("resolve_argmax", EVENT_SQL + """
SELECT w.k AS candidate_key, top.t AS full_name, head.t AS headline, top.v AS years_experience, top.e AS email, md5(lower(top.e)) AS candidate_id,
  array_to_string(list_filter(['full_name:' || top.s, 'headline:' || head.s, 'years_experience:' || top.s, 'links.linkedin:' || li.s, 'links.github:' || gh.s, 'emails:' || top.s], lambda q: q IS NOT NULL), ',') AS provenance, used AS sources_used FROM w
""")
def resolve_argmax(spark, sf):
    got = FU.fuse(event_profiles(spark, sf), SETTINGS)
    trail = F.transform("provenance", lambda p: F.concat_ws(":", p["field"], p["source"]))
    return got.select("candidate_key", "full_name", "headline", "years_experience", F.get("emails", 0).alias("email"), "candidate_id", joined(trail, ",").alias("provenance"), "sources_used")


@query("overall_confidence", EVENT_SQL + """
, t AS (SELECT w.k, [top.c, head.c, top.c, CASE WHEN li.c IS NOT NULL AND gh.c IS NOT NULL THEN (li.c + gh.c) / 2 ELSE coalesce(li.c, gh.c) END, top.c, mean] AS l FROM w JOIN m ON m.k = w.k)
SELECT k AS candidate_key, CAST(round(round(list_reduce(l, lambda a, b: a + b) / len(l), 2) * 100) AS BIGINT) AS percent FROM (SELECT k, list_filter(l, lambda x: x IS NOT NULL) AS l FROM t)
""")
def overall_confidence(spark, sf):
    got = FU.fuse(event_profiles(spark, sf), SETTINGS)
    return got.select("candidate_key", F.round(F.col("overall_confidence") * 100).cast("long").alias("percent"))


@query("skill_boost", EVENT_SQL + """
SELECT k AS candidate_key, name, CAST(round(c * 100) AS BIGINT) AS percent, sources, row_number() OVER (PARTITION BY k ORDER BY c DESC, place) AS rank FROM z
""")
def skill_boost(spark, sf):
    got = FU.fuse_skills(event_profiles(spark, sf), SETTINGS).select("candidate_key", F.posexplode("skills").alias("pos", "s"))
    return got.select("candidate_key", "s.name", F.round(F.col("s.confidence") * 100).cast("long").alias("percent"), joined(F.col("s.sources"), "+").alias("sources"), (F.col("pos") + 1).cast("long").alias("rank"))


@query("links_argmax_subfield", EVENT_SQL + """
, q AS (SELECT k, 'o' || (n % 3) AS link, min(o) AS o FROM p GROUP BY ALL), r AS (SELECT k, string_agg(link, ',' ORDER BY o) AS other FROM q GROUP BY k)
SELECT w.k AS candidate_key, li.t AS linkedin, gh.t AS github, other FROM w JOIN r ON r.k = w.k
""")
def links_argmax_subfield(spark, sf):
    got = FU.fuse(event_profiles(spark, sf), SETTINGS)
    return got.select("candidate_key", "links.linkedin", "links.github", joined(F.col("links.other"), ",").alias("other"))


def _array_profiles(rows: DataFrame, key: str, column: str, entries: Column) -> DataFrame:
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(entries)).alias("l"))
    return profiles(grouped, key, "table", 0, {column: F.transform("l", lambda x: x["e"])})


@query("dedupe_experience", """
WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS k, o_orderkey AS i, o_orderpriority AS company, o_orderstatus AS title, repeat('s', CAST(o_orderkey % 5 AS INTEGER)) AS st, CAST(o_orderkey AS VARCHAR) AS su FROM orders)
SELECT k AS candidate_key, company, title, nullif(arg_max(st, length(st) * 1000000000 - i), '') AS start, arg_max(su, length(su) * 1000000000 - i) AS summary FROM o GROUP BY k, company, title
""")
def dedupe_experience(spark, sf):
    none = F.lit(None)
    entry = F.struct("o_orderkey", job(F.col("o_orderpriority"), F.concat(F.lit(" "), F.lower("o_orderstatus")), F.repeat(F.lit("s"), (F.col("o_orderkey") % 5).cast("int")), none, F.col("o_orderkey").cast("string")).alias("e"))
    got = FU.fuse_experience(_array_profiles(table(spark, sf, "orders"), "o_custkey", "experience", entry)).select("candidate_key", F.explode("experience").alias("e"))
    return got.select("candidate_key", "e.company", F.upper(F.trim("e.title")).alias("title"), "e.start", "e.summary")


@query("dedupe_education", """
WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, l_returnflag AS i, l_linestatus AS d, repeat('f', l_linenumber % 3) AS f, year(l_shipdate) AS y FROM lineitem)
SELECT k AS candidate_key, i AS institution, d AS degree, nullif(max(f), '') AS field, CAST(max(y) AS INTEGER) AS end_year FROM l GROUP BY k, i, d
""")
def dedupe_education(spark, sf):
    entry = F.struct("l_linenumber", "l_partkey", school(F.col("l_returnflag"), F.col("l_linestatus"), F.repeat(F.lit("f"), F.col("l_linenumber") % 3), F.year("l_shipdate")).alias("e"))
    got = FU.fuse_education(_array_profiles(table(spark, sf, "lineitem"), "l_orderkey", "education", entry)).select("candidate_key", F.explode("education").alias("e"))
    return got.select("candidate_key", "e.institution", "e.degree", "e.field", "e.end_year")


@query("tenure_months", """
WITH j AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS a, o_orderkey % 9 AS n FROM orders), m AS (SELECT DISTINCT o_custkey, unnest(range(a, a + n + 1)) AS month FROM j)
SELECT o_custkey, CAST(count(*) AS BIGINT) AS months FROM m GROUP BY 1
""")
def tenure_months(spark, sf):
    none = F.lit(None)
    date = lambda c: F.date_format(c, "MMM yyyy")
    entry = job(none, none, date(F.col("o_orderdate")), date(F.add_months(F.trunc("o_orderdate", "month"), (F.col("o_orderkey") % 9).cast("int"))), none)
    jobs = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(entry).alias("jobs"))
    return jobs.select("o_custkey", F.round(N.tenure_years(F.col("jobs"), SETTINGS) * 12).cast("long").alias("months"))


@query("source_union", "SELECT 'c' || c_custkey AS candidate_key, 'recruiter_csv' AS source, c_name AS full_name, 0.8 AS confidence FROM customer UNION ALL SELECT 's' || s_suppkey, 'ats_json', s_name, 0.85 FROM supplier")
def source_union(spark, sf):
    one = lambda name, key, prefix, source, conf: profiles(table(spark, sf, name).withColumn("k", F.concat(F.lit(prefix), key)), "k", source, 0, {"full_name": tagged(F.col(f"{key[0]}_name"), conf, source)})
    both = union_sources(one("customer", "c_custkey", "c", "recruiter_csv", 0.8), one("supplier", "s_suppkey", "s", "ats_json", 0.85))
    return both.select("candidate_key", "source", F.col("full_name.value").alias("full_name"), F.col("full_name.confidence").cast("decimal(3,2)").alias("confidence"))


@query("link_enrichment", """SELECT CAST(page_id AS VARCHAR) AS candidate_key, CASE WHEN page_id % 3 = 0 THEN 'https://github.com/given' || page_id WHEN page_id % 2 = 0 THEN 'https://github.com/u' || page_id END AS github FROM pages""")
def link_enrichment(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("candidate_key"), "page_id")
    text = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("see github.com/u"), "page_id")).otherwise("nothing")
    links = X.extract_links(text)
    found = profiles(pages, "candidate_key", "resume_txt", 1, {"links": tagged(F.when(X.any_link(links), links), 0.75, "resume_txt")})
    given = pages.where("page_id % 3 = 0").select("candidate_key", F.concat(F.lit("https://github.com/given"), "page_id").alias("github"), F.lit("").alias("linkedin"))
    return discovered_urls(found, given).select("candidate_key", "github")


# ------------------------------------------------------------------------------------------ projection and validation

CONFIG = {
    "fields": [
        {"path": "name", "from": "full_name", "required": True, "type": "string"},
        {"path": "primary_email", "from": "emails[0]", "normalize": "upper", "type": "string"},
        {"path": "second", "from": "emails[5]"},
        {"path": "skills", "from": "skills[].name", "type": "string[]"},
        {"path": "city", "from": "location.city"},
        {"path": "job", "from": "experience[0].title"},
        {"path": "headline"},
    ],
    "include_confidence": True,
    "on_missing": "null",
}
CUSTOMER_SQL = "SELECT CAST(c_custkey AS VARCHAR) AS k, nullif(c_name, 'Customer#000000003') AS n, 'c' || c_custkey || '@x.com' AS e, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS s, CASE WHEN c_custkey % 3 > 0 THEN 'City' || c_nationkey END AS city, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS h, c_nationkey / 100.0 AS c FROM customer"


def customer_records(spark, sf) -> DataFrame:
    key = F.col("c_custkey")
    skill = F.struct(F.col("c_mktsegment").alias("name"), F.lit(0.5).alias("confidence"), F.array(F.lit("ats_json")).alias("sources"))
    none = F.lit(None).cast("string")
    return table(spark, sf, "customer").select(
        key.cast("string").alias("candidate_key"),
        F.md5("c_name").alias("candidate_id"),
        F.nullif("c_name", F.lit("Customer#000000003")).alias("full_name"),
        F.array(F.concat(F.lit("c"), key, F.lit("@x.com"))).alias("emails"),
        F.array(F.lit("+919876543210")).alias("phones"),
        F.when(key % 2 == 0, F.array(skill)).otherwise(F.array().cast("array<struct<name:string,confidence:double,sources:array<string>>>")).alias("skills"),
        F.struct(F.when(key % 3 > 0, F.concat(F.lit("City"), "c_nationkey")).alias("city"), none.alias("region"), none.alias("country")).alias("location"),
        F.array(job(none, F.lit("t"), none, none, none)).alias("experience"),
        F.when(key % 5 > 0, F.col("c_mktsegment")).alias("headline"),
        (F.col("c_nationkey") / 100.0).alias("overall_confidence"),
    )


@query("project_config", f"SELECT k AS candidate_key, n AS name, upper(e) AS primary_email, NULL::VARCHAR AS second, s AS skills, city, NULL::VARCHAR AS job, h AS headline, c AS overall_confidence FROM ({CUSTOMER_SQL})")
def project_config(spark, sf):
    return project(customer_records(spark, sf), CONFIG).withColumn("skills", F.get("skills", 0))


_OMIT = CONFIG | {"on_missing": "omit", "include_confidence": False}


@query("project_omit", f"""SELECT k AS candidate_key, '{{' || array_to_string(list_filter(['"name":"' || n || '"', '"primary_email":"' || upper(e) || '"', '"skills":["' || s || '"]', '"city":"' || city || '"', '"headline":"' || h || '"'], lambda x: x IS NOT NULL), ',') || '}}' AS projected FROM ({CUSTOMER_SQL})""")
def project_omit(spark, sf):
    return project_json(customer_records(spark, sf), _OMIT)


@query("validate_profile", f"""SELECT k AS candidate_key, CASE WHEN len(l) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(len(l) AS INTEGER) AS error_count, array_to_string(l, ';') AS errors FROM
(SELECT k, list_filter([CASE WHEN n IS NULL THEN 'Missing full_name' END, CASE WHEN s IS NULL THEN 'Missing skills' END, CASE WHEN c < 0.5 THEN 'Low profile confidence' END], lambda x: x IS NOT NULL) AS l FROM ({CUSTOMER_SQL}))""")
def validate_profile(spark, sf):
    got = validate(customer_records(spark, sf))
    errors = F.transform("validation.errors", lambda e: F.substring_index(e, ":", 1))
    return got.select("candidate_key", "validation.status", "validation.error_count", joined(errors, ";").alias("errors"))


_TYPED = {"fields": [{"path": "full_name", "required": True, "type": "string"}, {"path": "headline", "type": "number"}, {"path": "skills", "required": True, "type": "object[]"}, {"path": "emails", "type": "object[]"}, {"path": "location", "type": "object"}]}


@query("validate_projected", f"""SELECT k AS candidate_key, array_to_string(list_filter([CASE WHEN n IS NULL THEN 'Projected field ''full_name'' is required but missing or empty.' END,
 CASE WHEN h IS NOT NULL THEN 'Projected field ''headline'' should be number, got str.' END, CASE WHEN s IS NULL THEN 'Projected field ''skills'' is required but missing or empty.' END,
 'Projected field ''emails'' should be a list of objects.'], lambda x: x IS NOT NULL), ' ') AS errors FROM ({CUSTOMER_SQL})""")
def validate_projection(spark, sf):
    return validate_projected(customer_records(spark, sf), _TYPED).select("candidate_key", joined(F.col("projection_errors"), " ").alias("errors"))


# ------------------------------------------------------------------------------------------------------------- store


def _stored(spark, sf) -> DataFrame:
    """Customers as rows of the candidate table."""
    given = {
        "id": "c_custkey + 1",
        "candidate_id": "md5(c_name)",
        "full_name": "c_name",
        "location": "c_mktsegment",
        "years_experience": "c_acctbal / 1000",
        "skills_count": "c_nationkey",
        "overall_confidence": "c_nationkey / 100.0",
        "sources_count": "2",
    }
    kinds = dict(x.split() for x in store.STORE.split(", "))
    return table(spark, sf, "customer").select(*[F.expr(given.get(k, "null")).cast(kind).alias(k) for k, kind in kinds.items()])


@query("store_stats", "SELECT count(*) AS total, round(avg(c_nationkey / 100.0), 2) AS avg_confidence, round(avg(c_nationkey), 1) AS avg_skills, round(avg(c_acctbal / 1000), 1) AS avg_experience FROM customer")
def store_stats(spark, sf):
    return store.stats(_stored(spark, sf))


def _saved(spark, sf) -> store.CandidateStore:
    """The table with all customers saved, in the order of their keys."""
    saved = store.CandidateStore(spark, new_folder(spark))
    saved.init()
    saved.save(_stored(spark, sf).orderBy("id").drop("id"))
    return saved


@query("store_latest", "SELECT CAST(c_custkey + 1 AS BIGINT) AS id, md5(c_name) AS candidate_id, c_name AS full_name, c_nationkey AS skills_count FROM customer ORDER BY c_custkey DESC LIMIT 200")
def store_latest(spark, sf):
    return _saved(spark, sf).latest().select("id", "candidate_id", "full_name", "skills_count")


@query("store_lookup", "SELECT CAST(c_custkey + 1 AS BIGINT) AS id, c_name AS full_name FROM customer WHERE c_custkey = 41")
def store_lookup(spark, sf):
    return _saved(spark, sf).get(42).select("id", "full_name")


@query("store_record", """SELECT CAST(c_custkey + 1 AS BIGINT) AS id, md5(c_name) AS candidate_id, nullif(c_name, 'Customer#000000003') AS full_name, 'c' || c_custkey || '@x.com' AS email,
 CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS skill, 'C' || c_custkey AS shown FROM customer""")
def store_record(spark, sf):
    records = customer_records(spark, sf)
    final = store.record_json(records, [c for c in records.columns if c != "candidate_key"])
    rows = records.select((F.col("candidate_key").cast("long") + 1).alias("id"), "candidate_id", final.alias("final_profile"), F.concat(F.lit('{"shown": "C'), "candidate_key", F.lit('", "more": [1]}')).alias("projected_profile"))
    got = store.decoded(rows)
    return got.select("id", "candidate_id", "final_profile.full_name", F.get("final_profile.emails", 0).alias("email"), F.get("final_profile.skills", 0)["name"].alias("skill"), F.try_variant_get("projected_profile", "$.shown", "string").alias("shown"))


@query("display_grid", "SELECT c_custkey + 1 AS id, CAST((row_number() OVER (ORDER BY c_custkey DESC) - 1) // 3 AS BIGINT) AS line, '2024-02-29' AS processed_on FROM customer ORDER BY c_custkey DESC LIMIT 200")
def display_grid(spark, sf):
    return grid(store.latest(_stored(spark, sf).withColumn("processed_at", F.expr("timestamp '2024-02-29 23:59:59'")))).select("id", "line", "processed_on")


@query("extract_links_html", r"""
WITH u AS (SELECT page_id, list_transform(list_concat(regexp_extract_all(html, 'https?://[^\s|]+|[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}/[^\s|]+'), regexp_extract_all(html, '\b(?:github\.com/[^\s|]+|linkedin\.com/in/[^\s|]+)\b')), lambda x: rtrim(x, '.,;|)')) AS l FROM pages),
o AS (SELECT page_id, list_sort(list_distinct(list_filter(l, lambda x: NOT regexp_matches(lower(x), 'linkedin\.com|github\.com|gmail\.com|email\.com')))) AS l FROM u)
SELECT page_id, CAST(len(l) AS BIGINT) AS n_other, md5(array_to_string(l, '~')) AS digest FROM o
""")
def extract_links_html(spark, sf):
    found = table(spark, sf, "pages").select("page_id", X.extract_links(F.col("html"))["other"].alias("l"))
    return found.select("page_id", F.size("l").cast("long").alias("n_other"), F.md5(joined(F.array_sort("l"), "~")).alias("digest"))


# ----------------------------------------------------------------------------------- cases that the queries above leave out

_HEADERS_SQL = "['PROFESSIONAL SUMMARY', 'SUMMARY', 'TECHNICAL SKILLS', 'SKILLS', 'INTERNSHIP EXPERIENCE', 'WORK EXPERIENCE', 'EXPERIENCE', 'INTERNSHIPS', 'PROJECTS', 'PROJECT', 'EDUCATION', 'CERTIFICATIONS', 'ACHIEVEMENTS', 'LANGUAGES', 'DECLARATION']"


@query("section_headers", f"""
WITH c AS (SELECT c_custkey, ({_HEADERS_SQL})[1 + c_custkey % 15] AS h, c_name FROM customer)
SELECT c_custkey, CAST(0 AS BIGINT) AS block, 'HEADER' AS name, c_name || '~' || 'Not ' || h || ' but more' AS body FROM c
UNION ALL SELECT c_custkey, 1, h, 'a ' || c_custkey FROM c UNION ALL SELECT c_custkey, 2, 'SKILLS', 'Langs~b' FROM c UNION ALL SELECT c_custkey, 3, 'LANGUAGES', '' FROM c
""")
def section_headers(spark, sf):
    key = F.col("c_custkey")
    h = F.element_at(F.array(*[F.lit(x) for x in S.HEADERS]), (key % 15 + 1).cast("int"))
    # as it is, as a first or last part in any case, or inside a short line of capitals
    line = F.when(key % 4 == 0, h).when(key % 4 == 1, F.concat(F.lower(h), F.lit(" so far"))).when(key % 4 == 2, F.concat(F.lit("my "), F.lower(h))).otherwise(F.concat(F.lit("X"), h, F.lit("*")))
    text = F.concat("c_name", F.lit("\n  Not "), h, F.lit(" but more\n\n"), line, F.lit("\na "), key, F.lit("\nTools and Skills\nLangs\nb\nlanguages\n"))
    return table(spark, sf, "customer").select("c_custkey", F.posexplode(S.segment(text)).alias("block", "b")).select("c_custkey", F.col("block").cast("long").alias("block"), "b.name", joined(F.col("b.body"), "~").alias("body"))


@query("source_notes_bare", """SELECT CAST(c_custkey AS VARCHAR) AS candidate_key, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS full_name,
 CASE c_custkey % 4 WHEN 0 THEN 'Base ' || chr(10) || 'Pune' WHEN 1 THEN 'Old Town of Bergen' END AS city, CASE c_custkey % 4 WHEN 0 THEN 'India' WHEN 1 THEN 'Norway' END AS country FROM customer""")
def source_notes_bare(spark, sf):
    key = F.col("c_custkey")
    first = F.when(key % 3 == 0, F.concat(F.lit("notes on:  "), "c_name")).when(key % 3 == 1, F.col("c_name")).otherwise(F.lit("a talk of five words"))
    where = F.when(key % 4 == 0, F.lit("5\nBase \nPune, India - 7")).when(key % 4 == 1, F.lit("x | Old Town of Bergen, Norway | y")).otherwise(F.lit("Bergen; Norway"))
    found = parse_notes(table(spark, sf, "customer").select(key.cast("string").alias("candidate_key"), F.concat(first, F.lit("\n"), where).alias("text")))
    return found.select("candidate_key", F.col("full_name.value").alias("full_name"), F.col("location.value.city").alias("city"), F.col("location.value.country").alias("country"))


@query("source_ats_shapes", """SELECT CAST(s_suppkey AS VARCHAR) AS candidate_key, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS full_name,
 CASE s_suppkey % 4 WHEN 0 THEN 'https://linkedin.com/in/b' WHEN 1 THEN 'l' || s_suppkey WHEN 2 THEN 'https://linkedin.com/in/r' END AS linkedin, CASE s_suppkey % 4 WHEN 0 THEN 'https://github.com/u' || s_suppkey END AS github,
 CASE s_suppkey % 4 WHEN 0 THEN 'x.org' WHEN 1 THEN 'o1|o2' WHEN 2 THEN '' END AS other, CASE WHEN s_suppkey % 3 > 0 THEN 'School ' || s_nationkey END AS institution, CASE WHEN s_suppkey % 3 > 0 THEN 'Law' END AS field,
 CASE s_suppkey % 3 WHEN 1 THEN CAST(1990 + s_nationkey AS INTEGER) END AS end_year, CASE s_suppkey % 3 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS n_schools FROM supplier""")
def source_ats_shapes(spark, sf):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    lit = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    # an alias that is there, but null, hides the later ones
    name = F.when(key % 2 == 0, lit('"profile": {"name": "', F.col("s_name"), '"}')).otherwise(lit('"candidate_name": null, "name": "', F.col("s_name"), '"'))
    links = (
        F.when(key % 4 == 0, lit(', "links": ["https://linkedin.com/in/a", "https://github.com/u', key, '", "x.org", "https://linkedin.com/in/b"]'))
        .when(key % 4 == 1, lit(', "urls": {"linkedin": "l', key, '", "github": "", "other": ["o1", "", "o2"]}'))
        .when(key % 4 == 2, F.lit(', "linkedin_url": "https://linkedin.com/in/r", "links": 0'))
        .otherwise(F.lit(""))
    )
    schools = F.when(key % 3 == 1, lit(', "academic_history": [{"college": "School ', nation, '", "major": "Law", "end_year": "', 1990 + nation, '"}, 5]')).when(key % 3 == 2, lit(', "education": [{"institution": "School ', nation, '", "field_of_study": "Law", "end_year": "soon"}]')).otherwise(F.lit(', "education": {}'))
    found = parse_ats(table(spark, sf, "supplier").select(key.cast("string").alias("candidate_key"), lit("{", name, links, schools, "}").alias("raw")))
    at, school_ = F.col("links.value"), F.get("education", 0)
    return found.select("candidate_key", F.col("full_name.value").alias("full_name"), at["linkedin"].alias("linkedin"), X.truthy(at["github"]).alias("github"), joined(at["other"]).alias("other"), school_["institution"].alias("institution"), school_["field"].alias("field"), school_["end_year"].alias("end_year"), F.when(F.col("education").isNotNull(), F.size("education")).alias("n_schools"))


@query("resume_keywords", """SELECT CAST(c_custkey AS VARCHAR) AS candidate_key, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 3 THEN 'Ann Mary-Lou' END AS full_name, 'Line ' || c_custkey AS headline,
 CASE c_custkey % 3 WHEN 0 THEN 'Python|Mysql|OOP' WHEN 1 THEN 'Docker' END AS skills FROM customer""")
def resume_keywords(spark, sf):
    key = F.col("c_custkey")
    first = F.when(key % 4 == 0, F.col("c_name")).when(key % 4 == 1, F.lit("one two three four five six seven")).when(key % 4 == 2, F.lit("MY RESUME")).otherwise(F.lit("ANN MARY-LOU"))
    words = F.when(key % 3 == 0, F.lit("uses python, oop and MySQL")).when(key % 3 == 1, F.lit("ships with Docker, pythonic")).otherwise(F.lit("cooks"))
    raw = table(spark, sf, "customer").select(key.cast("string").alias("candidate_key"), F.concat(first, F.lit("\nLine "), key, F.lit("\n"), words).alias("text"), F.lit("md").alias("ext"))
    found = parse_resumes(raw)
    return found.select("candidate_key", F.col("full_name.value").alias("full_name"), F.col("headline.value").alias("headline"), joined(F.transform("skills", lambda s: s["name"])).alias("skills"))


@query("resolve_places", """
WITH s AS (SELECT s_suppkey % 20 AS k, s_suppkey, s_nationkey FROM supplier), a AS (SELECT k, arg_max(s_nationkey, {'c': s_suppkey % 3, 'o': -s_suppkey}) FILTER (WHERE s_suppkey % 2 = 0) AS n, max({'c': s_suppkey % 3, 'o': -s_suppkey}) FILTER (WHERE s_suppkey % 5 > 0) AS p FROM s GROUP BY k)
SELECT CAST(k AS VARCHAR) AS candidate_key, 'City' || n AS city, 'phone ' || (-p.o) AS phone, 2 - CAST(n IS NULL AS INTEGER) - CAST(p IS NULL AS INTEGER) AS n_trail FROM a WHERE n IS NOT NULL OR p IS NOT NULL
""")
def resolve_places(spark, sf):
    key, none = F.col("s_suppkey"), F.lit(None).cast("string")
    conf = 0.5 + (key % 3) / 10
    claim = lambda v: F.struct(v.alias("value"), conf.alias("confidence"), key.cast("string").alias("source"))
    place_ = F.struct(F.concat(F.lit("City"), "s_nationkey").alias("city"), none.alias("region"), none.alias("country"))
    # every second supplier states a place; a list of phones without a phone does not count
    parts = {"location": F.when(key % 2 == 0, claim(place_)), "phones": claim(F.when(key % 5 > 0, F.array(F.concat(F.lit("phone "), key), F.lit("x"))).otherwise(F.array().cast("array<string>")))}
    rows = table(spark, sf, "supplier").withColumn("k", key % 20)
    cells = [parts[k].cast(kind).alias(k) if k in parts else F.lit(None).cast(kind).alias(k) for k, kind in PROFILE_FIELDS.items()]
    given = rows.select(F.col("k").cast("string").alias("candidate_key"), key.cast("string").alias("source"), key.cast("int").alias("source_ord"), *cells)
    got = FU.fuse(given)
    return got.where("location is not null or size(phones) > 0").select("candidate_key", "location.city", F.get("phones", 0).alias("phone"), F.size("provenance").alias("n_trail"))


_SHAPED = {"fields": [{"path": "skills", "required": True}, {"path": "location"}, {"path": "experience"}, {"path": "job", "from": "experience"}, {"path": "name", "from": "full_name", "required": True}], "on_missing": "error"}


@query("project_shapes", f"""SELECT k AS candidate_key, '{{"skills":[{{"name":"' || s || '","confidence":0.5,"sources":["ats_json"]}}],"location":{{"city":' || coalesce('"' || city || '"', 'null') || ',"region":null,"country":null}},'
 || '"experience":[{{"company":null,"title":"t","start":null,"end":null,"summary":null}}],"job":[{{"company":null,"title":"t","start":null,"end":null,"summary":null}}],"name":"' || n || '"}}' AS projected FROM ({CUSTOMER_SQL}) WHERE n IS NOT NULL AND s IS NOT NULL""")
def project_shapes(spark, sf):
    good = accepted(validate_projected(customer_records(spark, sf), _SHAPED), _SHAPED).drop("projection_errors")
    return project_json(good, _SHAPED).select("candidate_key", "projected")


# the queries over the shop's tables register themselves beside these
from fusewright.plans import shop_queries  # noqa: E402, F401
