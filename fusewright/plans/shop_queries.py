"""Queries of the fusion operators over the shop's tables, and over whole results that other queries show in part; with their SQL."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusewright.operators import fuse as FU
from fusewright.operators.claims import claims, combine
from fusewright.operators.validate import validate
from fusewright.plans.display import cards
from fusewright.plans.queries import CUSTOMER_SQL, SETTINGS, _saved, customer_records, joined, query, table
from fusewright.plans.staging import staged
from fusewright.schema import EDUCATION, PROFILE_FIELDS
from fusewright.sources.github import parse_github
from fusewright.sources.profile import job, school, union_sources
from fusewright.sources.recruiter_csv import POSITION, first_row, parse_csv

CONFIDENCE = {"crm": 0.8, "store": 0.7, "web": 0.6, "partner": 0.5}


def client_profiles(spark, sf) -> DataFrame:
    """A profile per client: clients of one master are sources of one candidate. What a client does not state is null."""
    source, given = F.col("source"), lambda c: F.nullif(F.trim(c), F.lit(""))
    conf = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])[source]
    tag = lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), conf.alias("confidence"), source.alias("source")))
    none = F.lit(None).cast("string")
    city, mail = given("city"), given("email")
    parts = {
        "full_name": tag(given("name")),
        "headline": tag(given("segment")),
        "years_experience": tag(F.col("balance")),
        "location": tag(F.when(city.isNotNull(), F.struct(city.alias("city"), none.alias("region"), F.col("nation_id").cast("string").alias("country")))),
        "emails": tag(F.when(mail.isNotNull(), F.array(mail))),
    }
    cells = [parts[k].cast(kind).alias(k) if k in parts else F.lit(None).cast(kind).alias(k) for k, kind in PROFILE_FIELDS.items()]
    return table(spark, sf, "clients").select(F.col("master_id").cast("string").alias("candidate_key"), source, F.col("client_id").cast("int").alias("source_ord"), *cells, none.alias("error"))


CLIENT_SQL = """
WITH p AS (SELECT CAST(master_id AS VARCHAR) AS k, client_id AS o, source AS s, CASE source WHEN 'crm' THEN 0.8::DOUBLE WHEN 'store' THEN 0.7 WHEN 'web' THEN 0.6 WHEN 'partner' THEN 0.5 END AS c,
  nullif(trim(name), '') AS n, nullif(trim(segment), '') AS h, balance AS b, nullif(trim(city), '') AS city, CAST(nation_id AS VARCHAR) AS nation, nullif(trim(email), '') AS e FROM clients),
w AS (SELECT k, arg_max({'v': n, 'c': c}, {'c': c, 'o': -o}) FILTER (WHERE n IS NOT NULL) AS n, arg_max({'v': h, 'c': c}, {'c': c, 'o': -o}) FILTER (WHERE h IS NOT NULL) AS h, arg_max({'v': b, 'c': c}, {'c': c, 'o': -o}) FILTER (WHERE b IS NOT NULL) AS b,
  arg_max({'v': city, 'x': nation, 'c': c}, {'c': c, 'o': -o}) FILTER (WHERE city IS NOT NULL) AS l, arg_max({'v': e, 'c': c, 's': s}, {'c': c, 'o': -o}) FILTER (WHERE e IS NOT NULL) AS e,
  count(*) AS attempted, count(*) FILTER (WHERE coalesce(n, h, city, e, CAST(b AS VARCHAR)) IS NOT NULL) AS used FROM p GROUP BY k),
t AS (SELECT *, list_filter([n.c, h.c, b.c, l.c, e.c], lambda x: x IS NOT NULL) AS cs FROM w WHERE used > 0)
SELECT k AS candidate_key, coalesce(md5(lower(coalesce(e.v, n.v))), 'unknown') AS candidate_id, n.v AS full_name, h.v AS headline, b.v AS years_experience, l.v AS city, l.x AS country, e.v AS email, e.s AS email_source,
  CAST(round(coalesce(round(list_sum(cs) / len(cs), 2), 0) * 100) AS BIGINT) AS percent, attempted AS sources_attempted, used AS sources_used FROM t
"""


def _client_columns(got: DataFrame) -> DataFrame:
    source = F.get(F.filter("provenance", lambda p: p["field"] == "emails"), 0)["source"]
    return got.select("candidate_key", "candidate_id", "full_name", "headline", "years_experience", "location.city", "location.country", F.get("emails", 0).alias("email"), source.alias("email_source"), F.round(F.col("overall_confidence") * 100).cast("long").alias("percent"), "sources_attempted", "sources_used")


@query("client_fusion", CLIENT_SQL)
def client_fusion(spark, sf):
    """Clients that state nothing are attempted only; a master of which nothing is stated has no record."""
    return _client_columns(FU.fuse(client_profiles(spark, sf), SETTINGS))


@query("client_fusion_by_parts", CLIENT_SQL)
def client_fusion_by_parts(spark, sf):
    """The same from claims that were combined apart, source by source, and merged: what a stream's state does."""
    given = client_profiles(spark, sf)
    parts = [combine(claims(given.where(F.col("source") == s))) for s in CONFIDENCE]
    rest = combine(claims(given.where(F.col("source").isNull() | ~F.col("source").isin(*CONFIDENCE))))
    merged = rest
    for part in parts:
        merged = merged.unionByName(part)
    return _client_columns(FU.records(FU.together(combine(merged), SETTINGS)))


@query("client_entries", """
WITH u AS (SELECT client_id, 0 AS o, segment AS c, city AS t, NULL AS st, source AS su FROM clients UNION ALL SELECT client_id, change_id + 1, segment, city, strftime(valid_at, '%Y-%m'), op FROM client_changes),
n AS (SELECT *, nullif(lower(trim(c)), '') AS a, nullif(lower(trim(t)), '') AS b FROM u), m AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN o END AS alone, CASE WHEN b IS NOT NULL THEN a END AS ka, CASE WHEN a IS NOT NULL THEN b END AS kb FROM n),
g AS (SELECT client_id, ka, kb, alone, min(o) AS place, arg_min({'c': c, 't': t}, o) AS first, arg_max(st, {'n': length(st), 'o': -o}) FILTER (WHERE st <> '') AS st, arg_max(su, {'n': length(su), 'o': -o}) FILTER (WHERE su <> '') AS su FROM m GROUP BY ALL)
SELECT CAST(client_id AS VARCHAR) AS candidate_key, CAST(row_number() OVER (PARTITION BY client_id ORDER BY place) - 1 AS BIGINT) AS position, first.c AS company, first.t AS title, st AS start, su AS summary FROM g
""")
def client_entries(spark, sf):
    """Jobs of two sources united, numbered as rows, of clients with any number of changes."""
    none = F.lit(None)

    def of(name: str, source: str, order: Column, start: Column, summary: Column) -> DataFrame:
        rows = table(spark, sf, name)
        cells = {"experience": F.array(job(F.col("segment"), F.col("city"), start, none, summary))}
        found = [cells[k].cast(kind).alias(k) if k in cells else none.cast(kind).alias(k) for k, kind in PROFILE_FIELDS.items()]
        return rows.select(F.col("client_id").cast("string").alias("candidate_key"), F.lit(source).alias("source"), order.cast("int").alias("source_ord"), *found, none.cast("string").alias("error"))

    both = union_sources(of("clients", "clients", F.lit(0), none, F.col("source")), of("client_changes", "changes", F.col("change_id") + 1, F.date_format("valid_at", "yyyy-MM"), F.col("op")))
    return FU.entries(both, "experience").select("candidate_key", "position", "entry.company", "entry.title", "entry.start", "entry.summary")


@query("source_github_filled", """
WITH r AS (SELECT client_id, segment, change_id, row_number() OVER (PARTITION BY client_id ORDER BY change_id) AS n FROM client_changes), f AS (SELECT client_id, segment, min(n) AS first_n FROM r WHERE n <= 10 AND segment <> '' GROUP BY ALL),
s AS (SELECT client_id, string_agg(segment, '|' ORDER BY first_n) AS skills FROM f GROUP BY client_id)
SELECT CAST(c.client_id AS VARCHAR) AS candidate_key, nullif(name, '') AS full_name, nullif(segment, '') AS headline, nullif(email, '') AS email, CASE WHEN city <> '' THEN city END AS city, CASE WHEN city <> '' THEN 'N' || nation_id END AS country,
  'https://github.com/user' || c.client_id AS github, CASE WHEN c.client_id % 3 > 0 THEN 'https://b' || c.client_id || '.example' END AS portfolio, skills FROM clients c LEFT JOIN s ON s.client_id = c.client_id
""")
def source_github_filled(spark, sf):
    """Users with bio, address, place and blog."""
    clients, key = table(spark, sf, "clients"), F.col("client_id")
    login = F.concat(F.lit("User"), key)
    where = F.when((F.col("city") != "") & F.col("nation_id").isNotNull(), F.concat("city", F.lit(", N"), "nation_id")).otherwise(F.when(F.col("city") != "", F.concat("city", F.lit(",x"))))
    blog = F.when(key % 3 > 0, F.concat(F.lit("https://b"), key, F.lit(".example"))).otherwise("")
    users = clients.select(login.alias("login"), "name", F.col("segment").alias("bio"), "email", where.alias("location"), blog.alias("blog"), F.col("nation_id").isNull().alias("bare"))
    repos = table(spark, sf, "client_changes").select(F.concat(F.lit("user"), "client_id").alias("login"), F.col("change_id").alias("position"), F.col("segment").alias("language"))
    found = parse_github(clients.select(key.cast("string").alias("candidate_key"), F.concat(F.lit("https://github.com/user"), key).alias("url")), users, repos)
    skills = F.when(F.col("skills").isNotNull(), joined(F.transform("skills", lambda s: s["name"])))
    at, links = F.col("location.value"), F.col("links.value")
    country = F.when(at["country"].startswith("N"), at["country"])
    return found.select("candidate_key", F.col("full_name.value").alias("full_name"), F.col("headline.value").alias("headline"), F.get("emails.value", 0).alias("email"), at["city"].alias("city"), country.alias("country"), links["github"].alias("github"), links["portfolio"].alias("portfolio"), skills.alias("skills"))


@query("display_cards_whole", f"""
SELECT md5(r.c_name) AS candidate_id, coalesce(n, '—') AS name, coalesce(city, '—') AS place, CAST(trunc(CAST(r.c_nationkey AS DOUBLE) / 100 * 100) AS INTEGER) AS confidence_percent, CASE WHEN r.c_custkey % 2 = 0 THEN r.c_acctbal ELSE 0 END AS years,
  't · 2020 – Present' AS jobs, 'BSc · School ' || r.c_nationkey || CASE WHEN r.c_custkey % 3 > 0 THEN ' · Graduated 2001' ELSE '' END AS schools, CASE WHEN s IS NULL THEN '' ELSE s || ' 50%' END AS skills
FROM ({CUSTOMER_SQL}) q JOIN customer r ON CAST(r.c_custkey AS VARCHAR) = q.k
""")
def display_cards_whole(spark, sf):
    none, key = F.lit(None).cast("string"), F.col("candidate_key").cast("long")
    more = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("candidate_key"), "c_acctbal", "c_nationkey")
    rows = customer_records(spark, sf).join(more, "candidate_key").withColumns({
        "years_experience": F.when(key % 2 == 0, F.col("c_acctbal")),
        "experience": F.array(job(none, F.lit("t"), F.lit("2020"), none, none)),
        "education": F.array(school(F.concat(F.lit("School "), "c_nationkey"), F.lit("BSc"), none, F.when(key % 3 > 0, F.lit(2001)))).cast(EDUCATION),
    })
    shown = cards(rows)
    return shown.select("candidate_id", "name", "place", "confidence_percent", "years", *[joined(F.col(c), "; ").alias(c) for c in ("jobs", "schools", "skills")])


@query("validate_profile_whole", f"""SELECT k AS candidate_key, array_to_string(l, ';') AS errors, s IS NOT NULL AS skills_present FROM
(SELECT k, s, list_filter([CASE WHEN n IS NULL THEN 'Missing full_name' END, CASE WHEN s IS NULL THEN 'Missing skills' END, CASE WHEN c < 0.5 THEN 'Low profile confidence: ' || CAST(CAST(c AS DOUBLE) AS VARCHAR) || ' < 0.5' END], lambda x: x IS NOT NULL) AS l FROM ({CUSTOMER_SQL}))""")
def validate_profile_whole(spark, sf):
    return validate(customer_records(spark, sf)).select("candidate_key", joined(F.col("validation.errors"), ";").alias("errors"), "validation.checks.skills_present")


@query("csv_first_row", "SELECT s_name AS full_name, 's' || s_suppkey || '@x.com' AS email FROM supplier ORDER BY s_suppkey LIMIT 1")
def csv_first_row(spark, sf):
    """An export's first row by its position, out of rows in any order."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias(POSITION), F.col("s_name").alias("name"), F.concat(F.lit("s"), "s_suppkey", F.lit("@x.com")).alias("email"), F.lit("k").alias("candidate_key"))
    return parse_csv(first_row(rows), "candidate_key").select(F.col("full_name.value").alias("full_name"), F.get("emails.value", 0).alias("email"))


@query("store_changes", "SELECT CAST(c_custkey + 1 AS BIGINT) AS id, 'candidate_' || md5(c_name) || '.json' AS file_name, 'canonical_' || md5(c_name) || '.json' AS canonical_name, CAST(NULL AS VARCHAR) AS projected_profile FROM customer WHERE c_custkey NOT IN (2, 41, 77)")
def store_changes(spark, sf):
    """What can be downloaded once three rows are deleted, by their ids."""
    saved = _saved(spark, sf)
    for row_id in (3, 42, 78, 42):
        saved.delete(row_id)
    return saved.export().select("id", "file_name", "canonical_name", "projected_profile")


@query("store_cleared", "SELECT (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY md5(c_name), c_name) AS id, c_name AS full_name FROM customer")
def store_cleared(spark, sf):
    """A table that was cleared and filled again: ids go on."""
    saved = _saved(spark, sf)
    again = staged(saved.rows().drop("id"))
    saved.clear()
    saved.save(again.orderBy("candidate_id", "full_name"))
    return saved.rows().select("id", "full_name")
