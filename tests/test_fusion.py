"""Fusion, projection, validation, store, command line and stream."""
import json
import os

import pytest
from pyspark.sql import functions as F

from fusewright.operators.fuse import fuse
from fusewright.operators.project import project, project_json
from fusewright.operators.validate import validate, validate_projected
from fusewright.plans import cli, display
from fusewright.plans.pipeline import Inputs, run
from fusewright.schema import CANONICAL, PROFILE, PROFILE_FIELDS
from fusewright.settings import Settings
from fusewright.sources import store
from fusewright.sources.ats import parse_ats
from fusewright.streaming.fusion import BUCKETS, current, fuse_stream


def profile(source, ord_, key="k", **fields):
    conf = fields.pop("conf", 0.8)
    row = {"candidate_key": key, "source": source, "source_ord": ord_, "error": None, **{k: None for k in PROFILE_FIELDS}}
    for k, v in fields.items():
        row[k] = [(n, conf, source) for n in v] if k == "skills" else v if k in ("experience", "education") else (v, conf, source)
    return row


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r[c.strip().split(" ")[0]] for c in ["candidate_key", "source", "source_ord", *PROFILE_FIELDS, "error"]) for r in rows], PROFILE)


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict(recursive=True)


def test_conflicts_between_three_sources(spark):
    rows = [
        profile("resume_txt", 2, conf=0.6, full_name="Tomas Quill", headline="Glass Blower", skills=["Kilns", "Welding"], emails=["tq@kiln.example"]),
        profile("recruiter_csv", 1, conf=0.85, full_name="T. Quill", skills=["Welding"], phones=["+447700900111"]),
        profile("recruiter_notes", 3, conf=0.7, full_name="Tomas", headline="Artist", skills=["Kilns", "Etching"], emails=["tomas@kiln.example"], phones=["+447700900222"]),
    ]
    got = only(fuse(frame(spark, *rows)))
    assert (got["full_name"], got["headline"], got["emails"], got["phones"]) == ("T. Quill", "Artist", ["tomas@kiln.example"], ["+447700900111"])
    # each agreement adds the bonus to the greater confidence; sources stand in their order
    bonus = Settings().agreement_bonus
    assert [(s["name"], round(s["confidence"], 6), s["sources"]) for s in got["skills"]] == [
        ("Welding", round(0.85 + bonus, 6), ["recruiter_csv", "resume_txt"]),
        ("Kilns", round(0.7 + bonus, 6), ["resume_txt", "recruiter_notes"]),
        ("Etching", 0.7, ["recruiter_notes"]),
    ]
    assert {(p["field"], p["source"]) for p in got["provenance"]} == {("full_name", "recruiter_csv"), ("headline", "recruiter_notes"), ("emails", "recruiter_notes"), ("phones", "recruiter_csv")}


def test_ties_folds_and_order(spark):
    rows = [
        profile("b", 1, full_name="B", skills=["X"], conf=0.75, links=(None, None, None, ["p", "q"])),
        profile("a", 0, full_name="A", skills=["X", "X"], conf=0.75, links=("l", None, None, ["q", "r"])),
        profile("c", 2, skills=["X"], conf=0.85, years_experience=0.0),
        profile("empty", 3),
    ]
    got = only(fuse(frame(spark, *rows)))
    assert got["full_name"] == "A" and got["years_experience"] == 0.0 and got["links"]["other"] == ["q", "r", "p"]
    assert got["skills"] == [{"name": "X", "confidence": pytest.approx(0.95), "sources": ["a", "b", "c"]}]
    assert (got["sources_attempted"], got["sources_used"]) == (4, 3)
    assert [p["field"] for p in got["provenance"]] == ["full_name", "years_experience", "links.linkedin"]
    again = only(fuse(frame(spark, *reversed(rows)).repartition(3)))
    assert again == got


def test_duplicate_jobs_and_schools(spark):
    job = lambda c, t, s, e, u: (c, t, s, e, u)
    a = profile("a", 0, experience=[job("Acme ", "Dev", None, "2020", "x"), job(None, "Dev", None, None, None)], education=[("U", "B", "CSE", 2019)])
    b = profile("b", 1, experience=[job("acme", "dev", "2019-01", None, "longer"), job(None, "Dev", None, None, None)], education=[("u", "b ", None, 2021)])
    got = only(fuse(frame(spark, a, b)))
    assert [tuple(e.values()) for e in got["experience"]] == [("Acme ", "Dev", "2019-01", "2020", "longer"), (None, "Dev", None, None, None), (None, "Dev", None, None, None)]
    assert got["education"] == [{"institution": "U", "degree": "B", "field": "CSE", "end_year": 2021}]


def test_no_email_and_no_name(spark):
    got = only(fuse(frame(spark, profile("a", 0, skills=["X"]))))
    assert got["candidate_id"] == "unknown" and got["overall_confidence"] == 0.8 and got["emails"] == [] and got["links"] is None
    assert fuse(frame(spark, profile("a", 0))).count() == 0


RECORD = {"candidate_key": "k", "full_name": "Jane", "emails": ["a@x.com", "b@x.com"], "phones": ["+447700900321"], "skills": [("Python", 0.9, ["s"]), ("py", None, None)], "location": ("Pune", "", None), "overall_confidence": 0.85}


def record(spark, **changes):
    row = RECORD | changes
    names = [c.split(" ")[0] for c in ["candidate_key string", "candidate_id string"]] + [k for k in ("full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education", "provenance", "overall_confidence")]
    return spark.createDataFrame([tuple(row.get(n) for n in names)], CANONICAL)


def test_projection_paths(spark):
    config = {"fields": [{"path": "name", "from": "full_name"}, {"path": "first", "from": "emails[0]"}, {"path": "far", "from": "emails[7]"}, {"path": "skills", "from": "skills[].name", "normalize": "canonical"}, {"path": "city", "from": "location.city"}, {"path": "bad", "from": "experience[0].title"}, {"path": "phones", "normalize": "E164"}, {"path": "location"}], "include_confidence": True, "include_provenance": True}
    got = only(project(record(spark), config))
    assert (got["name"], got["first"], got["far"], got["skills"], got["city"], got["bad"]) == ("Jane", "a@x.com", None, ["Python", "Python"], "Pune", None)
    assert got["phones"] == ["+447700900321"] and got["location"] == {"city": "Pune", "region": None, "country": None}
    assert got["overall_confidence"] == 0.85 and got["provenance"] == []
    assert json.loads(only(project_json(record(spark), config))["projected"]) == {k: v for k, v in got.items() if k != "candidate_key"}


def test_missing_policies(spark):
    fields = [{"path": "name", "from": "full_name"}, {"path": "h", "from": "headline"}, {"path": "mail", "from": "emails[0]", "required": True}]
    text = lambda policy, **c: only(project_json(record(spark, **c), {"fields": fields, "on_missing": policy}))
    assert json.loads(text("null")["projected"]) == {"name": "Jane", "h": None, "mail": "a@x.com"}
    assert json.loads(text("omit")["projected"]) == {"name": "Jane", "mail": "a@x.com"}
    assert json.loads(text("error")["projected"]) == {"name": "Jane", "mail": "a@x.com"}
    bad = text("error", emails=[])
    assert bad["projected"] is None and bad["_errors"] == ["Required projected field 'mail' is missing."]
    with pytest.raises(Exception, match="Required projected field 'mail' is missing"):
        project(record(spark, emails=[]), {"fields": fields, "on_missing": "error"}, strict=True).collect()


def test_skill_shapes_stay_whole(spark):
    got = only(project(record(spark), {"fields": [{"path": "skills"}]}))
    assert got["skills"] == [{"name": "Python", "confidence": 0.9, "sources": ["s"]}, {"name": "py", "confidence": 0.0, "sources": []}]


def test_validation(spark):
    good = only(validate(record(spark, candidate_id="x")))["validation"]
    assert good["status"] == "PASS" and good["checks"]["education_present"] is False
    bad = only(validate(record(spark, full_name=None, overall_confidence=0.4)))["validation"]
    assert bad["errors"] == ["Missing candidate_id", "Missing full_name", "Low profile confidence: 0.4 < 0.5"] and bad["error_count"] == 3
    config = {"fields": [{"path": "full_name", "type": "number"}, {"path": "headline", "type": "string", "required": True}, {"path": "emails", "type": "string[]"}, {"path": "phones", "type": "string"}]}
    assert only(validate_projected(record(spark), config))["projection_errors"] == [
        "Projected field 'full_name' should be number, got str.",
        "Projected field 'headline' is required but missing or empty.",
        "Projected field 'phones' should be string, got list.",
    ]


def sample_inputs(spark):
    raw = {"full_name": "Ines Calder", "emails": ["Ines@Corvid.example", "other@corvid.example"], "technologies": ["postgres", "py"], "exp_years": 4, "academic_history": [{"college": "Porto Tech", "degree": "MSc", "major": "Botany", "end_year": 2011}]}
    ats = spark.createDataFrame([("k", json.dumps(raw))], "candidate_key string, raw string")
    csv = spark.createDataFrame([("k", "I. Calder", "ic@corvid.example", "+44 7700 900123", "Corvid Labs", "Field Botanist")], "candidate_key string, candidate_name string, mail string, contact string, company string, role string")
    text = "Notes on: Ines M Calder\nHeadline: Plant Hunter\nShe brings 6.5 yrs of experience.\nTechnologies: Rust | Python & Seeds\nMail to ines@seeds.example"
    return Inputs(ats=ats, csv=csv, notes=spark.createDataFrame([("k", text)], "candidate_key string, text string"))


CONFIG = {"fields": [{"path": "full_name", "required": True}, {"path": "primary_email", "from": "emails[0]"}, {"path": "skills", "from": "skills[].name"}], "include_confidence": True}


def test_whole_pipeline(spark):
    got = run(sample_inputs(spark), CONFIG)
    r = only(got.fused)
    assert (r["full_name"], r["headline"], r["years_experience"], r["emails"], r["phones"]) == ("Ines Calder", "Field Botanist", 4.0, ["ines@corvid.example"], ["+447700900123"])
    assert sorted(s["name"] for s in r["skills"]) == ["Python", "Rust", "Seeds", "postgres"] and r["skills"][0]["name"] == "Python" and r["skills"][0]["sources"] == ["ats_json", "recruiter_notes"]
    assert r["location"] is None and [(e["company"], e["title"]) for e in r["experience"]] == [("Corvid Labs", "Field Botanist")]
    assert r["education"] == [{"institution": "Porto Tech", "degree": "MSc", "field": "Botany", "end_year": 2011}]
    assert [p["field"] for p in r["provenance"]] == ["full_name", "headline", "years_experience", "emails", "phones"]
    assert only(got.validated)["validation"]["status"] == "PASS" and got.quarantined.count() == 0
    assert json.loads(only(got.projected_json)["projected"])["primary_email"] == "ines@corvid.example"


def test_staged_tables_go(spark):
    got = run(sample_inputs(spark), CONFIG)
    assert got.fused.count() == 1
    at = [f._staged_at.removeprefix("file:") for f in (got.profiles, got.fused)]
    assert all(os.path.isdir(x) for x in at)
    got.close()
    assert not any(os.path.exists(x) for x in at)


def test_paths_of_any_characters(spark):
    row = fuse(frame(spark, profile("a", 0, full_name='Q "x" \\ é')))
    fields = [{"path": 'the "name"\\é', "from": "full_name"}, {"path": 'a"b', "from": "headline"}]
    assert json.loads(only(project_json(row, {"fields": fields}))["projected"]) == {'the "name"\\é': 'Q "x" \\ é', 'a"b': None}


def test_store(spark, tmp_path):
    got = run(sample_inputs(spark), CONFIG)
    confidence = only(got.fused)["overall_confidence"]
    table = store.CandidateStore(spark, str(tmp_path / "store"))
    table.init()
    rows = store.store_rows(got.fused, got.projected_json)
    assert table.save(rows) == (1, 1) and table.save(rows.union(rows)) == (2, 2)
    assert [r["id"] for r in table.latest(2).collect()] == [3, 2]
    row = table.get(2).first()
    assert json.loads(row["final_profile"])["links"] is None and row["location"] == "" and row["skills_count"] == 4
    stats = table.stats().first()
    assert (stats["total"], stats["avg_confidence"], stats["avg_skills"]) == (3, confidence, 4.0)
    table.delete(3)
    assert [r["id"] for r in table.latest().collect()] == [2, 1] and table.save(rows) == (4, 1)
    table.clear()
    assert table.rows().count() == 0 and table.save(rows) == (5, 1) and table.get(9).count() == 0
    assert len(json.loads(store.json_array(table.export(), "projected_profile").first()["document"])) == 1
    card = only(display.cards(got.fused))
    assert card["place"] == display.DASH and card["confidence_percent"] == int(confidence * 100)


def test_command_line(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"candidate_name":"Pavel Moss","email":"pm@moss.example","mobile":"+44 7700 900888","skill_set":["py"]}')
    (tmp_path / "c.json").write_text(json.dumps(CONFIG))
    (tmp_path / "r.txt").write_text("Pavel Moss\nGardener\nlinkedin.com/in/pavel-moss\n")
    out = tmp_path / "out/profile.json"
    args = ["--ats", str(tmp_path / "a.json"), "--resume", str(tmp_path / "r.txt"), "--config", str(tmp_path / "c.json"), "--output", str(out)]
    assert cli.main(args, spark) == 0
    assert json.loads(out.read_text())["full_name"] == "Pavel Moss"
    assert json.loads((tmp_path / "out/canonical_profile.json").read_text())["links"]["linkedin"] == "https://linkedin.com/in/pavel-moss"
    assert json.loads((tmp_path / "out/validation_report.json").read_text())["status"] == "PASS"
    assert cli.main(["--ats", "none", "--resume", "none", "--config", str(tmp_path / "c.json")], spark) == 1


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    folder = str(tmp_path / "out")
    frame(spark, profile("a", 0, full_name="A")).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(PROFILE).parquet(str(source))
    fuse_stream(stream, folder, Settings(), availableNow=True).awaitTermination()
    frame(spark, profile("b", 1, full_name="B", conf=0.9), profile("b", 1, key="z", full_name="Z")).write.mode("append").parquet(str(source))
    fuse_stream(stream, folder, Settings(), availableNow=True).awaitTermination()
    assert sorted((r["candidate_key"], r["full_name"]) for r in current(spark, folder).collect()) == [("k", "B"), ("z", "Z")]
    # a null key is a key too, and an empty batch touches nobody
    for rows in ([profile("a", 0, key=None, full_name="N")], []):
        (frame(spark, *rows) if rows else spark.createDataFrame([], PROFILE)).write.mode("append").parquet(str(source))
        fuse_stream(stream, folder, Settings(), availableNow=True).awaitTermination()
    frame(spark, profile("b", 1, key=None, full_name="M", conf=0.9)).write.mode("append").parquet(str(source))
    fuse_stream(stream, folder, Settings(), availableNow=True).awaitTermination()
    assert {r["candidate_key"]: r["full_name"] for r in current(spark, folder).collect()} == {"k": "B", "z": "Z", None: "M"}
    assert {r["candidate_key"] for r in spark.read.schema(CANONICAL).parquet(f"{folder}/fused").collect()} == {"k", "z", None}


def test_stream_reads_touched_buckets_only(spark, tmp_path):
    """A bucket that the second batch does not touch may be unreadable."""
    source, folder = tmp_path / "in", tmp_path / "out"
    keys = [f"k{i}" for i in range(40)]
    frame(spark, *[profile("a", 0, key=k, full_name="A") for k in keys]).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(PROFILE).parquet(str(source))
    fuse_stream(stream, str(folder), Settings(), availableNow=True).awaitTermination()
    bucket = spark.createDataFrame([("k0",)], "candidate_key string").selectExpr(f"pmod(xxhash64(candidate_key), {BUCKETS})").first()[0]
    others = [p for p in (folder / "state").glob("batch=*/bucket=*") if p.name != f"bucket={bucket}"]
    assert len(others) > 20
    for other in others:
        for part in other.glob("*.parquet"):
            part.write_text("not a table")
            other.joinpath(f".{part.name}.crc").unlink(missing_ok=True)
    frame(spark, profile("b", 1, key="k0", full_name="B", conf=0.9)).write.mode("append").parquet(str(source))
    fuse_stream(stream, str(folder), Settings(), availableNow=True).awaitTermination()
    fused = spark.read.schema(CANONICAL + ", batch int").parquet(f"{folder}/fused")
    assert [(r["candidate_key"], r["full_name"]) for r in fused.where("batch = 1").collect()] == [("k0", "B")]


def test_parsers_run_on_streams(spark, tmp_path):
    (tmp_path / "x.txt").write_text('{"name":"Jo"}')
    raw = spark.readStream.schema("value string").text(str(tmp_path)).select(F.lit("k").alias("candidate_key"), F.col("value").alias("raw"))
    assert parse_ats(raw).isStreaming
