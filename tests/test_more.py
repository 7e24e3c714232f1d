"""Sessions, grids, the store's records and exports, first rows by position, settings, optional formats, logs."""
import datetime
import json

import pytest
from pyspark.sql import functions as F

from fusewright.plans import cli, display
from fusewright.settings import CLI_ORDER, UI_ORDER, Settings, load_settings
from fusewright.sources import files, recruiter_csv, resume, store


def test_session_history_and_grid(spark):
    session = display.Session()
    for run in ({"name": "a"}, None, {}, {"name": "b"}):
        session.append(run)
    assert session.newest_first() == [(2, {"name": "b"}), (1, {"name": "a"})]
    session.clear()
    assert session.newest_first() == []
    frame = spark.createDataFrame([(k, f"r{k}") for k in (5, 1, 3)], "seq int, name string")
    assert [(r["number"], r["name"]) for r in display.history(frame).collect()] == [(3, "r5"), (2, "r3"), (1, "r1")]
    assert display.history(frame.limit(0)).collect() == []
    page = spark.range(1, 8).withColumn("processed_at", F.expr("timestamp '2031-12-31 23:59:59'"))
    found = display.grid(page, width=2, limit=5).orderBy(F.desc("id")).collect()
    assert [(r["id"], r["line"]) for r in found] == [(7, 0), (6, 0), (5, 1), (4, 1), (3, 2)] and found[0]["processed_on"] == "2031-12-31"


def stored(spark, tmp_path, n):
    table = store.CandidateStore(spark, str(tmp_path / "store"))
    table.init()
    kinds = dict(x.split() for x in store.STORE.split(", "))
    given = {"candidate_id": "concat('c', id)", "final_profile": """concat('{"full_name":"N', id, '","emails":["e"],"location":{"city":"Y"}}')""", "projected_profile": "if(id = 1, 'no json', concat('{\"x\":', id, '}'))", "processed_at": "timestamp '2030-01-02 03:04:05'"}
    rows = spark.range(n).select(*[F.expr(given.get(k, "null")).cast(kind).alias(k) for k, kind in kinds.items() if k != "id"])
    table.save(rows.coalesce(1))
    return table


def test_records_and_exports(spark, tmp_path):
    table = stored(spark, tmp_path, 4)
    row = table.record(1).select("final_profile", F.try_variant_get("projected_profile", "$.x", "int").alias("x")).first()
    assert row["final_profile"]["full_name"] == "N0" and row["final_profile"]["location"]["city"] == "Y" and row["x"] == 0
    assert table.record(2).select(F.col("projected_profile").isNull().alias("n")).first()["n"] and table.record(99).count() == 0
    first = table.export().orderBy("id").first()
    assert (first["file_name"], first["canonical_name"], first["processed_at"]) == ("candidate_c0.json", "canonical_c0.json", "2030-01-02T03:04:05Z")
    assert json.loads(first["final_profile"])["emails"] == ["e"]
    table.write_export(str(tmp_path / "all"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "all")).collect()) == ["no json", '{"x":0}', '{"x":2}', '{"x":3}']
    assert json.loads(store.json_array(table.export().where("id <> 2"), "projected_profile", limit=2).first()["document"]) == [{"x": 3}, {"x": 2}]


def test_iso_utc(spark):
    at = datetime.datetime(2026, 3, 1, 0, 30, tzinfo=datetime.timezone(datetime.timedelta(hours=5, minutes=30)))
    assert spark.createDataFrame([(at,), (None,)], "t timestamp").select(store.iso_utc(F.col("t")).alias("x")).collect() == [("2026-02-28T19:00:00Z",), (None,)]


def test_first_csv_row_by_position(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("name,email\n" + "".join(f'"P{k}\nsecond line",p{k}@x.example\n' for k in range(500)))
    rows = recruiter_csv.read_csv(spark, str(path), position=True).repartition(7)
    assert [(r["email"], r["name"]) for r in recruiter_csv.first_row(rows).collect()] == [("p0@x.example", "P0\nsecond line")]
    path.write_text("name,email\n")
    assert recruiter_csv.first_row(recruiter_csv.read_csv(spark, str(path), position=True)).collect() == []


def test_settings_order(tmp_path):
    path = tmp_path / "s.json"
    for given, wanted in (("ui", UI_ORDER), ("cli", CLI_ORDER), (list(UI_ORDER), UI_ORDER)):
        path.write_text(json.dumps({"order": given, "agreement_bonus": 0.2, "unknown": 1}))
        assert load_settings(str(path)) == Settings(order=wanted, agreement_bonus=0.2)
    for wrong in ("other", ["ats_json"], 5):
        path.write_text(json.dumps({"order": wrong}))
        assert load_settings(str(path)) == Settings()


def test_pdf_and_markdown(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF of Rosa Kern")
    (tmp_path / "b.md").write_text("Rosa Kern\nWelder\n")
    (tmp_path / "c.pdf").write_bytes(b"damaged")

    def extractor(content):
        if not content.startswith(b"%PDF"):
            raise ValueError("damaged")
        return "Rosa Kern\nWelder\n"

    got = {r["candidate_key"]: r for r in resume.parse_resumes(files.read_resumes(spark, str(tmp_path), {"pdf": extractor})).collect()}
    assert (got["a"]["source"], got["a"]["full_name"]["value"]) == ("resume_pdf", "Rosa Kern") and got["b"]["headline"]["value"] == "Welder"
    assert got["c"]["error"] == "ValueError: damaged" and got["c"]["full_name"] is None
    try:
        import pdfplumber  # noqa: F401
    except ImportError:
        without = {r["candidate_key"]: r for r in files.read_resumes(spark, str(tmp_path)).collect()}
        assert without["a"]["text"] is None and without["a"]["error"].startswith("ModuleNotFoundError") and without["b"]["error"] is None


def test_log_file(spark, tmp_path):
    at = tmp_path / "logs/pipeline.log"
    assert cli.main(["--ats", "none", "--resume", "none", "--log", str(at)], spark) == 1
    assert "No valid candidate sources" in at.read_text()


def test_optional_modules(monkeypatch, tmp_path):
    import __spark_entry__ as entry

    assert entry._optional("fusewright.no_such_part") is None
    (tmp_path / "needs_more.py").write_text("import no_such_library\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.warns(UserWarning, match="needs_more is left out: No module named 'no_such_library'"):
        assert entry._optional("needs_more") is None
