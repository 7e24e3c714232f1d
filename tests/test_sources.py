"""Sources, from raw input to profiles."""
import io
import json
import zipfile

from fusewright.functions.normalize import normalize_profile
from fusewright.sources import ats, files, github, linkedin, notes, recruiter_csv, resume

RESUME = """JANE DOE
Data Engineer
Pune, India | jane@x.com | +44 7700 900777 | github.com/jane
SKILLS
Languages: Python, SQL (MySQL)
EXPERIENCE
Data Engineer | Acme | Jan 2024 - Mar 2024
• built things
Intern at Beta Jun 2023 – Present
Beta Labs
- ran - tests
EDUCATION
B.Tech - Computer Science CGPA 9.1
Some College | 2019 - 2023
"""


def one(frame):
    return frame.collect()[0].asDict(recursive=True)


def test_ats_aliases_and_nesting(spark):
    raws = {
        "a": {"candidate_name": None, "name": "hidden", "contact": {"mail": "J@X.com", "phone": 98}, "skills": "py, sql,", "urls": ["https://linkedin.com/in/j", "https://github.com/j", "z"], "city": "Pune, MH, India"},
        "b": {"name": "Bo", "emails": [" b@x.org ", "", None], "contact": {"fax": 1}, "experience_years": "3.5", "work_history": [{"employer": "Acme", "role": "Dev", "start_date": "May 2020"}, "x"], "academic_history": [{"school": "S", "end_year": "2020"}, {"college": "C", "end_year": "x"}]},
        "c": {"location": {"town": "Bonn", "state": "NW", "country": "germany"}, "title": "Lead", "company": "Z", "years_experience": 0, "github": "https://github.com/c"},
    }
    rows = [(k, json.dumps(v)) for k, v in raws.items()] + [("bad", "{"), ("list", "[1]"), ("null", None)]
    got = {r["candidate_key"]: r.asDict(recursive=True) for r in normalize_profile(ats.parse_ats(spark.createDataFrame(rows, "candidate_key string, raw string"))).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert a["full_name"] is None and a["emails"]["value"] == ["j@x.com"] and [s["name"] for s in a["skills"]] == ["Python", "SQL"]
    assert a["links"]["value"] == {"linkedin": "https://linkedin.com/in/j", "github": "https://github.com/j", "portfolio": None, "other": ["z"]}
    assert a["location"]["value"] == {"city": "Pune", "region": None, "country": "IN"}
    assert b["emails"]["value"] == ["b@x.org"] and b["phones"] is None and b["years_experience"]["value"] == 3.5
    assert b["experience"] == [{"company": "Acme", "title": "Dev", "start": "2020-05", "end": None, "summary": None}]
    assert [(e["institution"], e["end_year"]) for e in b["education"]] == [("S", 2020), ("C", None)]
    assert c["location"]["value"] == {"city": "Bonn", "region": "NW", "country": "DE"} and c["years_experience"]["value"] == 0
    assert c["experience"][0]["summary"] == ats.SYNTHESIZED and c["links"]["value"]["github"] == "https://github.com/c"
    assert all(got[k]["error"] and got[k]["full_name"] is None for k in ("bad", "list", "null"))


def test_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(' Name ,EMAIL,phone,current_company,title\nJane Roe,jane@x.com,+911,Acme,Intern\n"Bo, Jr",,,,\n')
    rows = recruiter_csv.read_csv(spark, str(path))
    got = {r["full_name"]["value"]: r for r in recruiter_csv.parse_csv(rows).collect()}
    assert got["Jane Roe"]["emails"]["value"] == ["jane@x.com"] and got["Jane Roe"]["headline"]["value"] == "Intern"
    assert got["Bo, Jr"]["experience"] is None and got["Bo, Jr"]["candidate_key"] == "bo, jr"
    assert recruiter_csv.first_row(rows).count() == 1


def test_notes(spark):
    text = "Met at the harbour fair\nName: Oskar Lind\nTitle: Boat Builder\nTurku, Finland\nReach him at oskar@lind.example or +44 7700 900555\nTechnologies: Rust | Sails & Knots\n12.5 yrs of experience with wood"
    got = {r["candidate_key"]: r for r in notes.parse_notes(spark.createDataFrame([("a", text), ("b", "Bo Li\nx"), ("c", None)], "candidate_key string, text string")).collect()}
    a = got["a"]
    assert (a["full_name"]["value"], a["headline"]["value"], a["years_experience"]["value"]) == ("Oskar Lind", "Boat Builder", 12.5)
    assert [s["name"] for s in a["skills"]] == ["Rust", "Sails", "Knots"] and a["location"]["value"]["country"] == "Finland" and a["emails"]["value"] == ["oskar@lind.example"]
    assert got["b"]["full_name"]["value"] == "Bo Li" and got["c"]["error"] == "no text"


def test_linkedin_and_github(spark):
    urls = spark.createDataFrame([("a", "https://linkedin.com/in/jane-q-roe-b97"), ("b", "x")], "candidate_key string, url string")
    got = {r["candidate_key"]: r for r in linkedin.parse_linkedin(urls).collect()}
    assert got["a"]["full_name"]["value"] == "Jane Q Roe" and got["a"]["full_name"]["confidence"] == 0.4 and got["b"]["links"] is None
    urls = spark.createDataFrame([("a", "https://github.com/Jane"), ("b", "https://github.com/unknown"), ("c", "x")], "candidate_key string, url string")
    users = spark.createDataFrame([("jane", "Jane", "", "j@x.com", "Pune, India", "b.io")], github.USER)
    repos = spark.createDataFrame([("jane", k, "Go" if k % 2 else None) for k in range(12)] + [("jane", 11, "Late")], "login string, position int, language string")
    got = {r["candidate_key"]: r for r in github.parse_github(urls, users, repos).collect()}
    assert got["a"]["links"]["value"]["portfolio"] == "b.io" and [s["name"] for s in got["a"]["skills"]] == ["Go"] and got["a"]["headline"] is None
    assert got["b"]["links"]["value"]["github"] == "https://github.com/unknown" and got["b"]["full_name"] is None and got["c"]["links"] is None


def docx(text):
    body = "".join(f"<w:p><w:r><w:t>{line.replace('&', '&amp;')}</w:t></w:r></w:p>" for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        file.writestr("word/document.xml", f'<w:document xmlns:w="{files.WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_resumes_of_all_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text(RESUME)
    (tmp_path / "b.docx").write_bytes(docx(RESUME))
    (tmp_path / "c.rtf").write_text("x")
    (tmp_path / "d.docx").write_text("broken")
    (tmp_path / "e.json").write_text('{"k": "python"}')
    read = files.read_resumes(spark, str(tmp_path))
    got = {r["candidate_key"]: r.asDict(recursive=True) for r in normalize_profile(resume.parse_resumes(read)).collect()}
    a, b = got["a"], got["b"]
    assert a["source"] == "resume_txt" and {k: v for k, v in a.items() if isinstance(v, list)} == {k: v for k, v in b.items() if isinstance(v, list)} | {"skills": a["skills"]}
    assert (a["full_name"]["value"], a["headline"]["value"]) == ("Jane Doe", "Data Engineer")
    assert [s["name"] for s in a["skills"]] == ["Python", "SQL", "MySQL"] and a["links"]["value"]["github"] == "github.com/jane"
    assert a["experience"] == [
        {"company": "Acme", "title": "Data Engineer", "start": "2024-01", "end": "2024-03", "summary": "built things"},
        {"company": "Beta Labs", "title": "Intern at Beta", "start": "2023-06", "end": "Present", "summary": "ran - tests"},
    ]
    assert a["years_experience"]["value"] == round(37 / 12, 2)
    assert a["education"] == [{"institution": "Some College", "degree": "B.Tech", "field": "Computer Science", "end_year": 2023}]
    assert got["c"]["error"].startswith("Unsupported") and got["d"]["error"] and [s["name"] for s in got["e"]["skills"]] == ["Python"]


def test_config_precedence(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"fields": []}')
    assert files.load_config(None, str(path)) == {"fields": []} and files.load_config("none", "none") == files.BUILT_IN_CONFIG
