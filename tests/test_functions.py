"""Text functions and normalisers, case by case."""
from pyspark.sql import functions as F

from fusewright.functions import normalize as N
from fusewright.functions import text as X
from fusewright.settings import Settings, load_settings
from fusewright.sources.ats import clean_json


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_emails_phones_and_skills(spark):
    assert apply(spark, N.normalize_email, [" A@B.COM ", "", None]) == ["a@b.com", "", None]
    phones = ["9876543210", "12345", "+91 98765 43210", "919876543210", "098765 43210", "+999 1", None, "+44 20 7946 0958"]
    assert apply(spark, N.normalize_phone, phones) == ["+919876543210", "12345", "+919876543210", "+919876543210", "+919876543210", "+999 1", None, "+442079460958"]
    assert apply(spark, N.normalize_skill, ["PY", " Docker ", "css3", None]) == ["Python", "Docker", "CSS", None]


def test_countries_and_dates(spark):
    assert apply(spark, N.normalize_country, ["india", "UK", "France", "", None]) == ["IN", "GB", "FR", None, None]
    given = ["May 2025", "05/2025", "15/05/2025", "2025", "2025-13", "Currently", "soon", "", None, "2024-09", "market 2024"]
    once = apply(spark, N.normalize_date, given)
    assert once == ["2025-05", "2025-05", "2025-05", "2025-01", "2025-01", "Present", "soon", None, None, "2024-09", "2024-03"]
    assert apply(spark, N.normalize_date, once) == once


def test_tenure(spark):
    job = lambda a, b: (None, None, a, b, None)
    given = [[job("2024-01", "2024-06"), job("2024-04", "2024-09")], [job("2024-05", "2024-01")], [], None, [job("2026-01", "Present"), job("soon", "2026-01")]]
    assert apply(spark, lambda c: N.tenure_years(c, Settings()), given, N.experience_type()) == [0.75, 0.0, 0.0, 0.0, 0.5]


def test_case_and_space(spark):
    assert apply(spark, X.title_case, ["O'NEIL-SMITH", "jane q doe", "x2y é", ""]) == ["O'Neil-Smith", "Jane Q Doe", "X2Y É", ""]
    assert apply(spark, X.strip_ws, ["  a b\t\n", "", None]) == ["a b", "", None]
    assert apply(spark, X.capitalize, ["hELLO", "", None]) == ["Hello", "", None]


def test_extraction(spark):
    assert apply(spark, X.extract_emails, ["a @ b . com, c@d.org a@b.com", "none", None]) == [["a@b.com", "c@d.org"], [], None]
    assert apply(spark, X.extract_phones, ["call +91 98765 43210 now", "12", None]) == [["+91 98765 43210"], [], None]
    got = apply(spark, X.extract_links, ["https://linkedin.com/in/x, github.com/u | https://a.org/p. gmail.com/x https://a.org/p"])[0]
    assert (got["linkedin"], got["github"], got["portfolio"], got["other"]) == ("https://linkedin.com/in/x", "github.com/u", None, ["https://a.org/p"])
    places = apply(spark, X.extract_location, ["Jo\nx | Pune, India | y", "no place", "a\nb\nc\nd\ne\nlives in Berlin, Germany now", None])
    assert [p and (p["city"], p["country"]) for p in places] == [("Pune", "India"), None, ("a\nb\nc\nd\ne\nlives in Berlin", "Germany"), None]


def test_json_cleanup(spark):
    got = apply(spark, clean_json, ['{"a":"https://x", // c\n"b":[1,2,],/* d */}'])
    assert got == ['{"a":"https://x", \n"b":[1,2]}']


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"ats_confidence": 0.5, "other": 1}')
    assert load_settings(str(path)).ats_confidence == 0.5
    assert load_settings(str(tmp_path / "none")) == Settings() == load_settings(None)
