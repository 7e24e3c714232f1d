"""Phones by the numbering plan."""
from pyspark.sql import functions as F

from fusewright.functions.phones import PLAN, e164, find_phones, matched_phones, normalize_phone


def apply(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "id int, x string")
    return [r["y"] for r in rows.select("id", f(F.col("x")).alias("y")).orderBy("id").collect()]


def test_validity(spark):
    right = {"98765 43210": "+919876543210", "098765-43210": "+919876543210", "+91 (0)98765 43210": "+919876543210", "0091 98765 43210": "+919876543210", "919876543210": "+919876543210", "+44 (0)20 7946 0958": "+442079460958", "+1 (212) 736-5000": "+12127365000", "+65 6123 4567": "+6561234567", "+39 06 1234567": "+39061234567", "+49 30 1234567": "+49301234567", "+691 320 1234": "+6913201234"}
    assert apply(spark, e164, list(right)) == list(right.values())
    wrong = ["+1 555 736 5000", "+1 212 136 5000", "+1 211 736 5000", "+1 212 736 500", "+44 7700 9009", "+65 1123 4567", "+999 12345678", "12345", "", "+", "no digits", "+91 0 123", None, "+33 1 23 45 67 89 0"]
    assert apply(spark, e164, wrong) == [None] * len(wrong)
    # what the plan does not have keeps its form, unless its length says it is one of the home country
    assert apply(spark, normalize_phone, ["+1 555 736 5000", "12345", "0123456789", None, ""]) == ["+1 555 736 5000", "12345", "+910123456789", None, ""]
    assert len({row.split()[0] for row in PLAN.strip().splitlines()}) == len(PLAN.strip().splitlines())


def test_numbers_in_texts(spark):
    texts = ["Call +44 20 7946 0958 or 98765-43210, not 98765432101234567 nor id9876543210 nor 9876543210x; again (98765) 43210.", "9876543210 9123456789", "1234 5678 90", None, "", "call 12345 678 9012", "x" * 200_000 + " 9876543210"]
    assert apply(spark, matched_phones, texts) == [["+442079460958", "+919876543210"], ["+919876543210", "+919123456789"], ["+911234567890"], None, [], [], ["+919876543210"]]
    assert apply(spark, find_phones, ["at 000 000 00001 only", "9876543210", None]) == [["000 000 00001"], ["+919876543210"], None]
