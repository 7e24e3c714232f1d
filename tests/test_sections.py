"""Array expressions for sections against small sequential models."""
import random

from pyspark.sql import functions as F

from fusewright.functions.text import lines_of
from fusewright.operators import sections as S


def test_repeated_header_keeps_its_last_block(spark):
    text = "Jo\nEDUCATION\nold\nSkills\nx: a, b\nEducation\nnew\n"
    blocks = spark.createDataFrame([(text,)], "t string").select(S.segment(F.col("t")).alias("b"))
    got = blocks.select(S.section(F.col("b"), "EDUCATION").alias("e"), S.section(F.col("b"), "HEADER").alias("h"), S.section(F.col("b"), "PROJECTS").alias("p")).first()
    assert (got["e"], got["h"], got["p"]) == (["new"], ["Jo"], None)


def sequential_lookahead(lines, flag):
    out, i = [], 0
    while i < len(lines):
        if flag(lines[i]):
            out.append((lines[i], lines[i + 1] if i + 1 < len(lines) else None))
            i += 1
        i += 1
    return out


def sequential_blocks(lines, label):
    out = [["HEADER", []]]
    for x in lines:
        if label(x):
            out.append([x, []])
        else:
            out[-1][1].append(x)
    return [(a, b) for a, b in out]


def test_random_lines_match_sequential_models(spark):
    rng = random.Random(5)
    cases = [[rng.choice("dx") + str(k) for k in range(rng.randint(0, 12))] for _ in range(300)]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, l array<string>")
    flag = lambda x: x.startswith("d")
    rows = frame.select("i", S.lookahead(F.col("l"), flag).alias("e"), S.cut_at(F.col("l"), lambda x: F.when(flag(x), x)).alias("b")).collect()
    for r in rows:
        lines = cases[r["i"]]
        assert [(e["line"], e["next"]) for e in r["e"]] == sequential_lookahead(lines, flag)
        assert [(b["name"], list(b["body"])) for b in r["b"]] == sequential_blocks(lines, flag)


def test_jobs(spark):
    lines = ["before", "Work 2019 - 2020", "Unlisted", "May 2021", "- did", "more words than five in here", "Lead dev", "Gamma"]
    got = spark.createDataFrame([(lines,)], "l array<string>").select(S.parse_experience(F.col("l")).alias("e")).first()["e"]
    assert [(j["company"], j["title"], j["start"], j["end"], j["summary"]) for j in got] == [
        ("Unlisted", "Work", "2019-01", "2020-01", "May 2021\ndid\nmore words than five in here"),
        ("Gamma", "Lead dev", None, None, ""),
    ]


def test_three_degrees_in_a_row(spark):
    got = spark.createDataFrame([("B.E one\nMaster two 2019\nPhD - three\n",)], "t string").select(S.parse_education(lines_of(F.col("t"))).alias("e")).first()["e"]
    assert [(e["institution"], e["degree"], e["field"], e["end_year"]) for e in got] == [("Master two 2019", "B.E one", None, 2019), (None, "PhD", "three", None)]
