"""Means at the half of a hundredth, rows of one split parsed by many tasks, lists whose facts move once."""
import itertools
import math
import operator
from functools import reduce

from pyspark.sql import functions as F
from test_fusion import frame, profile

from fusewright.operators.fuse import fuse, fuse_education
from fusewright.sources.ats import parse_ats
from fusewright.sources.notes import parse_notes
from fusewright.sources.resume import parse_resumes


def test_means_at_a_half_are_rounded_by_their_product(spark):
    rows, wanted = [], {}
    fields = {"full_name": "A", "headline": "B", "years_experience": 1.0, "location": ("Oslo", None, "NO")}
    for n, given in enumerate(itertools.product((0.8, 0.7, 0.6, 0.5), repeat=4)):
        rows += [profile(f"s{i}", i, key=f"k{n}", conf=c, **{k: fields[k]}) for i, (k, c) in enumerate(zip(fields, given))]
        mean = reduce(operator.add, given) / 4  # sum() of Python adds more exactly
        wanted[f"k{n}"] = math.floor(mean * 100 + 0.5) / 100
    found = {r["candidate_key"]: r["overall_confidence"] for r in fuse(frame(spark, *rows)).collect()}
    assert found == wanted


def test_rows_of_one_split_are_parsed_by_many_tasks(spark):
    one = spark.range(400).coalesce(1).select(F.col("id").cast("string").alias("candidate_key"), F.lit('{"name": "Ada"}').alias("raw"), F.lit("Name: Ada").alias("text"), F.lit("txt").alias("ext"))
    assert one.rdd.getNumPartitions() == 1
    for found in (parse_ats(one), parse_notes(one), parse_resumes(one)):
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 400 and len(sizes) >= 4 and max(sizes) <= 100


def test_facts_of_a_list_move_once_before_their_candidate(spark):
    rows = [profile("s", n, key=str(n % 3), education=[("MIT", "BSc", "Glass", 1999 + n)]) for n in range(9)]
    found = fuse_education(frame(spark, *rows))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert {r["candidate_key"]: r["education"][0]["end_year"] for r in found.collect()} == {"0": 2005, "1": 2006, "2": 2007}
