"""Extraction takes time that grows with a text's length, and finds what plain patterns find."""
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fusewright.functions import text as X
from fusewright.operators.sections import lookahead

PLAIN_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PLAIN_URL = r"https?://[^\s|]+|[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}/[^\s|]+"
PLAIN_PLACE = r"(?i)\b([A-Za-z\s]+),\s*(India|USA|United States|UK|United Kingdom|Germany|Singapore|Canada|Australia)\b"


def test_same_as_plain_patterns(spark):
    rng = random.Random(11)
    pieces = ["a", "b.c", "x@y", "@", ".", "com", " ", "  ", "org", "a@b.co", "http", "https://", "/", "q.de/", "|", "\n", ",", ", ", "India", "UK", "New Town", "5", "é", "_", "-", "github.com/u"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select(
        "text", F.regexp_extract_all("text", F.lit(X.EMAIL), F.lit(0)).alias("emails"), F.regexp_extract_all("text", F.lit(X.URL), F.lit(0)).alias("urls"),
        F.col("text").rlike(X.PLACE_ANYWHERE).alias("place"), F.regexp_extract("text", X.PLACE_ANYWHERE, 1).alias("city"), F.regexp_extract("text", X.PLACE_ANYWHERE, 2).alias("country"),
        X.strip_ws(F.col("text")).alias("stripped"), F.regexp_replace("text", r"(?U)(?:\G|(?<!\s))\s*+@\s*+", "@").alias("closed"), X.extract_emails(F.col("text")).alias("found"),
    )
    for r in got.collect():
        t = r["text"]
        assert r["emails"] == re.findall(PLAIN_EMAIL, t) and r["urls"] == re.findall(PLAIN_URL, t), t
        place = re.search(PLAIN_PLACE, t)
        assert (r["place"], r["city"], r["country"]) == ((True, *place.groups()) if place else (False, "", "")), t
        assert r["stripped"] == t.strip() and r["closed"] == re.sub(r"\s*@\s*", "@", t), t
        closed = re.sub(rf"(?i)\s*\.\s*({X.TLDS})\b", r".\1", re.sub(r"\s*@\s*", "@", t))
        assert r["found"] == list(dict.fromkeys(re.findall(PLAIN_EMAIL, closed))), t


@pytest.mark.parametrize("size", [40_000, 1_000_000])
def test_long_runs(spark, size):
    texts = {
        "run": "a" * size + " me@x.example",
        "dots": "a." * (size // 2) + " me@x.example",
        "signs": "a@" * (size // 2) + " me@x.example",
        "spaces": "x" + " " * size + "y me @ x . example",
        "words": "plain words " * (size // 12) + "; me@x.example Pune, India",
        "commas": "a, " * (size // 3) + "; me@x.example",
    }
    rows = spark.createDataFrame(list(texts.items()), "name string, text string").coalesce(1).cache()
    rows.count()
    for of in (X.extract_emails, X.extract_links, X.extract_location, X.strip_ws):
        rows.limit(0).select(of(F.col("text"))).collect()
        began = time.time()
        got = {r["name"]: r["v"] for r in rows.select("name", of(F.col("text")).alias("v")).collect()}
        assert time.time() - began < (3 if size < 100_000 else 20), of
        if of is X.extract_emails:
            assert got["run"][-1] == "me@x.example" == got["dots"][-1] == got["commas"][-1] and got["spaces"] == ["me@x"] or got["spaces"] == []
        if of is X.extract_location:
            assert (got["words"]["city"], got["words"]["country"]) == ("Pune", "India") or got["words"]["country"] == "India"
    rows.unpersist()


def test_lookahead_of_many_lines(spark):
    lines = F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda k: F.concat(F.when(k % 7 < 3, "d").otherwise("x"), k.cast("string")))
    held = spark.range(1).select(lines.alias("l")).cache()
    held.count()
    began = time.time()
    found = held.select(F.explode(lookahead(F.col("l"), lambda x: x.startswith("d"))).alias("e")).select("e.line", "e.next").collect()
    assert time.time() - began < 5
    flags = [k % 7 < 3 for k in range(1, 200_001)]
    wanted, k = [], 0
    while k < len(flags):
        if flags[k]:
            name = lambda i: ("d" if flags[i] else "x") + str(i + 1) if i < len(flags) else None
            wanted.append((name(k), name(k + 1)))
            k += 1
        k += 1
    assert [tuple(r) for r in found] == wanted
    held.unpersist()
