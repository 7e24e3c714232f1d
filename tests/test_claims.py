"""Claims that merge: one table, few exchanges, hot candidates, lists as rows, streams equal to a recompute."""
import random

import pytest
from pyspark.sql import functions as F
from test_fusion import frame, profile

from fusewright.operators.claims import LISTS, SCHEMA, claims, combine
from fusewright.operators.fuse import entries, fuse, records, together
from fusewright.schema import PROFILE, PROFILE_FIELDS
from fusewright.settings import Settings
from fusewright.streaming.fusion import _states, current, fuse_stream


def invented(rng, n):
    """Profiles with ties, nulls, repeats and odd entries, of a few candidates."""
    pick = lambda *xs: rng.choice([None, *xs])
    rows = []
    for _ in range(n):
        source = rng.randrange(4)
        fields = {
            "full_name": pick("Ada Quist", "A. Quist"),
            "headline": pick("Diver", "Welder"),
            "years_experience": pick(0.0, 2.5, 7.0),
            "location": pick(("Oslo", None, "NO"), ("Bergen", None, None)),
            "links": pick((pick("l1", "l2"), pick("", "g"), None, rng.choices(["o1", "o2", "o3"], k=2)), (None, None, None, [])),
            "emails": pick(["a@x.example"], ["b@x.example", "c@x.example"], []),
            "phones": pick(["1"], ["2", "3"]),
            "skills": rng.choices(["Kilns", "Etching", "Glue"], k=rng.randrange(1, 3)),
            "experience": pick([(pick("Acme", " acme", ""), pick("Diver", "diver "), pick("2001", "2001-02"), None, pick("x", "xyz", "abc")) for _ in range(2)], []),
            "education": pick([(pick("MIT", "mit"), pick("BSc", ""), pick("Glass", "Glass Art"), pick(1999, 2004))]),
        }
        rows.append(profile(f"s{source}", source, key=rng.choice(["k1", "k2", "k3", None]), conf=rng.choice([0.5, 0.7, 0.9]), **{k: v for k, v in fields.items() if v is not None}))
    return rows


def plain(df):
    return sorted((repr(r.asDict(recursive=True)) for r in df.collect()))


def test_claims_merge_in_any_grouping(spark):
    rng = random.Random(5)
    rows = invented(rng, 60)
    whole = fuse(frame(spark, *rows), Settings())
    parts = [combine(claims(frame(spark, *rows[k::3]))) for k in range(3)]
    merged = combine(parts[2].unionByName(combine(parts[0].unionByName(parts[1]))))
    assert plain(records(together(merged, Settings()))) == plain(whole) and whole.count() == 4
    assert [f.name for f in claims(frame(spark, *rows)).schema] == [x.strip().split(" ")[0] for x in SCHEMA.split(", ")]


def test_few_exchanges(spark):
    """Three of combined claims; none of whole profiles."""
    given = frame(spark, *invented(random.Random(1), 5))
    plan = fuse(given)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 3 and plan.count("Join") == 0
    assert plan.split("== Initial Plan ==")[-1].count("partial_max") >= 5


def test_hot_null_key(spark):
    """Many rows of one candidate, a null one, are combined before they move, and listed as rows over several partitions."""
    n = 60_000
    entry = lambda company: F.array(F.struct(company.alias("company"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"), F.repeat(F.lit("s"), (F.col("id") % 4).cast("int")).alias("summary")))
    cells = [(entry(F.concat(F.lit("c"), (F.col("id") % 20_000).cast("string"))) if k == "experience" else F.lit(None)).cast(kind).alias(k) for k, kind in PROFILE_FIELDS.items()]
    none = F.lit(None).cast("string")
    rows = spark.range(n).repartition(6).select(none.alias("candidate_key"), F.lit("s").alias("source"), F.col("id").cast("int").alias("source_ord"), *cells, none.alias("error"))
    listed = entries(rows, "experience")
    assert listed.count() == 20_000 and sorted(r[0] for r in listed.select("position").collect()) == list(range(20_000))
    at = {r["position"]: r["company"] for r in listed.where("position IN (0, 777, 19999)").select("position", "entry.company").collect()}
    assert at == {0: "c0", 777: "c777", 19_999: "c19999"}
    assert listed.select("entry.summary").distinct().count() == 4


@pytest.mark.parametrize("kind", LISTS)
def test_entries_are_the_arrays(spark, kind):
    given = frame(spark, *invented(random.Random(9), 50)).repartition(5)
    name = {"skill": "skills", "other": "links.other"}.get(kind, kind)
    arrays = fuse(given).select("candidate_key", F.posexplode(name).alias("position", "entry"))
    cast = lambda df: sorted((repr(r.asDict(recursive=True)) for r in df.select("candidate_key", F.col("position").cast("int").alias("position"), "entry").collect()))
    assert cast(entries(given, kind)) == cast(arrays)
    with pytest.raises(ValueError, match="kind must be one of"):
        entries(given, "profile")


def test_stream_equals_recompute(spark, tmp_path):
    """Random batches with repeats; a batch that runs again counts once; two states of a bucket stay at most."""
    source, folder, rng = tmp_path / "in", str(tmp_path / "out"), random.Random(3)
    source.mkdir()
    stream, every = spark.readStream.schema(PROFILE).parquet(str(source)), []
    for _ in range(4):
        rows = invented(rng, 12)
        every += rows
        frame(spark, *rows).coalesce(1).write.mode("append").parquet(str(source))
        fuse_stream(stream, folder, Settings(), availableNow=True).awaitTermination()
        assert plain(current(spark, folder)) == plain(fuse(frame(spark, *every)))
    assert all(len(ns) <= 2 for ns in _states(spark, folder).values())
    (tmp_path / "out/checkpoint/commits/3").unlink()
    (tmp_path / "out/checkpoint/commits/.3.crc").unlink(missing_ok=True)
    fuse_stream(stream, folder, Settings(), availableNow=True).awaitTermination()
    assert plain(current(spark, folder)) == plain(fuse(frame(spark, *every)))
    assert not any((tmp_path / "out").glob("profiles"))
