"""Queries over the driver's smallest tables against SQL or brute force, and the pipeline against its parts."""
import os

import pytest

from fusewright.llm import decontamination, queries, secret_scan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_chat_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    found = queries.QUERIES["op7_chat_format"](spark, SF).collect()
    assert sorted(map(tuple, found)) == sorted(connection.sql(queries.ORACLE_SQL["op7_chat_format"]).fetchall())


def test_decontamination_against_brute_force(spark):
    wanted = decontamination.brute_force([(r["doc_id"], r["text"]) for r in read(spark, "documents")], [(r["item_id"], r["text"]) for r in read(spark, "benchmark")])
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op10_decontamination"](spark, SF).collect()} == wanted


def test_secrets_against_plain_patterns(spark):
    wanted = {r["doc_id"]: secret_scan.base_digest(r["text"]) for r in read(spark, "documents")}
    assert {r["doc_id"]: r["base_sha256"] for r in queries.QUERIES["op5_secret_scan"](spark, SF).collect()} == wanted


def test_every_query_keeps_its_rows(spark):
    n = {name: len(read(spark, name)) for name in ("documents", "pages")}
    assert queries.QUERIES["op6_url_filter"](spark, SF).count() == queries.QUERIES["op8_html_extract"](spark, SF).count() == n["pages"]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    done = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in docs.collect()}
    assert 0 < len(done) < len(ids) and len({r["doc_id"] for r in done}) == len(done) and {r["doc_id"] for r in done} <= ids
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]
