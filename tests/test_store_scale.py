"""The store: deletions without rewriting, look-ups that read one file, downloads in order over any number of files."""
import json

import pytest
from pyspark.sql import functions as F

from fusewright.sources import store

KINDS = dict(x.split() for x in store.STORE.split(", "))


def filled(spark, tmp_path, n, parts=5, **options):
    table = store.CandidateStore(spark, str(tmp_path / "store"), **options)
    table.init()
    given = {"candidate_id": "concat('c', id)", "projected_profile": "if(id % 10 = 3, null, concat('{\"x\":', id, '}'))", "final_profile": "'{}'"}
    rows = spark.range(0, n, 1, parts).select(*[F.expr(given.get(k, "null")).cast(kind).alias(k) for k, kind in KINDS.items() if k != "id"])
    assert table.save(rows) == (1, n)
    return table


def data_files(tmp_path):
    return {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet") if "/gone/" not in str(p) and "/last_ids/" not in str(p) and "/staged/" not in str(p)}


def test_deletion_writes_no_data_file(spark, tmp_path):
    table = filled(spark, tmp_path, 100)
    before = data_files(tmp_path)
    for k in (7, 100, 7, 5000):
        table.delete(k)
    assert data_files(tmp_path) == before
    assert sorted(r["id"] for r in table.rows().collect()) == [k for k in range(1, 101) if k not in (7, 100)]
    assert table.get(7).count() == 0 and table.get(8).count() == 1 and table.stats().first()["total"] == 98
    # an id is not given again, neither after a deletion nor after compaction or clearing
    assert table.save(table.rows().where("id = 8").drop("id")) == (101, 1)
    table.delete(101)
    table.compact()
    assert len(table.rows().collect()) == 98 and table.save(table.rows().where("id = 8").drop("id")) == (102, 1)
    table.clear()
    assert table.rows().count() == 0 and table.save(spark.createDataFrame([], store.STORE).drop("id")) == (103, 0)


def test_lookup_reads_one_file(spark, tmp_path):
    table = filled(spark, tmp_path, 1000, ids_per_folder=100)
    assert len(data_files(tmp_path)) >= 10
    found = table.get(555)._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(id_range" in found.toString() and len(found.executeCollect()) == 1
    scan = found.collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 1
    table.delete(556)
    assert [r["candidate_id"] for r in table.get(555).collect()] == ["c554"] and table.get(556).count() == 0


@pytest.mark.parametrize("files", [3, 7, 64])
def test_downloads_are_one_list(spark, tmp_path, files):
    table = filled(spark, tmp_path, 500, parts=6)
    for k in (1, 250, 500):
        table.delete(k)
    wanted = [None if (k - 1) % 10 == 3 else {"x": k - 1} for k in range(499, 1, -1) if k != 250]
    table.write_array(str(tmp_path / "array"), files)
    parts = sorted((tmp_path / "array").glob("part-*"))
    assert 1 < len(parts) <= files and json.loads("".join(p.read_text() for p in parts)) == wanted
    table.write_export(str(tmp_path / "lines"), files)
    lines = "".join(p.read_text() for p in sorted((tmp_path / "lines").glob("part-*"))).splitlines()
    assert [json.loads(x) for x in lines] == [x for x in wanted if x]


def test_downloads_of_an_empty_table(spark, tmp_path):
    table = store.CandidateStore(spark, str(tmp_path / "store"))
    table.write_array(str(tmp_path / "array"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "array").glob("part-*")))) == []
