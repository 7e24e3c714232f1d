"""Every registered fusion query against its SQL on the smallest tables."""
import glob
import os
from decimal import Decimal

import pytest

from fusewright.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(rows):
    cell = lambda v: float(v) if isinstance(v, Decimal) else v
    return sorted((tuple(cell(v) for v in row) for row in rows), key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = [[row[c] for c in columns] for row in frame.collect()]
    wanted = duck.sql(ORACLE_SQL[name])
    places = [list(wanted.columns).index(c) for c in columns]
    assert plain(found) == plain([[row[i] for i in places] for row in wanted.fetchall()])
