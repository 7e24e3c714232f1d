"""The conversation queries return whole texts, and order turns of equal number by them."""
import pytest

from fusewright.plans.queries import ORACLE_SQL, QUERIES

LONG = "the same thirty characters, and then "


@pytest.mark.parametrize("name", ["experience_sessionize_whole", "education_lookahead_whole"])
def test_whole_texts(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    turns = [(1, 0, "user", LONG + "b" * 2000), (1, 0, "user", LONG + "a"), (1, 1, "assistant", LONG + "z"), (1, 1, "assistant", LONG + "y"), (1, 2, "system", None), (1, 3, None, LONG + "c"), (1, 4, "user", None), (1, 5, "assistant", LONG + "\nx~y")]
    turns += [(2, 0, "assistant", LONG), (2, 1, "user", LONG + "é"), (2, 2, "user", ""), (2, 3, "user", LONG), (2, 3, "user", LONG)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()), key=str)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert found == sorted(duck.sql(ORACLE_SQL[name]).fetchall(), key=str)
    cells = [c for row in found for c in row if isinstance(c, str)]
    assert any("b" * 2000 in c for c in cells) and any(LONG + "a" in c for c in cells)
