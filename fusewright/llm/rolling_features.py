"""Rolling window features: DuckDB works out RANGE frames inside Arrow partitions, keyed by hashed groups of sources and by blocks of time.

Sources are dealt to ``groups`` by hash, and time is cut into blocks, so that a source with a third of all rows is spread over all of its
time. A block gets a copy of the rows that lie up to the longest window before it (its halo), so each row's whole window is in its own
task: one shuffle of narrow rows (id, time, source, length, category), no join. In a task DuckDB counts, sums and counts distinct
categories over RANGE frames of the rows; lengths are gathered per moment, and a frame's lists are put in order and indexed.

A task holds one block and its halo of one group of sources. Lists are made for so many moments at a time that they have about
``LIST_BUDGET`` entries together.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusewright.llm._shared import prepare, table

WINDOWS = (1800, 86400)
GROUPS = 4
#: Entries of the lists that are held at once, 8 bytes each.
LIST_BUDGET = 2_000_000

_FRAME = "WINDOW w AS (PARTITION BY k ORDER BY t RANGE BETWEEN CASE WHEN {want} THEN {w} ELSE 1 END PRECEDING AND 1 PRECEDING)"
#: A moment's own rows never lie in its frame, and a moment of the halo has no use for one: its frame is the second before it.
_COUNTS = """
SELECT DISTINCT k, t, n, s, c, m FROM (
  SELECT k, t, own, count(*) OVER w AS n, sum(len) OVER w AS s, count(DISTINCT cat) OVER w AS c, count(len) OVER w AS m FROM input {frame}
) WHERE own
"""
_LISTS = """
SELECT k, t, l[(m + 1) // 2] AS median, l[(99 * m + 99) // 100] AS high FROM (
  SELECT k, t, want, list_sort(flatten(list(lens) OVER w)) AS l, len(l) AS m FROM (SELECT *, own AND slice = {part} AS want FROM moments) {frame}
) WHERE want
"""


def _connection():
    """One connection for a worker's life: one thread, bounded memory, no files."""
    global _OPEN
    if _OPEN is None:
        import duckdb

        _OPEN = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
    return _OPEN


_OPEN = None


def _features(windows: tuple[int, ...], budget: int):
    def run(rows):
        import pyarrow as pa

        con = _connection()
        con.register("arrived", rows)
        con.execute("CREATE OR REPLACE TEMP TABLE input AS SELECT id, k, t, len, cat, own FROM arrived")
        con.unregister("arrived")
        con.execute("CREATE OR REPLACE TEMP TABLE plain AS SELECT k, t, bool_or(own) AS own, coalesce(list(len) FILTER (len IS NOT NULL), []) AS lens FROM input GROUP BY k, t")
        found = []
        for w in windows:
            con.execute("CREATE OR REPLACE TEMP TABLE counts AS " + _COUNTS.format(frame=_FRAME.format(want="own", w=w)))
            longest, moments = con.execute("SELECT coalesce(max(m), 0), count(*) FROM counts").fetchone()
            size = max(1, budget // max(1, longest))
            con.execute(f"CREATE OR REPLACE TEMP TABLE moments AS SELECT *, (row_number() OVER (ORDER BY own DESC, t) - 1) // {size} AS slice FROM plain")
            con.execute("CREATE OR REPLACE TEMP TABLE places (k VARCHAR, t BIGINT, median BIGINT, high BIGINT)")
            for part in range(-(-moments // size)):
                con.execute("INSERT INTO places " + _LISTS.format(part=part, frame=_FRAME.format(want="want", w=w)))
            found.append(con.sql(f"""
                SELECT i.id, {w}::BIGINT AS w, i.t, c.n::BIGINT AS n, coalesce(c.s, 0)::BIGINT AS s, c.c::BIGINT AS c, p.median, p.high
                FROM input i JOIN counts c ON c.t = i.t AND c.k IS NOT DISTINCT FROM i.k JOIN places p ON p.t = i.t AND p.k IS NOT DISTINCT FROM i.k WHERE i.own
            """).to_arrow_table())
        return pa.concat_tables(found).cast(pa.schema([("id", rows.schema.field("id").type), *((x, pa.int64()) for x in ("w", "t", "n", "s", "c", "median", "high"))]))

    return run


def rolling_features(rows: DataFrame, time: Column, length: Column, id_col: str = "doc_id", source_col: str = "source", category_col: str = "lang", windows: tuple[int, ...] = WINDOWS, groups: int = GROUPS, block: int | None = None, list_budget: int = LIST_BUDGET) -> DataFrame:
    """For each row and each window: id, window_s, event_s, n_events, sum_chars, n_langs, median_chars, high_chars; all but the id long.

    ``time`` gives whole seconds. A row's window of W seconds holds all rows of its source with its time - W <= time < its time, so never the row
    itself nor others of the same second. Of the m lengths there that are not null, in order and with repeats, median_chars is number
    ceil(m / 2) and high_chars number ceil(99 * m / 100), counted from 1.

    A null source is one source. A null category is none, a null length is left out of sums and lists but its row counts. A row
    with a null time is in no window and has an empty one: 0 events, sum and categories, null lengths. Repeated rows, and rows with equal or null ids,
    all count and all come back. Empty tables give no rows. Other columns are not read, so they may have any name. Sources
    and categories are compared as strings; ids may be of any type. ``block`` is the length of a block in seconds, at least the
    longest window, as by default.
    """
    prepare(rows.sparkSession)
    widest = max(windows)
    block = max(widest, block or 0)
    kind = rows.schema[id_col].dataType
    slim = rows.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("k"), time.cast("long").alias("t"), length.cast("long").alias("len"), F.col(category_col).cast("string").alias("cat"))
    whole = lambda c: (c - F.pmod(c, F.lit(block))) / F.lit(block)
    reach = F.sequence(whole(F.col("t")).cast("long"), whole(F.col("t") + widest).cast("long"))
    dealt = slim.where("t IS NOT NULL").select(F.posexplode(reach).alias("far", "b"), "*")
    dealt = dealt.select(F.pmod(F.xxhash64("k"), F.lit(groups)).alias("g"), "b", "id", "k", "t", "len", "cat", (F.col("far") == 0).alias("own"))
    names = ("window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars")
    out = T.StructType([T.StructField("id", kind), *(T.StructField(x, T.LongType()) for x in ("w", "t", "n", "s", "c", "median", "high"))])
    done = dealt.groupBy("g", "b").applyInArrow(_features(tuple(windows), list_budget), out)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    timeless = slim.where("t IS NULL").select("id", F.explode(F.array(*[F.lit(w).cast("long") for w in windows])).alias("w"), none.alias("t"), zero.alias("n"), zero.alias("s"), zero.alias("c"), none.alias("median"), none.alias("high"))
    every = done.unionByName(timeless)
    return every.select(F.col("id").alias(id_col), *[F.col(a).alias(b) for a, b in zip(out.names[1:], names, strict=True)])


def op11_rolling_features(spark, sf_dir: str) -> DataFrame:
    """rolling_features over all of ``documents``, by the contract's clock."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    late = F.col("doc_id") + F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1000))
    clock = F.lit(60) * ((late - F.pmod(late, F.lit(6))) / F.lit(6)).cast("long")
    return rolling_features(docs, clock, F.length("text"))


OP11_SQL = r"""
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
hashed AS (SELECT d.*, xor(4294967295, list_reduce(list_transform(range(0, len(CAST(doc_id AS VARCHAR)) + 1), lambda k: CASE WHEN k = 0 THEN 4294967295 ELSE CAST(ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT) END),
    lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]))) AS h FROM documents d, crc),
e AS (SELECT doc_id, source, lang, length(text) AS len, 60 * ((doc_id + h % 1000 - ((doc_id + h % 1000) % 6 + 6) % 6) // 6) AS t FROM hashed),
q AS (SELECT doc_id, CAST(w AS BIGINT) AS window_s, t, source, lang, len, w FROM e, (SELECT unnest([1800, 86400]) AS w)),
f AS (SELECT p.doc_id, p.window_s, p.t AS event_s, count(r.doc_id) AS n_events, coalesce(sum(r.len), 0) AS sum_chars, count(DISTINCT r.lang) AS n_langs, list(r.len ORDER BY r.len) FILTER (r.len IS NOT NULL) AS l, count(r.len) AS m
  FROM q p LEFT JOIN e r ON r.source IS NOT DISTINCT FROM p.source AND r.t >= p.t - p.w AND r.t < p.t GROUP BY p.doc_id, p.window_s, p.t)
SELECT doc_id, window_s, CAST(event_s AS BIGINT) AS event_s, n_events, CAST(sum_chars AS BIGINT) AS sum_chars, n_langs, l[(m + 1) // 2] AS median_chars, l[(99 * m + 99) // 100] AS high_chars FROM f
"""
