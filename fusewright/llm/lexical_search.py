"""Ranked lexical search: postings as a term-bucketed table, joined with the items' terms, scored in integers, summed and ranked.

Documents are taken in blocks of a few megabytes of text. A term's postings of one block are one row: the ids of the documents that hold it,
how often, and how long they are. So a term in every document has as many rows as there are blocks, not as many as documents,
and no row is larger than a block. Each task sorts what it made by the term's bucket and the term before it writes it, so a search for few terms
reads the pages of their buckets only, and building the index needs no shuffle.

A search joins the items' terms twice: once for their document frequencies, from a column of counts, and once for the lists, with
each term's weight. What matches is then dealt by block: all terms of a block's documents meet there, so that summing by item and document needs no
other exchange, and only a block's best go to the final ranking.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusewright.llm._shared import cut, discard, prepare, table
from fusewright.llm._text import ALNUM, Words, as_bytes, slices

BUCKETS, BLOCK_BYTES, TOP = 64, 4 << 20, 50
#: A broadcast of search terms has this many at most, with this many items' references.
MAX_BROADCAST_TERMS, MAX_BROADCAST_REFERENCES = 100_000, 1_000_000
#: Items in one list of a term's items.
ITEMS_A_LIST = 1_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _layers(ids: pa.Array) -> np.ndarray:
    """How many times each id came before in the block."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    layer = np.zeros(len(codes), dtype=np.int64)
    layer[order] = np.arange(len(codes)) - np.repeat(first, np.diff(np.r_[first, len(codes)]))
    return layer


def _lists(texts: list[bytes], ids: pa.Array, block: int) -> pa.RecordBatch | None:
    """One row per term of the texts: term, block, n_docs, docs, tfs, lens. The empty term has every document with a term."""
    words = Words(texts, ALNUM)
    counts = np.diff(words.bounds)
    if not len(words.hashes):
        return None
    _, first, term = np.unique(words.hashes, return_index=True, return_inverse=True)
    pairs, tf = np.unique(term.astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), counts), return_counts=True)
    term, doc = np.divmod(pairs, len(texts))
    whole = np.flatnonzero(counts)
    doc, tf = np.r_[whole, doc], np.r_[counts[whole], tf]
    cuts = np.r_[0, len(whole) + np.searchsorted(term, np.arange(len(first) + 1))]
    raw = words.buffer.tobytes()
    names = [b"", *(raw[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True))]
    offsets = pa.array(cuts, pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (ids.take(pa.array(doc)), pa.array(tf, pa.int32()), pa.array(counts[doc], pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.array(np.full(len(names), block)), pa.array(np.diff(cuts), pa.int32()), *lists], names=["term", "block", "n_docs", "docs", "tfs", "lens"])


def _blocks(limit: int):
    def run(batches):
        at, texts, ids, size = TaskContext.get().partitionId() << 32, [], [], 0

        def close():
            nonlocal at, texts, ids, size
            every = pa.concat_arrays(ids)
            layers = _layers(every)
            for k in range(int(layers.max()) + 1):
                rows = np.flatnonzero(layers == k)
                found = _lists([texts[i] for i in rows.tolist()], every.take(pa.array(rows)), at)
                at += 1
                if found is not None:
                    yield found
            texts, ids, size = [], [], 0

        for batch in (part for whole in batches for part in slices(whole, "text")):
            more = as_bytes(batch.column("text"))
            texts += more
            ids.append(batch.column("id"))
            size += sum(map(len, more))
            if size >= limit:
                yield from close()
        if ids:
            yield from close()

    return run


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index, written to the shared folder: bucket, term, block, n_docs, docs (their ids), tfs (times in each), lens (terms of each).

    Terms are runs of ASCII letters and digits and of all that is not ASCII, of the whole text, A-Z lower-cased. Every row is a document of its
    own: rows that repeat an id are in different blocks, so that they are never summed. A null id is an id; a null or empty text, or one
    without terms, is in no list. The empty term lists every document that has a term. An empty table gives an empty index. Only the two
    columns are read, so others may have any name. ``discard`` deletes the table.
    """
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    of = lambda kind: T.ArrayType(kind)
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("block", T.LongType()), T.StructField("n_docs", T.IntegerType()), T.StructField("docs", of(slim.schema["id"].dataType)), T.StructField("tfs", of(T.IntegerType())), T.StructField("lens", of(T.IntegerType()))])
    lists = slim.mapInArrow(_blocks(block_bytes), schema).select(F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"), "*")
    return cut(lists.sortWithinPartitions("bucket", "term", "block"))


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.translate(F.col(text_col).cast("string"), upper, upper.lower())
    return items.select(F.col(item_col).alias("item"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)))).alias("term")).distinct()


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", doc_col: str = "doc_id", top: int = TOP, buckets: int = BUCKETS) -> DataFrame:
    """Each item's ``top`` best documents of ``index`` (of ``postings``): item, rank (int, from 1), document, score (long, over 0).

    With N documents that have a term, L terms in them and n in one, a term held by df of them weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); with
    m = 50 + 50 * n * N div L a document scores the sum of w * (10^9 * tf div (1000 * tf + 20 * m)) over the item's terms, once each.
    Equal scores go by ascending document id, null last. Rows of one item id, null too, are one item with the terms of all. Items that
    are null, empty or without a known term, and empty tables, give no rows.
    """
    spark = index.sparkSession
    every = F.expr(f"term = '' AND bucket = pmod(xxhash64(''), {buckets})")
    total = index.where(every).agg(F.sum("n_docs").alias("N"), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda t, x: t + x)).alias("L")).first()
    n_docs, n_terms = total["N"] or 0, total["L"] or 1
    wanted = cut(_item_terms(items, item_col, text_col).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))))
    sizes = wanted.agg(F.countDistinct("term").alias("terms"), F.count("*").alias("references")).first()
    small = sizes["terms"] <= MAX_BROADCAST_TERMS and sizes["references"] <= MAX_BROADCAST_REFERENCES
    bounded = F.broadcast if small else lambda frame: frame
    terms = wanted.select("bucket", "term").distinct()
    df = index.select("bucket", "term", "n_docs").join(bounded(terms), ["bucket", "term"]).groupBy("bucket", "term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    chunk = F.pmod(F.xxhash64("item"), F.lit(-(-sizes["references"] // ITEMS_A_LIST) or 1))
    named = wanted.groupBy("bucket", "term", chunk.alias("chunk")).agg(F.collect_list(F.struct("item")).alias("items"))
    weights = cut(named.join(df, ["bucket", "term"]).select("bucket", "term", "items", weight.alias("w")).where("w > 0"))
    matched = index.join(bounded(weights), ["bucket", "term"]).select("block", "docs", "tfs", "lens", "items", "w").repartition("block")
    each = matched.select("block", F.posexplode("docs").alias("at", "doc"), "tfs", "lens", "items", "w")
    each = each.select("block", "doc", "items", "w", F.col("tfs")[F.col("at")].cast("long").alias("tf"), F.col("lens")[F.col("at")].cast("long").alias("n"))
    m = f"(100L - 50L + ((50L * n * {n_docs}L) div {n_terms}L))"
    scored = each.select("block", "doc", "items", F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 20L * {m}))").alias("s")).where("s > 0")
    summed = scored.select("block", "doc", "s", F.explode("items").alias("i")).groupBy("block", "i", "doc").agg(F.sum("s").alias("score"))
    best = Window.partitionBy("i").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last(), "block")
    ranked = summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select(F.col("i.item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_col), "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """search of all ``benchmark`` items in the postings of all ``documents``."""
    return search(postings(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH t AS (SELECT doc_id, {_TERMS_SQL} AS l FROM documents), d AS (SELECT doc_id, l, CAST(len(l) AS BIGINT) AS n FROM t WHERE len(l) > 0),
g AS (SELECT count(*) AS N_docs, CAST(sum(n) AS BIGINT) AS L_terms FROM d),
p AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM (SELECT doc_id, n, unnest(l) AS term FROM d) GROUP BY doc_id, term),
i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark)),
w AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(N_docs AS DOUBLE) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g WHERE term IN (SELECT term FROM i) GROUP BY term, N_docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * N_docs) // L_terms))))) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN p USING (term), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
"""
