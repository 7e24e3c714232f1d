"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows is scanned over every training text.

A window's 64-bit hash is only a candidate: each hit is verified on the words themselves. The set is broadcast while the benchmark
has at most ``max_broadcast_windows`` windows; a larger benchmark is cut into parts of that size, which are broadcast and scanned one
after another, so neither the driver nor a worker ever holds more than one. The documents are then written down once, with a number
for each row, and of each part only the numbers and hits of the rows that it hits; these are united and joined to the documents at the end.
"""
from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusewright.llm._shared import cut, discard, free_name, prepare, table
from fusewright.llm._text import ALNUM, U64, Words, as_bytes, groups, signed, slices, windows

WINDOW = 13
#: About 100 bytes each.
MAX_BROADCAST_WINDOWS = 500_000


def _item_windows(size: int):
    """(window's words joined by one space, its number of words, its hash, item) of every item."""

    def run(batches):
        for batch in batches:
            texts, items = as_bytes(batch.column("text")), batch.column("item").to_pylist()
            for item, text in zip(items, texts, strict=True):
                w = Words([text], ALNUM)
                k = min(size, len(w.hashes))
                if not k:
                    continue
                words = [w.text(x) for x in range(len(w.hashes))]
                first, hashes = windows(w, k)
                for at in range(0, len(first), 10_000):
                    part = first[at : at + 10_000].tolist()
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([b" ".join(words[a : a + k]) for a in part], pa.binary()), pa.array([k] * n, pa.int32()), pa.array(signed(hashes[at : at + n])), pa.array([item] * n, pa.string())], names=["window", "k", "h", "item"])

    return run


class WindowSet:
    """The broadcast set: sorted hashes by window length, and the windows' words and items in Arrow arrays for verification."""

    def __init__(self, found: pa.Table):
        """``found`` has window, k, h and items."""
        self.words, self.items = found.column("window").combine_chunks(), found.column("items").combine_chunks()
        ks, hashes = found.column("k").to_numpy(), found.column("h").to_numpy().view(U64)
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in np.unique(ks).tolist():
            rows = np.flatnonzero(ks == k)
            rows = rows[np.argsort(hashes[rows], kind="stable")]
            self.parts[k] = (hashes[rows], rows)

    def hits(self, words: Words):
        """(document index, first word, number of words, items) of every verified occurrence."""
        for k, (hashes, rows) in self.parts.items():
            first, h = windows(words, k)
            if not len(first):
                continue
            low = np.searchsorted(hashes, h)
            may = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == h)
            for a, at, own in zip(first[may].tolist(), low[may].tolist(), h[may], strict=True):
                text = b" ".join(words.text(x) for x in range(a, a + k))
                while at < len(hashes) and hashes[at] == own:
                    if self.words[int(rows[at])].as_py() == text:
                        yield int(np.searchsorted(words.bounds, a, side="right")) - 1, a, k, self.items[int(rows[at])].as_py()
                    at += 1


def _scan(shared, text_col: str, hits: str):
    """Appends (n_words, spans of hit words, items) to every row; spans are first word and end, merged."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            yield batch.append_column(hits, pa.array(_hits(as_bytes(batch.column(text_col)), shared.value), HITS_ARROW))

    return run


def _scan_part(shared):
    """(row, hits) of every row that the part hits."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            found = _hits(as_bytes(batch.column("text")), shared.value)
            rows = [k for k, x in enumerate(found) if x["spans"]]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows, pa.int64())), pa.array([found[k] for k in rows], HITS_ARROW)], names=["row", "hits"])

    return run


def _hits(texts: list[bytes], found: WindowSet) -> list[dict]:
    out = []
    for a, b in groups(texts):
        words = Words(texts[a:b], ALNUM)
        per: dict[int, tuple[list, set]] = {}
        for doc, at, k, items in found.hits(words):
            spans, named = per.setdefault(doc, ([], set()))
            spans.append((at - int(words.bounds[doc]), at - int(words.bounds[doc]) + k))
            named.update(items)
        for doc in range(b - a):
            spans, named = per.get(doc, ([], set()))
            out.append({"n_words": int(words.bounds[doc + 1] - words.bounds[doc]), "spans": merged(spans), "items": sorted(named)})
    return out


def _unite(hits: str, more_col: str):
    """The hits of all parts (``more_col``) of each row as one; those of the first part are there already."""

    def run(batches):
        for batch in batches:
            own, more = batch.column(hits).to_pylist(), batch.column(more_col).to_pylist()
            for x, parts in zip(own, more, strict=True):
                if parts:
                    x["spans"] = merged([(s["start"], s["end"]) for p in (x, *parts) for s in p["spans"]])
                    x["items"] = sorted({i for p in (x, *parts) for i in p["items"]})
            yield batch.drop_columns([hits, more_col]).append_column(hits, pa.array(own, HITS_ARROW))

    return run


def merged(spans):
    """Overlapping and touching spans as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


HITS_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
HITS = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_broadcast_windows: int = MAX_BROADCAST_WINDOWS, hits_col: str = "hits") -> DataFrame:
    """``docs`` with a last column of hits: n_words, spans (word offsets, end exclusive, merged) and items with occurring windows.

    The column is named ``hits_col``, with underscores before it where ``docs`` has a column of that name. Words are runs of ASCII letters
    and digits and of anything that is not ASCII, A-Z lower-cased. A window is ``window`` consecutive words of an item; an item of
    fewer words, but not none, is one window. A document's word is hit if it lies inside any occurrence of a window. Every row stays with
    all its columns, repeated ones too. A null or empty text has no words and no hits; a benchmark item that is null, empty or
    without words matches nothing; repeated items count once by their id; an item with a null id still hits words, but is not listed.
    Empty tables give no hits or no rows. Whole texts of any length are scanned, about a megabyte of them at a time.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    every = items.mapInArrow(_item_windows(window), "window binary, k int, h long, item string")
    every = cut(every.groupBy("window", "k", "h").agg(F.array_sort(F.collect_set("item")).alias("items")))
    parts = max(1, -(-every.count() // max_broadcast_windows))
    name = free_name(hits_col, docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(HITS))])
    if parts == 1:
        shared = spark.sparkContext.broadcast(WindowSet(every.toArrow()))
        discard(every)
        return docs.mapInArrow(_scan(shared, text_col, name), schema)
    row, more = free_name("row", [*docs.columns, name]), free_name("more", [*docs.columns, name])
    held = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    texts, found = held.select(F.col(f"`{row}`").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")), []
    for part in range(1, parts):
        shared = spark.sparkContext.broadcast(WindowSet(every.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part).toArrow()))
        found.append(cut(texts.mapInArrow(_scan_part(shared), f"row long, hits {HITS}")))
        shared.destroy()
    shared = spark.sparkContext.broadcast(WindowSet(every.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == 0).toArrow()))
    hit = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.collect_list("hits").alias(more))
    both = held.join(cut(hit).withColumnRenamed("row", row), row, "left").select(*[F.col(f"`{c}`") for c in docs.columns], more)
    first = T.StructType([*docs.schema.fields, both.schema[more], T.StructField(name, T._parse_datatype_string(HITS))])
    discard(every, *found)
    return both.mapInArrow(_scan(shared, text_col, name), first).mapInArrow(_unite(name, more), schema)


def _contaminated(column: str = "hits"):
    column = F.col(f"`{column}`")
    n_hit = F.aggregate(column["spans"], F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return n_hit, (n_hit > 0) & (n_hit * 20 >= column["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged: a twentieth or more of the words hit rejects a document.

    Cases are as in ``find_hits``: rows without words stay, repeated rows share their fate, columns may have any name.
    """
    found = find_hits(docs, benchmark, **options)
    return found.where(~_contaminated(found.columns[-1])[1]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _cut_spans(text_col: str, hits: str):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            texts, found = batch.column(text_col).to_pylist(), batch.column(hits).to_pylist()
            out = []
            for text, hit in zip(texts, found, strict=True):
                if text is not None and hit["spans"]:
                    raw = text.encode()
                    words = Words([raw], ALNUM)
                    kept, at = [], 0
                    for s in hit["spans"]:
                        kept.append(raw[at : int(words.starts[s["start"]])])
                        at = int(words.ends[s["end"] - 1])
                    text = b"".join([*kept, raw[at:]]).decode()
                out.append(text)
            place = batch.schema.get_field_index(text_col)
            yield batch.set_column(place, text_col, pa.array(out, batch.column(text_col).type)).drop_columns([hits])

    return run


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every hit run of words cut out of its text; other rows are unchanged. Cases are as in ``find_hits``."""
    found = find_hits(docs, benchmark, text_col=text_col, **options)
    return found.mapInArrow(_cut_spans(text_col, found.columns[-1]), docs.schema)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of find_hits over all of ``documents`` and ``benchmark``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_hits(docs, table(spark, sf_dir, "benchmark"))
    n_hit, bad = _contaminated()
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ","), 256).alias("items_sha256"),
        bad.alias("contaminated"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS_SQL} AS l FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS l FROM benchmark),
bk AS (SELECT item, l, least(len(l), 13) AS k FROM b WHERE len(l) > 0),
bi AS (SELECT item, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM bk), bw AS (SELECT DISTINCT item, k, array_to_string(l[i:i + k - 1], ' ') AS win FROM bi),
di AS (SELECT doc_id, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM bk) WHERE len(l) >= k),
h AS (SELECT doc_id, i, d.k, item FROM (SELECT doc_id, k, i, array_to_string(l[i:i + k - 1], ' ') AS win FROM di) d JOIN bw ON bw.k = d.k AND bw.win = d.win),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(l) AS contaminated FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
"""


def brute_force(docs, items, window: int = WINDOW):
    """The same digest by plain Python, for tests: docs and items are lists of (id, text)."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
    split = lambda x: word.findall((x or "").translate(lower))
    wanted: dict[tuple, set] = {}
    for item, text in items:
        w = split(text)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            wanted.setdefault(tuple(w[a : a + k]), set()).add(str(item))
    sizes = {len(x) for x in wanted}
    out = {}
    for doc, text in docs:
        w, hit, named = split(text), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (got := wanted.get(tuple(w[a : a + k]))) is not None:
                    hit.update(range(a, a + k))
                    named |= got
        out[doc] = (len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


__all__ = ["brute_force", "decontaminate", "find_hits", "op10_decontamination", "remove_spans"]
