"""Reversible line dedup: sharded cuckoo filters, backed by exact tables of references.

The index is a folder of tables, dealt into shards by the hash of a line's key:

- ``lines``: (key, document) of every long line, as inserted; ``gone`` has the documents removed since.
- ``counts``: how many documents gained or lost a key with each change. The sum over all changes is its exact count of references.
- ``filters``: a cuckoo filter per shard that holds each key once while its count is over 0.

An insertion asks the filters first: a key that they do not hold is new, and only the others are looked up in ``counts``. A removal takes the
documents' references off, and keys that have none left leave the filters, so the index is as if those documents had never come.
Changes are written as new generations beside the old ones; a generation counts once its marker is there, so a failed one leaves no trace.

Keys are 128-bit digests. References are combined before they move, so a line in a third of all documents is one row per task.
"""
from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusewright.llm._shared import cut, discard, free_name, prepare, shared_folder, table
from fusewright.llm._text import slices
from fusewright.llm.cuckoo import Cuckoo

SPACE = b" \t\n\x0b\x0c\r"
LEAST = 10
#: Different keys that a shard has at most when an index begins; a shard's filter is one row.
SHARD_KEYS, LEAST_SHARDS = 500_000, 16


def key_of(line: bytes, least: int) -> bytes | None:
    """The 16-byte digest of a line (lower-cased before) without white space at its ends; None if it is short."""
    import xxhash

    line = line.strip(SPACE)
    if len(line) < least or (not line.isascii() and len(line.decode(errors="replace")) < least):
        return None
    return xxhash.xxh3_128_digest(line)


def _keys(least: int):
    """(document, key's halves) of each document's different long lines."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows, keys = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                own = dict.fromkeys(key_of(x, least) for x in (text or "").encode().lower().split(b"\n"))
                own.pop(None, None)
                keys += own
                rows += [row] * len(own)
            halves = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(rows, pa.int64())), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc", "k1", "k2"])

    return run


_TESTED = "shard int, k1 long, k2 long, refs long, maybe boolean"
_FILTERS = "shard int, layers array<binary>"


def _combined(table):
    import numpy as np

    k1, k2 = table.column("k1").to_numpy(), table.column("k2").to_numpy()
    return (k1.view(np.uint64) ^ (k2.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) if len(k1) else np.zeros(0, np.uint64)


def _stored(state) -> Cuckoo:
    return Cuckoo(state.column("layers")[0].as_py() if state.num_rows else [])


def _test(rows, state):
    """Marks the keys that the shard's filter may hold."""
    import pyarrow as pa

    return rows.append_column("maybe", pa.array(_stored(state).has(_combined(rows)))).select(["shard", "k1", "k2", "refs", "maybe"])


def _change(rows, state):
    """The shard's filter with the keys of a positive ``refs`` added and those of a negative one removed."""
    import pyarrow as pa

    own, keys, refs = _stored(state), _combined(rows), rows.column("refs").to_numpy()
    own.remove(keys[refs < 0])
    own.add(keys[refs > 0])
    shard = (rows if rows.num_rows else state).column("shard")[0].as_py()
    return pa.table([pa.array([shard], pa.int32()), pa.array([own.dump()], pa.list_(pa.binary()))], names=["shard", "layers"])


class LineIndex:
    """Lines of documents that come and go, and which of them other documents hold.

    ``folder`` is where its tables are, by default a new one in the shared folder; an index that exists there is opened. A line's key is
    the line without ASCII white space at its ends, A-Z lower-cased; lines whose key has fewer than ``least`` code points are not held.
    Rows of one id are one document, those with a null id are one too, which is greater than all others. A null or empty text is one
    empty line. Ids must have an order. An empty table inserts nothing. Only the two columns are read, so others may have any name.
    ``insert`` of a document that is there adds its new lines; ``remove`` of one that is not there does nothing.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, least: int = LEAST, shards: int | None = None):
        prepare(spark)
        self.spark, self.least, self.shards = spark, least, shards
        self.folder = folder or f"{shared_folder(spark)}/fusewright-lines-{uuid.uuid4().hex}"
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        if folder is None:
            self._fs.deleteOnExit(self._path(""))
        self.last = 0
        while self._fs.exists(self._path(f"done/{self.last + 1}")):
            self.last += 1
        if self.last:
            self.shards = self._read("settings", 1).first()["shards"]

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{at}" if at else self.folder)

    def _read(self, name: str, change: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/change={change}")

    def _all(self, name: str) -> DataFrame | None:
        """All changes of a table, with the number of each."""
        there = [k for k in range(1, self.last + 1) if self._fs.exists(self._path(f"{name}/change={k}"))]
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/change={k}" for k in there]) if there else None

    def _write(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}/change={self.last + 1}")
        return self._read(name, self.last + 1)

    def _finish(self) -> None:
        self._fs.mkdirs(self._path(f"done/{self.last + 1}"))
        self.last += 1

    def lines(self) -> DataFrame | None:
        """(shard, k1, k2, doc) of the documents that are there."""
        every, gone = self._all("lines"), self._all("gone")
        if every is None or gone is None:
            return every
        left = gone.groupBy("doc").agg(F.max("change").alias("until"))
        both = every.join(left, every["doc"].eqNullSafe(left["doc"]), "left").where("until IS NULL OR change > until")
        return both.select("shard", "k1", "k2", every["doc"])

    def counts(self) -> DataFrame | None:
        """(shard, k1, k2, refs): the exact number of documents of each key that has any."""
        every = self._all("counts")
        return None if every is None else every.groupBy("shard", "k1", "k2").agg(F.sum("refs").alias("refs")).where("refs > 0")

    def _filters(self) -> DataFrame:
        """Each shard's filter after its last change."""
        every = self._all("filters")
        if every is None:
            return self.spark.createDataFrame([], _FILTERS)
        last = every.groupBy("shard").agg(F.max("change").alias("change"))
        return every.join(F.broadcast(last), ["shard", "change"]).select("shard", "layers") if self.shards <= 10_000 else every.join(last, ["shard", "change"]).select("shard", "layers")

    def _change_filters(self, keys: DataFrame) -> None:
        changed = keys.groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInArrow(_change, _FILTERS)
        self._write(changed, "filters")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        slim = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
        schema = T.StructType([slim.schema["doc"], T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])
        found = slim.mapInArrow(_keys(self.least), schema)
        if self.shards is None:
            found = cut(found)
            self.shards = max(LEAST_SHARDS, -(-found.count() // SHARD_KEYS))
        if not self.last:
            self._write(self.spark.range(1).select(F.lit(self.shards).alias("shards")), "settings")
        own = found.select(F.pmod(F.hash("k1"), F.lit(self.shards)).alias("shard"), "k1", "k2", "doc").distinct()
        there = self.lines()
        if there is not None:
            same = [own[c] == there[c] for c in ("shard", "k1", "k2")] + [own["doc"].eqNullSafe(there["doc"])]
            own = own.join(there, same, "left_anti")
        new = self._write(own, "lines")
        refs = new.groupBy("shard", "k1", "k2").agg(F.count("*").alias("refs"))
        if self._all("filters") is None:
            unseen = refs = self._write(refs, "counts")
        else:
            tested = cut(refs.groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInArrow(_test, _TESTED))
            known = self.counts().join(tested.where("maybe").select("k1", "k2"), ["k1", "k2"], "left_semi")
            unseen = tested.join(known.select("shard", "k1", "k2"), ["shard", "k1", "k2"], "left_anti").select("shard", "k1", "k2", "refs")
            self._write(tested.select("shard", "k1", "k2", "refs"), "counts")
        self._change_filters(unseen)
        if hasattr(found, "_staged_at"):
            discard(found)
        self._finish()

    def remove(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Takes the documents with these ids out again."""
        if not self.last:
            return
        wanted = ids.select(F.col(id_col).alias("id")).distinct()
        there = self.lines()
        lost = there.join(wanted, there["doc"].eqNullSafe(wanted["id"]), "left_semi").groupBy("shard", "k1", "k2").agg((-F.count("*")).alias("refs"))
        lost = self._write(lost, "counts")
        before = self.counts().withColumnRenamed("refs", "had")
        last = lost.join(before, ["shard", "k1", "k2"]).where("had + refs <= 0").select("shard", "k1", "k2", "refs")
        self._change_filters(last)
        self._write(wanted.select(F.col("id").alias("doc")), "gone")
        self._finish()

    def may_hold(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """By the filters alone, for each id: n_keys (different long lines) and n_maybe (those that the index may hold)."""
        slim = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
        schema = T.StructType([slim.schema["doc"], T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())])
        own = cut(slim.mapInArrow(_keys(self.least), schema).distinct())
        keys = own.select(F.pmod(F.hash("k1"), F.lit(self.shards or LEAST_SHARDS)).alias("shard"), "k1", "k2", F.lit(1).cast("long").alias("refs")).distinct()
        tested = keys.groupBy("shard").cogroup(self._filters().groupBy("shard")).applyInArrow(_test, _TESTED)
        return own.join(tested, ["k1", "k2"]).groupBy(F.col("doc").alias(id_col)).agg(F.count("*").alias("n_keys"), F.count_if("maybe").alias("n_maybe"))

    def repeated(self) -> DataFrame:
        """(k1, k2, doc) of each key of two or more documents, for each but the first of them: where its lines go."""
        there = self.lines()
        if there is None:
            return self.spark.createDataFrame([], "k1 long, k2 long, doc long")
        keys = ["shard", "k1", "k2"]
        # combined before they move, and written down: the last join then reads two plain exchanges, and Spark splits a hot key's
        first = there.groupBy(*keys).agg(F.min("doc").alias("first")).join(self.counts().where("refs > 1").select(*keys), keys)
        return there.join(cut(first), keys).where(~F.col("doc").eqNullSafe(F.col("first"))).select("k1", "k2", "doc")

    def deduplicate(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
        """``docs`` with the text without repeated lines, and the numbers of lines before and of those dropped (both long).

        A line goes if two or more documents of the index hold its key, unless the document's id is the smallest of theirs; all its places in
        that one stay. Documents that were not inserted lose nothing. All rows and columns stay, a null text stays null where nothing is
        dropped. The two numbers' columns have underscores before their names where ``docs`` has such names.
        """
        gone = self.repeated().groupBy("doc").agg(F.collect_list(F.struct("k1", "k2")).alias("gone"))
        extra = free_name("gone", docs.columns)
        gone = gone.select(F.col("doc").alias("_own"), F.col("gone").alias(extra))
        both = docs.join(gone, docs[id_col].eqNullSafe(gone["_own"]), "left").select(*[docs[c] for c in docs.columns], extra)
        n_lines, n_dropped = free_name(lines_col, docs.columns), free_name(dropped_col, docs.columns)
        schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
        return both.mapInArrow(_drop(text_col, extra, n_lines, n_dropped, self.least), schema)

    def delete(self) -> None:
        """Deletes the index."""
        self._fs.delete(self._path(""), True)


def _drop(text_col: str, gone: str, n_lines: str, n_dropped: str, least: int):
    import pyarrow as pa

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            out, counts, dropped = [], [], []
            for text, keys in zip(batch.column(text_col).to_pylist(), batch.column(gone).to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                counts.append(len(lines))
                if keys:
                    bad = {x["k1"].to_bytes(8, "little", signed=True) + x["k2"].to_bytes(8, "little", signed=True) for x in keys}
                    kept = [x for x in lines if key_of(x.lower(), least) not in bad]
                    dropped.append(len(lines) - len(kept))
                    text = b"\n".join(kept).decode() if dropped[-1] else text
                else:
                    dropped.append(0)
                out.append(text)
            place = batch.schema.get_field_index(text_col)
            batch = batch.set_column(place, batch.schema.field(place), pa.array(out, batch.column(text_col).type)).drop_columns([gone])
            yield batch.append_column(n_lines, pa.array(counts, pa.int64())).append_column(n_dropped, pa.array(dropped, pa.int64()))

    return run


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` inserted in two halves, the second one by way of the first one's filters; the contract's digest of what is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index, half = LineIndex(spark), F.pmod(F.xxhash64("doc_id"), F.lit(2))
    for k in (0, 1):
        index.insert(docs.where(half == k))
    return index.deduplicate(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM s),
k AS (SELECT doc_id, p, l[p] AS line, translate(regexp_replace(l[p], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, p, line, r.first IS NOT NULL AND k.doc_id <> r.first AS gone FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
