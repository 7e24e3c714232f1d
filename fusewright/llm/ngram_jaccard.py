"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix with its transpose.

Rows of the matrix are distinct shingle sets (exact copies share a row), columns are shingles. Overlaps are accumulated column by
column, and a pair is dropped as soon as a bound from the two sizes rules it out:

* sizes a <= b can reach the similarity only if a >= t * b;
* in any order of the columns that is the same for all rows, a pair that reaches it meets among the first
  ``a - ceil(t * a) + 1`` columns of both rows, so only those entries of a row are multiplied (its head);
* when the first common column is at positions p and q, the overlap is at most ``1 + min(a - p - 1, b - q - 1)``.

Columns are ordered by a corpus-wide count sketch of fixed size, rare ones first: frequent passages come last and fall out of the
heads. The order steers cost only; the result is the exact one for any order.

Texts are cut into shingles twice, for the sketch and for the heads, and again only where a whole set is wanted: whole sets of all texts
would take more disk than the texts. Rows are numbered in the order of (smallest id, signature), so that the least row of a component is
the one with its smallest id.

Products are evaluated in two steps, so that a large group of near copies does not turn into all its pairs: first each row of a
column with the column's first row; the verified links give components; then only pairs of rows of different components that
the bounds let through. A column that all belongs to one component is left out of the second step; of the others, long ones are cut into
bands by size and these into blocks of rows, and each pair of blocks of one band or of neighbours is a task of its own, so no column has to fit one task. For either step, the overlap is first
accumulated over the heads, and with what the rest of the rows can add at most it drops the pairs that cannot reach the similarity;
verified means that it is then counted over the two whole sets.

Shingles are compared by 64-bit hashes, see ``_text``; sets are told apart by 128 bits.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusewright.llm._shared import cut, discard, free_name, prepare, table
from fusewright.llm._text import U64, as_bytes, groups, mix, shingle_sets, signed
from fusewright.llm.components import components

SKETCH_SLOTS = 1 << 20
SKETCH_SLICES = 64
BLOCK_ROWS = 4096
ACTIVE_BITS = 1 << 23


def _signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of the set."""
    m = mix(shingles ^ U64(0x5851F42D4C957F2D))
    totals = np.array([m.sum(dtype=U64) + U64(len(m)), ((m ^ (m >> U64(31))) * (m | U64(1))).sum(dtype=U64)], dtype=U64)
    a, b = signed(mix(totals * U64(0x9E3779B97F4A7C15))).tolist()
    return a, b


def _describe(size: int, slices: int):
    """One row a document (kind 0), then this task's part of the sketch (kind 1)."""

    def run(batches):
        counts, seen, schema = np.zeros(SKETCH_SLOTS, dtype=np.uint32), set(), None
        for batch in batches:
            schema = pa.schema([("kind", pa.int32()), batch.schema.field("doc_id"), ("finger", pa.binary()), ("key", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])
            texts = as_bytes(batch.column("text"))
            for a, b in groups(texts):
                ns, sigs, fresh = [], [], []
                for s in shingle_sets(texts[a:b], size):
                    sig = _signature(s) if len(s) else (None, None)
                    ns.append(len(s))
                    sigs.append(sig)
                    if len(s) and sig not in seen:
                        seen.add(sig)
                        fresh.append(s)
                if fresh:
                    counts += np.bincount((np.concatenate(fresh) & U64(SKETCH_SLOTS - 1)).astype(np.int64), minlength=SKETCH_SLOTS).astype(np.uint32)
                k = b - a
                yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), *(batch.column(c).slice(a, k) for c in ("doc_id", "finger", "key")), pa.array(ns, pa.int64()), pa.array([x for x, _ in sigs], pa.int64()), pa.array([y for _, y in sigs], pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
        if seen:
            packed = [zlib.compress(x.tobytes(), 6) for x in np.minimum(counts, 65535).astype(np.uint16).reshape(slices, -1)]
            none = [pa.nulls(slices, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([pa.array([1] * slices, pa.int32()), *none[1:7], pa.array(range(slices), pa.int32()), pa.array(packed, pa.binary())], schema=schema)

    return run


def _add_slices(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, part in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            more = np.frombuffer(zlib.decompress(part), dtype=np.uint16).astype(np.uint64)
            total[at] = total[at] + more if at in total else more
    rows = [(at, np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes()) for at, x in total.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "counts"])


def _sketch(described: DataFrame) -> np.ndarray:
    """The summed sketch: 4 MB whatever the corpus. A task adds at most 65,535 to a slot."""
    parts = described.where("kind = 1").select("slice", "counts").repartition(SKETCH_SLICES, "slice")
    counts = np.zeros((SKETCH_SLICES, SKETCH_SLOTS // SKETCH_SLICES), dtype=np.uint32)
    for row in parts.mapInArrow(_add_slices, "slice int, counts binary").collect():
        counts[row["slice"]] = np.frombuffer(bytes(row["counts"]), dtype=np.uint32)
    return counts.reshape(-1)


def _column_levels(counts: np.ndarray, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Per sketch slot: the level by which columns are ordered (0: not seen to be frequent) and its number of row blocks."""
    usual = float(np.median(counts))
    over = np.maximum(counts.astype(np.float64) - usual, 0)
    frequent = over > 8 + 8 * np.sqrt(usual)
    levels = np.where(frequent, 1 + np.log2(np.maximum(over, 1)), 0).astype(np.uint8)
    return levels, np.where(frequent, np.ceil(over / block_rows), 1).astype(np.int64)


def _heads(size: int, num: int, den: int, shared):
    """The columns of the head of each set that the task meets, in order, as bytes."""

    def run(batches):
        levels, seen = _column_levels(shared.value)[0], set()
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for a, b in groups(texts):
                sigs, ns, hs = [], [], []
                for s in shingle_sets(texts[a:b], size):
                    if not len(s) or (sig := _signature(s)) in seen:
                        continue
                    seen.add(sig)
                    head = len(s) - (num * len(s) + den - 1) // den + 1
                    level = levels[(s & U64(SKETCH_SLOTS - 1)).astype(np.int64)]
                    order = np.argsort(level, kind="stable")[:head] if level.any() else slice(head)
                    sigs.append(sig)
                    ns.append(len(s))
                    hs.append(s[order].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in sigs], pa.int64()), pa.array([y for _, y in sigs], pa.int64()), pa.array(ns, pa.int64()), pa.array(hs, pa.binary())], names=["s1", "s2", "n", "head"])

    return run


ENTRY = "h long, salt int, rid long, pos int, n int"


def _entries(shared, block_rows: int):
    """One row per column of a row's head. Salt is -1 in columns that are not frequent, else one of the column's blocks.

    Copies of a row that follow it are left out.
    """

    def run(batches):
        levels, blocks = _column_levels(shared.value, block_rows)
        last = None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rid, n = np.asarray(part.column("rid")), np.asarray(part.column("n")).astype(np.int32)
                own = np.flatnonzero(np.concatenate([[rid[0] != last], np.diff(rid) != 0]))
                last = rid[-1]
                if not len(own):
                    continue
                part, rid, n = part.take(pa.array(own)), rid[own], n[own]
                hs = [np.frombuffer(x, dtype=U64) for x in part.column("head").to_pylist()]
                ks = [len(x) for x in hs]
                h, rid, pos = np.concatenate(hs), np.repeat(rid, ks), np.concatenate([np.arange(k, dtype=np.int32) for k in ks])
                slot = (h & U64(SKETCH_SLOTS - 1)).astype(np.int64)
                salt = np.where(levels[slot] > 0, (mix(rid.view(U64)) % blocks[slot].astype(U64)).astype(np.int32), np.int32(-1))
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(salt), pa.array(rid), pa.array(pos), pa.array(np.repeat(n, ks))], names=["h", "salt", "rid", "pos", "n"])

    return run


def _runs(batches, names, keys):
    """Runs of rows with the same first ``keys`` columns, of two rows at least unless there is a salt; runs may span batches."""
    held: list[list] = []
    salt = names.index("salt") if "salt" in names else None

    def joined():
        rows = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        if len(rows[0]) > 1 or (salt is not None and rows[salt][0] >= 0):
            yield rows

    for batch in batches:
        now = [np.asarray(batch.column(x)) for x in names]
        if not len(now[0]):
            continue
        if held and any(now[k][0] != held[-1][k][-1] for k in range(keys)):
            yield from joined()
        change = np.zeros(len(now[0]) - 1, dtype=bool)
        for k in range(keys):
            change |= np.diff(now[k]) != 0
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
        if len(cuts) == 1:
            held.append(now)
            continue
        held.append([x[: cuts[1]] for x in now])
        yield from joined()
        starts, ends = cuts[1:-1], cuts[2:]
        wanted = ends - starts > 1
        if salt is not None:
            wanted |= now[salt][starts] >= 0
        for k in np.flatnonzero(wanted):
            yield [x[starts[k] : ends[k]] for x in now]
        held.append([x[cuts[-1] :] for x in now])
    if held:
        yield from joined()


COLUMN = "h long, frequent boolean, rid long, pos int, n int, rid0 long, pos0 int, n0 int"
_COLUMN = pa.schema([("h", pa.int64()), ("frequent", pa.bool_()), ("rid", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("rid0", pa.int64()), ("pos0", pa.int32()), ("n0", pa.int32())])


def _shared_columns(batches):
    """Entries of columns with two or more rows, and all of frequent ones, each with the first entry of its column and salt."""
    out, held = [], 0

    def flush():
        cols = [np.concatenate([x[k] for x in out]) for k in range(8)]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _COLUMN, strict=True)], schema=_COLUMN)

    for h, salt, rid, pos, n in _runs(batches, ["h", "salt", "rid", "pos", "n"], 2):
        own = np.concatenate([[True], np.diff(rid) != 0])
        k = int(own.sum())
        if k < 2 and salt[0] < 0:
            continue
        out.append([h[own], salt[own] >= 0, rid[own], pos[own], n[own], np.full(k, rid[0]), np.full(k, pos[0]), np.full(k, n[0])])
        held += k
        if held > 100_000:
            yield flush()
            out.clear()
            held = 0
    if out:
        yield flush()


def _reaches(n, p, m, q, num, den):
    """Whether rows of sizes n and m whose first common column is at p and q can reach the similarity."""
    small, large = np.minimum(n, m), np.maximum(n, m)
    need = -(-(num * (n + m)) // (num + den))
    return (den * small >= num * large) & (np.minimum(n - p, m - q) >= need)


def _apart(num: int, den: int):
    """Pairs of rows of different components that meet in a column block and that the bounds let through."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def flush(found):
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    def run(batches):
        found, held = [], 0
        for _, pair, side, pos, n, rid, comp in _runs(batches, ["h", "pair", "side", "pos", "n", "rid", "comp"], 2):
            if (comp == comp[0]).all():
                continue
            order = np.argsort(n, kind="stable")
            pos, n, rid, comp, side = pos[order].astype(np.int64), n[order].astype(np.int64), rid[order], comp[order], side[order]
            if not pair[0] >> 40 & 1 and pair[0] >> 20 & 0xFFFFF == pair[0] & 0xFFFFF:
                side = np.arange(len(side))  # one block with itself: any two rows; else one row of either side
            ends = np.searchsorted(n, n * den // num, side="right")
            for a in range(len(n) - 1):
                b = slice(a + 1, ends[a])
                other = rid[b][(comp[b] != comp[a]) & (side[b] != side[a]) & _reaches(n[a], pos[a], n[b], pos[b], num, den)]
                if len(other):
                    found.append(np.stack([np.minimum(other, rid[a]), np.maximum(other, rid[a])], axis=1))
                    held += len(other)
                    if held > 200_000:
                        yield flush(found)
                        found, held = [], 0
        if found:
            yield flush(found)

    return run


def _lists(rows):
    """(sizes, where each row's entries begin, their columns in order, their positions) of structs of n, h and pos."""
    n, h, pos = (rows.field(c) for c in ("n", "h", "pos"))
    return np.asarray(n).tolist(), np.asarray(h.offsets).tolist(), np.asarray(h.values), np.asarray(pos.values)


def _hopeful(num: int, den: int):
    """Pairs that can still reach the similarity once the overlap of their heads is known.

    After the last common column of the heads at p and q the rows can share ``min(a - p - 1, b - q - 1)`` more. Up to where the shorter
    head ends everything is known, so the rest adds at most what lies beyond the heads.
    """
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def beyond(n):
        return -(-(num * n) // den) - 1

    def run(batches):
        for batch in batches:
            sides = [_lists(batch.column(c)) for c in ("ex", "ey")]
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                (n, h, p), (m, g, q) = ((size[k], names[at[k] : at[k + 1]], places[at[k] : at[k + 1]]) for size, at, names, places in sides)
                where = np.searchsorted(g, h)
                same = np.flatnonzero(g[np.minimum(where, len(g) - 1)] == h) if len(g) else where[:0]
                last_p, last_q = (p[same].max(), q[where[same]].max()) if len(same) else (-1, -1)
                most = len(same) + min(min(n - last_p - 1, m - last_q - 1), max(beyond(n), beyond(m)))
                keep[k] = most >= -(-(num * (n + m)) // (num + den))
            where = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column("x").take(where), batch.column("y").take(where)], schema=schema)

    return run



def _whole_sets(size: int, shared):
    """(s1, s2, key, set) of the documents whose key may be wanted."""

    def run(batches):
        bits = shared.value
        for batch in batches:
            slot = (mix(np.asarray(batch.column("key")).view(U64)) % U64(ACTIVE_BITS)).astype(np.int64)
            batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))
            texts = as_bytes(batch.column("text"))
            for a, b in groups(texts):
                sets = list(shingle_sets(texts[a:b], size))
                sigs = [_signature(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in sigs], pa.int64()), pa.array([y for _, y in sigs], pa.int64()), batch.column("key").slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], names=["s1", "s2", "key", "shingles"])

    return run


def _slots(batches):
    for batch in batches:
        keys = np.asarray(batch.column("key")).view(U64)
        yield pa.RecordBatch.from_arrays([pa.array((mix(keys) % U64(ACTIVE_BITS)).astype(np.int64))], names=["slot"])


def _linked(num: int, den: int):
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist(), strict=True):
                a, b = np.frombuffer(a, dtype=U64), np.frombuffer(b, dtype=U64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                keep.append(den * both >= num * (len(a) + len(b) - both))
            where = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column("x").take(pa.array(where)), batch.column("y").take(pa.array(where))], schema=schema)

    return run


class _Matrix:
    """The staged matrix: documents, rows (classes of equal sets), and the entries of columns with two rows or more."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, block_rows: int):
        self.spark, self.num, self.den, self.block_rows = docs.sparkSession, num, den, block_rows
        prepare(self.spark)
        self.words = words
        source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        source = source.withColumn("finger", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
        self.source = source = source.withColumn("key", F.xxhash64("doc_id", "finger"))
        fields = T._parse_datatype_string("kind int, finger binary, key long, n long, s1 long, s2 long, slice int, counts binary").fields
        schema = T.StructType([fields[0], source.schema["doc_id"], *fields[1:]])
        described = cut(source.mapInArrow(_describe(words, SKETCH_SLICES), schema))
        self.each = cut(described.where("kind = 0").select("doc_id", "finger", "key", "n", "s1", "s2"))
        sketch = self.spark.sparkContext.broadcast(_sketch(described))
        discard(described)

        # rows are numbered by smallest id, those without one last; a row's key names one of its texts
        rows = self.each.where("s1 is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.min("key").alias("key"))
        order = [F.col("first").asc_nulls_last(), "s1", "s2"]
        count = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.rows = cut(rows.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("rid", F.monotonically_increasing_id()))

        heads = source.select("text").mapInArrow(_heads(words, num, den, sketch), "s1 long, s2 long, n long, head binary")
        heads = heads.join(self.rows.select("s1", "s2", "rid"), ["s1", "s2"]).select("rid", "n", "head")
        entries = heads.mapInArrow(_entries(sketch, block_rows), ENTRY).repartition("h", "salt").sortWithinPartitions("h", "salt", "rid")
        shared = cut(entries.mapInArrow(_shared_columns, COLUMN))
        # a frequent column is not brought together: its first row is the least of its salts' first rows and is joined
        often = shared.where("frequent").drop("frequent", "rid0", "pos0", "n0")
        centre = often.groupBy("h").agg(F.min(F.struct("rid", "pos", "n")).alias("c"), F.min("rid").alias("low"), F.max("rid").alias("high")).where("low <> high")
        centre = cut(centre.select("h", F.col("c.rid").alias("rid0"), F.col("c.pos").alias("pos0"), F.col("c.n").alias("n0")))
        often = cut(often.distinct().join(centre, "h").select("h", "rid", "pos", "n", "rid0", "pos0", "n0"))
        discard(centre)
        self.columns = shared.where("not frequent").drop("frequent").union(often)
        self.staged = [self.each, self.rows, shared, often]
        owned = self.columns.groupBy("rid", "n").agg(F.array_sort(F.collect_list(F.struct("h", "pos"))).alias("e"))
        self.owned = cut(owned.select("rid", F.struct(F.col("n").cast("long").alias("n"), F.col("e.h").alias("h"), F.col("e.pos").alias("pos")).alias("e")))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) that reach the similarity: by the overlap of their heads they can, over their whole sets they do."""
        num, den = self.num, self.den
        heads_x, heads_y = (self.owned.select(F.col("rid").alias(k), F.col("e").alias(f"e{k}")) for k in "xy")
        pairs = cut(pairs.join(heads_x, "x").join(heads_y, "y").select("x", "y", "ex", "ey").mapInArrow(_hopeful(num, den), "x long, y long"))
        wanted = pairs.select(F.col("x").alias("rid")).union(pairs.select(F.col("y").alias("rid"))).distinct()
        wanted = cut(wanted.join(self.rows.select("rid", "s1", "s2", "key"), "rid"))
        slots = wanted.select("key").mapInArrow(_slots, "slot long")
        slots = slots.groupBy((F.col("slot") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
        bits = np.zeros(ACTIVE_BITS // 64, dtype=np.int64)  # at most this many rows come, whatever the corpus
        got = slots.toPandas()
        bits[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
        shared = self.spark.sparkContext.broadcast(bits.view(np.uint8))
        sets = self.source.select("key", "text").mapInArrow(_whole_sets(self.words, shared), "s1 long, s2 long, key long, shingles binary")
        sets = cut(sets.join(wanted, ["s1", "s2", "key"]).select("rid", "shingles").dropDuplicates(["rid"]))
        two = pairs.join(sets.select(F.col("rid").alias("x"), F.col("shingles").alias("sx")), "x").join(sets.select(F.col("rid").alias("y"), F.col("shingles").alias("sy")), "y")
        found = cut(two.select("x", "y", "sx", "sy").mapInArrow(_linked(num, den), "x long, y long"))
        discard(pairs, wanted, sets)
        return found

    def stars(self) -> DataFrame:
        """Pairs of a row with the first row of its columns: of the columns most of its entries share, and of the least."""
        num, den = self.num, self.den
        a = {k: F.col(k).cast("long") for k in ("n", "pos", "n0", "pos0")}
        small, large = F.least(a["n"], a["n0"]), F.greatest(a["n"], a["n0"])
        need = F.ceil(num * (a["n"] + a["n0"]) / (num + den))
        stars = self.columns.where("rid <> rid0").where((den * small >= num * large) & (F.least(a["n"] - a["pos"], a["n0"] - a["pos0"]) >= need - 1))
        stars = stars.groupBy("rid", "rid0").count().groupBy("rid").agg(F.max(F.struct("count", "rid0")).alias("most"), F.min("rid0").alias("least"))
        stars = stars.select("rid", F.explode(F.array("most.rid0", "least")).alias("rid0"))
        return stars.select(F.least("rid", "rid0").alias("x"), F.greatest("rid", "rid0").alias("y")).distinct()

    def across(self, known: DataFrame | None) -> DataFrame:
        """Pairs of rows of different components (node, component) that meet in a column and that the bounds let through.

        With None every row is a component of its own.
        """
        entries = self.columns.select("h", "rid", "pos", "n")
        if known is None:
            rest = entries.withColumn("comp", F.col("rid"))
        else:
            rest = entries.join(known.withColumnRenamed("node", "rid"), "rid", "left").select("h", "rid", "pos", "n", F.coalesce("component", "rid").alias("comp"))
        rest = cut(rest)
        # rows of a long column may go into bands by size, so wide that a pair that reaches the similarity is in one band or in two
        # neighbours; a column whose rows are much of one size would have more copies of its rows that way, and stays one band
        width = np.log(self.den / self.num) * (1 + 1e-6)
        banded = F.floor(F.log("n") / width).cast("int")
        counts = rest.groupBy("h", banded.alias("band")).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c"))
        blocks_of = F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("c") / self.block_rows).cast("int").alias("k"))))
        mixed = counts.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("c").alias("c"), F.collect_list(F.struct("band", "c")).alias("bands"), blocks_of.alias("of")).where("low <> high")
        at = lambda band: F.coalesce(F.try_element_at("of", band), F.lit(0))
        copies = F.aggregate("bands", F.lit(0).cast("long"), lambda t, x: t + x["c"] * (at(x["band"]) + at(x["band"] + 1) + at(x["band"] - 1)))
        plain = F.ceil(F.col("c") / self.block_rows).cast("int")
        worth = copies < F.col("c") * plain
        mixed = cut(mixed.select("h", worth.alias("banded"), F.when(worth, F.col("of")).otherwise(F.create_map(F.lit(0), plain)).alias("of")))
        met = rest.join(mixed, "h").withColumn("band", F.when(F.col("banded"), banded).otherwise(0))
        met = met.withColumns({"k": at(F.col("band")), "k_next": at(F.col("band") + 1), "k_before": at(F.col("band") - 1)})
        band, own = F.col("band").cast("long"), F.pmod(F.xxhash64("rid"), F.col("k").cast("long"))
        # a pair of blocks by one number: the lower band, whether the other is above it, and the blocks in them
        block = lambda low, above, i, j, side: F.struct((F.shiftleft(low, 41) + F.shiftleft(above, 40) + F.shiftleft(i, 20) + j).alias("pair"), side.cast("int").alias("side"))
        each = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), f))
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        within = each(F.col("k"), lambda o: block(band, zero, F.least(own, o), F.greatest(own, o), own))
        above = each(F.col("k_next"), lambda o: block(band, one, own, o, band))
        below = each(F.col("k_before"), lambda o: block(band - 1, one, o, own, band))
        none = F.array().cast("array<struct<pair:bigint,side:int>>")
        blocks = met.select("h", F.explode(F.concat(within, *[F.coalesce(x, none) for x in (above, below)])).alias("b"), "pos", "n", "rid", "comp")
        blocks = blocks.select("h", "b.pair", "b.side", "pos", "n", "rid", "comp")
        blocks = blocks.repartition("h", "pair").sortWithinPartitions("h", "pair", "n", "rid")
        pairs = cut(blocks.mapInArrow(_apart(self.num, self.den), "x long, y long").distinct())
        discard(rest, mixed)
        return pairs

    def close(self) -> None:
        discard(*self.staged, self.owned)


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The join itself: (all links between classes, class of every row).

    A class is a set of shingles that any rows have; it is named by ``a`` and ``b`` in the first frame and ``class_id`` in the second,
    numbers in the order of the classes' smallest ids. Every pair of classes with a similarity of ``num / den`` or more is a row of the
    first frame (a < b). The second has a row per input row: ``doc_id``, ``class_id`` (null for an empty set, which is linked with
    nothing), ``n_shingles``, and ``n_links``, the number of other rows that it is linked with, copies included. The result is as
    large as the links between different texts are many. Cases are as in ``near_duplicates``.
    """
    m = _Matrix(docs, id_col, text_col, words, num, den, block_rows)
    candidates = m.across(None)
    links = m.verified(candidates).select(F.col("x").alias("a"), F.col("y").alias("b"))
    each = m.each.groupBy("s1", "s2").agg(F.count("*").alias("copies")).join(m.rows, ["s1", "s2"]).select("s1", "s2", "rid", "copies")
    each = cut(each)
    ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = ends.join(each.select(F.col("rid").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("far"))
    classes = cut(each.join(far.withColumnRenamed("a", "rid"), "rid", "left").select("s1", "s2", "rid", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    members = cut(m.each.join(classes, ["s1", "s2"], "left").select("doc_id", F.col("rid").alias("class_id"), F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    discard(candidates, each, classes)
    m.close()
    return links, members


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Group documents whose sets of distinct ``words``-word shingles are linked by a Jaccard similarity of ``num / den`` or more.

    Words end at ASCII white space, A-Z is lower-cased. Returns one row per input row: ``doc_id`` (the id), ``n_shingles`` (set
    size, long), ``component_id`` (smallest id reachable by links, itself included), ``s1`` and ``s2`` (the set's signature, null
    for an empty set) and ``finger`` (a digest of the text). Whole texts of all rows count; exact copies share a matrix row and are
    not expanded into pairs. ``similar_pairs`` returns the links themselves.

    A null or empty text, or one without words, has an empty set: it is linked with nothing and is its own component. A text of
    fewer words than a shingle has its whole sequence as its one shingle. Ids may be of any type that has an order. Repeated ids are
    rows of their own. A row with a null id takes part in links, but is never the smallest id unless all of its component are null.
    An empty table gives an empty result. Only the id and text columns are read, so other columns may have any name.
    """
    m = _Matrix(docs, id_col, text_col, words, num, den, block_rows)
    stars = m.stars()
    first = m.verified(stars)
    known = cut(components(first, "x", "y"))
    candidates = m.across(known)
    second = m.verified(candidates)
    # stars around each component's root stand for the links of the first step
    links = known.select(F.col("node").alias("x"), F.col("component").alias("y")).union(second)
    roots = components(links, "x", "y")
    named = cut(roots.join(m.rows.select(F.col("rid").alias("component"), F.col("first").alias("component_id")), "component").select(F.col("node").alias("rid"), F.lit(True).alias("linked"), "component_id"))
    classes = cut(m.rows.join(named, "rid", "left").select("s1", "s2", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id")))
    full = m.each.where("s1 is not null").join(classes, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "s1", "s2", "finger")
    out = cut(full.union(m.each.where("s1 is null").select("doc_id", F.lit(0).cast("long"), F.col("doc_id").alias("component_id"), "s1", "s2", "finger")))
    discard(first, known, candidates, second, named, classes)
    m.close()
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows that stay when one document of each near-duplicate group does: the one with the smallest id.

    All columns stay, whatever their names. Rows without words all stay, as they are linked with nothing. Of repeated rows with the same
    id and shingle set one stays. Of a group in which no row has an id, one row of each distinct set stays. An empty table stays empty.
    Texts of any length are moved once, to meet the decision on their row.
    """
    found = near_duplicates(docs, id_col, text_col, words, num, den)
    keepers = found.where("s1 is not null and doc_id <=> component_id").groupBy("doc_id", "s1", "s2").agg(F.min("finger").alias("finger"))
    keepers = keepers.select("doc_id", "finger", F.lit(False).alias("every")).union(found.where("s1 is null").select("doc_id", "finger", F.lit(True)).distinct())
    names = {}
    for wanted in ("id", "finger", "every", "place"):
        names[wanted] = free_name(wanted, [*docs.columns, *names.values()])
    finger = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))).alias(names["finger"])
    # a null id is given the finger's hash, so that such rows do not all meet in one task
    key = lambda id_, finger: F.coalesce(id_.cast("string"), F.xxhash64(finger).cast("string"))
    keepers = keepers.select(key(F.col("doc_id"), F.col("finger")).alias(names["id"]), F.col("finger").alias(names["finger"]), F.col("every").alias(names["every"])).distinct()
    rows = docs.select("*", finger)
    rows = rows.withColumn(names["id"], key(F.col(f"`{id_col}`"), F.col(names["finger"])))
    kept = rows.join(keepers, [names["id"], names["finger"]])
    same = Window.partitionBy(names["id"], names["finger"]).orderBy(F.lit(0))
    kept = kept.withColumn(names["place"], F.row_number().over(same)).where(F.col(names["every"]) | (F.col(names["place"]) == 1))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """The contract's digest: 3-word shingles, similarity 0.9."""
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs, words=3, num=9, den=10).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(l) >= 3 THEN list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])
  WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END)) AS s FROM w),
c AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT rep, n, unnest(s) AS h FROM c),
p AS (SELECT a.rep AS x, b.rep AS y FROM e a JOIN e b ON a.h = b.h AND a.rep < b.rep AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
q AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(node, comp) AS (SELECT rep, rep FROM c UNION SELECT q.y, r.comp FROM r JOIN q ON q.x = r.node),
m AS (SELECT node, min(comp) AS comp FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.comp, s.doc_id) AS component_id FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN m ON m.node = c.rep
"""
