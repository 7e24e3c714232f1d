"""Embedding near-duplicates by sorted projection passes.

Each pass has random hyperplanes of its own. A vector's key is the concatenation of the sides it lies on, vectors are ordered
lexicographically by label and key, and each is compared with its neighbours of a bounded window. Verified pairs of all passes are
united into components. All passes run in one job: a vector is emitted once a pass, one range shuffle orders them all, and windows
cross the borders of partitions and blocks, because a block also gets the last rows before it.

A window finds only some of the links of a vector with many near copies. What a window may miss inside a component is found
exactly: members of a component are put into blocks in the order of their keys, and numbers of links are added up block pair by block pair,
without emitting pairs of vectors. Blocks have a centre and a radius (greatest angle from it), and by the triangle inequality many
pairs of blocks are settled by these alone: all linked, or none. Vectors travel only to the pairs that are left open. Copies of the same
vector share one row and its multiplicity from the start. So a link is lost only where no chain of found links joins its ends.

How often a pass shows an isolated pair falls with the number of vectors of a label and with how close they lie. So a label of many vectors gets as
many passes as it needs: of a bounded sample of it, pairs are made that are just close enough, how many sampled vectors come between
them is counted in trial passes, and the rate at which pairs stay within a window is carried on to the label's size. The number of
passes follows from that rate and ``recall``, the wanted share of such pairs.
"""
from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusewright.llm._shared import cut, discard, prepare, table
from fusewright.llm.components import components

KEY_BITS = 48
ROWS_IN_BLOCK = 512
MEMBERS_IN_BLOCK = 1024
#: Labels of more classes than that are sampled for their number of passes, by so many vectors, made pairs and trial passes.
SAMPLED_FROM, SAMPLE, TRIAL_PAIRS, TRIALS = 10_000, 4_096, 256, 12
#: Blocks whose centres are compared together.
CENTRES = 256
#: Angles are only trusted so far when they settle a pair of blocks.
ANGLE_ERROR = 1e-6


def _planes(dim: int, pass_no: int) -> np.ndarray:
    return np.random.default_rng([977, dim, pass_no]).standard_normal((dim, KEY_BITS))


def _matrix(binaries, dim: int, kind: str) -> np.ndarray:
    """The vectors as rows of unit length, in double precision."""
    x = np.frombuffer(b"".join(binaries), dtype=kind).reshape(-1, dim).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(kind: str):
    """(vec_id, label, dim, vector as bytes); the bytes are null where a vector can be linked with nothing."""

    def run(batches):
        for batch in batches:
            lists = batch.column("embedding")
            flat, ends = lists.values, np.asarray(lists.offsets)
            numbers = np.asarray(flat.fill_null(float("nan")), dtype=kind) + 0  # -0.0 becomes 0.0
            wide = numbers.astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                sums = np.concatenate([[0], np.cumsum(~np.isfinite(wide))])
                bad = sums[ends[1:]] - sums[ends[:-1]] > 0
                there = np.asarray(lists.is_valid()) & np.asarray(batch.column("label").is_valid()) & (ends[1:] > ends[:-1]) & ~bad
                out = []
                for k, ok in enumerate(there.tolist()):
                    w = wide[ends[k] : ends[k + 1]]
                    out.append(numbers[ends[k] : ends[k + 1]].tobytes() if ok and 0 < (w @ w) < np.inf else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(np.diff(ends).astype(np.int32)), pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "vector"])

    return run


def _sorted_keys(x: np.ndarray, pass_no: int) -> np.ndarray:
    """Each vector's key in a pass: the sides of its planes, one bit each."""
    return (x @ _planes(x.shape[1], pass_no) > 0).astype(np.int64) @ (np.int64(1) << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))


def rate_of(x: np.ndarray, n: int, threshold: float, window: int) -> float:
    """How often a pass over ``n`` vectors like the rows of ``x`` brings a pair of just the threshold within a window."""
    rng = np.random.default_rng(31)
    own = x[rng.permutation(len(x))[:TRIAL_PAIRS]]
    aside = rng.standard_normal(own.shape)
    aside -= (aside * own).sum(axis=1, keepdims=True) * own
    aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1, keepdims=True)), 1e-300)
    copies = threshold * own + np.sqrt(max(0.0, 1 - threshold * threshold)) * aside
    between = []
    for k in range(TRIALS):
        keys = np.sort(_sorted_keys(x, k))
        a, b = _sorted_keys(own, k), _sorted_keys(copies, k)
        # of the sampled ones the pair's own vector is one
        low, high = np.searchsorted(keys, np.minimum(a, b)), np.searchsorted(keys, np.maximum(a, b), side="right")
        between.append(np.maximum(high - low - 1, 0))
    between = np.concatenate(between)
    # a window of w among the sampled is as one of w * n / len(x) among all
    sizes = [w for w in (1, 2, 4, 8, 16, 32, 64, 128) if w < len(x)] or [1]
    rates = np.array([max((between < w).mean(), 0.5 / len(between)) for w in sizes])
    crowd = np.log([len(x) / w for w in sizes])
    slope, base = np.polyfit(crowd, np.log(rates), 1) if len(sizes) > 1 else (0.0, np.log(rates[0]))
    wanted = np.log(max(n / window, 1.0))
    if wanted <= crowd[0]:
        return float(min(0.999, np.exp(np.interp(wanted, crowd[::-1], np.log(rates)[::-1]))))
    return float(min(0.999, rates[0], np.exp(base + min(slope, 0.0) * wanted)))


def passes_for(rate: float, recall: float) -> int:
    """So many passes bring a pair within a window at least once with the wanted chance."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - rate)))


def _sampled(kind: str, threshold: float, window: int, recall: float):
    """(label, dim, passes) of a label's sample."""

    def run(sample):
        x = _matrix(sample.column("vector").to_pylist(), sample.column("dim")[0].as_py(), kind)
        rate = rate_of(x, sample.column("n")[0].as_py(), threshold, window)
        return pa.table([sample.column("label").slice(0, 1), sample.column("dim").slice(0, 1), pa.array([passes_for(rate, recall)], pa.int32())], names=["label", "dim", "passes"])

    return run


def _with_passes(classes: DataFrame, kind: str, threshold: float, window: int, passes: int, most: int, recall: float) -> DataFrame:
    """The classes with their label's number of passes: ``passes``, or as many as a large label needs."""
    sizes = cut(classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > SAMPLED_FROM))
    large = sizes.count()
    if not large:
        discard(sizes)
        return classes.withColumn("passes", F.lit(passes))
    hint = F.broadcast if large <= 10_000 else lambda frame: frame
    sample = classes.join(hint(sizes), ["label", "dim"]).where(F.pmod(F.xxhash64("cls"), F.col("n")) < SAMPLE)
    wanted = cut(sample.groupBy("label", "dim").applyInArrow(_sampled(kind, threshold, window, recall), "label string, dim int, passes int"))
    for r in wanted.where(F.col("passes") > most).limit(5).collect():
        warnings.warn(f"label {r['label']!r} would need {r['passes']} passes for a recall of {recall}; it gets {most}", stacklevel=3)
    return classes.join(hint(wanted), ["label", "dim"], "left").withColumn("passes", F.least(F.lit(most), F.greatest(F.lit(passes), F.coalesce("passes", F.lit(passes)))))


def _keys(kind: str):
    """Each class once a pass of its label, with its key in that pass."""

    def run(batches):
        for batch in batches:
            dims, passes = np.asarray(batch.column("dim")), np.asarray(batch.column("passes"))
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(own))
                x = _matrix(part.column("vector").to_pylist(), dim, kind)
                for k in range(int(passes[own].max())):
                    # the rows that have a pass of that number
                    some = np.flatnonzero(passes[own] > k)
                    rows = part.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * rows.num_rows, pa.int32()), rows.column("label"), rows.column("dim"), pa.array(_sorted_keys(x[some], k)), rows.column("cls"), rows.column("vector")], names=["pass", "label", "dim", "key", "cls", "vector"])

    return run


def _forest(pairs_a, pairs_b):
    """Of the given links as many as join the same rows without a cycle."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(pairs_a, pairs_b, strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            yield a, b


def _windows(window: int, least: float, kind: str):
    """The links that the windows of a block show, without cycles."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def block(rows: list):
        rows.sort(key=lambda r: r[1])
        by = {}
        for r in rows:
            by.setdefault((r[2], r[3], r[4]), []).append(r)
        for (_, _, dim), own in by.items():
            x = _matrix([r[6] for r in own], dim, kind)
            place = np.array([r[1] for r in own])
            ids = np.array([r[5] for r in own], dtype=np.int64)
            for d in range(1, min(window, len(own) - 1) + 1):
                hit = np.flatnonzero(((x[d:] * x[:-d]).sum(axis=1) >= least) & (place[d:] - place[:-d] <= window))
                yield from zip(ids[:-d][hit].tolist(), ids[d:][hit].tolist(), strict=True)

    def run(batches):
        now, rows = None, []

        def done():
            found = list(block(rows))
            links = list(_forest([a for a, _ in found], [b for _, b in found]))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "place", "pass", "label", "dim", "cls", "vector")]
            for r in zip(*columns, strict=True):
                if r[0] != now and rows:
                    yield done()
                    rows.clear()
                now = r[0]
                rows.append(r)
        if rows:
            yield done()

    return run


def _blocked(kind: str):
    """Members in blocks of one component (kind 0), and each block's centre, radius and number of vectors (kind 1).

    Rows come by component and key, so a block's members are near one another and none spans tasks.
    """

    def run(batches):
        from pyspark import TaskContext

        part, count, rows = TaskContext.get().partitionId(), 0, []

        def done():
            nonlocal count
            block = (part << 32) + count
            count += 1
            root, dim = rows[0][0], rows[0][2]
            x = _matrix([r[3] for r in rows], dim, kind)
            centre = x.mean(axis=0)
            size = np.sqrt(centre @ centre)
            radius = float(np.arccos(np.clip(x @ (centre / size), -1, 1)).max()) if size > 1e-9 else float(np.pi)
            k, copies = len(rows), [r[4] for r in rows]
            vectors = [r[3] for r in rows] + [(centre / max(size, 1e-9)).tobytes()]
            rows_ = [[0] * k + [1], [root] * (k + 1), [block] * (k + 1), [r[1] for r in rows] + [None], [dim] * (k + 1), vectors, [*copies, sum(copies)], [None] * k + [radius]]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows_, _BLOCKED, strict=True)], schema=_BLOCKED)

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("root", "cls", "dim", "vector", "copies")), strict=True):
                if rows and (r[0] != rows[0][0] or len(rows) == MEMBERS_IN_BLOCK):
                    yield done()
                rows.append(r)
        if rows:
            yield done()

    return run


_BLOCKED = pa.schema([("kind", pa.int32()), ("root", pa.int64()), ("block", pa.int64()), ("cls", pa.int64()), ("dim", pa.int32()), ("vector", pa.binary()), ("copies", pa.int64()), ("radius", pa.float64())])


def _settled(least: float):
    """Pairs of blocks whose vectors are not all apart: by the angles of their centres, all linked (whole) or open.

    A group has the centres of two runs of blocks of a component, each of ``CENTRES`` at most.
    """
    angle = float(np.arccos(least))
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("ni", pa.int64()), ("nj", pa.int64()), ("whole", pa.bool_())])

    def run(key, centres):
        if not centres.num_rows:
            return schema.empty_table()
        of = np.asarray(centres.column("run"))
        x = np.frombuffer(b"".join(centres.column("vector").to_pylist()), dtype=np.float64).reshape(centres.num_rows, -1)
        block, radius, size = (np.asarray(centres.column(c)) for c in ("block", "radius", "copies"))
        a, b = np.flatnonzero(of == key[1].as_py()), np.flatnonzero(of == key[2].as_py())
        between = np.arccos(np.clip(x[a] @ x[b].T, -1, 1))
        same = block[a][:, None] == block[b][None, :]
        between[same] = 0
        spread = radius[a][:, None] + radius[b][None, :]
        keep = between - spread <= angle + ANGLE_ERROR
        if key[1].as_py() == key[2].as_py():
            keep &= block[a][:, None] <= block[b][None, :]
        i, j = np.nonzero(keep)
        whole = (between + spread < angle - ANGLE_ERROR)[i, j]
        return pa.table([pa.array(c) for c in (block[a][i], block[b][j], size[a][i], size[b][j], whole)], schema=schema)

    return run


def _counts(least: float, kind: str):
    """For an open pair of blocks: per class the links that it has with classes of the other block."""
    schema = pa.schema([("cls", pa.int64()), ("links", pa.int64())])

    def run(key, grouped):
        if not grouped.num_rows:
            return schema.empty_table()
        i, j = key[0].as_py(), key[1].as_py()
        x = _matrix(grouped.column("vector").to_pylist(), grouped.column("dim")[0].as_py(), kind)
        of, size = np.asarray(grouped.column("block")), np.asarray(grouped.column("copies"))
        a, b = np.flatnonzero(of == i), np.flatnonzero(of == j)
        total = np.zeros(len(x), dtype=np.int64)
        near = np.einsum("id,jd->ij", x[a], x[b], optimize=True) >= least
        if i == j:
            np.fill_diagonal(near, False)
        else:
            total[b] += size[a] @ near
        total[a] += near @ size[b]
        return pa.table([grouped.column("cls").combine_chunks(), pa.array(total)], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.98, passes: int = 12, window: int = 48, recall: float = 0.98, most_passes: int = 256) -> DataFrame:
    """Link vectors of the same label whose cosine, in double precision, is ``threshold`` or more.

    Returns one row per input row: ``vec_id``, ``n_links`` (other rows linked directly), ``component_id`` (smallest id reachable by
    links, itself included) and ``kept`` (the id is its component's). With ``label_col=None`` all vectors are compared.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, are linked with nothing:
    n_links 0 and their own component. Vectors of different lengths are not compared. Repeated vectors are linked with each other;
    ids may be of any type that has an order, and repeated ids are rows of their own. A null id is never the smallest one. An empty
    table gives an empty result. Only the three columns are read, so others may have any name.
    ``window`` (below ROWS_IN_BLOCK) bounds the neighbours a pass compares, see the module for what finds the rest. Labels of more than
    ``SAMPLED_FROM`` different vectors get as many passes as their sample asks for ``recall``, at least ``passes``; a warning says so where
    that is more than ``most_passes``.
    """
    spark = vectors.sparkSession
    prepare(spark)
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    label = F.lit("").alias("label") if label_col is None else F.col(label_col).cast("string").alias("label")
    source = vectors.select(F.col(id_col).alias("vec_id"), label, F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    rows = source.mapInArrow(_usable(kind), T.StructType([source.schema["vec_id"], *T._parse_datatype_string("label string, dim int, vector binary").fields]))
    # vectors are told apart by 128 bits wherever the vector itself is not at hand
    rows = cut(rows.withColumn("mark", F.when(F.col("vector").isNotNull(), F.unhex(F.md5(F.concat(F.sha1(F.col("label").cast("binary")).cast("binary"), "vector"))))))
    good = rows.where("vector is not null")
    classes = good.groupBy("mark", "label", "dim", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))

    # order within (pass, label); equal keys are put in an order of the pass's own
    passing = _with_passes(classes, kind, threshold, window, passes, most_passes, recall)
    keyed = passing.mapInArrow(_keys(kind), "pass int, label string, dim int, key long, cls long, vector binary")
    keyed = keyed.withColumn("tie", F.xxhash64("pass", "cls"))
    order = ["pass", "label", "dim", "key", "tie"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered_at = cut(ordered.select("pass", "label", "dim", "cls", "vector", F.monotonically_increasing_id().alias("at")))
    ordered = ordered_at.withColumn("part", F.shiftright("at", 33))
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a partition
    starts, total = [], 0
    for part, size in sizes:
        starts.append((part, total))
        total += size
    starts_frame = spark.createDataFrame(starts, "part long, start long")
    placed = ordered.join(F.broadcast(starts_frame), "part").withColumn("place", F.col("start") + F.expr("at & 8589934591L"))
    block, into = F.floor(F.col("place") / ROWS_IN_BLOCK), F.col("place") % ROWS_IN_BLOCK
    blocks = F.when(into >= ROWS_IN_BLOCK - window, F.array(block, block + 1)).otherwise(F.array(block))
    blocked = placed.select(F.explode(blocks).alias("block"), "place", "pass", "label", "dim", "cls", "vector").repartition("block").sortWithinPartitions("block")
    links = blocked.mapInArrow(_windows(window, threshold, kind), "a long, b long")

    links = cut(links)
    roots = cut(components(links).select(F.col("node").alias("cls"), F.col("component").alias("root")))
    # a class's place in the first pass puts members that are near one another into the same block
    near = placed.where("pass = 0").select("cls", "place")
    members = classes.select("cls", "dim", "vector", "copies").join(roots, "cls").join(near, "cls")
    members = members.repartitionByRange(n, "root", "place").sortWithinPartitions("root", "place").select("root", "cls", "dim", "vector", "copies")
    members = cut(members.mapInArrow(_blocked(kind), "kind int, root long, block long, cls long, dim int, vector binary, copies long, radius double"))
    centres = members.where("kind = 1")
    # runs of blocks by their numbers: a component's blocks of one partition follow one another
    centres = centres.select("root", F.shiftright("block", int(np.log2(CENTRES))).alias("run"), "block", "vector", "radius", "copies")
    runs = centres.select("root", "run").distinct()
    met = runs.join(runs.withColumnRenamed("run", "other"), "root").where("run <= other").select("root", F.col("run").alias("a"), F.col("other").alias("b"))
    asked = met.select("root", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("run"))
    pairs = cut(centres.join(asked, ["root", "run"]).groupBy("root", "a", "b").applyInArrow(_settled(threshold), "i long, j long, ni long, nj long, whole boolean"))
    whole = pairs.where("whole")
    more = whole.select(F.col("i").alias("block"), F.col("nj").alias("more")).union(whole.where("i <> j").select("j", "ni"))
    more = more.groupBy("block").agg(F.sum("more").alias("more"))
    # of its own block a class's copies are counted below
    inner = whole.where("i = j").select(F.col("i").alias("block"), F.lit(1).alias("own"))
    plain = members.where("kind = 0").select("block", "cls", "copies").join(more, "block").join(inner, "block", "left")
    plain = plain.select("cls", (F.col("more") - F.when(F.col("own") == 1, F.col("copies")).otherwise(0)).alias("links"))
    asked = pairs.where("not whole").select("i", "j")
    asked = asked.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    met = members.where("kind = 0").select("block", "cls", "dim", "vector", "copies").join(asked, "block")
    counted = met.groupBy("i", "j").applyInArrow(_counts(threshold, kind), "cls long, links long")
    counted = counted.union(plain).groupBy("cls").agg(F.sum("links").alias("links"))

    firsts = classes.select("cls", "mark", "first", "copies").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    firsts = cut(firsts.join(counted, "cls", "left").select("mark", "first", "copies", "root", F.coalesce("links", F.lit(0)).alias("links")))
    low = cut(firsts.groupBy("root").agg(F.min("first").alias("component_id")))
    known = cut(firsts.join(low, "root").select("mark", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links")))
    linked = good.select("vec_id", "mark").join(known, "mark").select("vec_id", F.col("n_links").cast("long"), "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = cut(linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())))
    discard(rows, classes, ordered_at, links, roots, members, pairs, firsts, low, known)
    return out


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of near_duplicates over all of ``embeddings``."""
    return near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r(node, comp) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.y, r.comp FROM r JOIN p ON p.x = r.node),
m AS (SELECT node, min(comp) AS comp FROM r GROUP BY node), k AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, m.comp AS component_id, vec_id = m.comp AS kept FROM embeddings JOIN m ON m.node = vec_id LEFT JOIN k ON k.x = vec_id
"""
