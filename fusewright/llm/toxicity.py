"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models on lexical features; each later model also gets the earlier categories'
probabilities. In training those are out-of-fold ones: a row's probability comes from a model that has not seen the row, so a later
model learns how far an earlier one can be trusted on new rows.

Features are the logarithms of the counts of words and of word beginnings of a few lengths (inflected forms share a stem), by 64-bit
hashes, and the text's length. Per category and fold those most associated with the category among the fold's training rows are kept
(two-proportion z-scores from one grouped count over all rows). Models are L2-regularised logistic regressions by Newton steps.

Models are fitted on at most ``max_rows`` labelled rows, chosen by a hash of the id; what reaches the driver is bounded by that and by
the number of features. Scoring goes over every row of the documents, each row by itself.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusewright.llm._shared import cut, discard, free_name, prepare, table
from fusewright.llm._text import ALNUM, U64, Words, as_bytes, groups, signed, slices

FOLDS = 5
MAX_ROWS = 10_000
FEATURES = 256
#: Rows that a feature needs, unless it has ``least_share`` of a rare category's rows, see ``fit``.
LEAST_ROWS = 10
FEWEST_ROWS = 3
LEAST_SHARE = 0.1
#: Beginnings of so many bytes are features beside the words.
BEGINNINGS = (4, 5, 6, 7)
#: Columns of ``labels``, in chain order, and the value that is the category.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


@dataclass
class Link:
    """One category's model: features (sorted hashes) with weights, then length, earlier categories, constant."""

    name: str
    hashes: np.ndarray
    weights: np.ndarray
    threshold: float


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def __post_init__(self):
        self.hashes = np.unique(np.concatenate([x.hashes for x in self.links])) if self.links else np.zeros(0, dtype=U64)
        self.door = np.zeros(1 << 16, dtype=bool)
        self.door[(self.hashes & U64(0xFFFF)).astype(np.int64)] = True

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(documents by features, words of each document)."""
        words = Words(texts, ALNUM, BEGINNINGS)
        doc = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
        out = np.zeros((len(texts), len(self.hashes)))
        if len(self.hashes):
            for h in (words.hashes, *words.tops):
                may = np.flatnonzero(self.door[(h & U64(0xFFFF)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.hashes, h[may]), len(self.hashes) - 1)
                hit = self.hashes[at] == h[may]
                np.add.at(out, (doc[may[hit]], at[hit]), 1)
        return out, np.diff(words.bounds)

    def probabilities(self, counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Documents by categories."""
        x, size = np.log1p(counts), np.log1p(n_words)[:, None]
        done = np.zeros((len(x), 0))
        for link in self.links:
            own = x[:, np.searchsorted(self.hashes, link.hashes)]
            p = _sigmoid(np.hstack([own, size, _logit(done), np.ones((len(x), 1))]) @ link.weights)
            done = np.hstack([done, p[:, None]])
        return done


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of an L2-regularised logistic regression; the last column of x is the constant and is not penalised."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - y) + ridge * w
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(ridge), gradient)
        step *= min(1.0, 8 / max(1e-9, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The out-of-fold threshold of at least 0.5 with the best F1 (the lowest of equals)."""
    best, at = -1.0, 0.5
    for t in np.arange(0.5, 0.96, 0.05):
        hit = (p >= t) & (y == 1)
        f1 = 2 * hit.sum() / max(1, (p >= t).sum() + (y == 1).sum())
        if f1 > best + 1e-9:
            best, at = f1, float(t)
    return at


def _hashed(batches):
    """Adds the distinct feature hashes of each training text and their counts."""
    for batch in (part for whole in batches for part in slices(whole, "text")):
        texts = as_bytes(batch.column("text"))
        keys, counts, sizes = [], [], []
        for a, b in groups(texts):
            words = Words(texts[a:b], ALNUM, BEGINNINGS)
            for i in range(b - a):
                own = slice(words.bounds[i], words.bounds[i + 1])
                every = np.concatenate([words.hashes[own], *(t[own] for t in words.tops)])
                h, n = np.unique(every[every != 0], return_counts=True)
                keys.append(signed(h))
                counts.append(n.astype(np.int32))
                sizes.append(int(words.bounds[i + 1] - words.bounds[i]))
        out = batch.drop_columns(["text"])
        yield out.append_column("h", pa.array(keys, pa.list_(pa.int64()))).append_column("c", pa.array(counts, pa.list_(pa.int32()))).append_column("n_words", pa.array(sizes, pa.int64()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories=CATEGORIES, max_rows: int = MAX_ROWS, features: int = FEATURES, least_share: float = LEAST_SHARE) -> Chain:
    """A chain fitted on at most ``max_rows`` of the labelled documents.

    Labels with a null id, and null texts, are left out; of the texts of a repeated id the one with the smallest hash counts, of its
    labels the greatest. Ids may be of any type that has an order. A null label leaves its row out of that category only. A category without both kinds of rows gets a model that predicts the share it saw (0 with no rows), which never
    reaches its threshold unless all rows are of the category.

    A word can be a feature if it is in LEAST_ROWS labelled rows, or in ``least_share`` of the rows of a category (at least FEWEST_ROWS),
    so that categories with few rows have features too. Of these a category keeps the ``features`` with the greatest z-scores, above 3.
    Tables without rows give a chain whose models have no features.
    """
    prepare(docs.sparkSession)
    names = [c for c, _, _ in categories]
    wanted = [F.when(F.col(col).isNotNull(), (F.col(col) == value).cast("int")).alias(name) for name, col, value in categories]
    chosen = labels.select(F.col(id_col).alias("id"), *wanted).where("id is not null")
    chosen = chosen.groupBy("id").agg(*[F.max(c).alias(c) for c in names])
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(max_rows)  # the bound that makes the broadcast safe
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "id")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = rows.select("id", fold, *names, F.md5("text").alias("finger"), "text")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("h", T.ArrayType(T.LongType())), T.StructField("c", T.ArrayType(T.IntegerType())), T.StructField("n_words", T.LongType())])
    # of an id's rows one counts; rows are combined before they are moved
    rows = rows.mapInArrow(_hashed, schema).groupBy("id").agg(F.min_by(F.struct("fold", *names, "h", "c", "n_words"), "finger").alias("r"))
    rows = cut(rows.select("id", "r.*"))

    cells = [(k, f, v) for k in range(len(names)) for f in range(FOLDS) for v in (0, 1)]
    sums = [F.count_if((F.col("fold") == f) & (F.col(names[k]) == v)).cast("int").alias(f"s{i}") for i, (k, f, v) in enumerate(cells)]
    shape = (len(names), FOLDS, 2)
    totals = np.array(rows.agg(*sums).first(), dtype=np.float64).reshape(shape)
    enough = F.col("n") >= LEAST_ROWS
    for k, name in enumerate(names):
        least = max(FEWEST_ROWS, int(np.ceil(least_share * totals[k, :, 1].sum())))
        if least < LEAST_ROWS:
            enough = enough | (F.col(f"n_{name}") >= least)
    exploded = rows.select("fold", *names, F.explode("h").alias("h"))
    grouped = exploded.groupBy("h").agg(F.count("*").alias("n"), *[F.count_if(F.col(c) == 1).alias(f"n_{c}") for c in names], *sums)
    counted = grouped.where(enough).drop("n", *[f"n_{c}" for c in names]).toPandas()
    table_ = counted[[f"s{i}" for i in range(len(cells))]].to_numpy(dtype=np.float64).reshape(-1, *shape)
    hashes = counted["h"].to_numpy(dtype=np.int64).view(U64)

    def select(k: int, without: int | None) -> np.ndarray:
        keep = [f for f in range(FOLDS) if f != without]
        have, all_ = table_[:, k, keep].sum(axis=1), totals[k, keep].sum(axis=0)
        if not all_.all() or not len(have):
            return np.zeros(0, dtype=np.int64)
        share = have / all_
        both = have.sum(axis=1) / all_.sum()
        z = (share[:, 1] - share[:, 0]) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / all_).sum())
        order = np.lexsort((hashes, -np.abs(z)))[:features]
        return order[np.abs(z[order]) > 3]

    picks = {(k, f): select(k, f) for k in range(len(names)) for f in [*range(FOLDS), None]}
    used = np.unique(np.concatenate([hashes[p] for p in picks.values()])) if len(hashes) else np.zeros(0, dtype=U64)
    if len(used):
        shared = docs.sparkSession.sparkContext.broadcast(used)
        small = rows.select("id", "fold", *names, "n_words", "h", "c").mapInArrow(_only(shared), T.StructType([f for f in schema.fields if f.name not in ("h", "c", "finger")] + [T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("c", T.ArrayType(T.IntegerType()))]))
        got = small.collect()
    else:
        got = rows.select("id", "fold", *names, "n_words").collect()
    got.sort(key=lambda r: r["id"])
    x = np.zeros((len(got), len(used)), dtype=np.float32)
    for i, r in enumerate(got):
        if len(used):
            x[i, r["at"]] = r["c"]
    x = np.log1p(x)
    size = np.log1p(np.array([r["n_words"] for r in got], dtype=np.float64))[:, None]
    folds = np.array([r["fold"] for r in got], dtype=np.int64)
    y = np.array([[-1 if r[c] is None else r[c] for c in names] for r in got], dtype=np.int64).reshape(len(got), len(names))

    earlier = np.zeros((len(got), 0))
    links = []
    for k, name in enumerate(names):
        out = np.zeros(len(got))
        for f in [*range(FOLDS), None]:
            own = hashes[picks[k, f]] if len(hashes) else used
            own = np.sort(own)
            design = np.hstack([x[:, np.searchsorted(used, own)].astype(np.float64), size, _logit(earlier), np.ones((len(got), 1))])
            train = (y[:, k] >= 0) & (folds != f if f is not None else True)
            target = y[train, k]
            if not len(target) or target.min() == target.max():
                w = np.zeros(design.shape[1])
                w[-1] = 30.0 if len(target) and target[0] else -30.0
            else:
                w = logistic(design[train], target)
            if f is None:
                links.append(Link(name, own, w, best_threshold(out[y[:, k] >= 0], y[y[:, k] >= 0, k])))
            else:
                out[folds == f] = _sigmoid(design[folds == f] @ w)
        earlier = np.hstack([earlier, out[:, None]])
    discard(rows)
    return Chain(links)


def _only(shared):
    """Keeps the features that a model uses, as their places."""

    def run(batches):
        used = shared.value
        for batch in batches:
            ats, cs = [], []
            for h, c in zip(batch.column("h"), batch.column("c"), strict=True):
                h, c = np.asarray(h.values, dtype=np.int64).view(U64), np.asarray(c.values)
                at = np.minimum(np.searchsorted(used, h), len(used) - 1)
                hit = used[at] == h
                ats.append(at[hit].astype(np.int32))
                cs.append(c[hit])
            out = batch.drop_columns(["h", "c"])
            yield out.append_column("at", pa.array(ats, pa.list_(pa.int32()))).append_column("c", pa.array(cs, pa.list_(pa.int32())))

    return run


def _scored(shared, text_col: str, names: list[str]):
    def run(batches):
        chain: Chain = shared.value
        # a slice's rows by features are held at once
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            texts = as_bytes(batch.column(text_col))
            p = [chain.probabilities(*chain.counts(texts[a:b])) for a, b in groups(texts)]
            p = np.concatenate(p) if p else np.zeros((0, len(names)))
            for k, name in enumerate(names):
                batch = batch.append_column(name, pa.array(p[:, k]))
            yield batch

    return run


def score(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """``docs`` with a probability per category as last columns, over each whole text.

    They are named ``<prefix><category>``, with underscores before it where ``docs`` has a column of that name. A null text is scored as an
    empty one. Every row stays, repeated ones too; an empty table stays empty. Texts of any length are scored, about a megabyte at a time.
    """
    prepare(docs.sparkSession)
    names: list[str] = []
    for link in chain.links:
        names.append(free_name(prefix + link.name, [*docs.columns, *names]))
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return docs.mapInArrow(_scored(shared, text_col, names), schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Per document of ``documents``: doc_id, p_low_quality, p_toxic, and toxic (the last category reaches its threshold)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, chain)
    return scored.select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), (F.col("p_toxic") >= chain.links[-1].threshold).alias("toxic"))


def reject_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose last category, toxic, stays below its threshold; all their columns stay, whatever their names.

    Cases are as in ``fit`` and ``score``; without labels of both kinds nothing is rejected, unless all labels are toxic.
    """
    chain = fit(docs, labels, text_col=text_col)
    scored = score(docs, chain, text_col)
    return scored.where(F.col(f"`{scored.columns[-1]}`") < chain.links[-1].threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
