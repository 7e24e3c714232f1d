"""Rolling windows, lexical search and reversible line dedup against brute force; odd rows, repeats, partitions, empty tables."""
import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fusewright.llm import chat_format, decontamination, embedding_dedup, lexical_search, line_dedup, ngram_jaccard, queries, rolling_features, url_filter
from fusewright.llm.cuckoo import Cuckoo

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@needs_tables
@pytest.mark.parametrize("name", ["op11_rolling_features", "op12_lexical_search", "op13_line_dedup"])
def test_whole_tables_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for t in ("documents", "benchmark"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    frame = queries.QUERIES[name](spark, SF)
    wanted = connection.sql(queries.ORACLE_SQL[name])
    order = [wanted.columns.index(c) for c in frame.columns]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, frame.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in wanted.fetchall()), key=key)


# ------------------------------------------------------------------------------------------------------------- op11


def brute_windows(rows, windows):
    """rows: (id, time, source, length, category)."""
    out = []
    for own, t, source, _, _ in rows:
        for w in windows:
            seen = [r for r in rows if t is not None and r[1] is not None and r[2] == source and t - w <= r[1] < t]
            lengths = sorted(r[3] for r in seen if r[3] is not None)
            m = len(lengths)
            at = lambda k: lengths[k - 1] if m else None  # noqa: B023, E731
            out.append((own, w, t, len(seen), sum(lengths), len({r[4] for r in seen} - {None}), at(-(-m // 2)), at(-(-99 * m // 100))))
    return collections.Counter(out)


ODD = "id string, t long, source string, n long, lang string, k string, own int, len int"


def odd_rows(rng, n):
    return [(rng.choice(["a", "b", None, f"i{k}"]), rng.choice([None, *range(-400, 400, 7)]), rng.choice(["hot", "hot", "hot", None, "x", ""]), rng.choice([None, 0, 3, 3, 900]), rng.choice([None, "en", "de", ""]), "z", 1, 2) for k in range(n)]


@pytest.mark.parametrize(("groups", "block", "budget", "parts"), [(1, None, 2_000_000, 1), (3, 150, 40, 7), (16, 5000, 1, 3)])
def test_windows_against_brute_force(spark, groups, block, budget, parts):
    rows = odd_rows(random.Random(groups), 150)
    frame = spark.createDataFrame(rows, ODD).repartition(parts)
    found = rolling_features.rolling_features(frame, F.col("t"), F.col("n"), id_col="id", category_col="lang", windows=(20, 130), groups=groups, block=block, list_budget=budget)
    assert found.columns == ["id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars"]
    assert collections.Counter(map(tuple, found.collect())) == brute_windows([r[:5] for r in rows], (20, 130))


def test_windows_of_an_empty_table(spark):
    assert rolling_features.rolling_features(spark.createDataFrame([], ODD), F.col("t"), F.col("n"), id_col="id").collect() == []


def test_the_clock(spark):
    """The query's own time of a row, by zlib."""
    ids = [0, 5, 12, 999, 123_456, -7, None]
    late = F.col("doc_id") + F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1000))
    rows = spark.createDataFrame([(k,) for k in ids], "doc_id long").select("doc_id", (F.lit(60) * ((late - F.pmod(late, F.lit(6))) / F.lit(6)).cast("long")).alias("t")).collect()
    for r in rows:
        assert r["t"] == (None if r["doc_id"] is None else 60 * ((r["doc_id"] + zlib.crc32(str(r["doc_id"]).encode()) % 1000) // 6))


# ------------------------------------------------------------------------------------------------------------- op12

WORD = re.compile(lexical_search.TERM)
LOW = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def brute_search(docs, items, top):
    terms = [(k, i, collections.Counter(WORD.findall((t or "").translate(LOW)))) for k, (i, t) in enumerate(docs)]
    terms = [(k, i, c, sum(c.values())) for k, i, c in terms if c]
    n_docs, n_terms = len(terms), sum(n for *_, n in terms)
    df = collections.Counter(t for _, _, c, _ in terms for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(WORD.findall((t or "").translate(LOW)))
    out = set()
    for item, own in wanted.items():
        scored = []
        for _, i, c, n in terms:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0, i))
        out |= {(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top], 1)}
    return out


@pytest.mark.parametrize(("block", "parts", "broadcast"), [(1 << 22, 1, True), (60, 4, True), (400, 7, False)])
def test_search_against_brute_force(spark, monkeypatch, block, parts, broadcast):
    rng = random.Random(block)
    words = ["the", "THE", "köln", "a1", "日本", "x", "run", "Run", "zebra", "_", "…", "it's"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(rng.choice([None, 1, 2, 3, *range(10, 60)]) if k % 3 else k + 100, rng.choice([None, "", " - ", text(3), text(9), text(9), text(200)])) for k in range(120)]
    docs += [(500 + k, "zebra run") for k in range(9)]
    items = [(1, "Zebra run"), (2, None), (3, ""), (4, "unknown"), (5, "the köln 日本"), (5, "zebra"), (None, "x a1"), (7, "the the THE"), (8, text(40))]
    if not broadcast:
        monkeypatch.setattr(lexical_search, "MAX_BROADCAST_TERMS", 0)
        monkeypatch.setattr(lexical_search, "ITEMS_A_LIST", 2)
    frame = spark.createDataFrame([(*d, "y", 1) for d in docs], "doc_id long, text string, term string, block int").repartition(parts)
    index = lexical_search.postings(frame, block_bytes=block, buckets=5)
    found = lexical_search.search(index, spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, score int"), top=7, buckets=5)
    rows = [tuple(r) for r in found.collect()]
    # equal ids may tie with themselves, so ranks are compared as they come
    assert len(rows) == len(set(rows)) and set(rows) == brute_search(docs, items, 7)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    empty = lexical_search.postings(docs.limit(0))
    assert empty.count() == 0 and lexical_search.search(empty, items).collect() == []
    assert lexical_search.search(lexical_search.postings(docs), items.limit(0)).collect() == []
    assert lexical_search.postings(spark.createDataFrame([(1, None), (2, "--")], "doc_id long, text string")).count() == 0


def test_a_long_text_is_one_document(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000 + "rare"), (2, "word"), (3, "other"), (4, "thing")], "doc_id long, text string")
    index = lexical_search.postings(docs, block_bytes=1000)
    assert index.where("term = 'word'").select(F.sum("n_docs"), F.max(F.array_max("tfs")), F.max(F.array_max("lens"))).first() == (2, 400_000, 400_001)
    assert [r["doc_id"] for r in lexical_search.search(index, spark.createDataFrame([(1, "rare")], "item_id long, text string")).collect()] == [1]


# ------------------------------------------------------------------------------------------------------------- op13


@pytest.mark.parametrize("n", [0, 1, 7, 1000, 50_000])
def test_cuckoo_filter(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, 2 * n + 10, dtype=np.uint64))[: 2 * n]
    mine, others = keys[::2], keys[1::2]
    own = Cuckoo()
    for part in np.array_split(mine, 3):
        own.add(part)
        own = Cuckoo(own.dump())
    assert own.has(mine).all() and own.has(others).mean() <= 0.003 if n > 100 else own.has(mine).all()
    gone, kept = mine[::3], np.setdiff1d(mine, mine[::3])
    own.remove(gone)
    assert own.has(kept).all()
    if n >= 1000:
        assert own.has(gone).mean() < 0.01 and sum(len(x) for x in own.dump()) <= 16 * n
    own.add(gone)
    assert own.has(mine).all()


def brute_dedup(docs, held=None):
    """docs: (id, text) to be cut; held: those in the index, by default the same."""
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = collections.defaultdict(set)
    last = (1, 0)
    order = lambda i: last if i is None else (0, i)
    for i, t in docs if held is None else held:
        for line in (t or "").split("\n"):
            if len(norm(line)) >= 10:
                holders[norm(line)].add(order(i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(h := holders.get(norm(x), ())) > 1 and order(i) in h and min(h) != order(i))]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return collections.Counter(out)


LINE_DOCS = "doc_id long, text string, gone string, n_lines int, doc int"


def line_docs(rng, n, first=0):
    pool = [f"Common line {k} of all" for k in range(8)] + [" common LINE 1 of all\t", "short", "", "ÀÉÎÕÜ ÀÉÎ", "àéîõü àéîõ", "ÄÄÄÄÄÄÄÄÄÄ", "ten chars!", "nine char", "a" * 3000]
    return [(rng.choice([None, first + k, first + k, first + k // 2]), rng.choice([None, "", "\n".join(rng.choice(pool) for _ in range(rng.randrange(9))), f"only document {first + k} has it\nCommon line 3 of all\n"])) for k in range(n)]


def rows_of(frame):
    return collections.Counter((r["doc_id"], r["_n_lines"], r["n_dropped"], r["text"] or "") for r in frame.collect())


@pytest.mark.parametrize("shards", [1, 5])
def test_line_dedup_against_brute_force(spark, shards):
    docs = line_docs(random.Random(shards), 90)
    frame = spark.createDataFrame([(*d, "g", 1, 2) for d in docs], LINE_DOCS).repartition(6)
    index = line_dedup.LineIndex(spark, shards=shards)
    index.insert(frame.where("doc_id % 3 = 0 OR doc_id IS NULL"))
    index.insert(frame.where("doc_id % 3 <> 0"))
    found = index.deduplicate(frame)
    assert found.columns == ["doc_id", "text", "gone", "n_lines", "doc", "_n_lines", "n_dropped"]
    assert rows_of(found) == brute_dedup(docs)
    index.delete()


def test_removal_reverses_insertion(spark):
    """After any insertions and removals, counts, filters and results are those of an index that saw the documents left only."""
    rng = random.Random(12)
    parts = [line_docs(rng, 40, first) for first in (0, 30, 60)]
    frames = [spark.createDataFrame([(*d, "g", 1, 2) for d in p], LINE_DOCS) for p in parts]
    index = line_dedup.LineIndex(spark, shards=3)
    for f in frames:
        index.insert(f)
    every = [d for p in parts for d in p]
    left = [d for d in every if d[0] is None or d[0] % 4]
    index.remove(spark.createDataFrame([(i,) for i in range(0, 400, 4)], "doc_id long"))
    # it is all in its folder: another one opens it
    index = line_dedup.LineIndex(spark, index.folder)
    plain = line_dedup.LineIndex(spark, shards=3)
    plain.insert(spark.createDataFrame([(*d, "g", 1, 2) for d in left], LINE_DOCS))
    counts = lambda x: {(r["k1"], r["k2"]): r["refs"] for r in x.counts().collect()}
    assert counts(index) == counts(plain) and len(counts(plain)) > 10
    whole = spark.createDataFrame([(*d, "g", 1, 2) for d in every], LINE_DOCS)
    assert rows_of(index.deduplicate(whole)) == rows_of(plain.deduplicate(whole)) == brute_dedup(every, left)
    # what only removed documents held has left the filters, what is held never leaves them
    maybe = {r["doc_id"]: (r["n_keys"], r["n_maybe"]) for r in index.may_hold(whole.where("doc_id IS NOT NULL")).collect()}
    assert all(a == b for i, (a, b) in maybe.items() if i % 4)
    alone = [i for i in maybe if i % 4 == 0 and any(d[0] == i and f"only document {i} has" in (d[1] or "") for d in every)]
    assert alone and all(maybe[i][1] < maybe[i][0] for i in alone)
    # the same documents again: all is as it was before the removal
    index.insert(whole.where("doc_id % 4 = 0"))
    assert rows_of(index.deduplicate(whole)) == brute_dedup(every)
    # twice, or ids that are not there, change nothing
    before = counts(index)
    index.insert(whole)
    index.remove(spark.createDataFrame([(10_000,)], "doc_id long"))
    assert counts(index) == before
    index.remove(spark.createDataFrame([(None,)], "doc_id long"))
    assert rows_of(index.deduplicate(whole)) == brute_dedup(every, [d for d in every if d[0] is not None])


def test_line_dedup_of_empty_tables(spark):
    empty, one = spark.createDataFrame([], LINE_DOCS), spark.createDataFrame([(1, "a line of text\na line of text", "g", 1, 2)], LINE_DOCS)
    index = line_dedup.LineIndex(spark)
    assert index.deduplicate(empty).collect() == [] and rows_of(index.deduplicate(one)) == {(1, 2, 0, "a line of text\na line of text"): 1}
    index.remove(spark.createDataFrame([(1,)], "doc_id long"))
    index.insert(empty)
    index.insert(one)
    assert rows_of(index.deduplicate(one)) == {(1, 2, 0, "a line of text\na line of text"): 1}


def test_hot_line_and_long_text(spark):
    """A line in every document is one count; a text of many lines is cut whole."""
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the very same line\nnumber "), "id", F.lit(" of its own")).alias("text"))
    long = spark.range(1).select(F.lit(5000).cast("long").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda k: F.concat(F.lit("number "), k.cast("string"), F.lit(" of its own"))), "\n").alias("text"))
    docs = hot.unionByName(long).repartition(8)
    index = line_dedup.LineIndex(spark)
    index.insert(docs)
    assert index.counts().agg(F.max("refs")).first()[0] == 3000
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.md5((r["text"] or "").encode()).hexdigest()) for r in index.deduplicate(docs).where("doc_id IN (0, 1, 5000)").collect()}
    rest = "\n".join(f"number {k} of its own" for k in range(3000, 100_000))
    assert found == {0: (2, 0, hashlib.md5(b"the very same line\nnumber 0 of its own").hexdigest()), 1: (2, 1, hashlib.md5(b"number 1 of its own").hexdigest()), 5000: (100_000, 3000, hashlib.md5(rest.encode()).hexdigest())}


# ------------------------------------------------------------------------------------------- recall of the projection passes


def dense(n, cosine, dim=64):
    """Unit vectors of which any two are at about that cosine."""
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(dim)
    centre /= np.linalg.norm(centre)
    rest = rng.standard_normal((n, dim))
    rest -= np.outer(rest @ centre, centre)
    return np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * rest / np.linalg.norm(rest, axis=1, keepdims=True)


def near(x, cosine, seed=5):
    aside = np.random.default_rng(seed).standard_normal(x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)


@pytest.mark.parametrize(("n", "cosine"), [(20_000, 0.8), (100_000, 0.9), (300_000, 0.8)])
def test_passes_follow_size_and_density(n, cosine):
    """Isolated pairs at 0.982, by the passes alone, with the number of passes that a sample of 4,096 vectors asks for."""
    x = dense(n, cosine)
    own = x[:500]
    copies = near(own, 0.982)
    rate = embedding_dedup.rate_of(x[np.random.default_rng(2).permutation(n)[: embedding_dedup.SAMPLE]], n, 0.98, 48)
    passes, found = embedding_dedup.passes_for(rate, 0.98), np.zeros(500, dtype=bool)
    for k in range(passes):
        keys = np.sort(embedding_dedup._sorted_keys(x, k))
        found |= np.abs(np.searchsorted(keys, embedding_dedup._sorted_keys(own, k)) - np.searchsorted(keys, embedding_dedup._sorted_keys(copies, k))) <= 48
    assert found.mean() >= 0.95 and passes <= 80


def test_dense_label_by_the_operator(spark, monkeypatch):
    """A label beyond the size from which it is sampled: pairs are found that the default passes would lose, none is made up."""
    monkeypatch.setattr(embedding_dedup, "SAMPLED_FROM", 2_000)
    x = dense(12_000, 0.9, dim=32)
    x = np.concatenate([x, near(x[:200], 0.983)]).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist(), "big") for k, v in enumerate(x)] + [(50_000 + k, x[k].tolist(), "small") for k in range(3)], "vec_id long, embedding array<float>, label string").repartition(8)
    found = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(rows).where("n_links > 0 OR vec_id >= 50000").collect()}
    wide = x.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    links = collections.Counter()
    for a in range(0, len(wide), 2000):
        i, j = np.nonzero(wide[a : a + 2000] @ wide.T >= 0.98)
        for p, q in zip((i + a).tolist(), j.tolist(), strict=True):
            if p != q:
                links[p] += 1
    small = {50_000 + k: sum(1 for m in range(3) if m != k and wide[k] @ wide[m] >= 0.98) for k in range(3)}
    assert all(found[k]["n_links"] == n for k, n in small.items())
    have = {k: r["n_links"] for k, r in found.items() if k < 50_000}
    assert all(n <= links[k] for k, n in have.items()) and sum(have.values()) >= 0.95 * sum(links.values()) >= 300


# ------------------------------------------------------------------------------------- long columns of the n-gram Jaccard join


@pytest.mark.parametrize(("block_rows", "num", "den"), [(3, 4, 5), (7, 9, 10), (2, 1, 2)])
def test_long_columns_by_bands_of_size(spark, block_rows, num, den):
    """A passage in texts of many sizes: columns longer than a block, whose rows are of several bands and components."""
    rng = random.Random(block_rows)
    passage = " ".join(f"p{k}" for k in range(12))
    texts = []
    for k in range(60):
        own = " ".join(f"w{k // 3}x{m}" for m in range(rng.choice([0, 1, 4, 9, 30, 80])))
        texts.append(f"{own} {passage} {rng.choice(['', 'a', 'a b', 'c d e'])}")
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    shingles = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for w in (t.split() for t in texts)]
    wanted = {(a, b) for a in range(60) for b in range(a + 1, 60) if den * len(shingles[a] & shingles[b]) >= num * len(shingles[a] | shingles[b])}
    links, members = ngram_jaccard.similar_pairs(frame, words=3, num=num, den=den, block_rows=block_rows)
    of = collections.defaultdict(list)
    for r in members.collect():
        of[r["class_id"]].append(r["doc_id"])
    pairs = {tuple(sorted((x, y))) for r in links.collect() for x in of[r["a"]] for y in of[r["b"]]}
    pairs |= {tuple(sorted((x, y))) for own in of.values() for x in own for y in own if x < y}
    assert pairs == wanted and len(wanted) > 20


# ----------------------------------------------------------------------------------------- cases of earlier operators


def test_urls_with_clashing_columns(spark):
    rows = [(1, "http://example.com/en/1", "h", "p", "r", "v", 1.0), (2, None, "h", "p", "r", "v", 1.0), (3, "no scheme", "h", "p", "r", "v", 1.0), (3, "no scheme", "h", "p", "r", "v", 1.0), (4, "ftp://A.Example.NET/de/8?q", "h", "p", "r", "v", 1.0)]
    names = ("host", "path", "rule", "verdict", "score")
    plain = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    odd = spark.createDataFrame(rows, "page_id long, url string, " + ", ".join(f"{c} {'double' if c == 'score' else 'string'}" for c in names))
    key = lambda f: sorted(map(repr, f.select("page_id", "host", "path", "rule", "verdict").collect()))
    assert key(url_filter.filter_urls(odd)) == key(url_filter.filter_urls(plain)) and len(key(url_filter.filter_urls(odd))) == 5


def test_a_very_long_conversation(spark):
    """Snapshots of one of 20,000 turns: a prefix of it goes, what differs in its last turn stays."""
    n = 20_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("said "), "id").alias("text"))
    prefix = turns.where("turn < 15000").withColumn("conv_id", F.lit(2))
    other = turns.where("turn < 15000").withColumns({"conv_id": F.lit(3), "text": F.when(F.col("turn") == 14_999, "else").otherwise(F.col("text"))})
    rows = turns.unionByName(prefix).unionByName(other).withColumns({"pos": F.lit("x"), "h1": F.lit(1), "n_turns": F.lit(None).cast("int"), "chat": F.lit("y")}).repartition(5)
    found = {r["conv_id"]: (r["n_turns"], r["n_copies"], len(r["chat"])) for r in chat_format.collapse(rows).collect()}
    size = sum(len(f"<|im_start|>{'user' if k % 2 == 0 else 'assistant'}\nsaid {k}<|im_end|>\n") for k in range(n))
    assert set(found) == {1, 3} and found[1] == (n, 1, size) and found[3][:2] == (15_000, 1)


@needs_tables
def test_decontamination_in_parts_of_whole_tables(spark):
    """The same from parts of 300 windows as from one broadcast, over all documents."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    digest = lambda most: sorted((r["doc_id"], r["hits"]["n_words"], str(r["hits"]["spans"]), str(r["hits"]["items"])) for r in decontamination.find_hits(docs, bench, max_broadcast_windows=most).select("doc_id", "hits").collect())
    whole = digest(500_000)
    assert digest(300) == whole and any(x[2] != "[]" for x in whole)
