"""Small fixtures: edge cases and brute force for each operator."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fusewright.llm import byte_bpe, chat_format, decontamination, embedding_dedup, html_extract, ngram_jaccard, secret_scan, token_counts, toxicity, url_filter
from fusewright.llm._text import NOT_SPACE, Words, shingle_sets

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, n_words string, hits2 int"
rng = random.Random(3)
VOCABULARY = [f"w{k}" for k in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def near(text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def documents():
    base = [prose(120) for _ in range(6)]
    rows = [None, "", "  \n\t ", "one", "one two", "ONE two", base[0], base[0], base[0].upper()]
    rows += [near(b, k) for b in base for k in (0, 1, 1, 2, 3, 5, 8)]
    rows += [prose(rng.randrange(1, 60)) for _ in range(25)] + ["common passage of words " * 9 + prose(8) for _ in range(12)]
    return [(k, t, "x", 1) for k, t in enumerate(rows)]


def brute_components(docs, size, num, den):
    sets = {}
    for i, text, *_ in docs:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets[i] = {tuple(w[a : a + size]) for a in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("size", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_jaccard_join_is_exact(spark, size, num, den):
    docs = documents()
    found = ngram_jaccard.near_duplicates(spark.createDataFrame(docs, DOCS).repartition(3), words=size, num=num, den=den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(docs, size, num, den)


def test_jaccard_blocks_and_order_do_not_change_results(spark):
    levels, blocks = ngram_jaccard._column_levels(np.array([1, 2, 9000, 50000], dtype=np.uint32))
    assert levels[3] >= levels[2] > levels[0] and blocks[3] > blocks[2] > blocks[0] == 1
    docs = documents()
    found = ngram_jaccard.near_duplicates(spark.createDataFrame(docs[::-1], DOCS).repartition(5), block_rows=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(docs, 5, 4, 5)


def test_deduplicate_keeps_one_of_each_group(spark):
    docs = documents() + [(None, prose(50), None, None), (6, documents()[6][1], "x", 1)]
    kept = ngram_jaccard.deduplicate(spark.createDataFrame(docs, DOCS)).collect()
    wanted = {i for i, (n, c) in brute_components(documents(), 5, 4, 5).items() if i == c}
    ids = [r["doc_id"] for r in kept]
    assert kept and kept[0].asDict().keys() == {"doc_id", "text", "n_words", "hits2"} and {i for i in ids if i is not None and i < 6} <= wanted
    assert ngram_jaccard.deduplicate(spark.createDataFrame([], DOCS)).collect() == []


def test_word_hashes_of_long_texts(monkeypatch):
    text = ("ab cd " * 300_000 + "x" * 3_000_000 + " end").encode()
    w = Words([text, b"ab end"], NOT_SPACE)
    assert len(w.hashes) == 600_004 and w.hashes[0] == w.hashes[-2] and w.hashes[-1] == w.hashes[600_001]
    assert [len(s) for s in shingle_sets([b"", b"a", b"a b c a b c"], 3)] == [0, 1, 3]


def vectors():
    r = np.random.default_rng(1)
    rows, k = [], 0
    for label in (1, 2):
        for _ in range(30):
            base = r.standard_normal(16)
            for _ in range(r.integers(1, 5)):
                rows.append((k, (base + r.standard_normal(16) * r.choice([0.0, 0.02, 0.05, 0.1])).astype(np.float32).tolist(), label))
                k += 1
    center = r.standard_normal(16)
    for _ in range(150):
        rows.append((k, (center + r.standard_normal(16) * 0.02).astype(np.float32).tolist(), 1))
        k += 1
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15]
    rows += [(k + i, v, 1) for i, v in enumerate(odd)]
    return [*rows, (k + 10, center.astype(np.float32).tolist(), None), (k + 11, center.astype(np.float32).tolist()[:8], 1)]


def test_embeddings_against_brute_force(spark):
    rows = vectors()
    found = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3), window=16).collect()}
    assert len(found) == len(rows)
    good = [(i, np.array(v, dtype=np.float64), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: {j for j, w, m in good if j != i and m == l and len(w) == len(v) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98} for i, v, l in good}
    total, got = sum(map(len, links.values())), 0
    for i, *_ in rows:
        assert found[i]["n_links"] <= len(links.get(i, ())) and found[i]["kept"] == (found[i]["component_id"] == i)
        got += found[i]["n_links"]
    assert got >= 0.99 * total
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_token_counts_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    alphabet = "ab é▁  \n\t日🎉<s>\0'the,."
    texts = [None, "", " ", "x" * 5000, "a  b " * 2000, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300))]
    found = token_counts.token_counts(spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], DOCS), path).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found} == {k: (len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for k, t in enumerate(texts)}


def test_byte_bpe_round_trip_and_chunks(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN
    codec = byte_bpe.codec(path, pattern)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    alphabet = "ab é▁  \n\t日🎉'sll1２.,!<|"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(300)]
    for text in texts:
        for size, overlap in ((3, 2), (5, 1), (8, 6), (1, 1), (64, 8)):
            assert byte_bpe.pieces(codec.pattern, text, size, overlap) == codec.pattern.findall(text)
    rows = [(k, t, "x", 1) for k, t in enumerate([None, "", "x" * 400, *texts[:60]])]
    frame = spark.createDataFrame(rows, DOCS)
    wanted = {}
    for k, t, *_ in rows:
        ids = own.encode_ordinary(t or "")
        wanted[k] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    for options in ({}, {"size": 16, "overlap": 8, "spread": 40}):
        found = byte_bpe.digests(frame, path, pattern, **options).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in found} == wanted
    encoded = byte_bpe.encode(frame, path, pattern)
    decoded = {r["doc_id"]: r["raw"] for r in byte_bpe.decode(encoded, path, pattern).collect()}
    assert {k: None if t is None else t.encode() for k, t, *_ in rows} == {k: None if v is None else bytes(v) for k, v in decoded.items()}


def test_decontamination_against_brute_force(spark):
    items = [(1, prose(30)), (2, "Short ITEM here"), (3, None), (4, ""), (10, prose(14)), (10, prose(14)), (None, prose(20))]
    texts = [None, "", "a short, item? HERE now", items[0][1].upper(), prose(40) + " " + items[0][1] + " " + prose(400), prose(5) + " " + " ".join(items[0][1].split()[3:17]) + prose(3), items[4][1] + " " + items[5][1], prose(50), items[6][1]]
    docs = [(k, t, "x", 1) for k, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = decontamination.brute_force([(k, t) for k, t, *_ in docs], items[:6])
    frame = spark.createDataFrame(docs, DOCS)
    for most in (2_000_000, 7):
        found = decontamination.find_hits(frame, bench, max_broadcast_windows=most).select("doc_id", F.col("hits.n_words"), F.expr("aggregate(hits.spans, 0L, (t, s) -> t + s.end - s.start)").alias("n"), F.col("hits.items").alias("items")).orderBy("doc_id").collect()  # the rows have no order of their own
        for r in found[:8]:
            assert (r["n_words"], r["n"], len(r["items"])) == wanted[r["doc_id"]][:3]
        assert found[8]["n"] == 20 and found[8]["items"] == []
    kept = {r["doc_id"] for r in decontamination.decontaminate(frame, bench).collect()}
    assert kept == {k for k in range(8) if not wanted[k][4]}
    cut = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(frame, bench).collect()}
    assert cut[2] in ("a , now", "a  now") and cut[7] == texts[7] and cut[0] is None and cut[3] == ""
    assert decontamination.find_hits(spark.createDataFrame([], DOCS), bench).collect() == []
    assert decontamination.decontaminate(frame, spark.createDataFrame([], "item_id long, text string")).count() == len(docs)


def test_secret_spans(spark):
    key = "AKIA" + "Z9" * 8
    token = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(44))
    texts = [None, "", f"Password: hunter2hunter2 and {key}.", 'api_key="short" secret=token:abcdefghij', "é " + "0a" * 16 + " " + "0" * 31, prose(200) + " " + token + " " + prose(50), "z" * 400, prose(300), "secret=" + key]
    found = secret_scan.find_secrets(spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], DOCS))
    digest = found.select("doc_id", F.sha2(secret_scan._joined("base"), 256).alias("base"), secret_scan._joined("spans").alias("spans")).collect()
    for r in digest:
        assert r["base"] == secret_scan.base_digest(texts[r["doc_id"]])
    spans = {r["doc_id"]: r["spans"] for r in digest}
    at = texts[5].index(token)
    assert spans[5] == f"random:{at}:{at + 44}" and spans[6] == spans[7] == spans[0] == ""
    assert spans[8].split(",") == ["assign:0:27", "access:7:27"]
    redacted = {r["doc_id"]: r["text"] for r in secret_scan.redact_secrets(spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], DOCS)).collect()}
    assert redacted[2] == "<assign> and <access>." and token not in redacted[5] and redacted[0] is None and redacted[7] == texts[7]


def test_random_tokens_are_told_from_written_ones():
    text = prose(400)
    hits = sum(bool(secret_scan.random_spans(f"{text} {''.join(rng.choice('abcdefghijklmnopqrstuvwxyz0123456789') for _ in range(32))} {text}")) for _ in range(100))
    words = sum(bool(secret_scan.random_spans(f"{text} {''.join(rng.choice(['ing', 'ber', 'lich', 'keit', 'er', 'the', 'tion']) for _ in range(9))} {text}")) for _ in range(100))
    assert hits >= 90 and words <= 2


def test_toxicity_on_held_out_rows(spark):
    bad = ["grumbo", "zorkel", "flaxer"]
    docs, labels = [], []
    for k in range(900):
        toxic = k % 6 == 0
        junk = k % 7 == 0
        words = prose(rng.randrange(20, 80)).split() + ([rng.choice(bad) + rng.choice(["", "s", "ing"]) for _ in range(3)] if toxic else []) + (["qqq"] * 4 if junk else [])
        rng.shuffle(words)
        docs.append((k, " ".join(words), "x", 1))
        if k < 600:
            labels.append((k, 0 if junk else 1, int(toxic) if rng.random() > 0.03 else 1 - int(toxic)))
    docs += [(2000, None, "x", 1), (2001, "", "x", 1), (2001, "", "x", 1)]
    labels += [(None, 1, 1), (1, 1, None), (5000, 1, 1)]
    frame, given = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit(frame, given, max_rows=500)
    scored = toxicity.score(frame, chain).collect()
    assert len(scored) == len(docs) and all(0 <= r["p_toxic"] <= 1 for r in scored)
    wrong = [r["doc_id"] for r in scored if 600 <= r["doc_id"] < 900 and (r["p_toxic"] >= chain.links[-1].threshold) != (r["doc_id"] % 6 == 0)]
    assert len(wrong) <= 6
    kept = toxicity.reject_toxic(frame, given)
    assert kept.columns == frame.columns and {2000, 2001} <= {r["doc_id"] for r in kept.collect()}
    none = toxicity.fit(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(frame, none).where("p_toxic > 0.5").count() == 0
    assert toxicity.score(spark.createDataFrame([], DOCS), chain).count() == 0


def test_url_rules_and_trees(spark):
    urls = [None, "no scheme", "https://A.Com/en/1?x#y", "http://example.com/en/75", "http://notexample.com/en/75", "https://x.net/de/", "https://example.net/de/81", "ftp://org/es/", "https://x.org", "http://q.com?/en/"]
    many = [f"https://h{k % 9}.{'com' if k % 2 else 'net'}/{'en' if k % 2 else 'de'}/{k}" for k in range(300)]
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(urls + many)], "page_id long, url string")
    found = {r["page_id"]: r for r in url_filter.filter_urls(frame).collect()}
    assert len(found) == 310 and all(r["verdict"] in ("allow", "block") for r in found.values())
    assert [(found[k]["host"], found[k]["path"], found[k]["rule"]) for k in range(10)] == [
        ("", "", None), ("", "", None), ("a.com", "/en/1", "com/en/"), ("example.com", "/en/75", "example.com/en/7"), ("notexample.com", "/en/75", "com/en/"),
        ("x.net", "/de/", "net/de/"), ("example.net", "/de/81", "example.net/de/8"), ("org", "/es/", "org/es/"), ("x.org", "", None), ("q.com", "", None),
    ]
    assert found[3]["verdict"] == "allow" and found[4]["verdict"] == "block" and found[6]["verdict"] == "block"
    labelled = spark.createDataFrame([(f"http://spam-{k}.win/{'9' * (k % 20 + 5)}", "block") for k in range(200)] + [(f"https://site{k}.org/page/{'a' * (k % 9)}", "allow") for k in range(200)] + [(None, "block"), ("x", None)], "url string, verdict string")
    held = spark.createDataFrame([(k, f"http://spam-z{k}.win/{'8' * 12}") for k in range(50)] + [(k, f"https://other{k}.org/text/abc") for k in range(50, 100)], "page_id long, url string")
    right = url_filter.filter_urls(held, labelled=labelled, rules=()).where("(verdict = 'block') = (page_id < 50)").count()
    assert right >= 95
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
    # copies of one URL do not take the places of others in the bounded sample
    first = labelled.where("url is not null and verdict is not null").orderBy(F.xxhash64("url")).first()
    hot = labelled.union(spark.createDataFrame([tuple(first)] * 5_000, labelled.schema))
    for rows in (labelled, hot):
        model = url_filter.UrlModel(rows, max_rows=300)
        assert model.trees is not None
        host, path = url_filter.host_and_path(F.col("url"))
        judged = model.judge(held.select("page_id", "url", host.alias("host"), path.alias("path")))
        assert judged.where("(judged = 'block') = (page_id < 50)").count() >= 95


def test_chat_collapse(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (4, 2, "user", "c"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 1, "assistant", "b")]
    turns += [(5, 0, None, "a"), (6, 0, "user", None), (7, 0, "user", "x <|im_end|> y"), (None, 0, "user", "z"), (8, None, "user", "q")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    found = {r["conv_id"]: r for r in chat_format.collapse(frame).collect()}
    assert set(found) == {2, 5, 6, 7, 8, None} and (found[2]["n_turns"], found[2]["n_copies"]) == (3, 2)
    assert found[2]["chat"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert found[7]["chat"].count("<|im_end|>") == 1 and found[5]["chat"].startswith("<|im_start|>unknown\na")
    assert chat_format.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><nav><ul><li><a href="/a">menu</a></ul></nav>
<!-- note --><div class="ad">buy</div><aside>side</aside><article><header><h1>Head &amp; line</h1></header><p><b>First  <i>part</i>.<br><p>Second&nbsp;&#233;<form>fill</form><div class="reader comments"><p>me too</p></div>
<p>Last</article><footer>&copy; f</footer></body></html>"""


def test_html_structure():
    text = lambda html: html_extract.main_text(html_extract.lines(html), None)
    assert text(PAGE) == "Head & line\nFirst part.\nSecond é\nLast"
    assert text("") == text("<html></html>") == "" and text("plain &lt; text") == "plain < text"
    assert text("<article><p>cut &am") == "cut &am" and text("<article>a<p") == "a" and text('<article>a<a href="x') == "a"
    assert text("<main>m</main><p>x") == "m" and text("<script>x") == "" and text("<p hidden>x</p>y") == "y"
    assert html_extract.shared_lines(list("abcab"), list("xaxbca")) in ({0, 1, 2, 3}, {0, 1, 2, 3})


def test_html_differencing(spark):
    page = lambda own: f"<body><div>Site name</div><p>{own}</p><div>All rights</div></body>"
    rows = [(k, f"http://h.org/{k:03d}", page(f"text {k}")) for k in range(20)] + [(50, "http://lone.org/", page("lone")), (51, None, None), (52, "http://h.org/005", ""), (53, "http://a.org/x", PAGE), (53, "http://a.org/x", PAGE)]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    text = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert [text[k] for k in range(20)] == [f"text {k}" for k in range(20)] and text[50] == "Site name\nlone\nAll rights" and text[51] == text[52] == ""
    assert text[53].startswith("Head & line") and html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_longest_common_subsequence():
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        places = html_extract.shared_lines(a, b)
        assert len(places) == brute_lcs(a, b) == brute_lcs([a[k] for k in sorted(places)], b)
