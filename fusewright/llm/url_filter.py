"""URL filters: rules first, then gradient-boosted trees on lexical features. DataFrame functions and Spark ML only.

Rules name a host and the start of a path; the longest rule that fits decides. The URLs that the rules decide are the labelled ones:
the trees learn from them what such URLs look like and judge the rest. Training takes at most ``max_rows`` labelled URLs, chosen by a
hash of the URL. Their first half (by another hash) gives the suffix statistics, the second half trains the trees, so that a URL's own
label is not among its features. The statistics have a row per suffix of those labelled rows at most, which bounds their broadcast.
"""
from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusewright.llm._shared import cut, table

MAX_ROWS = 20_000
#: (verdict, host and path), the contract's.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
FEATURES = ("n_chars", "n_host", "n_path", "depth", "labels", "digits", "letters", "entropy", "params", "n_query", "hyphens", "fragment", "secure", "suffix_seen", "suffix_rate", "lead_seen", "lead_rate")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(longest rule that fits, its verdict), null where none does. Of equal rules the first listed counts."""
    found, verdict = [], []
    for what, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.lit(rule)))
        verdict.append(F.when(fits, F.lit(what)))
    if not found:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return F.coalesce(*found), F.coalesce(*verdict)


def _lexical(frame: DataFrame) -> DataFrame:
    """Adds the features that come from the URL alone. Needs url, host, path."""
    u = F.coalesce("url", F.lit(""))
    n = F.length(u)
    count = lambda text, chars: F.length(text) - F.length(F.translate(text, chars, ""))
    share = lambda chars: F.when(n > 0, count(u, chars) / n).otherwise(0.0)
    chars = F.array_distinct(F.split(u, ""))
    of = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda t, c: t - of(c) * F.log2(of(c)))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return frame.withColumns({
        "n_chars": n.cast("double"),
        "n_host": F.length("host").cast("double"),
        "n_path": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/").cast("double"),
        "labels": count(F.col("host"), ".").cast("double"),
        "digits": share(string.digits),
        "letters": share(string.ascii_letters),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "params": count(query, "=").cast("double"),
        "n_query": F.length(query).cast("double"),
        "hyphens": count(F.col("host"), "-").cast("double"),
        "fragment": F.contains(u, F.lit("#")).cast("double"),
        "secure": F.startswith(F.lower(u), F.lit("https://")).cast("double"),
        "suffix": F.substring_index("host", ".", -1),
        "lead": F.regexp_extract("path", r"^/([^/]*)", 1),
    })


def _with_statistics(frame: DataFrame, suffixes: DataFrame, leads: DataFrame) -> DataFrame:
    frame = frame.join(F.broadcast(suffixes), "suffix", "left").join(F.broadcast(leads), "lead", "left")
    return frame.fillna({"suffix_seen": 0.0, "suffix_rate": 0.5, "lead_seen": 0.0, "lead_rate": 0.5})


def _statistics(rows: DataFrame, key: str) -> DataFrame:
    """Per value of ``key``: how often it was seen (logarithm) and the smoothed share of blocked URLs."""
    return rows.groupBy(key).agg(F.log1p(F.count("*").cast("double")).alias(f"{key}_seen"), ((F.sum("target") + 1) / (F.count("*") + 2)).alias(f"{key}_rate"))


class UrlModel:
    """Statistics and trees; ``judge`` adds the verdict of the trees. Without labelled URLs of both kinds there are no trees."""

    def __init__(self, labelled: DataFrame, max_rows: int = MAX_ROWS, trees: int = 20, depth: int = 4):
        """``labelled`` has url and verdict (allow or block); rows with a null in either are left out.

        A URL counts once per verdict, however often it comes, so that the ``max_rows`` rows with the smallest hashes are as many URLs.
        """
        host, path = host_and_path(F.col("url"))
        rows = labelled.select("url", (F.col("verdict") == "block").cast("double").alias("target")).where("url is not null and target is not null").distinct()
        rows = rows.orderBy(F.xxhash64("url"), "url", "target").limit(max_rows).select("url", "target", host.alias("host"), path.alias("path"))
        rows = cut(_lexical(rows).coalesce(4))
        half = F.pmod(F.xxhash64(F.lit("half"), "url"), F.lit(2))
        seen, taught = rows.where(half == 0), rows.where(half == 1)
        self.suffixes, self.leads = cut(_statistics(seen, "suffix")), cut(_statistics(seen, "lead"))
        kinds = {r["target"]: r["count"] for r in taught.groupBy("target").count().collect()}
        self.assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        self.trees = None
        self.usual = "block" if kinds and max(kinds, key=kinds.get) == 1.0 else "allow"
        if len(kinds) == 2:
            data = self.assembler.transform(_with_statistics(taught, self.suffixes, self.leads)).select("features", "target")
            self.trees = GBTClassifier(featuresCol="features", labelCol="target", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).fit(cut(data.select("features", "target")))

    def judge(self, frame: DataFrame) -> DataFrame:
        """``frame`` (url, host, path and more) with a column ``judged``: allow or block."""
        if self.trees is None:
            return frame.withColumn("judged", F.lit(self.usual))
        kept = frame.columns
        scored = self.trees.transform(self.assembler.transform(_with_statistics(_lexical(frame), self.suffixes, self.leads)))
        return scored.select(*kept, F.when(F.col("prediction") == 1.0, "block").otherwise("allow").alias("judged"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled: DataFrame | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per input row: the id, host, path, rule (null where none fits) and verdict (allow or block).

    The rule's verdict holds where a rule fits, else that of the trees, trained on ``labelled`` (url, verdict) or, by default, on the
    URLs of ``pages`` that the rules decide. A null URL, or one without ``://``, has an empty host and path; trees judge it like any
    other. Rows with null or repeated ids stay; an empty table gives an empty result. Only the id and URL columns are read.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    if labelled is None:
        labelled = rows.where("ruled is not null").select("url", F.col("ruled").alias("verdict"))
    judged = UrlModel(labelled, max_rows).judge(rows)
    return judged.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """The contract's rows: filter_urls over all of ``pages``."""
    return filter_urls(table(spark, sf_dir, "pages"))
