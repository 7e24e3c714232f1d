"""Secret scans: fixed patterns, and a battery of randomness tests for tokens of unknown form.

Candidates are runs of encoding characters. Each is given the smallest encoding that it fits (decimal, hex, base32, lower or upper
case letters and digits, base62, base64, base64url) and its characters become numbers of that alphabet. Three statistics measure how
they differ from independent uniform draws:

* chi-squared over the alphabet, as a z-score (Wilson-Hilferty);
* Wald-Wolfowitz runs above and below the middle of the alphabet;
* the lag-one serial correlation of the numbers.

A token is taken for random if none of the three rejects uniform draws. That alone would flag many short words, as short samples reject
little. So each candidate also gets a p-value under a null of written text: characters drawn with the frequencies of letters in the
candidate's own text (digits and case get what the text has) and in a fixed sample of natural language, which decides where the text has
few ASCII letters or none but candidates. Under it the chi-squared statistic has the mean and variance that are worked out for the
candidate's length. Where letters and digits alternate, as they hardly do in words, names and numbers, so has the characters' mean
log-frequency, and the smaller of the two p-values counts twice. False discoveries are controlled over each text's candidates by the Benjamini-Hochberg step-up with weights in proportion to length (and a mean of one): long
tokens, which the tests can judge, get most of the error budget, and it is this control that decides how short a token can be found.

A candidate has ``shortest`` characters, or ``mixed`` with letters and digits that alternate. Both are parameters, so that with lower ones the
control alone decides; by default they leave out what it hardly ever accepts, which would only cost time. Where the characters without ``- _`` are hex digits (as those of a UUID), they are judged as such.
"""
from __future__ import annotations

import functools
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusewright.llm._shared import prepare, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run; as a run has to have 32 characters, shorter ones need not be found to be dropped.
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

SHORTEST = 20
MIXED = 12
SEPARATORS = "+/_-"
CUTS = (re.compile(r"[+/]"), re.compile(r"[_-]"), re.compile(r"[+/_-]"))
#: Letters and digits alternate if one follows the other so often, separators aside.
SWITCHES = 3
_SWITCH = re.compile(r"[A-Za-z][+/_-]*(?=[0-9])|[0-9][+/_-]*(?=[A-Za-z])")
#: Alphabets in the order in which they are tried.
ENCODINGS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Letters of natural language in 1,000 characters (English; other languages in Latin script differ less from it than from uniform draws).
LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 2, 2, 1, 1), strict=True))
#: The sample counts as 100 characters: enough for a text that says nothing, little beside a page of text of another kind.
PRIOR = 0.1 * np.array([LETTERS.get(c) or LETTERS.get(c.lower(), 0) * 0.03 or 0.2 for c in map(chr, range(128))])
ALPHA_RANDOM = 0.005
FALSE_DISCOVERY_RATE = 0.01


@functools.cache
def candidates(shortest: int, mixed: int) -> re.Pattern:
    """Runs of encoding characters of at least ``shortest``, or of ``mixed`` with a letter and a digit."""
    long = f"[A-Za-z0-9+/_-]{{{shortest},}}={{0,2}}"
    if mixed >= shortest:
        return re.compile(long)
    return re.compile(rf"{long}|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{{{mixed},{shortest - 1}}}(?![A-Za-z0-9+/_-])={{0,2}}")


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _fitting(body: str) -> tuple[str, np.ndarray, int] | None:
    chars = set(body)
    for name, alphabet in ENCODINGS:
        if chars <= set(alphabet):
            at = {c: k for k, c in enumerate(alphabet)}
            return name, np.fromiter((at[c] for c in body), dtype=np.int64, count=len(body)), len(alphabet)
    return None


def infer_encoding(token: str) -> tuple[str, np.ndarray, int] | None:
    """(name, numbers, alphabet size) of the first encoding that holds all characters; padding is left out.

    If the characters without ``- _`` are hex digits (as those of a UUID), they are taken instead.
    """
    found = _fitting(token.rstrip("="))
    if found and found[0] == "base64url":
        bare = _fitting(token.rstrip("=").replace("-", "").replace("_", ""))
        if bare and bare[2] <= 16 and len(bare[1]) >= MIXED:
            return bare
    return found


def chi_squared(x: np.ndarray, k: int) -> tuple[float, float]:
    """(statistic, p-value of a greater one under uniform draws)."""
    n = len(x)
    counts = np.bincount(x, minlength=k)
    stat = float((counts * counts).sum()) * k / n - n
    df = k - 1
    z = ((stat / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return stat, _upper_tail(z)


def runs(x: np.ndarray, k: int) -> float:
    """Two-sided p-value of the number of runs above and below the middle."""
    high = x >= k / 2
    a = int(high.sum())
    b = len(x) - a
    if not a or not b:
        return 2.0 ** (1 - len(x))
    n = a + b
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    if var <= 0:
        return 1.0
    return 2 * _upper_tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var))


def serial(x: np.ndarray, k: int) -> float:
    """Two-sided p-value of the lag-one correlation under uniform draws."""
    y = x - (k - 1) / 2
    var = (k * k - 1) / 12
    return 2 * _upper_tail(abs(float((y[1:] * y[:-1]).sum())) / (var * math.sqrt(len(y) - 1)))


def _written(text: str) -> np.ndarray:
    """Frequencies of the ASCII characters in the text and the fixed sample, with a little of every character."""
    raw = np.frombuffer(text.encode("ascii", "ignore"), dtype=np.uint8)
    return np.bincount(raw, minlength=128).astype(np.float64)[:128] + PRIOR


def natural_p(stat: float, x: np.ndarray, alphabet: str, written: np.ndarray, mixed: bool) -> float:
    """Chance of a chi-squared statistic this small, or with ``mixed`` of characters this rare, when they are drawn as the text's are."""
    k, n = len(alphabet), len(x)
    p = written[np.frombuffer(alphabet.encode(), dtype=np.uint8)]
    p = p / p.sum()
    s2, s3 = float((p**2).sum()), float((p**3).sum())
    # the statistic is k / n * (sum of squared counts) - n
    mean = k / n * (n + n * (n - 1) * s2) - n
    var = (k / n) ** 2 * (2 * n * (n - 1) * (s2 + (2 * n - 4) * s3 - (2 * n - 3) * s2 * s2))
    even = _upper_tail((mean - stat) / math.sqrt(var)) if var > 0 else 1.0
    if not mixed:
        return even
    logs = np.log(p)
    usual = float((p * logs).sum())
    spread = float((p * logs * logs).sum()) - usual * usual
    rare = _upper_tail((usual - float(logs[x].mean())) * math.sqrt(n / spread)) if spread > 1e-12 else 1.0
    return min(1.0, 2 * min(even, rare))


def alternates(token: str) -> bool:
    """Whether letters and digits alternate."""
    return sum(1 for _ in _SWITCH.finditer(token)) >= SWITCHES


def _long_enough(token: str, shortest: int, mixed: int) -> bool:
    n = len(token.rstrip("="))
    return n >= shortest or (n >= mixed and alternates(token))


def _pieces(text: str, base: list[tuple[str, int, int]], shortest: int, mixed: int):
    """(start, end) of what is judged: runs outside base spans, whole and cut at either kind of separator or at both.

    No encoding holds both ``+ /`` and ``- _``, and either may join a token to a path or to words, so a run that holds separators is
    also judged by its parts. At a base span the separators that join it to the rest are left out.
    """
    fixed, at = sorted((s, e) for _, s, e in base), 0
    for m in candidates(shortest, mixed).finditer(text):
        start, end = m.span()
        while at < len(fixed) and fixed[at][1] <= start:
            at += 1
        rests, k = [], at
        while k < len(fixed) and fixed[k][0] < end:
            rests.append((start, fixed[k][0]))
            start = max(start, fixed[k][1])
            k += 1
        for a, b in [*rests, (start, end)]:
            while a > m.start() and a < b and text[a] in SEPARATORS:
                a += 1
            while b < m.end() and a < b and text[b - 1] in SEPARATORS:
                b -= 1
            if b - a < min(shortest, mixed):
                continue
            found = {(a, b)}
            for separator in CUTS:
                if separator.search(text, a, b):
                    cuts = [(a, a), *(c.span() for c in separator.finditer(text, a, b)), (b, b)]
                    found.update((x, y) for (_, x), (y, _) in zip(cuts, cuts[1:], strict=False))
            yield from sorted((x, y) for x, y in found if _long_enough(text[x:y], shortest, mixed))


def step_up(judged: list[tuple[float, int]], rate: float = FALSE_DISCOVERY_RATE) -> list[int]:
    """Which of the (p-value, length) are found at the false-discovery rate, with weights in proportion to length and a mean of one."""
    weight = len(judged) / max(1, sum(n for _, n in judged))
    ranked = sorted((p / (n * weight), k) for k, (p, n) in enumerate(judged))
    best = max((r for r, (q, _) in enumerate(ranked, 1) if q <= rate * r / len(judged)), default=0)
    return [k for _, k in ranked[:best]]


def random_spans(text: str, base: list[tuple[str, int, int]] = (), shortest: int = SHORTEST, mixed: int = MIXED) -> list[tuple[int, int]]:
    """Spans outside ``base`` that pass the battery and the length-aware false-discovery control; those that overlap are one."""
    found = []
    written = None
    for start, end in _pieces(text, base, shortest, mixed):
        inferred = infer_encoding(text[start:end])
        if inferred is None:
            continue
        name, x, k = inferred
        n = len(x)
        stat, uniform = chi_squared(x, k)
        if min(uniform, runs(x, k), serial(x, k)) < ALPHA_RANDOM or len(set(x.tolist())) < min(k, n) / 3:
            p = 1.0
        else:
            if written is None:
                written = _written(candidates(shortest, mixed).sub(" ", text))
            p = natural_p(stat, x, dict(ENCODINGS)[name], written, alternates(text[start:end]))
        found.append((p, n, start, end))
    chosen = step_up([(p, n) for p, n, _, _ in found])
    out: list[tuple[int, int]] = []
    for a, b in sorted(found[k][2:] for k in chosen):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _order(span):
    return span[1], KINDS.index(span[0]), span[2]


def all_spans(text: str, shortest: int = SHORTEST, mixed: int = MIXED) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), by start and then kind. The method judges what the base spans leave."""
    base = sorted(base_spans(text), key=_order)
    more = [("random", a, b) for a, b in random_spans(text, base, shortest, mixed)]
    return base, sorted([*base, *more], key=_order)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _find(shortest: int, mixed: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [all_spans(x or "", shortest, mixed) for x in part.column("text").to_pylist()]
                rows = [[[{"kind": k, "start": a, "end": b} for k, a, b in side] for side in f] for f in found]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([r[0] for r in rows], _SPANS), pa.array([r[1] for r in rows], _SPANS)], names=["id", "base", "spans"])

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, mixed: int = MIXED) -> DataFrame:
    """One row per input row: the id, ``base`` (spans of the fixed patterns) and ``spans`` (those and the method's).

    A span has a kind (assign, access, hex, random), start and end, in code points, end exclusive. Whole texts of any length are scanned, in
    time that grows with their length. A null text is empty and has none. Rows with null or repeated ids stay; an empty table gives an
    empty result. Only the id and text columns are read, so others may have any name.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return source.mapInArrow(_find(shortest, mixed), f"id {kind}, base {spans}, spans {spans}").withColumnRenamed("id", id_col)


def redact(text: str | None, shortest: int = SHORTEST, mixed: int = MIXED) -> str | None:
    """The text with each secret replaced by its kind in angle brackets; overlapping spans are replaced as one."""
    if not text:
        return text
    out, at = [], 0
    spans = all_spans(text, shortest, mixed)[1]
    if not spans:
        return text
    joined: list[list] = []
    for kind, a, b in spans:
        if joined and a < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], b)
        else:
            joined.append([kind, a, b])
    for kind, a, b in joined:
        out.append(text[at:a] + f"<{kind}>")
        at = b
    return "".join([*out, text[at:]])


def _redacted(text_col: str, shortest: int, mixed: int):
    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [redact(x, shortest, mixed) for x in part.column(place).to_pylist()]
                yield part.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return run


def redact_secrets(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST, mixed: int = MIXED) -> DataFrame:
    """``docs`` with the secrets of its texts redacted; every row and column stays, null stays null, an empty table empty."""
    prepare(docs.sparkSession)
    return docs.mapInArrow(_redacted(text_col, shortest, mixed), T.StructType(docs.schema.fields))


def _joined(column: str):
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    return F.array_join(F.transform(column, one), ",")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of find_secrets over all of ``documents``."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def base_digest(text: str | None) -> str:
    """The base digest by plain Python and the patterns as the contract words them, for tests."""
    text = text or ""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    spans += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))).encode()).hexdigest()
