"""Random tokens in texts with few ASCII letters or none of their own, and inside longer runs."""
import itertools
import math
import random

import numpy as np
import pytest

from fusewright.llm import secret_scan

BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
TEXTS = {"cyrillic": "Быстрая коричневая лиса прыгает через ленивую собаку. " * 20, "cjk": "这是一个关于数据处理的长文本，其中没有任何拉丁字母。" * 30, "nothing": "", "short": "The key for the server is here: "}
PARTS = ["ing", "ber", "lich", "keit", "er", "the", "tion", "Data", "Value", "Stream", "request", "config"]


@pytest.mark.parametrize("name", TEXTS)
def test_random_tokens_where_the_text_says_little(name):
    rng, text = random.Random(5), TEXTS[name]
    token = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    found = lambda x: bool(secret_scan.random_spans(f"{text} {x} {text}"))
    assert sum(found(token(BASE62, 44)) for _ in range(100)) >= 90
    assert sum(found(token("0123456789abcdef", 31)) for _ in range(100)) >= 90
    assert sum(found("_".join(rng.choice(PARTS) for _ in range(8))) for _ in range(100)) <= 2
    assert sum(found("".join(rng.choice(PARTS) for _ in range(8))) for _ in range(100)) <= 2


def test_a_text_of_many_keys():
    rng = random.Random(6)
    keys = ["".join(rng.choice(BASE62) for _ in range(44)) for _ in range(50)]
    assert len(secret_scan.random_spans("\n".join(keys))) >= 45


@pytest.mark.parametrize("before", ["/some-page/", "well-known/word-", "https://h.org/a-b/c_d/", "AKIA" + "Z9" * 8 + "/", "AKIA" + "Z9" * 8 + "-"])
def test_tokens_joined_to_other_runs(before):
    rng = random.Random(7)
    text = "The committee met on Tuesday to discuss the new plan for the harbour and the roads around it. " * 5
    covered = 0
    for _ in range(50):
        token = "".join(rng.choice(BASE62) for _ in range(44))
        whole = f"{text}{before}{token} {text}"
        at = whole.index(token)
        redacted = secret_scan.redact(whole)
        assert not before.startswith("AKIA") or "<access>" in redacted
        covered += any(k == "random" and a <= at and at + 44 <= b for k, a, b in secret_scan.all_spans(whole)[1]) and token not in redacted
    assert covered >= 45


def test_spans_outside_base_spans():
    key = "AKIA" + "Z9" * 8
    for text in (key, f"/{key}/", f"{key}/{key}", f"{key}-some-long-page-name-of-words", "=" * 30, "-" * 40, "a/b-c_d+" * 9):
        base, spans = secret_scan.all_spans(text)
        assert spans == base


@pytest.mark.parametrize(("alphabet", "n"), [("ab", 7), ("abc", 5), ("abcd", 4)])
def test_the_null_against_all_strings(alphabet, n):
    """Mean and variance of the statistic, and of the mean log-frequency, by going through every string."""
    written = secret_scan._written("a" * 30 + "b" * 11 + "c" * 5 + "d")
    p = np.array([written[ord(c)] for c in alphabet])
    p = p / p.sum()
    strings = np.array(list(itertools.product(range(len(alphabet)), repeat=n)))
    chance = p[strings].prod(axis=1)
    stats = np.array([secret_scan.chi_squared(x, len(alphabet))[0] for x in strings])
    mean = (chance * stats).sum()
    sd = np.sqrt((chance * (stats - mean) ** 2).sum())
    logs = np.log(p)[strings].mean(axis=1)
    usual = (chance * logs).sum()
    wide = np.sqrt((chance * (logs - usual) ** 2).sum())
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    for x, stat, log in list(zip(strings, stats, logs, strict=True))[:: max(1, len(strings) // 40)]:
        even, rare = tail((mean - stat) / sd), tail((usual - log) / wide)
        assert secret_scan.natural_p(stat, x, alphabet, written, False) == pytest.approx(even, rel=1e-6, abs=1e-12)
        assert secret_scan.natural_p(stat, x, alphabet, written, True) == pytest.approx(min(1.0, 2 * min(even, rare)), rel=1e-6, abs=1e-12)


def test_the_step_up_against_a_plain_one():
    rng = random.Random(8)
    for _ in range(300):
        judged = [(rng.choice([1.0, rng.random(), rng.random() ** 8, 1e-9]), rng.randrange(12, 80)) for _ in range(rng.randrange(9))]
        mean = sum(n for _, n in judged) / max(1, len(judged))
        # the largest number of discoveries such that each of them stays under its share of the rate
        wanted: set[int] = set()
        for r in range(1, len(judged) + 1):
            under = {k for k, (p, n) in enumerate(judged) if p * mean / n <= secret_scan.FALSE_DISCOVERY_RATE * r / len(judged)}
            if len(under) >= r:
                wanted = under
        assert set(secret_scan.step_up(judged)) == wanted


def test_floors_are_parameters(spark):
    rng = random.Random(9)
    text = "The committee met on Tuesday to discuss the new plan for the harbour and the roads around it. " * 5
    tokens = ["".join(rng.choice(BASE62) for _ in range(18)) for _ in range(60)]
    rate = lambda **floors: sum(bool(secret_scan.random_spans(f"{text} {t} {text}", **floors)) for t in tokens)
    assert rate(shortest=40, mixed=40) == 0 < rate() <= rate(shortest=10, mixed=10)
    docs = spark.createDataFrame([(k, f"{text} {t} {text}") for k, t in enumerate(tokens)], "doc_id int, text string")
    spans = secret_scan.find_secrets(docs, shortest=10, mixed=10).selectExpr("sum(size(spans))").first()[0]
    assert spans >= rate(shortest=10, mixed=10)
    assert secret_scan.redact_secrets(docs, shortest=40, mixed=40).where("text LIKE '%<random>%'").count() == 0
