"""Differencing pairs each page with the nearest of its host that differs, whatever the partitions."""
import random

import pytest

from fusewright.llm import html_extract

FIELDS = "page_id long, url string, html string"


def page(own):
    return f"<body><div>Site name</div><p>{own}</p><div>All rights</div></body>"


def brute(rows):
    """The definition, over lists."""
    hosts = {}
    for i, url, html in rows:
        host, _, path = (url or "").partition("://")[2].partition("/")
        found = html_extract.lines(html or "")
        hosts.setdefault(host, []).append((path, i, found))
    out = {}
    for pages in hosts.values():
        pages.sort(key=lambda p: p[:2])
        for k, (_, i, own) in enumerate(pages):
            near = [p[2] for p in pages[:k][::-1] + pages[k + 1 :]]
            out[i] = html_extract.main_text(own, next((x for x in near if x != own and any(kind == html_extract.OPEN for _, kind in x)), None))
    return out


def rows():
    rng = random.Random(9)
    out = []
    for h, n in enumerate((1, 2, 60, 200, 3)):
        for k in range(n):
            html = rng.choice([page(f"text {h} {k}"), page(f"text {h} {k}"), page("copied text"), "", None, f"<div>Site name</div><article>a {k}</article>", "<article>b</article>"])
            out.append((len(out), f"http://h{h}.org/{k // 2:04d}", html))
    out += [(len(out) + k, "http://copies.org/x", page("the same")) for k in range(300)]
    return [*out, (len(out) + 300, "http://copies.org/z", page("another"))]


@pytest.mark.parametrize("n", [1, 4, 13, 64])
def test_neighbours_do_not_depend_on_partitions(spark, n):
    given = rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        found = html_extract.extract(spark.createDataFrame(given, FIELDS).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    text = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(given) and text == brute(given)
    assert all(text[i] == "the same" for i, url, _ in given if url == "http://copies.org/x")
