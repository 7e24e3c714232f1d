"""HTML extraction: nearest-URL page differencing, with page structure as its guard.

A page's text lines (blocks) are of four kinds: prose of an article or main element (paragraphs, headings, list items, cells and text that
stands in it directly); loose lines of an article, which only containers hold; open lines, outside any article; and dropped ones: menus,
headers, footers, sidebars, notices, adverts, forms, reader comments and the like, by element, role or exact class name. A page with an
article offers its prose and loose lines as main text, another page its open lines.

Pages are sorted by host and URL path. Each is paired with the nearest one before it in its host whose lines differ from its own (if there
is none, with the nearest one after it), all lines of the two that are not dropped are aligned by a longest common subsequence, and the
shared lines are deleted, save prose of articles. Copies are so never paired with one another, nor is a page paired with one that has no
lines but prose (or none at all), which shows nothing of the site's frame.

Prose is not deleted when a neighbour shares it: neighbours that quote or copy one another share much of their articles, and deleting
that loses text that belongs to the page (see the README for the count on the test tables).

Every page is parsed once. Pages whose main text is prose only are not moved. Of the others one range shuffle by host, path and id brings neighbours
together, whatever the size of a host; of pages that only serve as neighbours it moves hashes of their lines. The first two and last two
pages that differ, of each partition's first and last host, go to the driver as hashes of lines, and from there over the borders, so
results do not depend on the partitions.
"""
from __future__ import annotations

import hashlib
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.llm._shared import checkpointed, cut, prepare, table
from fusewright.llm.url_filter import host_and_path

_MARKUP = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*>|</?\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)

#: Fixed lists of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("head nav menu footer aside form dialog button select search object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "footer comment comments disqus share sharing social related recommended popup modal overlay widget widgets toolbar skip".split()
)

#: Elements that hold prose, and those that may hold boilerplate inside an article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption summary address legend".split())
CONTAINERS = frozenset("div section ul ol dl table details figure fieldset center".split())
#: An open element of the left kind ends where one of the right kinds begins.
ENDED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}

OPEN, MAIN, DROPPED, LOOSE = 0, 1, 2, 3


def attributes_of(text: str) -> dict[str, str]:
    """Names (in lower case) and values; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), a or b or c)
    return out


#: Elements that hold a paragraph or heading.
TEXTS = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd blockquote pre".split())
#: Whole names that are boilerplate where parts of names do not count.
JOINED = frozenset(
    "cookie-notice cookie-banner cookie-consent ad-slot ad-box ad-banner ad-container advert-box share-bar share-buttons social-share social-links "
    "related-posts related-articles comment-list comments-list comment-form newsletter-signup".split()
)
#: Of NAMES those that may as well say what an article is about: they count as the whole of a class or id only.
AMBIGUOUS = frozenset("banner menu menus navigation notice notices promotion recommended related share sharing skip social subscription".split())


def _boilerplate(tag: str, given: dict[str, str], inside: int) -> bool:
    """Whether the class or id of an element names boilerplate.

    In an article only whole names count, on containers, paragraphs and headings alike: ``social science``, ``promotion-history`` and
    ``ad-spend`` may well be what it is about. Elsewhere any part of any name counts.
    """
    if inside == MAIN:
        if tag not in CONTAINERS and tag not in TEXTS:
            return False
        whole = [given.get(k, "").lower().split() for k in ("class", "id")]
        return any(names and set(names) <= NAMES for names in whole) or any(name in JOINED or (name in NAMES and name not in AMBIGUOUS) for names in whole for name in names)
    words = {part for k in ("class", "id") for name in given.get(k, "").lower().split() for part in (name, *re.split(r"[_-]+", name))}
    return bool(words & NAMES) or "header" in words


def _region(tag: str, attributes: str, inside: int) -> int:
    """The kind of lines inside an element: dropped, main or open."""
    if inside == DROPPED or tag in BOILERPLATE or (tag == "header" and inside != MAIN):
        return DROPPED
    main = tag in ("article", "main")
    if attributes.strip(" /"):
        given = attributes_of(attributes)
        role = given.get("role", "").lower()
        if role in ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(given.get("style", "")):
            return DROPPED
        main = main or role in ("main", "article") or given.get("itemprop", "").lower() == "articlebody"
        if tag not in ("html", "body", "article", "main") and _boilerplate(tag, given, inside):
            return DROPPED
    return MAIN if main else inside


def lines(html: str) -> list[tuple[str, int]]:
    """The page's text blocks in order with their kinds; white space is one space, character references are decoded."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = []  # element, kind around it, level of containers around it
    opened: Counter = Counter()
    kind, at, n = OPEN, 0, len(html)
    loose = 0  # inside an article: 0 is text that stands in it, 1 in a container, 2 in prose
    raw_end: dict[str, re.Pattern] = {}

    def close():
        if parts:
            text = "".join(parts)
            parts.clear()
            if kind != DROPPED and (text := " ".join(text.split())):
                out.append((text, LOOSE if kind == MAIN and loose == 1 else kind))

    def leave(k):
        nonlocal kind, loose
        _, before, level = stack[k]
        for tag, _, _ in stack[k:]:
            opened[tag] -= 1
        if before != kind or level != loose:
            close()
        del stack[k:]
        kind, loose = before, level

    while at < n:
        m = _MARKUP.search(html, at)
        end = m.start() if m else n
        if end > at and kind != DROPPED:
            piece = html[at:end]
            parts.append(unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m.group(1), m.group(3)
        if closing:
            if tag in BLOCKS:
                close()
            if opened[tag]:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in RAW:
            pattern = raw_end.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I))
            drawing = tag in ("svg", "math")
            stop = None if drawing and attributes.endswith("/") else pattern.search(html, at)
            if stop:
                at = stop.end()
            elif drawing and not attributes.endswith("/"):
                # one that nothing ends, ends with what it stands in
                stack.append((tag, kind, loose))
                opened[tag] += 1
                if kind != DROPPED:
                    close()
                kind, loose = DROPPED, 0
            elif not drawing:
                at = n
            continue
        if tag in BLOCKS:
            close()
            if stack and tag in ENDED_BY.get(stack[-1][0], ()):
                leave(len(stack) - 1)
        if tag in VOID:
            continue
        inner = _region(tag, attributes, kind)
        if tag in BOILERPLATE or tag in BLOCKS or inner != kind:
            stack.append((tag, kind, loose))
            opened[tag] += 1
            level = loose if loose == 2 else 2 if tag in PROSE else 1 if tag in CONTAINERS else loose
            if inner != kind:
                close()
                level = 0 if inner == MAIN else level
                kind = inner
            loose = level if kind == MAIN else 0
    close()
    return out


BITS = 1 << 28


def _lengths(a: list, b: list) -> list[int]:
    """Length of a longest common subsequence of all of ``a`` with each beginning of ``b``."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    v = every
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & every
    out = [0]
    for j in range(len(b)):
        out.append(out[-1] + (~v >> j & 1))
    return out


def shared_lines(a: list, b: list, bits: int = BITS) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Rows of the table of lengths are bit vectors, so a line that both repeat often costs no more than others. A table of more than
    ``bits`` is cut in two where the lengths of both halves add up to the most, so memory is bounded.
    """
    out: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.add(n)
        if i == n or j == m:
            continue
        if (n - i) * (m - j) > bits and n - i > 1:
            half = (i + n) // 2
            head, tail = _lengths(a[i:half], b[j:m]), _lengths(a[half:n][::-1], b[j:m][::-1])[::-1]
            k = max(range(m - j + 1), key=lambda k: head[k] + tail[k])
            todo += [(i, half, j, j + k), (half, n, j + k, m)]
            continue
        where: dict = {}
        for k in range(j, m):
            where[b[k]] = where.get(b[k], 0) | 1 << (k - j)
        every = (1 << (m - j)) - 1
        v, rows = every, []
        for x in a[i:n]:
            u = v & where.get(x, 0)
            v = (v + u | v - u) & every
            rows.append(v)
        row, col = n - i, m - j
        while row and col:
            if rows[row - 1] >> (col - 1) & 1:
                col -= 1  # the last line of b adds nothing
            else:
                row -= 1
                if not row or rows[row - 1] >> (col - 1) & 1:
                    out.add(i + row)
                    col -= 1
    return out


def differenced(page: list[tuple[str, int]], shared: set[int]) -> str:
    """The main text of a page of which the lines at ``shared`` also stand in its neighbour."""
    article = any(kind in (MAIN, LOOSE) for _, kind in page)
    return "\n".join(x for k, (x, kind) in enumerate(page) if kind == MAIN or (kind == (LOOSE if article else OPEN) and k not in shared))


def main_text(page: list[tuple[str, int]], neighbour: list[tuple[str, int]] | None) -> str:
    """The page's main text, given its lines and those of the page next to it."""
    return differenced(page, shared_lines([x for x, _ in page], [x for x, _ in neighbour]) if neighbour else set())


HASH_BYTES = 16


def _hash(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=HASH_BYTES).digest()


def _split(hashes: bytes) -> list[bytes]:
    return [hashes[k : k + HASH_BYTES] for k in range(0, len(hashes), HASH_BYTES)]


def _needs(page: list[tuple[str, int]]) -> bool:
    """Whether the page's main text depends on its neighbours."""
    kinds = {kind for _, kind in page}
    return LOOSE in kinds or kinds == {OPEN}


def _parts(batch, columns):
    for start in range(0, batch.num_rows, 256):
        part = batch.slice(start, 256)
        yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def _packed(rows, fields):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], names=[name for name, _ in fields])


def _chunks(rows, fields):
    """Record batches of at most 256 rows."""
    now = []
    for r in rows:
        now.append(r)
        if len(now) == 256:
            yield _packed(now, fields)
            now = []
    if now:
        yield _packed(now, fields)


def _texts(kind):
    return [("page_id", kind), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]


def _parsed(kind):
    """Each page parsed once: its text if that needs no neighbour, and if it has other lines than prose the hashes of all lines, a digest
    and, where the text needs a neighbour, the lines."""
    fields = [("page_id", kind), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("text", pa.string()), ("digest", pa.binary()), ("hashes", pa.binary()), ("lines", pa.list_(pa.string())), ("kinds", pa.binary())]

    def run(batches):
        for batch in batches:
            own = [(n, batch.schema.field("page_id").type if n == "page_id" else t) for n, t in fields]

            def rows(batch=batch):
                for i, url, host, path, html in _parts(batch, ("page_id", "url", "host", "path", "html")):
                    page = lines(html or "")
                    needs = _needs(page)
                    text = None if needs else main_text(page, None)
                    if all(kind == MAIN for _, kind in page):
                        yield i, url, None, None, text, None, None, None, None
                        continue
                    hashes, kinds = b"".join(_hash(x) for x, _ in page), bytes(kind for _, kind in page)
                    digest = hashlib.blake2b(kinds + hashes, digest_size=HASH_BYTES).digest()
                    yield i, url, host, path, text, digest, hashes, [x for x, _ in page] if needs else None, kinds

            yield from _chunks(rows(), own)

    return run


def _later(last, page):
    """The state (latest page, latest page before that differs from it) after one more page; pages are (digest, hashes)."""
    one, two = last
    return (page, two) if one is not None and one[0] == page[0] else (page, one)


def _other(state, digest):
    """The hashes of the nearest page of the state that differs."""
    return next((p[1] for p in state if p is not None and p[0] != digest), None)


def _ends(batches):
    """One row a partition: the first and last host, and of each the two pages at that end that differ."""
    first = last = part = None
    head: list = []
    tail = (None, None)
    for batch in batches:
        for part, host, digest, hashes in _parts(batch, ("part", "host", "digest", "hashes")):
            page = (digest, hashes)
            if first is None:
                first = host
            if host == first and len(head) < 2 and all(p[0] != digest for p in head):
                head.append(page)
            tail = _later(tail, page) if host == last else (page, None)
            last = host
    if part is not None:
        row = [part, first, last]
        for p in [*head, None, None][:2] + list(tail):
            row += p or (None, None)
        yield _packed([row], [(n, pa.string() if n in ("first", "last") else pa.int32() if n == "part" else pa.binary()) for n in _END_NAMES])


_END_NAMES = ("part", "first", "last", "d0", "h0", "d1", "h1", "d2", "h2", "d3", "h3")


def _carried(ends):
    """Per partition what its neighbours hand over: (host, pages) from before and from after."""

    def walk(rows, side):
        out, host, state = {}, None, (None, None)
        for r in rows:
            out[r["part"]] = (host, state)
            pages = [None if r[f"d{k}"] is None else (bytes(r[f"d{k}"]), bytes(r[f"h{k}"])) for k in range(4)]
            near, far = (r["last"], r["first"]) if side else (r["first"], r["last"])
            one, two = pages[2:] if side else pages[:2]
            if two is None and near == far == host:
                # all of the partition is copies of one page of the host
                two = next((p for p in state if p is not None and p[0] != one[0]), None)
            host, state = near, (one, two)
        return out

    ends = sorted(ends, key=lambda r: r["part"])
    before, after = walk(ends, True), walk(ends[::-1], False)
    return {part: (before[part], after[part]) for part in before}


def _differenced(carried):
    def run(batches):
        """Pages in order of host and path, each paired with the nearest of its host that differs."""
        now, state, after, fields = None, (None, None), (None, (None, None)), None
        waiting: list = []  # ids and URLs of pages, all copies of one, with nothing but copies before them
        lines_, digest_ = None, None

        def text(own, neighbour):
            return differenced(own, shared_lines([_hash(x) for x, _ in own], _split(neighbour)) if neighbour else set())

        def settled(neighbour):
            done = text(lines_, neighbour)
            rows = [(i, url, done, len(done)) for i, url in waiting]
            waiting.clear()
            return rows

        def rows(batch):
            nonlocal now, state, after, lines_, digest_
            for part, i, url, host, digest, hashes, own, kinds in _parts(batch, ("part", "page_id", "url", "host", "digest", "hashes", "lines", "kinds")):
                if host != now:
                    if waiting:
                        yield from settled(None)
                    if now is None:
                        (from_host, from_state), after = carried[part]
                        state = from_state if from_host == host else (None, None)
                    else:
                        state = (None, None)
                    now = host
                if waiting and digest != digest_:
                    yield from settled(hashes)
                neighbour = _other(state, digest)
                if own is not None:
                    own = list(zip(own, kinds, strict=True))
                    if neighbour is None:
                        waiting.append((i, url))
                        lines_, digest_ = own, digest
                    else:
                        done = text(own, neighbour)
                        yield i, url, done, len(done)
                state = _later(state, (digest, hashes))

        for batch in batches:
            fields = _texts(batch.schema.field("page_id").type)
            yield from _chunks(rows(batch), fields)
        if waiting:
            yield from _chunks(settled(_other(after[1], digest_) if after[0] == now else None), fields)

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text (lines joined by a newline, empty if none) and n_chars (its code points).

    Whole pages are read. A null or empty page has an empty text. A null URL, or one without ``://``, has the host ''. Rows with null
    or repeated ids stay; pages with the same URL are neighbours, in order of their ids and then of a digest of their lines. An empty
    table gives an empty result. Only the three columns are read, so others may have any name. A page of any length is held by one task.
    """
    spark = pages.sparkSession
    prepare(spark)
    host, path = host_and_path(F.col("url"))
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = source.schema["page_id"].dataType.simpleString()
    texts = f"page_id {kind}, url string, text string, n_chars long"
    hosted = source.select("page_id", "url", "html", host.alias("host"), path.alias("path"))
    parsed = cut(hosted.mapInArrow(_parsed(None), f"page_id {kind}, url string, host string, path string, text string, digest binary, hashes binary, lines array<string>, kinds binary"))
    decided = parsed.where("text is not null").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
    undecided = parsed.where("digest is not null").drop("text")
    order = ["host", "path", "page_id", "digest"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = checkpointed(undecided.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("path")).withColumn("part", F.spark_partition_id())
    names = ", ".join(f"{c} {'string' if c in ('first', 'last') else 'int' if c == 'part' else 'binary'}" for c in _END_NAMES)
    ends = ordered.select("part", "host", "digest", "hashes").mapInArrow(_ends, names).collect()  # a row a partition
    return decided.union(ordered.mapInArrow(_differenced(_carried(ends)), texts))


def op8_html_extract(spark, sf_dir: str) -> DataFrame:
    """The contract's rows: extract over all of ``pages``."""
    return extract(table(spark, sf_dir, "pages"))
