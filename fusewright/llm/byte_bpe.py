"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text is cut into chunks that overlap. Each chunk is pre-tokenised by itself, starting wherever the cut fell. The pattern looks
at nothing before a match, so once a chunk has a border where the text so far has one, all its later borders are right: there the
two resynchronise and are stitched. A chunk's last match may end too early, so it is used only up to a border inside it. If no border
is shared within the overlap (a run of a million letters, say), the left chunk is grown to twice its size, and so on. The stitched pieces
are then encoded, by merging the lowest-ranked adjacent pair first. Decoding concatenates the tokens' raw bytes.

Texts of more than ``spread`` characters are dealt out by chunk: chunks are pre-tokenised in tasks of their own, neighbours tell
each other the borders of their overlap, each chunk's own stretch is encoded where it is, and the results are digested in order as they
stream by, so that no task holds more than a chunk of a text. From the first two chunks that do not resynchronise on, the rest of that
text is one stretch. Other texts are chunked where they are read.
"""
from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusewright.llm._shared import cut, prepare, table
from fusewright.llm._text import slices

CHUNK = 1 << 13
OVERLAP = 1 << 9
SPREAD = 1 << 18
#: Chunks of a text that is dealt out are longer, as each is a row.
SPREAD_CHUNKS = 8
#: A match that ends so many characters before a chunk's end does not depend on what follows the chunk.
LOOKAHEAD = 3
#: Pieces a task remembers, of this length at most; beyond that it starts anew. They are forgotten when it ends, since workers live on
#: and serve other stages.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 256


def chunk_borders(pattern, chunk: str, last: bool) -> list[int]:
    """Ends of the chunk's matches that are right wherever the chunk stands; all of them if the text ends with it."""
    ends = [m.end() for m in pattern.finditer(chunk)]
    while not last and ends and ends[-1] > len(chunk) - LOOKAHEAD:
        ends.pop()
    return ends


def pieces(pattern, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pattern's matches over the whole text, chunk by chunk."""
    n = len(text)
    if n <= size + overlap:  # one chunk, nothing to stitch
        return pattern.findall(text)
    out: list[str] = []
    done = start = 0  # the text is stitched up to ``done``; the next chunk starts at ``start``
    length = size + overlap
    while done < n:
        stop = start + length
        last = stop >= n
        borders = [start + e for e in chunk_borders(pattern, text[start:stop], last)]
        if start != done:
            at = bisect_left(borders, done)
            if at == len(borders) or borders[at] != done:
                start = done  # no shared border: begin where the stitched part ends instead
                continue
            borders = borders[at + 1 :]
        if not borders and not last:
            length *= 2
            continue
        if borders:
            out += [text[a:b] for a, b in zip([done, *borders], borders, strict=False)]
            done = borders[-1]
        if last:
            break
        # the next chunk begins at a cut that knows nothing of borders, an overlap before the stitched part's end
        start, length = max(start + 1, done - overlap), size + overlap
    return out


BIG = 1 << 62


def merge(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair with the lowest rank is merged, the leftmost of equals, until no pair has a rank."""
    n = len(raw)
    if n > 64:
        return _merge_long(raw, ranks)
    get = ranks.get
    bounds = list(range(n + 1))
    pairs = [get(raw[i : i + 2], BIG) for i in range(n - 1)]
    while pairs:
        low = min(pairs)
        if low == BIG:
            break
        i = pairs.index(low)
        del bounds[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(raw[bounds[i] : bounds[i + 2]], BIG)
        if i:
            pairs[i - 1] = get(raw[bounds[i - 1] : bounds[i + 1]], BIG)
    return [ranks[raw[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]


def _merge_long(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs and a linked list of parts, for pieces of any length."""
    n = len(raw)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by a part's first byte; an end of 0 marks a part that is gone
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(raw[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(raw[i : end[stop]])) is not None:
                heappush(heap, (rank, i, end[stop]))
        h = before[i]
        if h >= 0 and (rank := ranks.get(raw[h:stop])) is not None:
            heappush(heap, (rank, h, stop))
    out, at = [], 0
    while at < n:
        out.append(ranks[raw[at : end[at]]])
        at = end[at]
    return out


class Codec(dict):
    """Piece to (number of ids, their decimals joined by spaces, the bytes they decode to)."""

    def __init__(self, path: str, pattern: str):
        import regex

        super().__init__()
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.tokens = {i: raw for raw, i in ranks.items()}
        self.ranks = ranks
        self.pattern = regex.compile(pattern)

    def ids(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else merge(raw, self.ranks)

    def __missing__(self, piece: str):
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.ids(piece)
        got = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        if len(piece) <= LONGEST_REMEMBERED:
            self[piece] = got
        return got

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.ids(p) for p in pieces(self.pattern, text)))

    def digest(self, found: list[str]) -> tuple[int, str, str]:
        ids, raw, n = hashlib.sha256(), hashlib.sha256(), 0
        for a in range(0, len(found), 20_000):
            got = [self[p] for p in found[a : a + 20_000]]
            n += sum([g[0] for g in got])
            if a:
                ids.update(b" ")
            ids.update(" ".join([g[1] for g in got]).encode())
            raw.update(b"".join([g[2] for g in got]))
        return n, ids.hexdigest(), raw.hexdigest()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _digests(path, pattern, size, overlap):
    def run(batches):
        own = codec(path, pattern)
        try:
            for batch in batches:
                for part in slices(batch, "text"):
                    got = [own.digest(pieces(own.pattern, x or "", size, overlap)) for x in part.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            own.clear()

    return run


def _encoded(path, pattern, size, overlap):
    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [None if x is None else [i for p in pieces(own.pattern, x, size, overlap) for i in own.ids(p)] for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return run


def _decoded(path, pattern):
    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            raw = [None if x is None else own.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], names=["id", "raw"])

    return run


def _cut_up(size, overlap):
    """(row, id, start, last, chunk) of each chunk of long texts."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id")
            for k, (row, text) in enumerate(zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                for start in range(0, len(text), size):
                    last = start + size + overlap >= len(text)
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), ids.slice(k, 1), pa.array([start], pa.int64()), pa.array([last]), pa.array([text[start : start + size + overlap]], pa.string())], names=["row", "id", "start", "last", "chunk"])
                    if last:
                        break

    return run


def _borders(path, pattern, size, overlap):
    """Adds to each chunk the borders that it has in the overlap with the chunk before it, and with the one after it."""

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            heads, tails = [], []
            for start, last, chunk in zip(*(batch.column(c).to_pylist() for c in ("start", "last", "chunk")), strict=True):
                ends = chunk_borders(own.pattern, chunk, last)
                heads.append([start + e for e in ends if e <= overlap])
                tails.append([start + e for e in ends if e >= size])
            yield batch.append_column("head", pa.array(heads, pa.list_(pa.int64()))).append_column("tail", pa.array(tails, pa.list_(pa.int64())))

    return run


def _stretches(path, pattern, size, overlap):
    """Ids and bytes of each stretch of a text; its chunks come in order."""
    fields = [("row", pa.int64()), ("id", None), ("stretch", pa.int64()), ("n", pa.int64()), ("ids", pa.string()), ("raw", pa.binary())]

    def run(batches):
        own = codec(path, pattern)
        now, texts = None, []

        def done(kind):
            row, id_, stretch, begin, end = now[:5]
            text = "".join(texts)
            got = [own[p] for p in pieces(own.pattern, text[begin : None if end is None else end], size, overlap)]
            values = [row, None, stretch, sum(g[0] for g in got), " ".join(g[1] for g in got), b"".join(g[2] for g in got)]
            columns = [id_ if t is None else pa.array([v], t) for v, (_, t) in zip(values, fields, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])

        try:
            for batch in batches:
                for k, (row, stretch, start, begin, end, chunk) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "stretch", "start", "begin", "end", "chunk")), strict=True)):
                    if now is not None and (row, stretch) != (now[0], now[2]):
                        yield done(None)
                        now, texts = None, []
                    if now is None:
                        # begin and end are places in the text; the stretch's text starts with its first chunk
                        now = (row, batch.column("id").slice(k, 1), stretch, begin - start, None if end is None else end - start, start)
                        texts.append(chunk)
                    else:
                        now = (*now[:4], None if end is None else end - now[5], now[5])
                        texts.append(chunk[now[5] + sum(map(len, texts)) - start :])
            if now is not None:
                yield done(None)
        finally:
            own.clear()

    return run


def _in_order(batches):
    """One row a text from its stretches, which come in order."""
    now, total, ids, raw, id_ = None, 0, None, None, None

    def done():
        return pa.RecordBatch.from_arrays([id_, pa.array([total], pa.int64()), pa.array([ids.hexdigest()]), pa.array([raw.hexdigest()])], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    for batch in batches:
        for k, (row, n, some, more) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "n", "ids", "raw")), strict=True)):
            if row != now:
                if now is not None:
                    yield done()
                now, total, ids, raw, id_ = row, 0, hashlib.sha256(), hashlib.sha256(), batch.column("id").slice(k, 1)
            if n:
                ids.update(((" " if total else "") + some).encode())
            total += n
            raw.update(more)
    if now is not None:
        yield done()


def _dealt_out(long: DataFrame, path: str, pattern: str, size: int, overlap: int, columns: T.StructType) -> DataFrame:
    """The digests of long texts, whose chunks are dealt out."""
    kind = long.schema["id"]
    struct = lambda *names: T.StructType([kind if n == "id" else T.StructField(*n) for n in names])
    row, start, last, chunk = ("row", T.LongType()), ("start", T.LongType()), ("last", T.BooleanType()), ("chunk", T.StringType())
    places = T.ArrayType(T.LongType())
    chunks = long.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_cut_up(size, overlap), struct(row, "id", start, last, chunk))
    chunks = chunks.repartition("row", "start").mapInArrow(_borders(path, pattern, size, overlap), struct(row, "id", start, last, chunk, ("head", places), ("tail", places)))
    chunks = cut(chunks)
    by_text = Window.partitionBy("row").orderBy("start")
    met = F.array_min(F.array_intersect(F.lag("tail").over(by_text), F.col("head")))
    links = chunks.select("row", "start", met.alias("met"))
    # up to the first chunk that does not resynchronise each is a stretch, from there on all are one
    lost = F.max(F.when((F.col("start") > 0) & F.col("met").isNull(), 1).otherwise(0)).over(by_text)
    links = links.withColumn("lost", lost).withColumn("opens", F.when(F.col("lost") == 0, 1).otherwise(0))
    links = links.withColumn("stretch", F.sum("opens").over(by_text))
    following = F.when(F.lead("opens").over(by_text) == 1, F.lead("met").over(by_text))
    links = links.select("row", "start", "stretch", F.coalesce("met", F.lit(0).cast("long")).alias("begin"), following.alias("end"))
    found = chunks.select("row", "id", "start", "chunk").join(links, ["row", "start"]).repartition("row", "stretch").sortWithinPartitions("row", "stretch", "start")
    found = found.mapInArrow(_stretches(path, pattern, size, overlap), struct(row, "id", ("stretch", T.LongType()), ("n", T.LongType()), ("ids", T.StringType()), ("raw", T.BinaryType())))
    return found.repartition("row").sortWithinPartitions("row", "stretch").mapInArrow(_in_order, columns)


def _source(docs, id_col, text_col):
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids) of every row: the token ids of its whole text, null for a null text and empty for an empty one.

    Repeated rows and null ids stay; an empty table gives an empty result. A text's ids are one row, so they must fit a task.
    """
    source = _source(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_encoded(path, pattern, size, overlap), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, raw) of every row: the concatenated bytes of its tokens (an unknown id is an error).

    Null ids of tokens give null bytes, no ids no bytes. Repeated rows stay; an empty table gives an empty result.
    """
    prepare(encoded.sparkSession)
    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_decoded(path, pattern), f"id {kind}, raw binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """One row per input row: the id, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256 (of the bytes).

    Every whole text is encoded as the tiktoken library would without special tokens, then decoded. A null text is empty: no
    tokens, the digests of nothing. Rows with null or repeated ids stay; an empty table gives an empty result. Texts of more than
    ``spread`` characters are dealt out by chunk. Only the id and text columns are read, so others may have any name.
    """
    source = _source(docs, id_col, text_col)
    columns = T.StructType([source.schema["id"], *T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string").fields])
    is_long = F.coalesce(F.length("text"), F.lit(0)) > spread
    here = source.where(~is_long).mapInArrow(_digests(path, pattern, size, overlap), columns)
    there = _dealt_out(source.where(is_long), path, pattern, SPREAD_CHUNKS * size, overlap, columns)
    return here.union(there).withColumnRenamed("id", id_col)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every text of ``documents``."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
