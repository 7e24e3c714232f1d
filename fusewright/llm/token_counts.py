"""Token counts of a SentencePiece BPE model by heap-and-linked-list merging.

The symbols of a normalised text are a doubly linked list. A heap holds the adjacent pairs whose union is a piece, by rank and then
position; the lowest is popped and merged, and the new neighbours are pushed, until none is left. The number of tokens is the number of
symbols at the start less the merges, where a symbol that is no piece counts as its UTF-8 bytes (byte fallback). No ids are made.

When the model is loaded, its pieces are searched for the places where none of them can reach across: before a space mark, and, if no
piece mixes them, between letters and other characters. Nothing merges there, so the count of a text is the sum over its parts.
Workers keep the counts of parts they have seen, up to a bound.
"""
from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusewright.llm._shared import prepare, table
from fusewright.llm._text import slices

MARK = "▁"
#: Parts a worker remembers, of this length at most; beyond that it starts anew. Some 30 MB.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 256
_LETTER = r"[^\W\d_]"
_MIXED = re.compile(rf"{_LETTER}(?!{_LETTER}|$)|[^{MARK}](?<!{_LETTER})(?={_LETTER})", re.S)
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_PARTS = re.compile(rf"{MARK}*{_LETTER}+|{MARK}*(?:(?!{_LETTER})[^{MARK}])+|{MARK}+", re.S)


class BpeCounter(dict):
    """Word (with its space marks) to number of tokens; missing ones are counted."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                pieces[model.id_to_piece(i)] = -model.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a space mark after another character")
        if any(model.is_unused(i) for i in range(model.get_piece_size())):
            raise ValueError("models with unused pieces are not supported")
        if not all(model.is_byte(model.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
            raise ValueError("the model has no byte fallback")
        self.ranks = pieces
        self.parts = (_WORDS if any(_MIXED.search(p) for p in pieces) else _PARTS).findall
        # a model that only marks spaces needs no normaliser call
        probe = " a  b ﬁ　é \tAÅ "
        self.plain = model.normalize(probe) == MARK + probe.replace(" ", MARK)

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = merge_count(word, self.ranks)
        if len(word) <= LONGEST_REMEMBERED:
            self[word] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.plain and "\0" not in text:
            norm = MARK + text.replace(" ", MARK)
        else:
            norm = self.model.normalize(text)
        if not norm:
            return 0
        return sum(map(self.__getitem__, self.parts(norm)))


def merge_count(word: str, ranks: dict[str, float]) -> int:
    """Symbols at the start less merges."""
    n = len(word)
    symbols: list[str | None] = list(word)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        pair = word[i : i + 2]
        if pair in ranks:
            heap.append((ranks[pair], i, pair))
    heapify(heap)
    while heap:
        _, i, pair = heappop(heap)
        left = symbols[i]
        if left is None:
            continue
        j = after[i]
        if j >= n or left + symbols[j] != pair:
            continue
        symbols[i], symbols[j] = pair, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (new := pair + symbols[k]) in ranks:
                heappush(heap, (ranks[new], i, new))
        h = before[i]
        if h >= 0 and (new := symbols[h] + pair) in ranks:
            heappush(heap, (ranks[new], h, new))
    total = 0
    for s in symbols:
        if s is not None:
            total += 1 if s in ranks else len(s.encode())
    return total


_COUNTERS: dict[str, BpeCounter] = {}


def counter(path: str) -> BpeCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = BpeCounter(path)
    return _COUNTERS[path]


def _count(path: str):
    def run(batches):
        count = counter(path).count
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                n_bytes = [len(x.encode()) if x else 0 for x in texts]
                n_tokens = [count(x) if x else 0 for x in texts]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    Counts are those of the model's own library, without begin, end or other added tokens; strings such as ``<s>`` inside a text
    are ordinary text. ``path`` names the model file on every worker. A null text is empty and has 0 tokens. Rows with null or
    repeated ids stay; an empty table gives an empty result. Only the id and text columns are read.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    counted = source.mapInArrow(_count(path), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """The contract's rows: token_counts over all of ``documents``."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
