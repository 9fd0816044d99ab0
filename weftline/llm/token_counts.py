"""Token counts by byte-pair merging with a heap and a linked list; no ids are made.

A chunk of text starts as its bytes.  A heap holds the adjacent pairs that have a
merge rank; the lowest rank (leftmost of equals) is popped, its two symbols become
one in the linked list, and the pairs that this makes are pushed.  The count is the
number of first symbols less the number of merges.  Chunks recur, so their counts
are kept in a bounded memo.

Defined cases: a null or empty text has 0 bytes and 0 tokens.  A special string
inside a text is one token, as the library takes it.  A null id, repeated rows and
other columns are carried as they are; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import Memo, chunks
from .shingling import slices
from .token_files import default_tokenizer

#: Fixed value: the published pretoken pattern of this vocabulary.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MEMO_ENTRIES = 1_000_000
_state: dict = {}


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeCounter:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        number: dict[str, int] = {}

        def of(symbol: str) -> int:
            return number.setdefault(symbol, len(number))

        self.first = [of(c) for c in _byte_symbols()]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[of(a), of(b)] = rank, of(a + b)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pretokens = regex.compile(PRETOKEN).findall
        self.memo = Memo(_MEMO_ENTRIES)
        self.words = Memo(_MEMO_ENTRIES)

    def merges(self, data: bytes) -> int:
        """Tokens of one pretoken."""
        symbols = [self.first[b] for b in data]
        n = count = len(symbols)
        if n < 2:
            return n
        pairs = self.pairs
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = pairs.get((symbols[i], symbols[i + 1]))
            if found:
                heap.append((found[0], i, found[1], i + 1))
        heapify(heap)
        while heap:
            rank, i, made, j = heappop(heap)
            if symbols[i] < 0 or after[i] != j or pairs.get((symbols[i], symbols[j]), (-1,))[0] != rank:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = made, -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs.get((made, symbols[k]))
                if found:
                    heappush(heap, (found[0], i, found[1], k))
            h = before[i]
            if h >= 0:
                found = pairs.get((symbols[h], made))
                if found:
                    heappush(heap, (found[0], h, found[1], i))
        return count

    def chunk(self, chunk: str) -> int:
        total = 0
        for piece in self.pretokens(chunk):
            n = self.words.get(piece) or self.words.recall(piece)
            if n is None:
                self.words.make_room(1)
                n = self.words[piece] = self.merges(piece.encode())
            total += n
        return total

    def plain(self, text: str) -> int:
        memo = self.memo
        total = 0
        for piece in chunks(text):
            n = memo.get(piece)
            if n is None:
                n = memo.recall(piece)
            if n is None:
                memo.make_room(1)
                n = memo[piece] = self.chunk(piece)
            total += n
        return total

    def count(self, text: str) -> int:
        if self.cut and any(s in text for s in self.special):
            parts = self.cut.split(text)
            return sum(map(self.plain, parts)) + len(parts) - 1
        return self.plain(text)


def counter(path: str) -> MergeCounter:
    if path not in _state:
        _state[path] = MergeCounter(path)
    return _state[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row.  Narrow: no shuffle, one Arrow batch at a time."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(tokenizer_path).count
        for batch in batches:
            for begin, stop in slices(batch.column(1)):
                texts = batch.column(1).slice(begin, stop - begin)
                n = pa.array([of(t or "") for t in texts.to_pylist()], pa.int64())
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, stop - begin), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
