"""Token-ID output: independent zstandard frames, a seek table at the end, a checksum for each frame.

File layout (one file for each range of document ids, ids ascending over the files
and inside them):

* data frames, each a zstandard frame of its own.  Its content is: u32 number of
  documents, i64 document ids, u32 token counts, then all token ids as u32
  (everything little-endian);
* one index frame: u32 number of data frames, i64 first document id of each,
  u64 tokens before each;
* a skippable frame with the seek table: for each frame u32 compressed size, u32
  content size, u32 checksum (low half of XXH64 of the content), and a footer
  with the number of frames.

A reader takes the seek table, the index frame, and then only the frames that
hold the documents it wants.

Defined cases: a null or empty text has only the end id.  A null document id is
written as the smallest 64-bit integer and read back as null.  Repeated ids keep
all their rows, ordered by text.  Other columns are ignored, whatever their names.
An empty table gives no documents.  One document is always within one frame.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import Memo, places
from .common import new_path, spool
from .shingling import slices

#: Magic numbers of zstandard's seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
NULL_ID = -(1 << 63)
#: How byte-level vocabularies write a leading space and a leading new line.
OPENERS = ("\u0120", "\u010a")
_MEMO_ENTRIES = 1_200_000
#: Chunks that are encoded in a row.
_ROW = 4_000
_state: dict = {}


class ChunkEncoder:
    """Token ids of texts as little-endian u32 bytes, with the tokenizers library; equal chunks are encoded once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(_MEMO_ENTRIES)
        vocabulary = self.tokenizer.get_vocab()
        #: Whether the token of each id starts with a space or a new line.
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(OPENERS)]] = True
        self.joinable = not any(" " in s or "\n" in s for s in self.special)

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """New chunks and their ids.

        Chunks of a space or new line and a word are encoded in a row, as one text, and
        cut again where a token starts with either: they meet where a token can't cross.
        """
        words, rest = [], []
        for c in new:
            (words if c[0] in " \n" and c.split() == [c[1:]] else rest).append(c)
        if not self.joinable:
            words, rest = [], new
        for begin in range(0, len(words), _ROW):
            part = words[begin : begin + _ROW]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (np.flatnonzero(self.opens[ids]) * 4).tolist()
            if len(cuts) != len(part):
                rest += part
                continue
            raw = ids.tobytes()
            yield from zip(part, [raw[i:j] for i, j in zip(cuts, [*cuts[1:], len(raw)], strict=True)], strict=True)
        for begin in range(0, len(rest), 20_000):
            part = rest[begin : begin + 20_000]
            yield from zip(part, self.library(part), strict=True)

    def known(self, distinct: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks."""
        found = list(map(self.memo.get, distinct))
        missing = [c for c, ids in zip(distinct, found, strict=True) if ids is None]
        old = self.memo.old
        fresh = {c: ids for c in missing if (ids := old.get(c)) is not None}
        fresh.update([(c.encode(), ids) for c, ids in self.learn([c.decode() for c in missing if c not in fresh])])
        self.memo.make_room(len(fresh))
        self.memo.update(fresh)
        return [fresh[c] if ids is None else ids for c, ids in zip(distinct, found, strict=True)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a string array.

        All texts are cut in one go; chunks are numbered by Arrow, so that Python sees each
        distinct one once, and the ids are put together by number.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            odd |= np.asarray(pc.match_substring(texts, s))
        whole = np.flatnonzero(odd).tolist()
        others = pc.if_else(pa.array(odd), "", texts) if whole else texts
        offsets = np.frombuffer(others.buffers()[1], dtype=np.int64)[others.offset : others.offset + len(others) + 1]
        first = int(offsets[0])
        data = np.frombuffer(others.buffers()[2] or b"", dtype=np.uint8)[first : int(offsets[-1])]
        offsets = offsets - first
        begins = places(data, offsets)
        found = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data)]
        ).dictionary_encode()
        known = self.known(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at, number = np.cumsum(sizes) - sizes, found.indices.to_numpy()
        counts = sizes[number]
        ends = np.append(0, np.cumsum(counts))
        steps = np.repeat(at[number] - ends[:-1], counts) + np.arange(ends[-1])
        raw = np.frombuffer(b"".join(known), dtype="<u4")[steps].tobytes()
        edges = (ends[np.searchsorted(begins, offsets)] * 4).tolist()
        out = [raw[i:j] for i, j in zip(edges, edges[1:], strict=False)]
        for k in whole:
            out[k] = self.library([texts[k].as_py()])[0]
        return out


def encoder(path: str) -> ChunkEncoder:
    """One for each worker process and tokenizer file."""
    if path not in _state:
        _state[path] = ChunkEncoder(path)
    return _state[path]


class FrameWriter:
    def __init__(self, sink, frame_tokens: int, level: int) -> None:
        self.sink, self.frame_tokens = sink, frame_tokens
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.table: list[tuple[int, int, int]] = []
        self.firsts: list[int] = []
        self.befores: list[int] = []
        self.ids: list[int] = []
        self.parts: list[bytes] = []
        self.held = self.tokens = self.docs = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        if not self.ids:
            self.firsts.append(doc_id)
            self.befores.append(self.tokens)
        self.ids.append(doc_id)
        self.parts.append(ids)
        self.held += len(ids) // 4
        self.tokens += len(ids) // 4
        self.docs += 1
        if self.held >= self.frame_tokens:
            self._data_frame()

    def _frame(self, content: bytes) -> None:
        packed = self.zstd.compress(content)
        self.sink.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def _data_frame(self) -> None:
        counts = np.array([len(p) // 4 for p in self.parts], dtype="<u4")
        self._frame(b"".join([struct.pack("<I", len(self.ids)), np.array(self.ids, dtype="<i8").tobytes(), counts.tobytes(), *self.parts]))
        self.ids, self.parts, self.held = [], [], 0

    def close(self) -> None:
        if self.ids:
            self._data_frame()
        self._frame(struct.pack("<I", len(self.firsts)) + np.array(self.firsts, dtype="<i8").tobytes() + np.array(self.befores, dtype="<u8").tobytes())
        body = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class FrameReader:
    """Random access to one token file; every frame that is read is checked."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table")
        body = source.read_at(12 * count, size - 9 - 12 * count)
        self.table = list(struct.iter_unpack("<III", body))
        self.at = np.concatenate([[0], np.cumsum([row[0] for row in self.table])]).tolist()
        index = self.frame(count - 1)
        n = struct.unpack_from("<I", index)[0]
        self.firsts = np.frombuffer(index, "<i8", n, 4).tolist()
        self.befores = np.frombuffer(index, "<u8", n, 4 + 8 * n).tolist()

    def frame(self, k: int) -> bytes:
        packed, size, check = self.table[k]
        content = zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, self.at[k]), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return content

    def documents(self, k: int) -> Iterator[tuple[int, int, bytes]]:
        """(document id, tokens of the file before it, ids as bytes) of data frame k."""
        content = self.frame(k)
        n = struct.unpack_from("<I", content)[0]
        ids = np.frombuffer(content, "<i8", n, 4).tolist()
        counts = np.frombuffer(content, "<u4", n, 4 + 8 * n).tolist()
        at, start = 4 + 12 * n, self.befores[k]
        for doc_id, count in zip(ids, counts, strict=True):
            yield doc_id, start, content[at : at + 4 * count]
            at += 4 * count
            start += count

    def find(self, doc_id: int) -> list[bytes]:
        """Ids of the documents with this id; only frames that can hold it are read."""
        last = bisect_right(self.firsts, doc_id) - 1
        found: list[bytes] = []
        while last >= 0:
            found = [ids for d, _, ids in self.documents(last) if d == doc_id] + found
            if self.firsts[last] < doc_id:
                break
            last -= 1
        return found


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame,
    out_dir: str,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    frame_tokens: int = 65_536,
    level: int = 3,
) -> DataFrame:
    """Encode every whole text and write the files; returns the manifest (part, path, n_docs, n_tokens), written too.

    Documents are dealt into ranges of ids, so a partition is one file and files
    follow each other.  A task writes under a name of its own attempt and renames at
    the end, so a repeated task leaves one whole file.  Memory: one Arrow batch and
    one frame.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        fs, folder = _open(out_dir)
        final, own = f"{folder}/tokens-{part:06d}.zst", f"{folder}/.tokens-{part:06d}.{context.taskAttemptId()}"
        end = struct.pack("<I", end_id)
        encode = encoder(tokenizer_path).encode
        writer = sink = None
        for batch in batches:
            for begin, stop in slices(batch.column(1)):
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    sink = fs.open_output_stream(own)
                    writer = FrameWriter(sink, frame_tokens, level)
                doc_ids = batch.column(0).slice(begin, stop - begin).to_pylist()
                for doc_id, ids in zip(doc_ids, encode(batch.column(1).slice(begin, stop - begin)), strict=True):
                    writer.add(NULL_ID if doc_id is None else doc_id, ids + end)
        if writer is None:
            return
        writer.close()
        sink.close()
        fs.move(own, final)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"tokens-{part:06d}.zst"], "n_docs": [writer.docs], "n_tokens": [writer.tokens]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return spool(ranged.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(spark: SparkSession, out_dir: str, manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32 (and ids, if asked for).

    start counts the ids of all documents before it.  The running sum over files
    needs one row for each file, no more.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _open(out_dir)
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{folder}/{path}") as source:
                    reader = FrameReader(source)
                    for k in range(len(reader.firsts)):
                        docs = list(reader.documents(k))
                        columns = {
                            "doc_id": pa.array([None if d == NULL_ID else d for d, _, _ in docs], pa.int64()),
                            "start": pa.array([before + s for _, s, _ in docs], pa.int64()),
                            "n_tokens": pa.array([len(ids) // 4 for _, _, ids in docs], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(ids) for _, _, ids in docs], pa.int64()),
                        }
                        if with_ids:
                            columns["ids"] = pa.array([np.frombuffer(ids, "<u4").astype(np.int64) for _, _, ids in docs], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_pydict(columns)

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("before"))
    files = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return files.mapInArrow(read, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    out_dir = new_path(spark, "token-files")
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), out_dir, default_tokenizer())
    return read_token_files(spark, out_dir, manifest)
