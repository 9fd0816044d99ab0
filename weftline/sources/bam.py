"""BAM as Spark data sources, with an exact index of record borders.

    spark.dataSource.register(bam.BamSource)
    spark.read.format("bam_records").load(path)          # ranges of split_bytes, borders told by their looks
    bam.build_index(spark, path, index)                  # one distributed pass
    bam.read_bam(spark, path, index).where("rname = 'chr1' and pos between 1000 and 2000")
    bam.write_bam(records, sizes, path)                  # one file a task

Without an index a file is cut into ranges of split_bytes (64 MiB by default), each one a
partition, which yields the records that start in blocks of the range.  The first of them
is the first place from which CHAIN records follow each other, each with a name, operations
that add up to its sequence, and tags that end where it ends; blocks are inflated until
that is decided, however long a record is, and only what is open is held.

The index makes this exact.  Its pass tells for each range the first record at or after its
start and the first at or after its end.  The first range starts at the header's end,
which is known, so where each range starts as the one before it ends, all borders are
right; a range that doesn't is walked again from where it must start.  Bodies of records
are skipped, blocks inside a body aren't inflated.  Beside the ranges it keeps, for stretches
of CHUNK bytes, their references and least and largest positions: a filter on rname and
pos, which Spark pushes down, opens only the stretches that can hold such records.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.ranks import ranked
from ..functions.scratch import new_path, spool, unspool
from . import bgzf
from .taskfiles import TaskFilesWriter, Written, files, filesystem

#: Letters of 4-bit bases and of CIGAR operations in the format, and the operations that take bases of the read.
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
_TAKES = {0, 1, 4, 7, 8}
SCHEMA = "name string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,string>, kinds map<string,string>, file string"
#: Records in a row that make a border; bytes of a range, and of a stretch of the index.
CHAIN = 4
SPLIT = 64 << 20
CHUNK = 1 << 18
#: Bytes of files that a task reads one after the other, and of records that are decoded at once.
TASK = 16 << 20
BATCH = 1 << 20
_LONGEST = 1 << 29
_SIZES = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_HIGH = bytes(ord(BASES[b >> 4]) for b in range(256))
_LOW = bytes(ord(BASES[b & 15]) for b in range(256))
_TO_QUAL = bytes(min(b + 33, 255) for b in range(256))
_FROM_QUAL = bytes(max(b - 33, 0) for b in range(256))
_CODE = bytes(BASES.find(chr(b).upper()) if chr(b).upper() in BASES else 15 for b in range(256))


# ---- records in bytes ------------------------------------------------------------------------------------------


def _tags(data: bytes) -> tuple[dict[str, str], dict[str, str]]:
    """Values and kinds of the tags."""
    out, kinds, at = {}, {}, 0
    while at + 3 <= len(data):
        key, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        kinds[key] = kind if kind not in "cCsSI" else "i"
        if kind in "ZH":
            end = data.index(b"\0", at)
            out[key], at = data[at:end].decode("utf-8", "replace"), end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            values = np.frombuffer(data, "<" + {"c": "i1", "C": "u1", "s": "i2", "S": "u2", "i": "i4", "I": "u4", "f": "f4"}[sub], n, at + 5)
            out[key], at = ",".join([sub, *map(str, values.tolist())]), at + 5 + values.nbytes
        else:
            value = struct.unpack_from(f"<{_SIZES[kind]}", data, at)[0]
            out[key], at = value.decode("latin-1") if kind == "A" else str(value), at + struct.calcsize(_SIZES[kind])
    return out, kinds


def _tags_end(data: bytearray, at: int, end: int) -> bool:
    """Whether tags from at on end at end."""
    while at + 4 <= end:
        kind = chr(data[at + 2])
        at += 3
        if kind in "ZH":
            at = data.find(b"\0", at, end) + 1
            if not at:
                return False
        elif kind == "B":
            sub = chr(data[at])
            if sub not in _SIZES or sub == "A" or at + 5 > end:
                return False
            at += 5 + struct.unpack_from("<I", data, at + 1)[0] * struct.calcsize(_SIZES[sub])
        elif kind in _SIZES:
            at += struct.calcsize(_SIZES[kind])
        else:
            return False
    return at == end


def _record_end(held: bytearray, at: int, n_refs: int) -> int | None:
    """Where the record at at ends, if there can be one; minus the bytes that must be held to tell; None if there can't."""
    if at + 36 > len(held):
        return -(at + 36)
    size, ref, pos, l_name, _, _, n_ops, _, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", held, at)
    if not (32 <= size < _LONGEST and -1 <= ref < n_refs and -1 <= next_ref < n_refs and pos >= -1 and next_pos >= -1 and l_name > 0 and l_seq >= 0):
        return None
    body = at + 36 + l_name + 4 * n_ops
    end = at + 4 + size
    if body + (l_seq + 1) // 2 + l_seq > end:
        return None
    if body > len(held):
        return -body
    name = held[at + 36 : at + 36 + l_name]
    if name[-1] or any(not 33 <= c <= 126 for c in name[:-1]):
        return None
    taken = 0
    for v in struct.unpack_from(f"<{n_ops}I", held, at + 36 + l_name):
        if v & 15 >= len(OPS):
            return None
        taken += (v >> 4) * (v & 15 in _TAKES)
    if n_ops and l_seq and taken != l_seq:
        return None
    if end > len(held):
        return -end
    return end if _tags_end(held, body + (l_seq + 1) // 2 + l_seq, end) else None


def _follow(f: bgzf.Inflated, at: int, n_refs: int) -> bool:
    """Whether CHAIN records, or as many as there are to the end of the file, follow each other from at on."""
    for k in range(CHAIN):
        while (end := _record_end(f.held, at, n_refs)) is not None and end < 0:
            if not f.fill(-end - f.at):
                return k > 0 and at == len(f.held)
        if end is None:
            return False
        at = end
    return True


def _candidates(held: bytearray, at: int, n_refs: int) -> np.ndarray:
    """Places from at on where the fixed fields of a record could stand."""
    b = np.frombuffer(bytes(held[at:]), np.uint8).astype(np.uint32)
    if len(b) < 36:
        return np.zeros(0, np.int64)
    word = (b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24).view(np.int32)
    n = len(b) - 35
    size, ref, pos, l_seq, next_ref, next_pos = (word[k : k + n] for k in (0, 4, 8, 20, 24, 28))
    fits = (size >= 32) & (size < _LONGEST) & (ref >= -1) & (ref < n_refs) & (pos >= -1) & (l_seq >= 0) & (l_seq <= size) & (next_ref >= -1) & (next_ref < n_refs) & (next_pos >= -1) & (b[12 : 12 + n] > 0)
    return np.flatnonzero(fits) + at


def _first_record(f: bgzf.Inflated, n_refs: int) -> bool:
    """Move to the first place where a record starts; False if the file ends before."""
    while f.fill(36):
        found = next((k for k in _candidates(f.held, f.at, n_refs).tolist() if _follow(f, k, n_refs)), None)
        if found is not None:
            f.at = found
            return True
        # Every place but the last 35 bytes has been looked at.
        f.at = max(f.at, len(f.held) - 35)
        if not f.more():
            return False
    return False


def header(f: bgzf.Inflated) -> tuple[str, list[tuple[str, int]]]:
    """Text, and names and lengths of the references; moves to the first record."""
    if f.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = f.read(struct.unpack("<i", f.read(4))[0]).decode("utf-8", "replace").rstrip("\0")
    refs = []
    for _ in range(struct.unpack("<i", f.read(4))[0]):
        name = f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", f.read(4))[0]))
    return text, refs


def _decode(d: bytes, name_of, file: str | None) -> tuple:
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", d)
    at = 32
    name = d[at : at + l_name - 1].decode("utf-8", "replace")
    at += l_name
    cigar = "".join(f"{v >> 4}{OPS[v & 15]}" for v in struct.unpack_from(f"<{n_ops}I", d, at))
    at += 4 * n_ops
    packed = d[at : at + (l_seq + 1) // 2]
    seq = bytearray(2 * len(packed))
    seq[0::2], seq[1::2] = packed.translate(_HIGH), packed.translate(_LOW)
    at += len(packed)
    qual = d[at : at + l_seq]
    at += l_seq
    text = "*" if not qual or qual[0] == 255 else qual.translate(_TO_QUAL).decode("latin-1")
    return name, flag, name_of(ref), pos + 1, mapq, cigar or "*", name_of(next_ref), next_pos + 1, tlen, seq[:l_seq].decode() or "*", text, *_tags(d[at:]), file


def _next_size(f: bgzf.Inflated) -> int | None:
    """Bytes of the next record, behind its size; None at the end."""
    size = f.read(4)
    if not size:
        return None
    if len(size) < 4:
        raise ValueError("the file ends inside a record")
    return struct.unpack("<i", size)[0]


def _between(f: bgzf.Inflated, refs: list, end: int, file: str | None) -> Iterator[tuple]:
    """Rows of the records from where f stands to the virtual offset end."""
    name_of = lambda k: refs[k][0] if k >= 0 else "*"
    while f.place() < end and (size := _next_size(f)) is not None:
        data = f.read(size)
        if len(data) < size:
            raise ValueError("the file ends inside a record")
        yield _decode(data, name_of, file)


_FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")])
_MAP = pa.map_(pa.string(), pa.string())
_ARROW = pa.schema([(k, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}.get(kind, _MAP)) for k, kind in (c.split(" ", 1) for c in SCHEMA.split(", "))])


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, kind) -> pa.Array:
    """An array of the stretches of data, as text or as bytes."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[at])])


def _decode_batch(held: bytes, offsets: list[int], names: pa.Array, file: str | None) -> pa.RecordBatch:
    """_decode() of the records at offsets.  names: those of the references, and * at last.  Records without bases and tags are read together."""
    data, at = np.frombuffer(held, np.uint8), np.array(offsets)
    fixed = np.ascontiguousarray(data[at[:, None] + np.arange(36)]).view(_FIXED)[:, 0]
    l_name, n_ops = fixed["l_name"].astype(np.int64), fixed["n_ops"].astype(np.int64)
    body = at + 36 + l_name
    named = None
    if not fixed["l_seq"].any() and (body + 4 * n_ops == at + 4 + fixed["size"]).all() and l_name.all():
        try:
            named = _gathered(data, at + 36, l_name - 1, pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:  # a name that isn't UTF-8
            pass
    if named is None:
        name_of = lambda k: names[k].as_py()
        rows = [_decode(held[k + 4 : k + 4 + int(n)], name_of, file) for k, n in zip(offsets, fixed["size"], strict=True)]
        rows = [[list(x.items()) if isinstance(x, dict) else x for x in r] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
    cigars = _gathered(data, body, 4 * n_ops, pa.binary()).dictionary_encode()
    texts = ["".join(f"{v >> 4}{OPS[v & 15]}" for v in np.frombuffer(x, "<u4").tolist()) or "*" for x in cigars.dictionary.to_pylist()]
    n = len(at)
    long = lambda k, plus=0: pa.array(fixed[k].astype(np.int64) + plus)
    whole = lambda k: pa.array(fixed[k].astype(np.int32))
    # -1 stands for no reference, as the last name does.
    ref = lambda k: names.take(pa.array(np.where(fixed[k] < 0, len(names) - 1, fixed[k])))
    none = pa.MapArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()), pa.array([], pa.string()))
    star = pa.repeat(pa.scalar("*"), n)
    columns = [named, whole("flag"), ref("ref"), long("pos", 1), whole("mapq"), pa.array(texts, pa.string()).take(cigars.indices), ref("next_ref"), long("next_pos", 1), long("tlen"), star, star, none, none, pa.repeat(pa.scalar(file, pa.string()), n)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def _batches(f: bgzf.Inflated, names: pa.Array, end: int, file: str | None) -> Iterator[pa.RecordBatch]:
    """_between() in batches of records."""
    unpack = struct.Struct("<i").unpack_from
    while True:
        while len(f.held) - f.at < BATCH and f.next <= end >> 16 and f.more():
            pass
        limit = next((start + (end & 0xFFFF if place == end >> 16 else 0) for start, place in f.blocks if place >= end >> 16), 1 << 62) - f.before
        held, at, offsets, over = f.held, f.at, [], len(f.held)
        while at < limit and at + 4 <= over:
            size = unpack(held, at)[0]
            if size < 32:
                raise ValueError("a record is shorter than can be")
            if at + 4 + size > over:
                break
            offsets.append(at - f.at)
            at += 4 + size
        if offsets:
            yield _decode_batch(bytes(held[f.at : at]), offsets, names, file)
            f.at = at
        elif at >= limit:
            return
        elif not f.more():
            if at < len(f.held):
                raise ValueError("the file ends inside a record")
            return


class _Opener:
    """Opens BAM files; files that begin with the same header, as those of one run do, have it read once."""

    def __init__(self) -> None:
        self.start, self.names = None, None

    def __call__(self, raw) -> bgzf.Inflated:
        """At the first record."""
        if self.start is not None:
            raw.seek(0)
            if raw.read(len(self.start)) == self.start:
                return bgzf.Inflated(raw, len(self.start))
        f = bgzf.Inflated(raw)
        _, refs = header(f)
        self.start, self.names = None, pa.array([n for n, _ in refs] + ["*"], pa.string())
        here = f.place()
        if not here & 0xFFFF:
            raw.seek(0)
            self.start = raw.read(here >> 16)
            f = bgzf.Inflated(raw, here >> 16)
        return f


def _seek(raw, begin: int, n_refs: int, after_header: bgzf.Inflated) -> bgzf.Inflated | None:
    """At the first record that starts in a block at or behind begin; None if there is none."""
    if not begin:
        return after_header
    first = bgzf.first_block(raw, begin, raw.size())
    if first is None:
        return None
    if first <= after_header.place() >> 16:
        # The header reaches up to here.
        return at_header(raw)
    f = bgzf.Inflated(raw, first)
    return f if _first_record(f, n_refs) else None


def at_header(raw) -> bgzf.Inflated:
    f = bgzf.Inflated(raw)
    header(f)
    return f


def records(raw, begin: int = 0, end: int | None = None, file: str | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA of the records of a seekable BAM file that start in blocks of [begin, end)."""
    f = bgzf.Inflated(raw)
    _, refs = header(f)
    f = _seek(raw, begin, len(refs), f)
    if f is not None:
        yield from _between(f, refs, (raw.size() if end is None else end) << 16, file)


# ---- the index -------------------------------------------------------------------------------------------------


def walk(raw, begin: int, end: int, start: int | None = None, chunk: int = CHUNK) -> tuple[int, int, list[dict]]:
    """Virtual offsets of the first records at or behind begin and end, and what stretches between them hold.

    start: where the first record is known to be.
    """
    f = bgzf.Inflated(raw)
    _, refs = header(f)
    over = raw.size() << 16
    if start is None:
        f = _seek(raw, begin, len(refs), f)
        start = over if f is None else f.place()
    else:
        f = None
    if start >= min(end << 16, over):
        return start, start, []
    f = f or bgzf.at_place(raw, start)
    made: list[dict] = []
    at = start
    held: dict[int, list[int]] = {}

    def put(upto: int) -> None:
        for ref, (n, low, high) in held.items():
            made.append({"from": at, "upto": upto, "rname": refs[ref][0] if ref >= 0 else "*", "n": n, "low": low + 1, "high": high + 1})
        held.clear()

    while (here := f.place()) < end << 16 and here < over:
        if (here >> 16) - (at >> 16) >= chunk:
            put(here)
            at = here
        size = _next_size(f)
        fixed = f.read(32)
        ref, pos = struct.unpack_from("<ii", fixed)
        f.skip(size - 32)
        n, low, high = held.get(ref, (0, pos, pos))
        held[ref] = [n + 1, min(low, pos), max(high, pos)]
    put(here)
    return start, here, made


_CHUNK_TYPE = pa.list_(pa.struct([("from", pa.int64()), ("upto", pa.int64()), ("rname", pa.string()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))
_WALKED = pa.schema([("file", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("first", pa.int64()), ("next", pa.int64()), ("chunks", _CHUNK_TYPE)])
_WALKED_DDL = "file string, begin long, end long, first long, next long, chunks array<struct<from: long, upto: long, rname: string, n: long, low: long, high: long>>"


def _walks(uri: str, chunk: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(uri)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(r["file"]) as raw:
                    first, after, chunks = walk(raw, r["begin"], r["end"], r["start"], chunk)
                yield pa.RecordBatch.from_pylist([{**{k: r[k] for k in ("file", "begin", "end")}, "first": first, "next": after, "chunks": chunks}], _WALKED)

    return run


def build_index(spark: SparkSession, path: str, index: str, *, split_bytes: int = SPLIT, chunk_bytes: int = CHUNK) -> None:
    """Write the index of the BAM files of path: index/ranges and index/chunks, two tables."""
    found = spark.createDataFrame(files(path, ".bam"), "file string, size long").where("size > 0")
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("begin")
    ranges = found.select("file", "size", begins).select("file", "begin", F.least(F.col("begin") + split_bytes, "size").alias("end"), F.lit(None).cast("long").alias("start"))
    ranges = spool(ranges, "bam-ranges")
    n = max(1, ranges.count())
    run = _walks(path, chunk_bytes)
    walked = spool(ranges.repartition(min(n, 10_000), "file", "begin").mapInArrow(run, _WALKED_DDL), "bam-walked")
    unspool(ranges)
    while True:
        borders = walked.select("file", "begin", "end", "first", F.lag("next").over(Window.partitionBy("file").orderBy("begin")).alias("start"))
        wrong = spool(borders.where("start <> first").select("file", "begin", "end", "start"), "bam-wrong")
        n = wrong.count()
        if not n:
            break
        again = wrong.repartition(min(n, 10_000), "file", "begin").mapInArrow(run, _WALKED_DDL)
        after = spool(walked.join(wrong.select("file", "begin"), ["file", "begin"], "left_anti").select("file", "begin", "end", "first", "next", "chunks").unionByName(again), "bam-walked")
        unspool(walked, wrong)
        walked = after
    walked.select("file", "first", "next").where("first < next").write.parquet(f"{index}/ranges")
    chunks = walked.select("file", F.explode("chunks").alias("c")).select("file", "c.*")
    chunks.repartitionByRange("rname", "low").sortWithinPartitions("rname", "low").write.parquet(f"{index}/chunks")
    unspool(walked, wrong)


def read_bam(spark: SparkSession, path: str, index: str, *, split_bytes: int = SPLIT) -> DataFrame:
    """Rows of SCHEMA, read by the index of build_index(); filters on rname and pos open only what they need."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedBamSource)
    return spark.read.format("bam_indexed").options(path=path, index=index, split_bytes=str(split_bytes)).load()


# ---- data sources ----------------------------------------------------------------------------------------------


class _Ranges(InputPartition):
    """Ranges of files, (path, begin, end) each."""

    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        self.ranges = ranges


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.uri = options["path"]
        self.split = int(options.get("split_bytes", SPLIT))

    def partitions(self) -> list[InputPartition]:
        made: list[_Ranges] = []
        room = 0
        for path, size in files(self.uri, ".bam"):
            for begin in range(0, size, self.split):
                # A task reads short files one after the other.
                if room <= 0:
                    made.append(_Ranges([]))
                    room = min(self.split, TASK)
                made[-1].ranges.append((path, begin, min(begin + self.split, size)))
                room -= min(self.split, size - begin)
        return made

    def read(self, partition: _Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no file
            return
        fs, _ = filesystem(self.uri)
        opened = _Opener()
        for path, begin, end in partition.ranges:
            with fs.open_input_file(path) as raw:
                f = opened(raw)
                f = _seek(raw, begin, len(opened.names) - 1, f)
                if f is not None:
                    yield from _batches(f, opened.names, end << 16, path.rpartition("/")[2])


class _Stretches(InputPartition):
    def __init__(self, path: str, stretches: list[tuple[int, int]]) -> None:
        self.path, self.stretches = path, stretches


class _IndexedReader(DataSourceReader):
    """A partition is some stretches of a file, of about split_bytes."""

    def __init__(self, options) -> None:
        self.uri, self.index = options["path"], options["index"]
        self.split = int(options.get("split_bytes", SPLIT))
        self.rname, self.low, self.high = None, None, None

    def pushFilters(self, filters: list) -> Iterable:
        """Takes note of what stretches can be left out by; Spark applies all filters again."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("rname",) and isinstance(f, EqualTo):
                self.rname = value
            elif column == ("pos",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = value if self.low is None else max(self.low, value)
            if column == ("pos",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = value if self.high is None else min(self.high, value)
            yield f

    def stretches(self) -> list[tuple[str, int, int]]:
        import pyarrow.dataset as pads

        fs, path = filesystem(self.index)
        if self.rname is None and self.low is None and self.high is None:
            t = pads.dataset(f"{path}/ranges", filesystem=fs, format="parquet").to_table()
            return sorted(zip(t["file"].to_pylist(), t["first"].to_pylist(), t["next"].to_pylist(), strict=True))
        tests = [pc.field("n") > 0]
        tests += [pc.field("rname") == self.rname] if self.rname is not None else []
        tests += [pc.field("high") >= self.low] if self.low is not None else []
        tests += [pc.field("low") <= self.high] if self.high is not None else []
        every = tests[0]
        for t in tests[1:]:
            every = every & t
        t = pads.dataset(f"{path}/chunks", filesystem=fs, format="parquet").to_table(columns=["file", "from", "upto"], filter=every)
        return sorted(set(zip(t["file"].to_pylist(), t["from"].to_pylist(), t["upto"].to_pylist(), strict=True)))

    def partitions(self) -> list[InputPartition]:
        made: list[_Stretches] = []
        held = 0
        for path, begin, end in self.stretches():
            if not made or made[-1].path != path or held >= self.split:
                made.append(_Stretches(path, []))
                held = 0
            parts = made[-1].stretches
            if parts and parts[-1][1] == begin:
                parts[-1] = (parts[-1][0], end)
            else:
                parts.append((begin, end))
            held += (end >> 16) - (begin >> 16)
        return made

    def read(self, partition: _Stretches | None) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        if partition is None:  # no stretch is left
            return
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        with fs.open_input_file(partition.path) as raw:
            opened = _Opener()
            opened(raw)
            for begin, end in partition.stretches:
                yield from _batches(bgzf.at_place(raw, begin), opened.names, end, partition.path.rpartition("/")[2])


class BamSource(DataSource):
    """bam_records: reads by ranges, and writes."""

    @classmethod
    def name(cls) -> str:
        return "bam_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema)


class IndexedBamSource(DataSource):
    """bam_indexed: reads by an index."""

    @classmethod
    def name(cls) -> str:
        return "bam_indexed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _IndexedReader(self.options)


# ---- writing ---------------------------------------------------------------------------------------------------

#: Tags of the format that hold whole numbers.
WHOLE = {"AM", "AS", "CM", "CP", "FI", "H0", "H1", "H2", "HI", "IH", "MQ", "NH", "NM", "OP", "PQ", "SM", "TC", "UQ"}


def _bin(begin: int, end: int) -> int:
    """The smallest bin of the format's scheme that holds [begin, end)."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


def _encode_tag(key: str, value: str, kind: str | None) -> bytes:
    kind = kind or ("i" if key in WHOLE else "Z")
    out = key.encode("latin-1")[:2] + kind.encode()
    if kind in "ZH":
        return out + value.encode() + b"\0"
    if kind == "A":
        return out + value.encode("latin-1")[:1]
    if kind == "f":
        return out + struct.pack("<f", float(value))
    if kind == "B":
        sub, *values = value.split(",")
        return out + sub.encode() + struct.pack(f"<I{len(values)}{_SIZES[sub]}", len(values), *[float(v) if sub == "f" else int(v) for v in values])
    n = int(value)
    return out[:2] + (b"i" + struct.pack("<i", n) if -(1 << 31) <= n < 1 << 31 else b"I" + struct.pack("<I", n))


def _operations(cigar: str) -> tuple[list[int], int]:
    """Operations as numbers, and the bases of the reference that they span."""
    ops, number, span = [], 0, 0
    for ch in "" if cigar == "*" else cigar:
        if ch.isdigit():
            number = number * 10 + int(ch)
        else:
            code = OPS.index(ch)
            ops.append(number << 4 | code)
            span += number if code in (0, 2, 3, 7, 8) else 0
            number = 0
    return ops, span


def encode(row: dict, ref_of: dict[str, int]) -> bytes:
    """A record of the format from a row with the columns of SCHEMA; absent or null ones are empty."""
    get = lambda k, other: other if row.get(k) is None else row[k]
    name, cigar, seq, qual = get("name", "*").encode(), get("cigar", "*"), get("seq", "*"), get("qual", "*")
    if not 1 <= len(name) <= 254:
        raise ValueError(f"a read's name has 1 to 254 bytes, not {len(name)}")
    ops, span = _operations(cigar)
    bases = b"" if seq == "*" else seq.encode("latin-1", "replace")
    codes = bases.translate(_CODE) + b"\0" * (len(bases) % 2)
    packed = bytes((np.frombuffer(codes[0::2], np.uint8) << 4 | np.frombuffer(codes[1::2], np.uint8)).astype(np.uint8))
    scores = b"\xff" * len(bases) if qual == "*" else qual.encode("latin-1").translate(_FROM_QUAL)
    if len(scores) != len(bases):
        raise ValueError("a read has as many qualities as bases")
    ref = ref_of[get("rname", "*")] if get("rname", "*") != "*" else -1
    mate = get("rnext", "*")
    next_ref = -1 if mate == "*" else ref if mate == "=" else ref_of[mate]
    pos = int(get("pos", 0)) - 1
    tags, kinds = get("tags", {}), get("kinds", {})
    extra = b"".join(_encode_tag(k, v, kinds.get(k)) for k, v in tags.items() if v is not None)
    if len(ops) > 65_535:  # the format's way for long alignments
        extra += b"CGBI" + struct.pack(f"<I{len(ops)}I", len(ops), *ops)
        ops = [len(bases) << 4 | 4, span << 4 | 3]
    in_bin = 4680 if pos < 0 else _bin(pos, pos + max(span, 1))
    fixed = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, int(get("mapq", 255)), in_bin & 0xFFFF, len(ops), int(get("flag", 0)), len(bases), next_ref, int(get("pnext", 0)) - 1, int(get("tlen", 0)))
    body = fixed + name + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + scores + extra
    return struct.pack("<i", len(body)) + body


def _bins(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """_bin() of many."""
    out, end = np.zeros(len(begin), np.int64), end - 1
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = np.where(begin >> shift == end >> shift, first + (begin >> shift), out)
    return out


def encode_batch(batch: pa.RecordBatch, ref_of: dict[str, int]) -> pa.Array:
    """encode() of each row, as binary.  Rows without bases and tags are put together column by column."""
    n = batch.num_rows
    column = lambda k, other, kind: batch.column(k).cast(kind).fill_null(other) if k in batch.schema.names else pa.repeat(pa.scalar(other, kind), n)
    number = lambda k, other: column(k, other, pa.int64()).to_numpy(zero_copy_only=False)
    plain = lambda k: k not in batch.schema.names or pc.all(pc.equal(batch.column(k).fill_null("*"), "*")).as_py() is not False
    bare = lambda k: k not in batch.schema.names or not np.diff(batch.column(k).offsets.to_numpy()).any()
    if not (plain("seq") and plain("qual") and bare("tags")):
        return pa.array([encode(row, ref_of) for row in _rows(batch)], pa.binary())
    names = column("name", "*", pa.string()).cast(pa.binary())
    lengths = pc.binary_length(names).to_numpy(zero_copy_only=False)
    if ((lengths < 1) | (lengths > 254)).any():
        raise ValueError("a read's name has 1 to 254 bytes")
    cigars = column("cigar", "*", pa.string()).dictionary_encode()
    parsed = [_operations(x) for x in cigars.dictionary.to_pylist()]
    if any(len(ops) > 65_535 for ops, _ in parsed):
        return pa.array([encode(row, ref_of) for row in _rows(batch)], pa.binary())
    which = cigars.indices.to_numpy()
    n_ops, span = np.array([len(ops) for ops, _ in parsed], np.int64)[which], np.array([x for _, x in parsed], np.int64)[which]
    ops = pa.array([struct.pack(f"<{len(o)}I", *o) for o, _ in parsed], pa.binary()).take(cigars.indices)

    def refs(k: str, same: int) -> np.ndarray:
        coded = column(k, "*", pa.string()).dictionary_encode()
        of = {"*": -1} | ({"=": same} if same else {})
        return np.array([of[x] if x in of else ref_of[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]

    ref = refs("rname", 0)
    mate = refs("rnext", -2)
    pos = number("pos", 0) - 1
    fixed = np.zeros(n, _FIXED)
    fixed["size"] = 32 + lengths + 1 + 4 * n_ops
    fixed["ref"], fixed["pos"], fixed["l_name"], fixed["n_ops"] = ref, pos, lengths + 1, n_ops
    fixed["bin"] = np.where(pos < 0, 4680, _bins(np.maximum(pos, 0), np.maximum(pos, 0) + np.maximum(span, 1))) & 0xFFFF
    fixed["next_ref"], fixed["next_pos"] = np.where(mate == -2, ref, mate), _fits(number("pnext", 0) - 1)
    _fits(pos)
    fixed["mapq"], fixed["flag"], fixed["tlen"] = _fits(number("mapq", 255), 0, 255), _fits(number("flag", 0), 0, 0xFFFF), _fits(number("tlen", 0))
    head = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 36).astype(np.int32)), pa.py_buffer(fixed.tobytes())])
    return pc.binary_join_element_wise(head, names, pa.scalar(b"\0"), ops, pa.scalar(b""))


def _fits(values: np.ndarray, low: int = -(1 << 31), high: int = (1 << 31) - 1) -> np.ndarray:
    if len(values) and not low <= values.min() <= values.max() <= high:
        raise ValueError(f"a number of a record isn't in {low} to {high}")
    return values


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows with maps as dictionaries."""
    for row in batch.to_pylist():
        yield {k: dict(v) if isinstance(v, list) else v for k, v in row.items()}


def encode_header(refs: list[tuple[str, int]], text: str = "") -> bytes:
    text = text or "@HD\tVN:1.6\tSO:unknown\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in refs)
    data = text.encode()
    out = [b"BAM\1", struct.pack("<i", len(data)), data, struct.pack("<i", len(refs))]
    for n, size in refs:
        out.append(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size))
    return b"".join(out)


class _Writer(TaskFilesWriter, DataSourceArrowWriter):
    """One file a task, or one for each value of file_column, by which rows come sorted.  The header is made once, in blocks of its own."""

    def __init__(self, options, schema) -> None:
        super().__init__(options["path"], ".bam")
        self.refs_uri, self.split, self.columns = options["references"], options.get("file_column"), schema.names

    def write(self, iterator) -> Written:
        fs, path = filesystem(self.refs_uri)
        with fs.open_input_stream(path) as f:
            refs = [tuple(x) for x in json.loads(f.read().decode())]
        ref_of = {n: k for k, (n, _) in enumerate(refs)}
        head = b"".join(bgzf.blocks(encode_header(refs)))
        made: list[tuple[str, str | None]] = []
        stream, held = None, bytearray()

        def put(most: int) -> None:
            for b in bgzf.blocks(bytes(held[:most])):
                stream.write(b)
            del held[:most]

        def close() -> None:
            if stream is not None:
                put(len(held))
                stream.write(bgzf.END)
                stream.close()

        for batch in iterator:
            if not batch.num_rows:
                continue
            keys, cuts = [None], [0, batch.num_rows]
            if self.split:
                coded = batch.column(self.split).dictionary_encode()
                borders = np.flatnonzero(np.diff(coded.indices.to_numpy())) + 1
                cuts = [0, *borders.tolist(), batch.num_rows]
                keys = [coded[k].as_py() for k in cuts[:-1]]
            done = encode_batch(batch.select([k for k in self.columns if k != self.split]), ref_of)
            at = np.frombuffer(done.buffers()[1], np.int32)[done.offset : done.offset + len(done) + 1]
            data = memoryview(done.buffers()[2])
            for key, first, last in zip(keys, cuts[:-1], cuts[1:], strict=True):
                if stream is None or key != made[-1][1]:
                    close()
                    name, stream = self.new_file()
                    made.append((name, key))
                    stream.write(head)
                held += data[at[first] : at[last]]
                if len(held) >= bgzf.MOST:
                    put(len(held) - len(held) % bgzf.MOST)
        close()
        return Written(made)


def _references(spark: SparkSession, sizes: DataFrame) -> str:
    """A file with the names and lengths of sizes (contig, size), in order of name, for the tasks that write; every BAM file holds them all."""
    uri = new_path(spark, "bam-references")
    fs, path = filesystem(uri)
    with fs.open_output_stream(path) as f:
        f.write(json.dumps([[r.contig, r.size] for r in sizes.select("contig", "size").orderBy("contig").toLocalIterator()]).encode())
    return uri


def write_bam(records: DataFrame, sizes: DataFrame, path: str, *, rows_per_file: int = 0, order: str = "name") -> None:
    """BAM files of records (columns of SCHEMA, in any order, absent ones are empty) with the references of sizes.

    One file a task; or, with rows_per_file, files split_0.bam, split_1.bam ... in the order of
    names, cut where rows_per_file records are reached and the name changes next: a read
    is never in two files.
    """
    spark = records.sparkSession
    spark.dataSource.register(BamSource)
    known = [c.split()[0] for c in SCHEMA.split(", ") if c != "file string"]
    records = records.select(*[c for c in known if c in records.columns])
    options = {"path": path, "references": _references(spark, sizes)}
    if not rows_per_file:
        records.write.format("bam_records").options(**options).mode("append").save()
        return
    placed = ranked(records, ["name", "flag", "rname", "pos"], "_place", name="bam-order")
    first = spool(placed.groupBy("name").agg(F.min("_place").alias("_first")), "bam-firsts")
    parts = placed.join(first, "name").withColumn("_part", F.expr(f"_first div {rows_per_file}"))
    parts = parts.repartition("_part").sortWithinPartitions("_part", "_place").select(*records.columns, "_part")
    parts.write.format("bam_records").options(**options, file_column="_part").mode("append").save()
    unspool(placed, first)
