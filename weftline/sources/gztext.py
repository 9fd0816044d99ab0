"""Lines of gzip files of many members (bgzip, .mgz), read by many tasks, and an index of them by region.

    spark.dataSource.register(gztext.LinesSource)
    spark.read.format("gzip_lines").option("split_bytes", 8 << 20).load(path)   # value
    gztext.build_index(spark, path, index)                                      # VCF by default
    gztext.region_lines(spark, path, index, "chr1", 1000, 2000)

A file is cut into ranges of split_bytes; a task looks for the first member of its range (a
header from which a member inflates to its checksum) and reads the lines that start in the
range's members.  A line belongs to the range in whose members it starts, but for one that starts
with a member: that belongs to the range before, which reads on until its last line ends.
So every range but the first drops what stands before its first line break, and lines
over borders are read once.  A member is inflated as a stream, whatever its size; a file
of one member is one task.

The index has for stretches of about CHUNK compressed bytes, cut at members, the names in
one column and their least and largest positions, found in one distributed pass.  A region
opens the stretches that can hold it, which are ranges like others.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition

from ..functions.scratch import spool, unspool
from . import bgzf
from .taskfiles import TaskFilesWriter, Written, files, filesystem

SPLIT = 32 << 20
CHUNK = 1 << 18
_PIECE = 1 << 18
_BATCH = 4 << 20


def _inflated(raw, at: int) -> Iterator[bytes | int]:
    """Pieces of the member at at, and then where it ends; zlib checks lengths and checksums."""
    raw.seek(at)
    d = zlib.decompressobj(31)
    while not d.eof:
        data = raw.read(_PIECE)
        if not data:
            raise ValueError("the file ends inside a member")
        at += len(data)
        out = d.decompress(data)
        if out:
            yield out
    yield at - len(d.unused_data)


def _member_at(raw, at: int) -> bool:
    try:
        for _ in _inflated(raw, at):
            pass
        return True
    except (zlib.error, ValueError):
        return False


def first_member(raw, begin: int, end: int) -> int | None:
    """Place of the first member that starts in [begin, end)."""
    if not begin:
        return 0 if raw.size() else None
    at = begin
    while at < end:
        raw.seek(at)
        window = raw.read(1 << 17)
        k = window.find(b"\x1f\x8b\x08")
        while k >= 0 and at + k < end:
            # Reserved flags are never set.
            if k + 3 < len(window) and window[k + 3] < 32 and _member_at(raw, at + k):
                return at + k
            if k + 3 >= len(window):
                break
            k = window.find(b"\x1f\x8b\x08", k + 1)
        if len(window) < 4:
            return None
        at += len(window) - 3 if k < 0 else max(1, min(k, len(window) - 3))
    return None


def members(raw, begin: int, end: int) -> Iterator[int]:
    """Places of the members that start in [begin, end), and where the first one behind them does; blocks that tell their sizes aren't inflated."""
    at = first_member(raw, begin, end)
    size = raw.size()
    while at is not None and at < size:
        yield at
        if at >= end:
            return
        raw.seek(at)
        head = raw.read(18)
        if head[:4] == bgzf.MAGIC and head[12:14] == b"BC":
            at += struct.unpack_from("<H", head, 16)[0] + 1
        else:
            for x in _inflated(raw, at):
                at = x if isinstance(x, int) else at
    yield size


def lines(raw, begin: int, end: int) -> Iterator[list[bytes]]:
    """Lists of the lines of a seekable file that belong to the members of [begin, end)."""
    at = first_member(raw, begin, end)
    if at is None:
        return
    size = raw.size()
    held: list[bytes] = []
    dropping = begin > 0
    while at < size:
        over = at >= end
        for x in _inflated(raw, at):
            if isinstance(x, int):
                at = x
                break
            if dropping:
                _, mark, x = x.partition(b"\n")
                if not mark:
                    continue
                if over:
                    return
                dropping = False
                if not x:
                    continue
            if over:
                line, mark, _ = x.partition(b"\n")
                held.append(line)
                if mark:
                    yield [b"".join(held)]
                    return
                continue
            head, mark, rest = x.rpartition(b"\n")
            if not mark:
                held.append(rest)
                continue
            yield b"".join([*held, head]).split(b"\n")
            held = [rest] if rest else []
    if held and not dropping:
        yield [b"".join(held)]


def _strings(found: list[bytes]) -> pa.Array:
    found = [x[:-1] if x.endswith(b"\r") else x for x in found]
    try:
        return pa.array(found, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in found], pa.string())


class _Range(InputPartition):
    def __init__(self, path: str, ranges: list[tuple[int, int]]) -> None:
        self.path, self.ranges = path, ranges


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.uri, self.split, self.index = options["path"], int(options.get("split_bytes", SPLIT)), options.get("index")
        self.region = [options.get(k) for k in ("chrom", "low", "high")]

    def ranges(self) -> list[tuple[str, int, int]]:
        if not self.index:
            return [(path, begin, min(begin + self.split, size)) for path, size in files(self.uri) for begin in range(0, size, self.split)]
        import pyarrow.compute as pc
        import pyarrow.dataset as pads

        fs, path = filesystem(self.index)
        chrom, low, high = self.region
        every = (pc.field("chrom") == chrom) & (pc.field("high") >= int(low)) & (pc.field("low") <= int(high))
        t = pads.dataset(path, filesystem=fs, format="parquet").to_table(columns=["file", "from", "upto"], filter=every)
        return sorted(set(zip(t["file"].to_pylist(), t["from"].to_pylist(), t["upto"].to_pylist(), strict=True)))

    def partitions(self) -> list[InputPartition]:
        made: list[_Range] = []
        held = 0
        for path, begin, end in self.ranges():
            if not made or made[-1].path != path or held >= self.split:
                made.append(_Range(path, []))
                held = 0
            parts = made[-1].ranges
            if parts and parts[-1][1] == begin:
                parts[-1] = (parts[-1][0], end)
            else:
                parts.append((begin, end))
            held += end - begin
        return made

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no range is left
            return
        fs, _ = filesystem(self.uri)
        with fs.open_input_file(partition.path) as raw:
            for begin, end in partition.ranges:
                held: list[bytes] = []
                n = 0
                for some in lines(raw, begin, end):
                    held += some
                    n += sum(map(len, some))
                    if n > _BATCH:
                        yield pa.RecordBatch.from_arrays([_strings(held)], ["value"])
                        held, n = [], 0
                yield pa.RecordBatch.from_arrays([_strings(held)], ["value"])


class _Writer(TaskFilesWriter):
    def __init__(self, options) -> None:
        super().__init__(options["path"], ".bgz")

    def write(self, iterator) -> Written:
        name, stream = self.new_file()
        held = bytearray()
        for (value,) in iterator:
            held += (value or "").encode() + b"\n"
            if len(held) >= bgzf.MOST:
                most = len(held) - len(held) % bgzf.MOST
                for b in bgzf.blocks(bytes(held[:most])):
                    stream.write(b)
                del held[:most]
        for b in bgzf.blocks(bytes(held)):
            stream.write(b)
        stream.write(bgzf.END)
        stream.close()
        return Written([(name, None)])


class LinesSource(DataSource):
    """gzip_lines: reads any gzip files, writes block-compressed ones; value string."""

    @classmethod
    def name(cls) -> str:
        return "gzip_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def write_lines(rows: DataFrame, path: str) -> None:
    """The column value as lines of block-compressed files, one a task, in the order of the rows."""
    rows.sparkSession.dataSource.register(LinesSource)
    rows.select("value").write.format("gzip_lines").option("path", path).mode("append").save()


def read_lines(spark: SparkSession, path: str, *, split_bytes: int = SPLIT) -> DataFrame:
    spark.dataSource.register(LinesSource)
    return spark.read.format("gzip_lines").options(path=path, split_bytes=str(split_bytes)).load()


def _stretches(uri: str, chunk: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(uri)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(r["file"]) as raw:
                    at, made = None, []
                    for place in members(raw, r["begin"], r["end"]):
                        if at is None:
                            at = place
                        elif place - at >= chunk or place >= r["end"]:
                            made.append((at, place))
                            at = place
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(made), pa.string()), *[pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)]], ["file", "from", "upto"])

    return run


def _positions(uri: str, chrom: int, begin: int, end: int | None, ref: int | None):
    """file, from, upto and, for each name in the lines of a stretch, its least and largest positions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(uri)
        for batch in batches:
            for r in batch.to_pylist():
                held: dict[str, list[int]] = {}
                with fs.open_input_file(r["file"]) as raw:
                    for some in lines(raw, r["from"], r["upto"]):
                        for line in some:
                            f = line.split(b"\t")
                            if line.startswith(b"#") or len(f) <= max(chrom, begin, end or 0, ref or 0):
                                continue
                            try:
                                low = int(f[begin])
                                high = int(f[end]) if end is not None else low + (len(f[ref]) if ref is not None else 1) - 1
                            except ValueError:
                                continue
                            span = held.setdefault(f[chrom].decode("utf-8", "replace"), [low, high])
                            span[0], span[1] = min(span[0], low), max(span[1], high)
                n = len(held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]] * n, pa.string()), pa.array([r["from"]] * n, pa.int64()), pa.array([r["upto"]] * n, pa.int64()), pa.array(list(held), pa.string()), *[pa.array([v[k] for v in held.values()], pa.int64()) for k in (0, 1)]],
                    ["file", "from", "upto", "chrom", "low", "high"],
                )

    return run


def build_index(spark: SparkSession, path: str, index: str, *, chrom: int = 0, begin: int = 1, end: int | None = None, ref: int | None = 3, split_bytes: int = SPLIT, chunk_bytes: int = CHUNK) -> None:
    """Write the index of tab-separated text: numbers of the columns of names, first positions, and last ones or the allele whose length counts."""
    found = spark.createDataFrame(files(path), "file string, size long").where("size > 0")
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("begin")
    ranges = spool(found.select("file", "size", begins).select("file", "begin", F.least(F.col("begin") + split_bytes, "size").alias("end")), "gzip-ranges")
    n = min(max(1, ranges.count()), 10_000)
    stretches = spool(ranges.repartition(n, "file", "begin").mapInArrow(_stretches(path, chunk_bytes), "file string, from long, upto long"), "gzip-stretches")
    rows = stretches.repartition(n, "file", "from").mapInArrow(_positions(path, chrom, begin, end, ref), "file string, from long, upto long, chrom string, low long, high long")
    rows.repartitionByRange("chrom", "low").sortWithinPartitions("chrom", "low").write.parquet(index)
    unspool(ranges, stretches)


def region_lines(spark: SparkSession, path: str, index: str, chrom: str, low: int, high: int, *, split_bytes: int = SPLIT) -> DataFrame:
    """value: the lines of the stretches that can overlap [low, high] of chrom; others of their lines come along."""
    spark.dataSource.register(LinesSource)
    return spark.read.format("gzip_lines").options(path=path, index=index, chrom=chrom, low=str(low), high=str(high), split_bytes=str(split_bytes)).load()
