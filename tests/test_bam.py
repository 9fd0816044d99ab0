"""BAM files: every record once, whatever the ranges; an exact index; round trips; cuts at names."""

import io
import random
import struct

import pytest

from weftline.sources import bam, bgzf

SIZES = [("t", 100_000_000), ("u", 5000), ("v", 70)]


class Raw(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def made_reads(r, n, lengths):
    rows = []
    for i in range(n):
        seq = "".join(r.choices("ACGT", k=r.choice(lengths)))
        tags = {"NM": "2", "RG": "a group", "ML": "C," + ",".join(map(str, r.choices(range(256), k=len(seq) // 9)))} if seq and len(seq) > 9 else {"NM": str(r.choice([0, -5, 70_000])), "XF": "0.5"}
        rows.append({"name": f"read{i}", "flag": r.choice((0, 16, 4)), "rname": r.choice("tuv"), "pos": r.randint(1, 60), "mapq": r.randint(0, 60), "cigar": f"{len(seq)}M" if seq else "*", "rnext": r.choice("*u"), "pnext": r.randint(0, 9), "tlen": -3,
                     "seq": seq or "*", "qual": "".join(chr(33 + r.randint(0, 40)) for _ in seq) or "*", "tags": tags, "kinds": {"ML": "B", "XF": "f"}})
    return rows


def packed(rows, block=bgzf.MOST, sizes=SIZES):
    ref_of = {n: k for k, (n, _) in enumerate(sizes)}
    body = bam.encode_header(sizes) + b"".join(bam.encode(x, ref_of) for x in rows)
    out = []
    for k in range(0, len(body), block):
        out += bgzf.blocks(body[k : k + block], 1)
    return b"".join(out) + bgzf.END


def key(rows):
    return [(x["name"], x["flag"], x["rname"], x["pos"], x["mapq"], x["cigar"], x["rnext"], x["pnext"], x["tlen"], x["seq"], x["qual"]) for x in rows]


@pytest.fixture(scope="module")
def long_reads():
    """Some thousand reads, one of 900,000 bases and some of 1,200,000 side by side."""
    r = random.Random(3)
    rows = made_reads(r, 1500, [0, 3, 40, 700])
    rows[1000:1000] = made_reads(r, 1, [900_000])
    rows[200:200] = made_reads(r, 3, [1_200_000])
    return rows, packed(rows)


@pytest.mark.parametrize("split", [50_000, 200_000, 440_000, 480_000, 1 << 20, 64 << 20])
def test_every_record_once_for_every_split(long_reads, split):
    rows, data = long_reads
    raw = Raw(data)
    got = []
    for begin in range(0, len(data), split):
        got += bam.records(raw, begin, min(begin + split, len(data)))
    assert [g[:11] for g in got] == key(rows)


def test_index_walk_is_a_chain(long_reads):
    rows, data = long_reads
    raw = Raw(data)
    before, n = None, 0
    for begin in range(0, len(data), 300_000):
        first, after, chunks = bam.walk(raw, begin, min(begin + 300_000, len(data)), chunk=50_000)
        assert before is None or first == before
        again = bam.walk(raw, begin, min(begin + 300_000, len(data)), start=first, chunk=50_000)
        assert again == (first, after, chunks)
        before = after
        n += sum(c["n"] for c in chunks)
    assert n == len(rows)
    # Blocks inside a long record aren't inflated.
    f = bgzf.Inflated(raw)
    bam.header(f)
    seen = 0
    while (size := bam._next_size(f)) is not None:
        f.skip(size)
        seen += 1
    blocks, at = 0, 0
    while at < len(data):
        raw.seek(at)
        at += bgzf.read_block(raw)[0]
        blocks += 1
    assert seen == len(rows) and f.opened < blocks / 2


def test_broken_files_raise(long_reads):
    _, data = long_reads
    with pytest.raises(ValueError):
        list(bam.records(Raw(data[: len(data) // 2])))
    spoilt = bytearray(data)
    spoilt[len(data) // 3] ^= 255
    with pytest.raises(Exception):
        list(bam.records(Raw(bytes(spoilt))))
    with pytest.raises(ValueError):
        list(bam.records(Raw(b"not a file")))
    assert list(bam.records(Raw(packed([])))) == []


def test_looks_of_records_inside_a_read():
    """A read whose qualities and tags spell whole records: chains that don't go on aren't taken."""
    r = random.Random(9)
    ref_of = {n: k for k, (n, _) in enumerate(SIZES)}
    inner = b"".join(bam.encode(x, ref_of) for x in made_reads(r, bam.CHAIN - 1, [5, 30]))
    rows = made_reads(r, 40, [300])
    for x in rows[10:30]:
        x["tags"] = {"XB": "C," + ",".join(map(str, inner * 40))}
        x["kinds"] = {"XB": "B"}
    data = packed(rows, block=700)
    raw = Raw(data)
    got = [g[:11] for begin in range(0, len(data), 3000) for g in bam.records(raw, begin, min(begin + 3000, len(data)))]
    # Records inside a record are chains of 120 here: looks alone may err, the index may not.
    starts = []
    before = None
    for begin in range(0, len(data), 3000):
        first, after, _ = bam.walk(raw, begin, min(begin + 3000, len(data)), start=before)
        starts.append((first, after))
        before = after
    _, refs = bam.header(bgzf.Inflated(raw))
    exact = [g[:11] for a, b in starts for g in bam._between(bgzf.at_place(raw, a), refs, b, None)]
    assert exact == key(rows)
    assert set(key(rows)) <= set(got)


def test_index_mends_wrong_borders(spark, tmp_path):
    r = random.Random(9)
    ref_of = {n: k for k, (n, _) in enumerate(SIZES)}
    inner = b"".join(bam.encode(x, ref_of) for x in made_reads(r, 6, [5, 30]))
    rows = made_reads(r, 40, [300])
    for x in rows[10:30]:
        x["tags"], x["kinds"] = {"XB": "C," + ",".join(map(str, inner * 40))}, {"XB": "B"}
    (tmp_path / "a.bam").write_bytes(packed(rows, block=700))
    bam.build_index(spark, f"file://{tmp_path}/a.bam", f"file://{tmp_path}/index", split_bytes=3000, chunk_bytes=1000)
    got = bam.read_bam(spark, f"file://{tmp_path}/a.bam", f"file://{tmp_path}/index", split_bytes=6000)
    assert got.rdd.getNumPartitions() > 3
    assert sorted(tuple(x)[:11] for x in got.collect()) == sorted(key(rows))


def test_region_opens_only_its_stretches(spark, tmp_path):
    r = random.Random(4)
    rows = sorted(made_reads(r, 3000, [60, 200]), key=lambda x: x["rname"])
    for i, x in enumerate(rows):
        x["pos"] = 1 + i * 10
    (tmp_path / "a").mkdir()
    for k in range(2):
        (tmp_path / "a" / f"{k}.bam").write_bytes(packed(rows[k::2], block=2000))
    uri, index = f"file://{tmp_path}/a", f"file://{tmp_path}/index"
    bam.build_index(spark, uri, index, split_bytes=40_000, chunk_bytes=4000)
    t = bam.read_bam(spark, uri, index)
    assert sorted(tuple(x)[:11] for x in t.collect()) == sorted(key(rows))
    some = t.where("rname = 'u' and pos >= 12000 and pos < 12500")
    assert sorted(tuple(x)[:11] for x in some.collect()) == sorted(k for k in key(rows) if k[2] == "u" and 12_000 <= k[3] < 12_500)
    assert t.where("rname = 'nowhere'").collect() == []
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    reader = bam._IndexedReader({"path": uri, "index": index})
    whole = sum((b >> 16) - (a >> 16) for _, a, b in reader.stretches())
    list(reader.pushFilters([EqualTo(("rname",), "u"), GreaterThanOrEqual(("pos",), 12_000), LessThan(("pos",), 12_500)]))
    part = sum((b >> 16) - (a >> 16) for _, a, b in reader.stretches())
    assert 0 < part < whole / 10


def test_round_trip_and_cuts_at_names(spark, tmp_path):
    r = random.Random(6)
    rows = made_reads(r, 500, [0, 1, 30, 31])
    for i, x in enumerate(rows):
        x["name"] = f"n{i // r.choice([1, 1, 2, 7])}"
    kinds = bam.SCHEMA.replace(", file string", "")
    t = spark.createDataFrame([tuple(x[c.split()[0]] for c in kinds.split(", ")) for x in rows], kinds).repartition(4)
    sizes = spark.createDataFrame(SIZES, "contig string, size long")
    bam.write_bam(t, sizes, f"file://{tmp_path}/whole")
    assert len(list((tmp_path / "whole").glob("part-*.bam"))) == 4 and not (tmp_path / "whole" / "_temporary").exists()
    spark.dataSource.register(bam.BamSource)
    back = spark.read.format("bam_records").load(f"file://{tmp_path}/whole")
    full = lambda x: (*tuple(x)[:11], tuple(sorted(x["tags"].items())))
    assert sorted(map(full, back.collect())) == sorted((*k, tuple(sorted(x["tags"].items()))) for k, x in zip(key(rows), rows))
    bam.write_bam(t, sizes, f"file://{tmp_path}/cut", rows_per_file=60)
    cut = spark.read.format("bam_records").load(f"file://{tmp_path}/cut").collect()
    assert sorted(tuple(x)[:11] for x in cut) == sorted(key(rows))
    where = {}
    for x in cut:
        where.setdefault(x["name"], set()).add(x["file"])
    assert all(len(v) == 1 for v in where.values()) and len({f for v in where.values() for f in v}) == -(-len(rows) // 60)
    with pytest.raises(Exception):
        bam.write_bam(t.withColumn("rname", t["name"]), sizes, f"file://{tmp_path}/bad")
    assert not list((tmp_path).glob("bad/*.bam"))


def test_long_alignments_and_bins():
    ref_of = {"t": 0}
    d = bam.encode({"name": "a", "rname": "t", "pos": 10, "cigar": "1M1I" * 40_000, "seq": "AC" * 40_000}, ref_of)
    assert struct.unpack_from("<H", d, 16)[0] == 2
    assert bam._bin(0, 1) == 4681 and bam._bin(0, 1 << 15) == 585 and bam._bin((1 << 14) - 1, (1 << 14) + 1) == 585


def test_rows_in_batches_equal_single_ones():
    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    ref_of = {"t": 0, "u": 1, "v": 2}
    cigar = lambda: r.choice(("*", "5M", "3S10M2D", "7H900M", "1M70000N3M"))
    place = lambda: r.choice((None, 0, 1, 16_384, r.randrange(1 << 29)))
    rows = [{"name": r.choice((f"r{k}", "\u00e9\u00e9", None)), "flag": r.choice((None, 4, 65_535)), "rname": r.choice(("t", "u", "*", None)), "pos": place(), "mapq": r.choice((None, 0, 254)), "cigar": r.choice((cigar(), None)), "rnext": r.choice(("=", "*", "v", None)), "pnext": place(), "tlen": r.choice((None, -3, 9))} for k in range(500)]
    kinds = pa.schema([("name", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("rnext", pa.string()), ("pnext", pa.int64()), ("tlen", pa.int64())])
    batch = pa.RecordBatch.from_pylist(rows, kinds)
    for part, of in ((batch, rows), (batch.slice(17, 200), rows[17:217]), (batch.select(["name"]), [{"name": x["name"]} for x in rows])):
        made = bam.encode_batch(part, ref_of).to_pylist()
        assert made == [bam.encode(x, ref_of) for x in of]
    extra = [{**x, "seq": "AC" if k % 2 else "*", "tags": {"NM": "3"} if k % 3 else None} for k, x in enumerate(rows[:50])]
    full = pa.RecordBatch.from_pylist([{**x, "tags": list((x["tags"] or {}).items())} for x in extra], pa.schema([*kinds, ("seq", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))]))
    assert bam.encode_batch(full, ref_of).to_pylist() == [bam.encode(x, ref_of) for x in extra]

    names = ["t", "u", "v", "*"]
    for group in (rows, extra):
        held = [bam.encode(x, ref_of) for x in group]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])])[:-1].tolist()
        got = bam._decode_batch(b"".join(held), offsets, pa.array(names), "f")
        assert [tuple(dict(v) if isinstance(v, list) else v for v in x.values()) for x in got.to_pylist()] == [bam._decode(x[4:], lambda k: names[k], "f") for x in held]
    with pytest.raises(ValueError):
        bam.encode_batch(pa.RecordBatch.from_pylist([{"name": "a", "flag": 70_000}], pa.schema([("name", pa.string()), ("flag", pa.int32())])), ref_of)


def test_batches_equal_rows_over_all_splits():
    rows = [{"name": f"r{k}", "rname": "t", "pos": k + 1, "cigar": "5M"} for k in range(9000)]
    sizes = [("t", 1 << 20)]
    data = b"".join(bgzf.blocks(bam.encode_header(sizes))) + b"".join(b for k in range(0, 9000, 500) for b in bgzf.blocks(b"".join(bam.encode(x, {"t": 0}) for x in rows[k : k + 500]))) + bgzf.END
    for raw, split in ((Raw(data), 3000), (Raw(data), 1 << 20)):
        got, opened = [], bam._Opener()
        for begin in range(0, len(data), split):
            f = bam._seek(raw, begin, 1, opened(raw))
            if f is not None:
                got += [x for b in bam._batches(f, opened.names, min(begin + split, len(data)) << 16, None) for x in b.column(0).to_pylist()]
        assert got == [x["name"] for x in rows]
        assert opened.start is not None
    with pytest.raises(ValueError):
        cut = Raw(b"".join(bgzf.blocks(bam.encode_header(sizes))) + b"".join(bgzf.blocks(bam.encode(rows[0], {"t": 0})[:-3])))
        opened = bam._Opener()
        list(bam._batches(opened(cut), opened.names, len(cut.getvalue()) << 16, None))


def test_short_files_share_a_task(spark, tmp_path):
    sizes = spark.createDataFrame([("t", 1000)], "contig string, size long")
    rows = spark.createDataFrame([(f"r{k:03d}", 0, "t", k + 1) for k in range(200)], "name string, flag int, rname string, pos long")
    bam.write_bam(rows, sizes, f"file://{tmp_path}/b", rows_per_file=4)
    reader = bam._Reader({"path": f"file://{tmp_path}/b"})
    assert [len(t.ranges) for t in reader.partitions()] == [50]
    t = spark.read.format("bam_records").load(f"file://{tmp_path}/b")
    assert sorted((x.name, x.pos) for x in t.collect()) == [(f"r{k:03d}", k + 1) for k in range(200)]
    assert t.select("file").distinct().count() == 50
