"""Lines of gzip files of many members, for any split, and regions by their index."""

import gzip
import io
import random

import pytest

from weftline.sources import bgzf, gztext, readers


class Raw(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def bodies(seed, n=4000):
    r = random.Random(seed)
    return "\n".join(r.choice(["", "é", "a\tb", "x" * r.randrange(300), "1f8b08 \x1f\x8b"]) for _ in range(n))


def packed(data, cut, kind):
    parts = [data[k : k + cut] for k in range(0, len(data), cut)]
    if kind == "bgzip":
        return b"".join(b for p in parts for b in bgzf.blocks(p)) + bgzf.END
    return b"".join(gzip.compress(p, 1) for p in parts)


@pytest.mark.parametrize("kind, cut, tail", [("bgzip", 900, ""), ("bgzip", 65_280, "\n"), ("members", 5000, "\n"), ("members", 1 << 30, ""), ("members", 40, "\n\n")])
def test_every_line_once(kind, cut, tail):
    text = bodies(2, 400 if cut == 40 else 4000) + tail
    data = packed(text.encode(), cut, kind)
    raw = Raw(data)
    want = text.split("\n")
    want = want[:-1] if want[-1] == "" else want
    for split in (70, 1000, 30_000, 1 << 30):
        if split == 70 and len(data) > 30_000:
            continue
        got = [x.decode() for b in range(0, len(data), split) for some in gztext.lines(raw, b, min(b + split, len(data))) for x in some]
        assert got == want
        places = sorted({p for b in range(0, len(data), split) for p in gztext.members(raw, b, min(b + split, len(data))) if p < len(data)})
        assert places[0] == 0 and all(gztext._member_at(raw, p) for p in places)


def test_line_starts_with_members():
    """Lines that end where members do belong to the range before."""
    data = b"".join(b for k in range(50) for b in bgzf.blocks(f"line {k}\n".encode())) + bgzf.END
    raw = Raw(data)
    for split in range(20, 200, 7):
        got = [x for b in range(0, len(data), split) for some in gztext.lines(raw, b, min(b + split, len(data))) for x in some]
        assert got == [f"line {k}".encode() for k in range(50)]


def test_one_large_file_in_many_tasks(spark, tmp_path):
    text = bodies(5, 20_000)
    (tmp_path / "a.mgz").write_bytes(packed(text.encode(), 3000, "members"))
    t = gztext.read_lines(spark, f"file://{tmp_path}/a.mgz", split_bytes=3000)
    assert t.rdd.getNumPartitions() > 8
    assert sorted(x.value for x in t.collect()) == sorted(text.split("\n"))
    assert sorted(x.value for x in readers.text_lines(spark, f"file://{tmp_path}/a.mgz").collect()) == sorted(text.split("\n"))
    broken = (tmp_path / "a.mgz").read_bytes()[:-30]
    with pytest.raises((ValueError, OSError)):
        [x for x in gztext.lines(Raw(broken), 0, len(broken))]


def test_region_reads_its_members(spark, tmp_path):
    r = random.Random(7)
    rows = sorted((c, r.randrange(1, 100_000), r.choice(["A", "ACGT" * 10])) for c in ("c1", "c2", "c3") for _ in range(4000))
    lines = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"] + [f"{c}\t{p}\t.\t{a}\tG\t.\tPASS\t." for c, p, a in rows]
    uri, index = f"file://{tmp_path}/v", f"file://{tmp_path}/index"
    gztext.write_lines(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), uri)
    assert [x.name for x in (tmp_path / "v").glob("*.bgz")] and not (tmp_path / "v" / "_temporary").exists()
    gztext.build_index(spark, uri, index, chunk_bytes=3000)
    got = readers.read_vcf_region(spark, uri, index, "c2", 5000, 5400)
    assert sorted((x.chrom, x.pos, x.ref) for x in got.collect()) == [x for x in rows if x[0] == "c2" and x[1] <= 5400 and x[1] + len(x[2]) - 1 >= 5000]
    size = sum(f.stat().st_size for f in (tmp_path / "v").glob("*.bgz"))
    opened = gztext._Reader({"path": uri, "index": index, "chrom": "c2", "low": "5000", "high": "5400"}).ranges()
    assert 0 < sum(e - b for _, b, e in opened) < size / 5
    assert readers.read_vcf_region(spark, uri, index, "c9", 1, 10).collect() == []
