"""Hand-made files through the scans, and the streaming form of the pile-up."""

import struct
import zlib

import pytest

from basewise.operators import coverage
from basewise.sources import bam, bigwig
from basewise.streaming import pileup


def bgzf(data: bytes, size: int = 50) -> bytes:
    out = b""
    for part in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def record(ref, pos, cigar, flag=0):
    codes = b"".join(struct.pack("<I", n << 4 | bam.CIGAR.index(op)) for op, n in cigar)
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, 2, 0, 0, len(cigar), flag, 0, -1, -1, 0) + b"r\0" + codes
    return struct.pack("<i", len(body)) + body


@pytest.fixture
def bam_file(tmp_path):
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + n + b"\0" + struct.pack("<i", k) for n, k in ((b"chr1", 1000), (b"chr2", 500)))
    reads = [record(0, 10, [("S", 2), ("M", 5), ("N", 10), ("M", 5)]), record(0, 12, [("M", 3), ("D", 2), ("M", 3)], 16), record(1, 1, [("=", 4), ("I", 1), ("X", 4)]), record(-1, 0, [], 4)]
    path = tmp_path / "a.bam"
    path.write_bytes(bgzf(head + b"".join(reads)))
    return str(path)


def test_bam(spark, bam_file):
    rows = lambda **o: sorted(tuple(r)[:4] for r in bam.read_bam(spark, {"s": bam_file}, **o).collect())
    assert rows() == [("chr1", "s", 10, 14), ("chr1", "s", 12, 19), ("chr1", "s", 25, 29), ("chr2", "s", 1, 8)]
    assert ("chr1", "s", 12, 14) in rows(drop_d=True) and ("chr1", "s", 17, 19) in rows(drop_d=True)
    assert rows(chrs=["chr2"]) == [("chr2", "s", 1, 8)] and rows(require=16) == [("chr1", "s", 12, 19)] and len(rows(exclude=16)) == 3
    assert bam.chrom_lengths(bam_file) == {"chr1": 1000, "chr2": 500}
    for bad in ({"chrs": ["chr9"]}, {"need_index": True}):
        with pytest.raises(Exception, match="chr9|no index"):
            rows(**bad)
    assert coverage.pileup(bam.read_bam(spark, {"s": bam_file})).where("score = 2").first()["end"] == 14


def test_bigwig(spark, tmp_path):
    runs = [("chr1", 1, 10, 2.0), ("chr1", 11, 11, 3.5), ("chr2", 5, 400, 1.0)] + [("chr2", 500 + i, 500 + i, float(i)) for i in range(1, 600)]
    path = tmp_path / "a.bw"
    path.write_bytes(bigwig.bigwig_bytes({"chr1": 1000, "chr2": 5000}, runs, 100))
    got = sorted(tuple(r) for r in bigwig.read_bigwig(spark, {"s": str(path)}).collect())
    assert got == sorted((c, "s", a, b, v) for c, a, b, v in runs)
    assert bigwig.read_bigwig(spark, {"s": str(path)}, ["chr1"]).count() == 2
    with pytest.raises(Exception, match="chr7"):
        bigwig.read_bigwig(spark, {"s": str(path)}, ["chr7"]).count()
    table = spark.createDataFrame([(c, "t", a, b, v) for c, a, b, v in runs] + [("chr1", "none", 1, 2, 0.0)], bigwig.RUNS)
    written = bigwig.write_bigwig(table, {"chr1": 1000, "chr2": 5000}, str(tmp_path)).collect()
    assert [r["sample"] for r in written] == ["t"]
    assert sorted(tuple(r) for r in bigwig.read_bigwig(spark, {"t": written[0]["path"]}).collect()) == sorted((c, "t", a, b, v) for c, a, b, v in runs)


def test_streaming_equals_batch(spark, tmp_path):
    schema = "chr string, sample string, start long, end long"
    parts = [[("c", "s", 1, 9), ("c", "s", 5, 20)], [("c", "s", 8, 30), ("c", "t", 2, 3)], [("c", "s", 21, 22)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = pileup.depth_changes(stream, 16).writeStream.outputMode("complete").format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    every = spark.createDataFrame([r for p in parts for r in p], schema)
    assert sorted(map(tuple, pileup.runs_of(spark.table("changes"), 16).collect())) == sorted(map(tuple, coverage.pileup(every).collect()))
