"""A scan of BAM files as aligned blocks: spark.read.format("bam_blocks").

One partition per file, read as a stream of compressed blocks, so that memory does not grow with the file. Options:
``paths`` and ``samples`` (JSON lists), ``chrs`` (JSON list), ``require`` and ``exclude`` (flag bits that must be set or
unset), ``drop_d`` (leave deleted bases out), ``need_index`` (fail if a file has no index beside it).
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCKS = "chr string, sample string, start long, end long, read long"
#: Fixed values of the format: CIGAR operations by number, and those that use up the reference.
CIGAR = "MIDNSHP=X"
UNMAPPED = 0x4


def decompressed(path: str) -> Iterator[bytes]:
    """The contents of a blocked gzip file, block by block."""
    with open(path, "rb") as f:
        while head := f.read(12):
            extra = f.read(struct.unpack_from("<H", head, 10)[0])
            at, size = 0, None
            while at < len(extra):
                a, b, n = extra[at], extra[at + 1], struct.unpack_from("<H", extra, at + 2)[0]
                if (a, b) == (66, 67):
                    size = struct.unpack_from("<H", extra, at + 4)[0] + 1
                at += 4 + n
            if size is None:
                raise ValueError(f"{path} is not a blocked gzip file")
            body = f.read(size - 12 - len(extra))
            yield zlib.decompress(body[:-8], -15)


class Stream:
    """Reads of a given size over a sequence of chunks."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.held = chunks, b""

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            more = next(self.chunks, None)
            if more is None:
                break
            parts.append(more)
            have += len(more)
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]


def header(stream: Stream, path: str) -> list[tuple[str, int]]:
    """Chromosome names and lengths."""
    if stream.take(4) != b"BAM\x01":
        raise ValueError(f"{path} is not a BAM file")
    stream.take(struct.unpack("<i", stream.take(4))[0])
    out = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        name = stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", stream.take(4))[0]))
    return out


def blocks(start: int, cigar: Sequence[tuple[str, int]], drop_d: bool = False) -> list[tuple[int, int]]:
    """1-based stretches that the alignment covers: skips split it, and deletions on demand."""
    out, at, begun = [], start, None
    for op, n in cigar:
        if op in "M=X" or (op == "D" and not drop_d):
            begun = at if begun is None else begun
            at += n
        elif op in "ND":
            if begun is not None:
                out.append((begun, at - 1))
            begun, at = None, at + n
    if begun is not None:
        out.append((begun, at - 1))
    return out


def alignments(path: str, chrs: set[str] | None = None, require: int = 0, exclude: int = UNMAPPED, drop_d: bool = False) -> Iterator[tuple[str, int, int, int]]:
    """(chr, start, end, number of the read) of each covered stretch."""
    stream = Stream(decompressed(path))
    names = [n for n, _ in header(stream, path)]
    if chrs and (unknown := chrs - set(names)):
        raise ValueError(f"{path} has no {', '.join(sorted(unknown))}; it has {', '.join(names)}")
    number = 0
    while len(size := stream.take(4)) == 4:
        record = stream.take(struct.unpack("<i", size)[0])
        ref, pos, l_name, _, _, n_cigar, flag = struct.unpack_from("<iiBBHHH", record)
        number += 1
        if ref < 0 or flag & require != require or flag & (exclude | UNMAPPED) or (chrs and names[ref] not in chrs):
            continue
        codes = struct.unpack_from(f"<{n_cigar}I", record, 32 + l_name)
        for a, b in blocks(pos + 1, [(CIGAR[c & 15], c >> 4) for c in codes], drop_d):
            yield names[ref], a, b, number


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        paths = json.loads(self.options["paths"])
        if self.options.get("need_index", "false").lower() == "true" and (missing := [p for p in paths if not os.path.exists(f"{p}.bai")]):
            raise ValueError(f"no index for {', '.join(missing)}")
        return [InputPartition(x) for x in zip(paths, json.loads(self.options["samples"]), strict=True)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, sample = partition.value
        o = self.options
        chrs = set(json.loads(o["chrs"])) if o.get("chrs") else None
        for chr_, a, b, number in alignments(path, chrs, int(o.get("require", 0)), int(o.get("exclude", UNMAPPED)), o.get("drop_d", "false").lower() == "true"):
            yield chr_, sample, a, b, number


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return BamReader(dict(self.options))


def read_bam(spark: SparkSession, files: dict[str, str], chrs: Sequence[str] | None = None, **options) -> DataFrame:
    """Aligned blocks of the samples' files, ready for ``coverage.pileup``."""
    spark.dataSource.register(BamSource)
    names = list(files)
    reader = spark.read.format("bam_blocks").option("paths", json.dumps([files[n] for n in names])).option("samples", json.dumps(names))
    if chrs:
        reader = reader.option("chrs", json.dumps(list(chrs)))
    return reader.options(**{k: str(v).lower() for k, v in options.items()}).load()


def chrom_lengths(path: str) -> dict[str, int]:
    return dict(header(Stream(decompressed(path)), path))
