"""A scan of BigWig files as runs: spark.read.format("bigwig_runs"), and a writer of small ones.

One partition per file and chromosome; the file's index leads to the chromosome's data blocks, the rest isn't read.
Options: ``paths`` and ``samples`` (JSON lists), ``chrs`` (JSON list; all by default).
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RUNS = "chr string, sample string, start long, end long, score double"
#: Fixed values of the format.
MAGIC, CHROMOSOMES, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BEDGRAPH, VARIABLE, FIXED = 1, 2, 3


class BigWig:
    def __init__(self, path: str) -> None:
        self.file = open(path, "rb")
        head = self.file.read(64)
        self.order = "<" if struct.unpack_from("<I", head)[0] == MAGIC else ">"
        magic, _, _, chrom_at, _, self.index_at, _, _, _, _, buffer, _ = self.unpack("IHHQQQHHQQIQ", head)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a BigWig file")
        self.packed = buffer > 0
        self.chroms = {name: (number, length) for name, number, length in self._chroms(chrom_at)}

    def unpack(self, layout: str, data: bytes, at: int = 0) -> tuple:
        return struct.unpack_from(self.order + layout, data, at)

    def at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def _chroms(self, place: int) -> Iterator[tuple[str, int, int]]:
        magic, _, key, value = self.unpack("IIII", self.at(place, 16))
        if magic != CHROMOSOMES:
            raise ValueError("bad chromosome tree")
        todo = [place + 32]
        while todo:
            here = todo.pop()
            leaf, _, n = self.unpack("BBH", self.at(here, 4))
            item = key + (value if leaf else 8)
            data = self.at(here + 4, n * item)
            for k in range(n):
                if leaf:
                    name = data[k * item : k * item + key].rstrip(b"\0").decode()
                    yield (name, *self.unpack("II", data, k * item + key))
                else:
                    todo.append(self.unpack("Q", data, k * item + key)[0])

    def _blocks(self, number: int) -> Iterator[tuple[int, int]]:
        todo = [self.index_at + 48]
        while todo:
            here = todo.pop()
            leaf, _, n = self.unpack("BBH", self.at(here, 4))
            item = 32 if leaf else 24
            data = self.at(here + 4, n * item)
            for k in range(n):
                first, _, last, _ = self.unpack("IIII", data, k * item)
                if first <= number <= last:
                    if leaf:
                        yield self.unpack("QQ", data, k * item + 16)
                    else:
                        todo.append(self.unpack("Q", data, k * item + 16)[0])

    def runs(self, name: str) -> Iterator[tuple[int, int, float]]:
        """1-based runs of a chromosome, in order of place."""
        number = self.chroms[name][0]
        for place, size in sorted(self._blocks(number)):
            data = self.at(place, size)
            data = zlib.decompress(data) if self.packed else data
            chrom, start, _, step, span, kind, _, n = self.unpack("IIIIIBBH", data)
            if chrom != number:
                continue
            for k in range(n):
                if kind == BEDGRAPH:
                    a, b, v = self.unpack("IIf", data, 24 + 12 * k)
                elif kind == VARIABLE:
                    a, v = self.unpack("If", data, 24 + 8 * k)
                    b = a + span
                else:
                    a, v = start + step * k, self.unpack("f", data, 24 + 4 * k)[0]
                    b = a + span
                yield a + 1, b, v


class BigWigReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        wanted = json.loads(self.options["chrs"]) if self.options.get("chrs") else None
        out = []
        for path, sample in zip(json.loads(self.options["paths"]), json.loads(self.options["samples"]), strict=True):
            own = BigWig(path).chroms
            if wanted and (unknown := set(wanted) - set(own)):
                raise ValueError(f"{path} has no {', '.join(sorted(unknown))}; it has {', '.join(own)}")
            out += [InputPartition((path, sample, c)) for c in wanted or own]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, sample, name = partition.value
        for a, b, v in BigWig(path).runs(name):
            yield name, sample, a, b, float(v)


class BigWigSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bigwig_runs"

    def schema(self) -> str:
        return RUNS

    def reader(self, schema) -> DataSourceReader:
        return BigWigReader(dict(self.options))


def read_bigwig(spark: SparkSession, files: dict[str, str], chrs: Sequence[str] | None = None) -> DataFrame:
    """Runs of the samples' files; task retry takes the place of a loop over flaky reads."""
    spark.dataSource.register(BigWigSource)
    names = list(files)
    reader = spark.read.format("bigwig_runs").option("paths", json.dumps([files[n] for n in names])).option("samples", json.dumps(names))
    return (reader.option("chrs", json.dumps(list(chrs))) if chrs else reader).load()


def bigwig_bytes(lengths: dict[str, int], runs: Iterable[tuple[str, int, int, float]], per_block: int = 512) -> bytes:
    """A BigWig file, without zoom levels, of sorted 1-based runs."""
    names = list(lengths)
    key = max(map(len, names))
    blocks: list[tuple[int, int, int, bytes]] = []
    for number, name in enumerate(names):
        own = [r for r in runs if r[0] == name]
        for at in range(0, len(own), per_block):
            part = own[at : at + per_block]
            body = b"".join(struct.pack("<IIf", a - 1, b, v) for _, a, b, v in part)
            blocks.append((number, part[0][1] - 1, part[-1][2], zlib.compress(struct.pack("<IIIIIBBH", number, part[0][1] - 1, part[-1][2], 0, 0, BEDGRAPH, 0, len(part)) + body)))
    tree = struct.pack("<IIIIQQ", CHROMOSOMES, len(names), key, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names))
    tree += b"".join(n.encode().ljust(key, b"\0") + struct.pack("<II", i, lengths[n]) for i, n in enumerate(names))
    data_at = 64 + len(tree)
    data, leaves = struct.pack("<Q", len(blocks)), b""
    for number, a, b, body in blocks:
        leaves += struct.pack("<IIIIQQ", number, a, number, b, data_at + len(data), len(body))
        data += body
    index_at = data_at + len(data)
    index = struct.pack("<IIQIIIIQII", INDEX, max(1, len(blocks)), len(blocks), 0, 0, max(0, len(names) - 1), max(lengths.values()), index_at, 1, 0) + struct.pack("<BBH", 1, 0, len(blocks)) + leaves
    head = struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, 0, 64, data_at, index_at, 0, 0, 0, 0, 1 << 15, 0)
    return head + tree + data + index


def write_bigwig(runs: DataFrame, lengths: dict[str, int], folder: str) -> DataFrame:
    """One file per sample under ``folder``, a shared path; gives (sample, path). Samples without signal have none.

    A sample's runs meet in one task, as one file holds them: at most a run per position of the genome.
    """
    import os

    import pandas as pd

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        sample = pdf["sample"].iloc[0]
        pdf = pdf.sort_values(["chr", "start"])
        path = os.path.join(folder, f"{sample}.bw")
        with open(f"{path}.part", "wb") as f:
            f.write(bigwig_bytes(lengths, list(zip(pdf["chr"], pdf["start"], pdf["end"], pdf["score"], strict=True))))
        os.replace(f"{path}.part", path)
        return pd.DataFrame({"sample": [sample], "path": [path]})

    return runs.where("score > 0").select("chr", "sample", "start", "end", "score").groupBy("sample").applyInPandas(write, "sample string, path string")
