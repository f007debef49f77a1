"""FASTA as a Python data source: chunks of sequence with what surrounds them."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Chunk(InputPartition):
    def __init__(self, chrom: str, offset: int, bases: int, width: int, line: int, first: int, last: int):
        super().__init__((chrom, first))
        self.at = (chrom, offset, bases, width, line, first, last)


def index(path: str) -> list[tuple[str, int, int, int, int]]:
    """name, length, offset, bases and bytes per line of every sequence: the .fai beside the file, or one made by
    reading the file once."""
    if os.path.exists(path + ".fai"):
        with open(path + ".fai") as f:
            return [(w[0], *(int(x) for x in w[1:5])) for w in (line.split("\t") for line in f) if len(w) >= 5]
    out: list[list] = []
    at = 0
    with open(path, "rb") as f:
        for line in f:
            body = line.rstrip(b"\r\n")
            if body.startswith(b">"):
                out.append([body[1:].split()[0].decode(), 0, at + len(line), 0, 0])
            elif out:
                if not out[-1][3]:
                    out[-1][3], out[-1][4] = len(body), len(line)
                out[-1][1] += len(body)
            at += len(line)
    return [tuple(x) for x in out]


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size, self.pad = int(options.get("chunk", 1 << 20)), int(options.get("pad", 64))
        self.per_task = max(1, int(options.get("chunksPerTask", 8)))

    def partitions(self) -> list[InputPartition]:
        step = self.size * self.per_task
        return [_Chunk(name, offset, length, bases, line, a, min(a + step, length)) for name, length, offset, bases, line in index(self.path) for a in range(0, length, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        chrom, offset, length, width, line, first, last = partition.at
        with open(self.path, "rb") as f:
            for start in range(first, last, self.size):
                a, z = max(0, start - self.pad), min(length, start + self.size + self.pad)
                f.seek(offset + a // width * line + a % width)
                raw = f.read((z - 1) // width * line + (z - 1) % width + 1 - (a // width * line + a % width))
                yield chrom, start, min(self.size, length - start), start - a, raw.replace(b"\n", b"").replace(b"\r", b"").decode().upper(), self.size


class FastaSource(DataSource):
    """chrom, start (0-based), length, lead (bases before start in seq), seq (upper case, with up to ``pad`` bases of
    both neighbours), size (the step)."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "chrom STRING, start BIGINT, length BIGINT, lead BIGINT, seq STRING, size BIGINT"

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 20, pad: int = 64) -> DataFrame:
    """Sequence chunks of a FASTA that every executor can open at ``path``."""
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").option("chunk", chunk).option("pad", pad).load(path)
