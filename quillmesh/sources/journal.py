"""The landing directory as a data source of its own: ``spark.read.format("intake")`` and ``spark.readStream.format("intake")``.

``land`` numbers files in the order in which they show, so a line's arrival is its file's number and its place in the file: it is known without counting lines, is the same in
batch and stream and on every reading, and needs no sort. A stream's offset is the number up to which it has read. The driver lists names and sizes; executors read the files, small ones
several in one partition, as Arrow batches. The directory must be mounted where the executors run.

Options: ``path``; ``partitionBytes``, by which files are put together. Blank lines are lines; files of other names are none of the journal's.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "raw string, arrival long, file string"
#: Bits of an arrival number for the place in a file.
PLACE_BITS = 30


@dataclass
class Files(InputPartition):
    """The numbers of some files of a directory."""

    path: str
    numbers: tuple[int, ...]


class _Journal:
    def __init__(self, options: dict[str, str]):
        self.path = re.sub(r"^file:(//)?(?=/)", "", options["path"])
        self.size = int(options.get("partitionbytes", options.get("partitionBytes", 32 << 20)))

    def listed(self) -> list[tuple[int, int]]:
        """(number, bytes) of the files there are."""
        if not os.path.isdir(self.path):
            return []
        with os.scandir(self.path) as found:
            return sorted((int(f.name[:16]), f.stat().st_size) for f in found if re.fullmatch(r"\d{16}\.jsonl", f.name))

    def parts(self, first: int, end: int | None) -> list[Files]:
        out: list[list[int]] = []
        room = 0
        for n, size in self.listed():
            if n < first or (end is not None and n >= end):
                continue
            if size >= 1 << PLACE_BITS:
                raise ValueError(f"file {n} of {self.path} has more than {(1 << PLACE_BITS) - 1} bytes")
            if not out or size > room:
                out.append([])
                room = self.size
            out[-1].append(n)
            room -= size
        return [Files(self.path, tuple(p)) for p in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for n in partition.numbers:
            name = f"{n:016d}.jsonl"
            with open(os.path.join(partition.path, name), "rb") as f:
                data = f.read()
            lines = data.split(b"\n")
            if not lines[-1]:
                lines.pop()
            arrivals, at = [], n << PLACE_BITS
            for line in lines:
                arrivals.append(at)
                at += len(line) + 1
            texts = pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())
            yield pa.RecordBatch.from_arrays([texts, pa.array(arrivals, pa.int64()), pa.array([name] * len(lines), pa.string())], ["raw", "arrival", "file"])


class JournalReader(_Journal, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.parts(0, None) or [Files(self.path, ())]


class JournalStream(_Journal, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        return {"next": max((n + 1 for n, _ in self.listed()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.parts(start["next"], end["next"])


class IntakeSource(DataSource):
    """``format("intake")`` over a landing directory."""

    @classmethod
    def name(cls) -> str:
        return "intake"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> JournalReader:
        return JournalReader(dict(self.options))

    def streamReader(self, schema) -> JournalStream:
        return JournalStream(dict(self.options))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(raw, arrival, file) of all lines that have landed."""
    spark.dataSource.register(IntakeSource)
    return spark.read.format("intake").load(path)


def stream(spark: SparkSession, path: str) -> DataFrame:
    """(raw, arrival, file) as lines land."""
    spark.dataSource.register(IntakeSource)
    return spark.readStream.format("intake").load(path)


def landed(lines: DataFrame, path: str, rows: int = 1000) -> DataFrame:
    """Lands ``lines`` (raw, arrival) from the tasks that hold them, some rows a file; one row (file, n) for each. Run it once: every run lands again.

    The order of landing is that of the tasks, so a caller that wants one sorts into one partition or keeps what belongs together in one.
    """
    from quillmesh.sources.inbox import land

    path = re.sub(r"^file:(//)?(?=/)", "", path)

    def run(batches):
        for batch in batches:
            raw = batch["raw"].to_pylist()
            for a in range(0, len(raw), rows):
                part = raw[a : a + rows]
                yield pa.RecordBatch.from_arrays([pa.array([land(path, [r or "" for r in part])]), pa.array([len(part)], pa.int64())], ["file", "n"])

    return lines.select("raw").mapInArrow(run, "file string, n long")
