"""The manifest of a ledger: one small file for each commit, numbered without a gap.

A batch's rows lie in a folder of its attempt and are part of the ledger once a commit names the attempt; what an attempt that failed has left behind is never read.
A commit is a file that appears whole, under a number that was free: of two writers one gets it, and the other's batch isn't in the ledger until it is run again.

Each commit says what the next one needs: the next arrival number, the runs of the keyed tables, each stream's last batch and
up to which date rows are purged. So a writer reads the last commit alone, and the list of names, which is kept short.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.sources import files

SCHEMA = """version long, kind string, attempt string, ingest_date string, batch string, stream string, inputs string, first long, next long, n_rows long,
    counts map<string,long>, replaces array<string>, purged string"""


#: Commits that keep a file of their own, and others that are put together at once.
KEPT, LEAST = 16, 256


class Refused(ValueError):
    """A batch that can't be committed: its name stands for other inputs, or another writer was faster."""


@dataclass
class Commit:
    """kind: batch, merge, purge, tombstone or erasure. ``claims``: whether invalid first records claim their event IDs in this ledger."""

    kind: str
    attempt: str | None = None
    ingest_date: str | None = None
    batch: str | None = None
    stream: str | None = None
    inputs: str | None = None
    first: int = 0
    next: int = 0
    n_rows: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    replaces: list[str] = field(default_factory=list)
    purged: str = ""
    claims: bool | None = None
    live: dict[str, list[dict]] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)
    version: int = -1

    def following(self, kind: str, **changes) -> Commit:
        """A commit of another kind after this one, with all that carries over."""
        kept = {n: getattr(self, n) for n in ("next", "purged", "claims", "live", "streams")}
        return Commit(kind, **{"first": self.next, **kept, **changes}, version=self.version + 1)


def _folder(path: str) -> str:
    return f"{path.rstrip('/')}/manifest"


def latest(spark: SparkSession, path: str) -> Commit:
    """The last commit; one of version -1 if there is none."""
    found = _numbered(spark, path)
    return Commit(**json.loads(files.read(spark, f"{_folder(path)}/{found[-1]}"))) if found else Commit("none")


def commit(spark: SparkSession, path: str, entry: Commit) -> Commit:
    if not files.put(spark, f"{_folder(path)}/{entry.version:012d}.json", json.dumps(asdict(entry))):
        raise Refused(f"another writer made commit {entry.version} of {path}; run the batch again")
    return entry


def entries(spark: SparkSession, path: str) -> DataFrame:
    """All commits, each once."""
    if not files.names(spark, _folder(path)):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(_folder(path)).dropDuplicates(["version"])


def compact(spark: SparkSession, path: str, least: int = LEAST) -> int:
    """Puts the commits but the last KEPT together in one file of a line each, once they are ``least``; says how many they were.

    The file shows before the commits go, so one that is there twice counts once, and a compaction that was broken off is done again. A reader that has listed a file which then goes fails and reads again.
    """
    old = _numbered(spark, path)[:-KEPT]
    if len(old) < least:
        return 0
    texts = (json.loads(files.read(spark, f"{_folder(path)}/{n}")) for n in old)
    lines = [json.dumps({k: v for k, v in entry.items() if k not in ("live", "streams")}) for entry in texts]
    files.put(spark, f"{_folder(path)}/to-{old[-1]}", "\n".join(lines) + "\n")
    for n in old:
        files.remove(spark, f"{_folder(path)}/{n}")
    return len(old)


def _numbered(spark: SparkSession, path: str) -> list[str]:
    return [n for n in files.names(spark, _folder(path)) if re.fullmatch(r"\d{12}\.json", n)]


def visible(spark: SparkSession, path: str) -> DataFrame:
    """(attempt): those whose rows are part of the ledger."""
    all_ = entries(spark, path)
    gone = all_.select(F.explode("replaces").alias("attempt"))
    return all_.where("kind in ('batch', 'erasure') and attempt is not null").select("attempt").join(gone, "attempt", "left_anti")


def batch_of(spark: SparkSession, path: str, ingest_date: str, batch: str) -> Commit | None:
    """The commit of a named batch of a date."""
    found = entries(spark, path).where((F.col("kind") == "batch") & (F.col("ingest_date") == ingest_date) & (F.col("batch") == batch)).head(1)
    return Commit(**{k: v for k, v in found[0].asDict().items() if v is not None}) if found else None


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(ingest_date, batch, metric, n): what was counted while each batch was written."""
    return entries(spark, path).where("kind = 'batch'").select("ingest_date", "batch", F.explode("counts").alias("metric", "n"))
