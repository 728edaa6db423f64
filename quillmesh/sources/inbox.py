"""The landing directory: files of one JSON envelope a line.

Nothing in an envelope orders events, so a line's arrival number says when it landed: by the file's modification time, then its name, a number in the order of landing, then
the line's place in it. Batch and stream number alike.
"""

from __future__ import annotations

import json
import os
import re
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LANDED = ["time", "file", "block"]


def _landed() -> Column:
    return F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).alias("landed")


def numbered(lines: DataFrame) -> DataFrame:
    """(raw, arrival, file) of ``lines`` (raw, landed): whole numbers from 0 in the order of landing.

    A split of a file is read by one task in its order; the splits' counts, one row for each, are summed in theirs. Lines aren't sorted.
    """
    rows = lines.select("raw", "landed.*", F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy(*_LANDED).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"))
    earlier = Window.orderBy(*_LANDED).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(*_LANDED, "least", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    return rows.join(splits, _LANDED).select("raw", (F.col("first") + F.col("at") - F.col("least")).alias("arrival"), "file")


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    """(raw, arrival, file) of each line under ``path``, blank ones included."""
    return numbered(spark.read.text(path).select(F.col("value").alias("raw"), _landed()))


def stream_inbox(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(raw, landed): the lines as a stream."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.col("value").alias("raw"), _landed())


#: Files that each landing directory is known to have had, so that the next one needn't list it.
_KNOWN: dict[str, int] = {}


def _free(path: str) -> int:
    """A number that follows those of all files that have landed, purged ones included."""
    numbers = [int(n[:16]) + 1 for n in os.listdir(path) if re.fullmatch(r"\d{16}\.jsonl", n)]
    try:
        with open(os.path.join(path, ".next"), encoding="ascii") as f:
            numbers.append(int(f.read()))
    except (OSError, ValueError):
        pass
    return max([0, _KNOWN.get(path, 0), *numbers])


def land(path: str, envelopes: list[str]) -> str:
    """Writes envelopes as one file of the landing directory; it shows under its name only when whole.

    Names are numbers in the order in which files show: a number is taken by linking the finished file to it, which fails where another process has been faster. So no file ever shows before
    one of a smaller number, and whoever has read up to a number has missed nothing. The directory must be on a file system with hard links.
    An envelope's text stays as it is, but for line breaks: inside a JSON string there are none, outside they are white space.
    """
    os.makedirs(path, exist_ok=True)
    hidden = os.path.join(path, f".{uuid.uuid4().hex}")
    with open(hidden, "w", encoding="utf-8", newline="\n") as f:
        f.writelines(re.sub(r"[\r\n]+", " ", e) + "\n" for e in envelopes)
    n = _KNOWN[path] if path in _KNOWN else _free(path)
    while True:
        name = f"{n:016d}.jsonl"
        try:
            os.link(hidden, os.path.join(path, name))
            break
        except FileExistsError:
            n += 1
    os.unlink(hidden)
    _KNOWN[path] = n + 1
    with open(f"{hidden}-next", "w", encoding="ascii") as f:
        f.write(str(n + 1))
    os.replace(f"{hidden}-next", os.path.join(path, ".next"))
    return name


def _unique(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key occurs twice")
    return found


def _refused(name: str) -> None:
    raise ValueError(f"{name} is no JSON number")


def envelopes_of(body: str) -> list[str]:
    """The text of the body's one JSON value, or of each element if that is an array, unaltered. Raises ValueError for anything else."""
    decoder, skip = json.JSONDecoder(object_pairs_hook=_unique, parse_constant=_refused), re.compile(r"[ \t\r\n]*")
    pass_by = lambda i: skip.match(body, i).end()
    start = pass_by(0)
    value, end = decoder.raw_decode(body, start)
    if pass_by(end) != len(body):
        raise ValueError("more than one value")
    if not isinstance(value, list):
        return [body[start:end]]
    out, i = [], pass_by(start + 1)
    while body[i] != "]":
        _, end = decoder.raw_decode(body, i)
        out.append(body[i:end])
        i = pass_by(end)
        i = pass_by(i + 1) if body[i] == "," else i
    return out


class Endpoint:
    """HTTP submission: POST /intake with an envelope, or a JSON array of them, lands it and answers 202.

    It judges nothing but whether the body is JSON in UTF-8 without repeated keys, and lands the text that it got; a client may send again after
    any failure, because replays have no effect. Errors: 400 for a body or a length that can't be read, 404 for another path, 411 without
    a length, 413 for a body beyond ``limit``. What became of an envelope is read from the ledger by its event ID.
    """

    def __init__(self, landing: str, port: int = 0, limit: int = 1 << 20, host: str = "127.0.0.1"):
        class Handler(BaseHTTPRequestHandler):
            def do_POST(self) -> None:
                given = self.headers.get("Content-Length")
                if self.path != "/intake":
                    return self._say(404, {"error": "no such path"})
                if given is None:
                    return self._say(411, {"error": "a length is needed"})
                if not re.fullmatch(r"[0-9]{1,18}", given.strip()):
                    return self._say(400, {"error": "no such length"})
                if int(given) > limit:
                    return self._say(413, {"error": "too large"})
                try:
                    each = envelopes_of(self.rfile.read(int(given)).decode("utf-8"))
                except (ValueError, RecursionError):
                    return self._say(400, {"error": "not JSON"})
                self._say(202, {"file": land(landing, each), "envelopes": len(each)})

            def _say(self, status: int, answer: dict) -> None:
                data = json.dumps(answer).encode()
                self.close_connection = True
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]

    def __enter__(self) -> Endpoint:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self.server.shutdown()
        self.server.server_close()
