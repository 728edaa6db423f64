"""The registered queries over the landing directory: its data source, the endpoint that fills it, and replays by stream state."""

from __future__ import annotations

import http.client

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.plans.intake import canonical, outcomes
from quillmesh.sources import journal
from quillmesh.sources.inbox import Endpoint, envelopes_of
from quillmesh.sources.scratch import folder
from quillmesh.sources.synthetic import SQL, inbox
from quillmesh.streaming import keyed_state


def _landing(spark: SparkSession) -> str:
    """A landing directory must be mounted, so the shared folder must be."""
    return folder(spark, "landing").removeprefix("file://")


def _lines_landed(spark: SparkSession, sf_dir: str) -> str:
    """All lines land, those of an event in their order."""
    path = _landing(spark)
    journal.landed(inbox(spark, sf_dir), path).agg(F.sum("n")).collect()
    return path


def _written(spark: SparkSession, stream: DataFrame) -> DataFrame:
    out = folder(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def intake_source(spark, sf_dir):
    """The landing directory read by its data source, as a table and as a stream: the lines of each channel and their arrival numbers."""
    path = _lines_landed(spark, sf_dir)
    both = journal.read(spark, path).withColumn("how", F.lit("batch")).unionAll(_written(spark, journal.stream(spark, path)).withColumn("how", F.lit("stream")))
    rows = canonical(both.select(F.concat("how", F.lit("/"), "file").alias("file"), "raw", "arrival")).withColumn("how", F.substring_index("file", "/", 1))
    return rows.groupBy("how", "channel").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("arrival").alias("n_arrivals"))


def stateful_replay(spark, sf_dir):
    """Outcomes of each event ID by keyed stream state, its fingerprints in RocksDB."""
    path = _lines_landed(spark, sf_dir)
    with keyed_state.rocksdb(spark):
        rows = _written(spark, keyed_state.judged(journal.stream(spark, path).select("raw", "arrival")))
    return rows.groupBy("channel", "outcome", F.array_join("errors", ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


def _post(c: http.client.HTTPConnection, body: str) -> int:
    c.request("POST", "/intake", body.encode())
    with c.getresponse() as answer:
        answer.read()
        return answer.status


def _posted(lines: DataFrame, host: str, port: int, each: int = 200) -> DataFrame:
    """Posts the lines from the tasks that hold them, ``each`` in one body; (status, n) of what was answered. A line that is no JSON goes alone, since its body is refused."""

    def is_json(raw: str) -> bool:
        try:
            return len(envelopes_of(raw)) == 1
        except ValueError:
            return False

    def run(batches):
        c = http.client.HTTPConnection(host, port, timeout=60)
        for batch in batches:
            raw = batch["raw"].to_pylist()
            good, bad = [r for r in raw if is_json(r)], [r for r in raw if not is_json(r)]
            found = [(_post(c, f"[{','.join(good[a : a + each])}]"), len(good[a : a + each])) for a in range(0, len(good), each)] + [(_post(c, r), 1) for r in bad]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found)], ["status", "n"])
        c.close()

    return lines.select("raw").mapInArrow(run, "status long, n long")


def endpoint_submission(spark, sf_dir):
    """All lines are sent over HTTP by the tasks that make them; what landed is judged, what was refused is counted. A task that runs again sends again, as a client may; those are replays."""
    path, host = _landing(spark), spark.conf.get("spark.driver.host")
    with Endpoint(path, host=host) as server:
        answers = _posted(inbox(spark, sf_dir), host, server.port).groupBy("status").agg(F.sum("n").alias("n")).collect()  # a row for each status
    refused = spark.createDataFrame([(None, f"HTTP {r['status']}", r["n"]) for r in answers if r["status"] != 202], "channel string, outcome string, n long")
    judged = outcomes(journal.read(spark, path).select("raw", "arrival"))
    return judged.groupBy("channel", "outcome").agg(F.count(F.lit(1)).alias("n")).unionAll(refused)


QUERIES = {f.__name__: f for f in (intake_source, stateful_replay, endpoint_submission)}

ORACLES = {
    "intake_source": SQL + "select how, channel, count(*) as n, count(*) as n_arrivals from lines, (values ('batch'), ('stream')) t(how) group by all",
    "stateful_replay": SQL + "select channel, outcome, array_to_string(errors, ',') as errors, count(*) as n from outcomes group by all",
    "endpoint_submission": SQL + "select channel, outcome, count(*) as n from outcomes where not broken group by all union all select null, 'HTTP 400', count(*) from lines where broken having count(*) > 0",
}
