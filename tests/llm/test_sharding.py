from collections import Counter, defaultdict

import pytest

from quillmesh.llm import extendible_sharding as X


def brute(rows, limit):
    """Splits oversized buckets bit by bit; rows: (id, bytes, bits)."""
    out, open_ = [], [("", rows)]
    while open_:
        prefix, part = open_.pop()
        if sum(r[1] for r in part) <= limit or len(part) == 1 or len(prefix) == 64:
            out += [(r[0], r[1], prefix, sum(x[1] for x in part), len(part)) for r in part]
            continue
        halves = defaultdict(list)
        for r in part:
            halves[r[2][len(prefix)]].append(r)
        open_ += [(prefix + b, p) for b, p in halves.items()]
    return Counter(out)


@pytest.mark.parametrize("limit, step", [(1, 12), (700, 2), (3000, 3), (60_000, 12), (1 << 30, 12)])
def test_shards_match_brute_force(odd, limit, step):
    rows = X.hashed_rows(odd)
    got = X.assign_shards(rows, limit, step).collect()
    assert Counter((r.id, r.bytes, r.shard, r.shard_bytes, r.shard_docs) for r in got) == brute([tuple(r) for r in rows.select("id", "bytes", "bits").collect()], limit)
    assert all(r.local_depth == len(r.shard) for r in got)
    assert all(r.shard_bytes <= limit or r.shard_docs == 1 for r in got)


def test_directory_points_to_each_shard(odd):
    found = X.assign_shards(X.hashed_rows(odd), 30_000)
    rows = X.directory(found).collect()
    depth = rows[0].global_depth
    assert len({r["index"] for r in rows}) == len(rows) and all(len(r["index"]) == depth and r["index"].startswith(r.shard) for r in rows)
    assert {r.shard for r in rows} == {r.shard for r in found.collect()}


def test_copies_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "abc")] * 50, "doc_id long, text string")
    assert X.assign_shards(X.hashed_rows(docs), 30).agg({"shard_bytes": "max"}).first()[0] <= 30


def test_empty(none):
    assert X.assign_shards(X.hashed_rows(none)).count() == 0
