import random

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import pfair_mixing as M


def test_every_block_runs_in_its_window_and_no_source_lags_a_block():
    r = random.Random(3)
    for _ in range(150):
        n = r.randint(1, 12)
        share = M.shares({f"s{i}": r.random() ** 3 + 0.001 for i in range(n)}, r.choice([20, 60, 100]))
        slots, at = sum(share.values()), M.period(share)
        assert sorted(t for x in at.values() for t in x) == list(range(slots))
        for s, x in at.items():
            assert len(x) == share[s]
            for k, t in enumerate(x):
                release, due = M.window(k, share[s], slots)
                assert release <= t < due
            for t in range(slots):
                assert abs(sum(y <= t for y in x) - (t + 1) * share[s] / slots) < 1


def test_phases_use_up_every_block():
    r = random.Random(4)
    for _ in range(50):
        blocks = {f"s{i}": r.randint(0, 300) for i in range(r.randint(1, 9))}
        found = M.phases(blocks, {s: r.random() + 0.01 for s in blocks}, 50)
        assert {s: sum(p["took"].get(s, 0) for p in found) for s in blocks} == blocks


@pytest.mark.parametrize("most", [500, 2])
def test_rows(odd, odd_rows, monkeypatch, most):
    monkeypatch.setattr(M, "MAX_SOURCES", most)
    monkeypatch.setattr(M, "BUCKET_ROWS", 4)
    got = M.schedule(odd, block_bytes=300).collect()
    assert len(got) == len(odd_rows)
    assert all(r.release <= r.slot < r.deadline for r in got)
    by_source = {}
    for r in got:
        key = r.source if most == 500 else None
        by_source.setdefault(key, []).append((r.before, r.bytes))
    if most == 500:  # the rows of a source lie end to end
        for rows in by_source.values():
            rows.sort()
            assert all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:])) and rows[0][0] == 0
    assert len({r.slot for r in got}) == len({(r.slot, r.block) for r in got})


def test_weights_set_the_mix(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit("x" * 100).alias("text"))
    got = M.schedule(docs, {"s0": 6, "s1": 3, "s2": 1}, block_bytes=1000, slots=10).where("phase = 0").collect()
    last = max(r.slot for r in got) + 1
    for source, w in (("s0", 0.6), ("s1", 0.3), ("s2", 0.1)):
        taken = sorted({r.slot for r in got if r.source == source})
        assert all(abs(sum(t < n for t in taken) - w * n) < 1 for n in range(1, last + 1))


def test_mixed_keeps_every_row(odd, odd_rows, none):
    clash = odd.withColumn("mix_h", F.lit("clash"))
    got = M.mixed(clash, block_bytes=300)
    assert got.columns == clash.columns and got.count() == len(odd_rows)
    key = lambda r: (r[0] is None, r[0], str(r[1]), str(r[3]))
    assert sorted((tuple(r[:5]) for r in got.collect()), key=key) == sorted(odd_rows, key=key)
    assert M.mixed(none).count() == 0 and M.schedule(none).count() == 0


def test_long_phases_stay_within_a_block_of_the_exact_weights():
    r = random.Random(7)
    size = {f"s{i:02d}": r.paretovariate(1.1) for i in range(19)}
    size["big"] = sum(size.values()) / 2
    n = {s: max(1, round(x / sum(size.values()) * 20_000)) for s, x in size.items()}
    weights = {s: x**0.5 for s, x in size.items()} | {"s00": 1e-4}
    total, first = sum(weights.values()), M.phases(n, weights)[0]
    at = {s: set(t) for s, t in first["at"].items()}
    length, done = sum(first["took"].values()), dict.fromkeys(n, 0)
    assert length > 2000
    for t in range(length):
        for s in n:
            done[s] += t in at[s]
            assert abs(done[s] - (t + 1) * weights[s] / total) < 1 + 1e-6


def test_sources_past_the_most_keep_their_weights(monkeypatch):
    monkeypatch.setattr(M, "MAX_SOURCES", 3)
    n = {f"s{i:02d}": 400 for i in range(20)}
    weights = {s: 1 + i % 4 for i, s in enumerate(n)}
    got = list(M.plan(n, weights))
    assert sorted((s, b) for s, b, *_ in got) == sorted((s, b) for s in n for b in range(400))
    assert sorted(x[2] for x in got) == list(range(8000)) and all(x[3] <= x[2] < x[4] for x in got)
    for s in n:
        slots = [x[2] for x in got if x[0] == s]
        assert slots == sorted(slots)
        took, total = sum(t < 2000 for t in slots), sum(weights.values())
        assert abs(took - 2000 * weights[s] / total) < 3


def test_position_survives_any_order_of_rows(odd):
    key = lambda df: sorted((str(r[0]), str(r[1]), r.mix_slot, r.mix_before) for r in df.collect())
    assert key(M.positioned(odd, block_bytes=300)) == key(M.positioned(odd.orderBy("n_chars").repartition(7), block_bytes=300))


def test_blocks_never_grow_by_themselves(spark, odd, monkeypatch):
    monkeypatch.setattr(M, "MAX_BLOCKS", 40)
    with pytest.raises(ValueError):
        M.schedule(odd.select("doc_id", "source", "text"), block_bytes=16)


def test_columns_of_the_mix_are_replaced(odd, odd_rows):
    clash = odd.withColumn("mix_slot", F.lit("x")).withColumn("MIX_before", F.lit(1)).withColumn("mix_slot_new", F.lit(2)).withColumn("before", F.lit(3))
    got = M.positioned(clash, block_bytes=300)
    assert got.columns == [*odd.columns, "mix_slot_new", "before", "mix_slot", "mix_before"] and got.count() == len(odd_rows)
    assert M.mixed(clash, block_bytes=300).columns == clash.columns


def test_many_copies_of_one_row(spark):
    """Ten million copies are numbered without an array of that length."""
    from quillmesh.llm.common import each_copy

    got = each_copy(spark.range(1).selectExpr("'x' as part", "10000000L as n"), "n", "copy").agg(F.count("*"), F.min("copy"), F.max("copy"), F.sum("copy"), F.min("part")).first()
    assert tuple(got) == (10_000_000, 0, 9_999_999, 10_000_000 * 9_999_999 // 2, "x")
    assert sorted(r.copy for r in each_copy(spark.createDataFrame([(1,), (7,), (8,)], "n long"), "n", "copy", 4).collect()) == sorted([0, *range(7), *range(8)])
