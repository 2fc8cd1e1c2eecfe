"""As-of lookups of offsets that go through the shuffle as rows of a block."""

import random

import pytest
from pyspark.sql import functions as F

from scopeforge.operators.ranges import asof_lines, range_join


@pytest.mark.parametrize("block", [16, 256, 1000])
def test_packed_offsets_meet_the_lines_that_cover_them(spark, block):
    """Unknown, negative and far offsets, repeats, lines that overlap, other columns; against the range join."""
    rng, rows, lines = random.Random(3), [], []
    for f in range(1, 20):
        at = 0
        for i in range(rng.randrange(1, 30)):
            n = rng.choice([0, 1, 3, 40, 700])
            lines.append((f, i, at, n))
            at += n + 1
        for k in range(rng.randrange(0, 200)):
            rows.append((rng.choice([f, f, f, None]), rng.choice([None, *[rng.randrange(-3, at + 5)] * 9]), f"x{k}", None if k % 3 else [k]))
    lines += [(2, 99, 5, 400), (2, 98, 5, 400), (None, 1, 0, 10)]
    offsets = spark.createDataFrame(rows, "file_id long, off long, tag string, more array<int>")
    lines = spark.createDataFrame(lines, "file_id long, line long, line_start long, line_len long")
    spans = lines.select("file_id", "line", "line_start", (F.col("line_start") + F.col("line_len")).alias("end"))
    want = range_join(offsets, spans, ["file_id"], "off", "line_start", "end").withColumn("col", F.col("off") - F.col("line_start")).drop("end")
    found = asof_lines(offsets, lines, "file_id", block=block)
    assert found.columns == want.columns and found.count() > 1000
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, asof_lines(offsets, lines, "file_id", block=block, packed=False).collect())) == sorted(map(str, want.collect()))


def test_offsets_of_a_block_cross_the_shuffle_as_one_row(spark):
    import pyarrow as pa
    from scopeforge.operators import ranges
    from scopeforge.plans import extract_queries as EQ
    plan = EQ.q_offset_to_line(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("_low") > 1     # packed in front of the join, looked up behind it
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 5120), pa.array(range(5120))], ["file_id", "off"])
    rows = pa.Table.from_batches(ranges._packed(256, iter([batch]))).to_pylist()
    assert [r["_bin"] for r in rows] == list(range(20)) and rows[3]["_low"] == bytes(range(256))
