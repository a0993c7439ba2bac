"""Rows that come out of order count as if they had come in order."""

import random

import pytest
from pyspark.sql import functions as F

from fleetwise.operators.rollup import unit_rollup
from fleetwise.spec import DEFAULT
from fleetwise.streaming import jobs as st
from fleetwise.streaming.reorder import reordered_risk_stream

KIND = "unit_id bigint, t_index int, timestamp_h double, score double"


def rows_of(units, n, seed):
    draw = random.Random(seed)
    return [(u, t, 2.0 * t, draw.randint(0, 1000) / 1000) for u in range(units) for t in range(n)]


def deliver(spark, batches, folder, spec, **options):
    """One run of the stream after each batch of files."""
    source, out, state = (f"{folder}/{n}" for n in ("in", "out", "cp"))
    query = None
    for batch in batches:
        spark.createDataFrame(batch, KIND).write.mode("append").parquet(source)
        stream = st.reading_stream(spark, source, spark.read.parquet(source).schema)
        query = reordered_risk_stream(stream, "score", out, state, spec, **options)
        query.awaitTermination()
    return st.unit_risk(spark.read.parquet(out)), query


def same_as_table(spark, got, rows):
    want = unit_rollup(spark.createDataFrame(rows, KIND), "score").toPandas().sort_values("unit_id")
    got = got.toPandas().sort_values("unit_id")
    for c in ("unit_id", "n_rows", "peak", "flagged"):
        assert got[c].tolist() == want[c].tolist(), c
    for c in ("risk", "high_risk_share"):
        assert got[c].tolist() == pytest.approx(want[c].tolist(), abs=1e-12), c


def test_shuffled_rows_give_the_batch_roll_up(spark, tmp_path):
    rows = rows_of(4, 150, 5)
    draw = random.Random(1)
    arrival = sorted(rows, key=lambda r: r[2] + draw.uniform(0, 20))
    cuts = [0, 131, 300, 600]
    batches = [arrival[a:b] for a, b in zip(cuts, cuts[1:])]
    batches[1] = [*batches[1], *batches[1][:30]]  # repeats inside the lateness
    spec = DEFAULT.but(block_rows=64)
    got, _ = deliver(spark, batches, str(tmp_path), spec, lateness_h=24)
    mark = max(r[2] for r in rows) - 24
    same_as_table(spark, got, [r for r in rows if r[2] <= mark])


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    rows = rows_of(2, 60, 6)
    late = [(0, 3, 6.0, 1.0), (1, 70, 10.0, 1.0)]
    got, _ = deliver(spark, [rows, late], str(tmp_path), DEFAULT, lateness_h=10)
    same_as_table(spark, got, [r for r in rows if r[2] <= 2.0 * 59 - 10])


def test_state_ends_with_idle_units_and_full_blocks(spark, tmp_path):
    spec = DEFAULT.but(block_rows=16)
    first = rows_of(5, 40, 7)
    later = [(9, t, 2.0 * t, 0.5) for t in range(400, 416)]
    last = [(9, t, 2.0 * t, 0.5) for t in range(800, 801)]
    got, query = deliver(spark, [first, later, last], str(tmp_path), spec, lateness_h=4, idle_h=48)
    assert {r["unit_id"]: r["n_rows"] for r in got.collect()} == {**{u: 40 for u in range(5)}, 9: 16}
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept <= 12  # the one waiting row of unit 9, its timer, and their indexes


def test_no_clock_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="timestamp_h is NULL or neg"):
        deliver(spark, [[(1, 0, None, 0.5)]], str(tmp_path), DEFAULT)


def test_the_session_keeps_its_state_store(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    deliver(spark, [rows_of(1, 20, 8)], str(tmp_path), DEFAULT)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
