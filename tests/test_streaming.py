import datetime

from strandloom.streaming import arrivals

SCHEMA = "ts timestamp, a string, b string, genome_id string"


def arrive(spark, folder, rows):
    parsed = [(datetime.datetime.fromisoformat(t), a, b, g) for t, a, b, g in rows]
    spark.createDataFrame(parsed, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"file://{folder}/in")
    query = arrivals.write_edge_counts(stream, f"file://{folder}/out", f"file://{folder}/check")
    query.awaitTermination()
    found = {(r.start.isoformat(), r.src, r.dst): r.support for r in arrivals.read_edge_counts(spark, f"file://{folder}/out").collect()}
    operators = [o for p in query.recentProgress for o in p["stateOperators"]]
    return found, operators[-1]["numRowsTotal"], sum(o["numRowsDroppedByWatermark"] for o in operators)


def test_late_rows_inside_and_outside_the_delay(spark, tmp_path):
    first, second = ("2024-01-01T00:00:00", "x", "y"), ("2024-01-03T00:00:00", "x", "y")
    found, state, dropped = arrive(spark, tmp_path, [("2024-01-01T00:01:00", "x", "y", "g1"), ("2024-01-01T00:02:00", "y", "x", "g1"), ("2024-01-01T00:03:00", "y", "x", "g2")])
    assert (found, dropped) == ({first: 2}, 0)
    found, state, dropped = arrive(spark, tmp_path, [("2024-01-03T00:04:00", "x", "y", "g1")])
    assert (found, state, dropped) == ({first: 2, second: 1}, 1, 0)  # the old window is out of the state
    found, state, dropped = arrive(spark, tmp_path, [("2024-01-01T00:04:00", "x", "y", "g3"), ("2024-01-02T23:56:00", "x", "y", "g4"), ("2024-01-03T00:01:00", "x", "y", "g5")])
    assert (found, dropped) == ({first: 2, second: 2, ("2024-01-02T23:55:00", "x", "y"): 1}, 1)
    for day in range(4, 12):
        found, state, dropped = arrive(spark, tmp_path, [(f"2024-01-{day:02}T00:04:00", "x", "y", "g1")])
        assert state <= 2 and dropped == 0
    assert len(found) == 11


def test_a_batch_that_runs_again_replaces_its_own(spark, tmp_path):
    arrive(spark, tmp_path, [("2024-01-01T00:01:00", "x", "y", "g1")])
    before = arrivals.read_edge_counts(spark, f"file://{tmp_path}/out").collect()
    again = spark.read.parquet(f"file://{tmp_path}/out/batch=0")
    rows = spark.createDataFrame(again.collect(), again.schema)
    rows.write.mode("overwrite").parquet(f"file://{tmp_path}/out/batch=0")
    assert arrivals.read_edge_counts(spark, f"file://{tmp_path}/out").collect() == before
