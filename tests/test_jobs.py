"""Job states kept by a stream, with a timer for jobs that never end."""

from datetime import datetime, timedelta

from lectern.plans import ingestion as ing
from lectern.streaming import jobs

EVENTS = "job_id string, event_seq long, status string, at timestamp, nodes long, error string"
START = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


def follow(spark, tmp_path, *batches):
    """Tables of the jobs after each batch of events, and the stored events."""
    rows = []
    for number, batch in enumerate(batches):
        frame = spark.createDataFrame([(j, n, s, at(t), nodes, error) for j, n, s, t, nodes, error in batch], EVENTS)
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/events")
        jobs.start_tracking(stream, f"{tmp_path}/out", "10 minutes", lost_after=3600, keep_for=7200).awaitTermination()
        rows.append({r.job_id: r for r in jobs.tracked_jobs(spark, f"{tmp_path}/out").collect()})
    return rows, spark.read.parquet(f"{tmp_path}/events")


def test_lost_job_fails_and_a_later_event_overrules(spark, tmp_path):
    first = [("a", 0, "queued", 0, None, None), ("a", 1, "processing", 1, None, None), ("b", 0, "queued", 0, None, None),
             ("b", 1, "processing", 2, None, None), ("b", 2, "completed", 5, 7, None)]
    (one, two, three), _ = follow(
        spark, tmp_path, first, [("c", 0, "queued", 90, None, None)], [("a", 2, "completed", 95, 3, None)])
    assert one["a"].status == "processing" and one["a"].completed_at is None
    assert (one["b"].status, one["b"].nodes) == ("completed", 7)
    assert (two["a"].status, two["a"].error, two["a"].completed_at) == ("failed", jobs.LOST, at(61))
    assert (two["c"].status, two["b"].status) == ("queued", "completed")
    assert (three["a"].status, three["a"].error, three["a"].nodes, three["a"].completed_at) == ("completed", None, 3, at(95))
    assert (three["a"].created_at, three["a"].started_at) == (at(0), at(1))


def test_equals_job_states(spark, tmp_path):
    """Events out of order, repeated, without a time, without a job, and a job with very many."""
    events = [("x", 2, "failed", 9, None, "broken"), ("x", 0, "queued", 3, None, None), ("x", 1, "processing", 4, None, None),
              ("x", 1, "processing", 4, None, None), ("y", 5, "queued", None, None, None), (None, 1, "queued", 4, None, None),
              ("z", None, "queued", 4, None, None), ("w", 1, None, 4, 2**60 + 1, None)]
    events += [("hot", n, "processing", 10, n, None) for n in range(3000)]
    (got,), stored = follow(spark, tmp_path, events)
    want = ing.job_states(stored.where("job_id is not null and event_seq is not null")).collect()
    assert len(want) == len(got) == 4
    for r in want:
        assert all(getattr(got[r.job_id], c) == r[c] for c in r.__fields__), r
    assert got["w"].nodes == 2**60 + 1


def test_no_events(spark, tmp_path):
    stream = spark.createDataFrame([], EVENTS)
    stream.write.parquet(f"{tmp_path}/events")
    got = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/events")
    assert jobs.track_jobs(got, "1 minute", 1, 1).columns == [
        "job_id", "version", "status", "nodes", "error", "created_at", "started_at", "completed_at"]
