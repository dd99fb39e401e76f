from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusmill.plans import surfaces as plans
from corpusmill.sources import corpus as sources

NOW = datetime(2024, 2, 1)


def test_turn_pairs_takes_every_session_of_the_look_back(spark, tmp_path):
    """Sixty recent sessions, one 80 days old (within the look-back of 90) and one 100 days old."""
    ages = {user: 1 + user % 5 for user in range(60)} | {60: 80, 61: 100}
    events = [(2 * u + i, u, kind, NOW - timedelta(days=age)) for u, age in ages.items() for i, kind in enumerate(("view", "error"))]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.session_id: (r.artifact_id, r.user_prompt, r.assistant_summary) for r in plans.turn_pairs(spark, str(tmp_path)).collect()}
    assert got == {str(u): (f"{u}#1", str(2 * u), str(2 * u + 1)) for u in range(61)}


def test_max_sessions(spark):
    turns = [(f"s{i}", t, role, f"{role} {i}", NOW - timedelta(days=i)) for i in range(6) for t, role in enumerate(("user", "assistant"))]
    turns = spark.createDataFrame(turns, "session_id string, turn int, role string, text string, ts timestamp")
    kept = lambda **x: sorted(r.session_id for r in sources.sessions(turns, F.lit("2024-02-01").cast("timestamp"), **x).items().collect())
    assert kept() == [f"s{i}" for i in range(6)] and kept(max_sessions=2) == ["s0", "s1"] and kept(since_days=3) == ["s0", "s1", "s2", "s3"]
