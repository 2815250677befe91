"""Streams give what their batch forms give."""

from pyspark.sql import functions as F

from sparkloom.streaming import activity


def test_hours_equal_batch(spark, sf_dir):
    stream = activity.source(spark, sf_dir, "events.parquet")
    got = activity.finish(activity.hourly(activity.distinct_events(stream)), "hours")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    want = events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    last = events.agg(F.max("ts") - F.expr("interval 2 hours")).first()[0]
    a = {(r.hour, r.event_type): r.n for r in got.collect() if r.hour < last}
    b = {(r.hour, r.event_type): r.n for r in want.collect() if r.hour < last}
    assert a and set(a.items()) <= set(b.items()) and len(b) - len(a) < 12


def test_sessions(spark, sf_dir):
    got = activity.finish(activity.sessions(activity.source(spark, sf_dir, "events.parquet")), "sessions")
    assert got.count() > 0 and got.where("n < 1").count() == 0
