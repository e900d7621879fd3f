"""Queries over streams: keyed state that says what to call, and calls that follow it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.plans.registry import T, query
from tessella.plans.rules import flaky
from tessella.sources.scratch import work_folder
from tessella.streaming import calls

HOUR = 3600

ACTIONS_SQL = """
WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'queued' ELSE 'request' END AS kind FROM events),
o AS (SELECT *, max(CASE WHEN kind = 'success' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done_at,
  sum((kind = 'success')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since FROM e),
n AS (SELECT *, (sum((kind = 'failure')::INT) OVER (PARTITION BY user_id, since ORDER BY ts, event_id))::INT AS tries FROM o),
r AS (SELECT user_id, ts, kind, tries, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_at FROM n WHERE kind <> 'request'),
m AS (SELECT max(ts) AS top FROM events)
SELECT user_id, ts AS at, CASE WHEN ts - done_at <= INTERVAL 24 HOUR THEN 'known' ELSE 'call' END AS action, tries FROM n WHERE kind = 'request'
UNION ALL SELECT user_id, ts, CASE kind WHEN 'success' THEN 'done' WHEN 'queued' THEN 'waiting' ELSE CASE WHEN tries > 3 THEN 'gave_up' ELSE 'retry_later' END END, tries FROM r
UNION ALL SELECT user_id, ts + to_hours((2 ** (tries - 1))::INT) AS due, 'retry', tries FROM r, m WHERE kind = 'failure' AND tries <= 3 AND due < least(coalesce(next_at, top), top)
UNION ALL SELECT user_id, ts + to_hours(8 * i::INT) AS due, 'poll', tries FROM r, m, range(1, 10000) t(i) WHERE kind = 'queued' AND due < least(coalesce(next_at, top), top)
"""


@query(ACTIONS_SQL)
def call_actions(s, d):
    """Events as requests and replies in three arrivals; the stream stops after each and goes on from its state."""
    calls.store_settings(s)
    kind = F.when(F.col("event_type") == "error", calls.FAILURE).when(F.col("event_type") == "purchase", calls.SUCCESS).when(F.col("event_type") == "view", calls.QUEUED).otherwise(calls.REQUEST)
    rows = T(s, d, "events").select("user_id", "ts", kind.alias("kind"), F.col("event_id").alias("seq"))
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    given, out, checkpoint = (work_folder(s, n) for n in ("arrivals", "actions", "checkpoint"))
    part = F.when(F.col("ts") < low + (high - low) / 3, 0).when(F.col("ts") < low + 2 * (high - low) / 3, 1).otherwise(2)
    for arrival in range(3):
        rows.where(part == arrival).write.mode("append").parquet(given)
        source = s.readStream.schema(rows.schema).parquet(given)
        calls.run_available(calls.next_actions(source, "user_id", wait=HOUR, most=3, poll=8 * HOUR, keep=24 * HOUR), out, checkpoint)
    return s.read.parquet(out)


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 NOT IN (0, 2) THEN 'a' || c_custkey END AS answer, CASE WHEN c_custkey % 5 IN (0, 2) THEN 2 ELSE 1 END::BIGINT AS calls FROM customer")
def followed_calls(s, d):
    """Every customer arrives twice: what is known is not called again, what failed is."""
    calls.store_settings(s)
    at, given, checkpoint = (work_folder(s, n) for n in ("results", "arrivals", "checkpoint"))
    for _ in range(2):
        T(s, d, "customer").select("c_custkey").write.mode("append").parquet(given)
        source = s.readStream.schema("c_custkey long").parquet(given)
        calls.follow(source, at, checkpoint, "c_custkey", flaky({}), "answer string, attempts int", wait=0.0, hold=10 * HOUR).awaitTermination()
    return s.read.parquet(at).groupBy("c_custkey").agg(F.max("answer").alias("answer"), F.count("*").alias("calls"))
