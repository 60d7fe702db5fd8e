"""Event windows over the whole table."""

from __future__ import annotations

from graphloom.plans.registry import query, table
from graphloom.streaming import windows


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"))


@query("events_sliding", "SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1")
def events_sliding(spark, sf_dir):
    return windows.sliding(table(spark, sf_dir, "events"))


@query("events_session", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, g""")
def events_session(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"))
