"""Views that derive location data from the event table, with the same SQL for both engines.

Constants never change: queries and their twins depend on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIXES_SQL = """
SELECT event_id AS fix_id, user_id % 150 AS device, user_id,
       1704067200000 + event_id * 5000 AS t_ms,
       -74e0 + (user_id % 150 % 40) * 4e-3 + (event_id % 97) * 5e-5 AS lon,
       40.6e0 + (user_id % 150 % 25) * 4e-3 + (event_id % 89) * 5e-5 AS lat,
       (event_id * 7919) % 120 AS acc
FROM events"""


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fix_id, device, user_id, t_ms, lon, lat, acc."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr("event_id AS fix_id", "user_id % 150 AS device", "user_id", "1704067200000 + event_id * 5000 AS t_ms",
                             "-74e0 + (user_id % 150 % 40) * 4e-3 + (event_id % 97) * 5e-5 AS lon",
                             "40.6e0 + (user_id % 150 % 25) * 4e-3 + (event_id % 89) * 5e-5 AS lat",
                             "(event_id * 7919) % 120 AS acc")
