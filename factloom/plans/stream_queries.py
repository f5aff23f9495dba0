"""Queries that run a stream over a table to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.state import shared_root
from factloom.streaming import queue

DAY = 86_400


def settled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily looks at a folder for each event type, in which events are files; some looks fail, and the rules change in the middle."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / DAY)
    e = e.select("event_type", "user_id", day.alias("day")).where((F.col("day") * 7 + F.char_length("event_type")) % 5 != 0)
    place, look = F.col("user_id") % 40, F.struct(F.col("event_type").alias("root"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("mark"), F.lit(None).cast("string").alias("rules"), (F.col("day") * DAY).alias("seen"))
    sight = F.struct(
        F.col("event_type").alias("root"), F.concat(F.lit("/u"), place.cast("string")).alias("path"), F.floor(F.col("day") / (4 + place % 5)).cast("string").alias("mark"),
        F.concat(F.lit("r"), F.floor(F.col("day") / 15).cast("string")).alias("rules"), (F.col("day") * DAY).alias("seen"),
    )
    folder = f"{shared_root(spark)}/factloom/settling-{uuid.uuid4().hex}"
    query = queue.run_queue(e.select(F.inline(F.array(sight, look))), folder, 2 * DAY, buckets=4)
    query.awaitTermination()
    return spark.read.schema(queue.EVENTS).parquet(f"{folder}/events/*").where("event = 'settled'").select("root", "path", "mark", "rules", "since", "at")


SETTLED_STREAM_SQL = """
WITH e AS (SELECT event_type AS root, user_id % 40 AS place, floor(epoch(ts) / 86400)::BIGINT AS day FROM events),
looks AS (SELECT DISTINCT root, place, day FROM e WHERE (day * 7 + length(root)) % 5 <> 0),
days AS (SELECT root, day, row_number() OVER (PARTITION BY root ORDER BY day) AS look FROM (SELECT DISTINCT root, day FROM looks)),
seen AS (SELECT root, place, day, look, (day // (4 + place % 5))::VARCHAR AS mark, 'r' || (day // 15) AS rules FROM looks JOIN days USING (root, day)),
islands AS (SELECT *, look - row_number() OVER (PARTITION BY root, place, mark, rules ORDER BY look) AS island FROM seen),
stands AS (SELECT *, min(day) OVER (PARTITION BY root, place, mark, rules, island) AS since FROM islands)
SELECT root, '/u' || place AS path, mark, rules, (since * 86400)::DOUBLE AS since, (min(day) * 86400)::DOUBLE AS at
FROM stands WHERE day - since >= 2 GROUP BY root, place, mark, rules, island, stands.since
"""

QUERIES = {"settled_stream": settled_stream}
ORACLE_SQL = {"settled_stream": SETTLED_STREAM_SQL}
