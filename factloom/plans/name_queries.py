"""Queries of what names of media and programs hold, over names that orders make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.media_names import media_facts


def media_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else text(p) for p in parts])
    name = F.get(F.array(
        join("IMG-", F.date_format("o_orderdate", "yyyyMMdd"), "-WA", F.lpad(text(k % 10000), 4, "0"), ".jpg"), join("received_", F.lpad(text(k), 12, "1"), ".jpeg"), join("CamScanner ", k, ".pdf"),
        join("Tool_", k % 9, ".", k % 7, ".", k % 5, "-setup.exe"), join("Kick ", k % 100 + 40, "bpm.wav"), join("0", k % 9 + 1, " - Artist", k % 50, " - Song ", k, " (Official Video).mp3"),
        join("Show.Name", k % 9, ".S0", k % 9 + 1, "E1", k % 10, ".720p.WEB-DL-GRP.mkv"), join("Film ", k % 100, " ", k % 90 + 1950, " 1080p x264.mkv"),
    ), (k % 8).cast("int"))
    found = o.select("o_orderkey", *media_facts(name))
    return found.select(
        "o_orderkey", "messaging.from_app", F.col("scan_name.from_app").alias("scan_app"), "software.version", "software.product", "sample.sample_type", "sample.bpm", "music.track", "music.artist", "music.song_title",
        "release.title", "release.season", "release.episode", "release.release_year", "release.resolution", "release.release_group",
    )


#: What each kind of name was made of; a number may be a drum machine's.
MEDIA_SQL = """
WITH o AS (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 8 AS t FROM orders)
SELECT o_orderkey, CASE t WHEN 0 THEN 'WhatsApp' WHEN 1 THEN 'Facebook Messenger' END AS from_app, CASE t WHEN 2 THEN 'CamScanner' END AS scan_app,
       CASE t WHEN 3 THEN (k % 9) || '.' || (k % 7) || '.' || (k % 5) END AS version, CASE t WHEN 3 THEN 'Tool' END AS product, CASE WHEN t = 4 THEN 'kick' WHEN t IN (2, 5) AND k IN (707, 808, 909) THEN k::VARCHAR END AS sample_type, CASE t WHEN 4 THEN (k % 100 + 40)::INTEGER END AS bpm,
       CASE t WHEN 5 THEN (k % 9 + 1)::INTEGER END AS track, CASE t WHEN 5 THEN 'Artist' || (k % 50) END AS artist, CASE t WHEN 5 THEN 'Song ' || k END AS song_title,
       CASE t WHEN 6 THEN 'Show Name' || (k % 9) WHEN 7 THEN 'Film ' || (k % 100) END AS title, CASE t WHEN 6 THEN (k % 9 + 1)::INTEGER END AS season, CASE t WHEN 6 THEN (10 + k % 10)::INTEGER END AS episode,
       CASE t WHEN 7 THEN (k % 90 + 1950)::INTEGER END AS release_year, CASE t WHEN 6 THEN '720p' WHEN 7 THEN '1080p' END AS resolution, CASE t WHEN 6 THEN 'GRP' END AS release_group
FROM o
"""

QUERIES = {"media_names": media_names}
ORACLE_SQL = {"media_names": MEDIA_SQL}
