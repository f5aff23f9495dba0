"""Queries of where files came from and of keeping records up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.provenance import provenance
from factloom.operators import upkeep


def page_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as downloads: their URLs, with records of browsers, messengers and zones, in folders of several kinds."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    k = F.col("page_id")
    pick = lambda every, *values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (k % every).cast("int"))
    path = F.concat(pick(5, "/home/me/Downloads/", "/media/usb/Music/", "/home/me/Dropbox/Documents/", "C:\\Users\\me\\Desktop\\", "/srv/x/"), k.cast("string"), F.lit(".html"))
    quarantine = F.concat(F.lit("0083;"), F.lower(F.hex(k + 1_700_000_000)), F.lit(";"), pick(7, "Google Chrome", "WhatsApp", "Some Tool", None, None, "", "Mail"), F.lit(";id"))
    zone = F.when(k % 7 == 4, F.concat(F.lit("[ZoneTransfer]\r\nZoneId="), (k % 5).cast("string"), F.lit("\r\nReferrerUrl=https://ref.example/\r\nHostUrl="), F.col("url"), F.lit("\r\n")))
    found = provenance(path, F.when(k % 7 < 2, F.array("url", F.lit("https://from.example/a"))), quarantine, zone)
    return p.select("page_id", found.alias("_p")).select("page_id", "_p.*").drop("from_host", "source").withColumn("downloaded", F.date_format("downloaded", "yyyy-MM-dd HH:mm:ss"))


PROVENANCE_SQL = """
WITH p AS (SELECT page_id, url, page_id AS k, page_id % 7 AS a, page_id % 5 AS f FROM pages),
m AS (
    SELECT *, f = 2 AS in_cloud, a IN (0, 1) OR a = 4 AS has_url, CASE WHEN a = 4 THEN f END AS zone,
           CASE a WHEN 0 THEN 'Chrome' WHEN 1 THEN 'WhatsApp' WHEN 2 THEN 'Some Tool' WHEN 6 THEN 'Mail' END AS app,
           CASE a WHEN 0 THEN 'download' WHEN 1 THEN 'message' WHEN 2 THEN 'download' WHEN 6 THEN 'email' END AS app_origin FROM p
), r AS (SELECT *, coalesce(CASE WHEN zone = 1 THEN 'network' WHEN zone IN (3, 4) THEN 'download' END, CASE WHEN has_url THEN 'download' END) AS recorded FROM m)
SELECT page_id, ['downloads', 'music', 'documents', 'desktop', NULL][f + 1] AS place, f = 1 AS removable, CASE WHEN in_cloud THEN 'Dropbox' END AS cloud, app AS from_app,
       coalesce(app_origin, CASE WHEN in_cloud THEN 'cloud' END, recorded, CASE WHEN f = 0 THEN 'download' END) AS origin,
       CASE WHEN app IS NOT NULL THEN 0.85 WHEN in_cloud OR recorded IS NOT NULL THEN 0.7 WHEN f = 0 THEN 0.45 END::DOUBLE AS origin_confidence,
       CASE WHEN a NOT IN (3, 4) THEN strftime(to_timestamp(k + 1700000000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS downloaded,
       CASE WHEN app IS NOT NULL THEN true WHEN zone IS NOT NULL THEN zone IN (3, 4) END AS quarantined,
       CASE WHEN has_url THEN url END AS from_url, CASE WHEN a < 2 THEN 'https://from.example/a' WHEN a = 4 THEN 'https://ref.example/' END AS referrer
FROM r
"""


def recalled_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings of users' files by tools, of which only those of a file's latest state still count."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    path, mark = F.concat(F.lit("/u"), (F.col("user_id") * 20 + F.col("event_id") % 20).cast("string")), F.concat(F.lit("m"), F.floor(F.col("event_id") / 700).cast("string"))
    files = e.groupBy(path.alias("path")).agg(F.max_by(mark, "event_id").alias("fingerprint"))
    readings = e.where("event_type in ('click', 'view', 'error')").select(path.alias("path"), F.col("event_type").alias("tool"), mark.alias("fingerprint"), F.col("event_id").cast("string").alias("delta"), F.col("event_id").alias("made_at"))
    return upkeep.recall_readings(files, readings, ["click", "view", "error"])


RECALLED_SQL = """
WITH e AS (SELECT *, '/u' || (user_id * 20 + event_id % 20) AS path, 'm' || (event_id // 700) AS mark FROM events),
files AS (SELECT path, arg_max(mark, event_id) AS mark FROM e GROUP BY path)
SELECT f.path, t.tool, max(e.event_id)::VARCHAR AS delta, count(e.event_id) > 0 AS recalled
FROM files f CROSS JOIN (VALUES ('click'), ('view'), ('error')) t(tool) LEFT JOIN e ON e.path = f.path AND e.mark = f.mark AND e.event_type = t.tool GROUP BY 1, 2
"""


def refreshed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that wait, read again: new headings come, old ones go, and what isn't read from the text stays."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k, head = F.col("doc_id"), F.left(F.col("text"), F.lit(12))
    fact = lambda cond, name, value: F.when(cond, F.struct(F.lit(name).alias("k"), value.cast("string").alias("v")))
    of = lambda *facts: F.map_from_entries(F.filter(F.array(*facts), lambda x: x.isNotNull()))
    held = d.select(k.alias("id"), F.concat(F.lit("/h/"), k.cast("string")).alias("destination"), of(fact(k % 3 > 0, "heading", F.when(k % 3 == 1, head).otherwise(F.lit("old"))), fact(k % 4 == 0, "pages", F.lit(7)), fact(k >= 0, "lang", F.col("lang"))).alias("facts"))
    fresh = d.where("doc_id % 5 <> 0").select(F.concat(F.lit("/h/"), k.cast("string")).alias("path"), of(fact(k % 6 != 2, "heading", head), fact(k >= 0, "lang", F.lit("xx"))).alias("facts"))
    told = upkeep.refresh_held(held, fresh)
    return told.select("id", *[F.try_element_at("facts", F.lit(c)).alias(c) for c in ("heading", "pages", "lang")])


REFRESHED_SQL = """
WITH h AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 1 THEN left(text, 12) WHEN doc_id % 3 = 2 THEN 'old' END AS heading, CASE WHEN doc_id % 4 = 0 THEN '7' END AS pages, lang,
                  CASE WHEN doc_id % 6 <> 2 THEN left(text, 12) END AS now FROM documents WHERE doc_id % 5 <> 0)
SELECT id, now AS heading, NULL::VARCHAR AS pages, lang FROM h WHERE now IS DISTINCT FROM heading OR pages IS NOT NULL
"""


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    plan = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("rule "), (F.col("p_size") % 4).cast("string")).alias("rule"), F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_name").alias("destination"))
    return upkeep.promotion_summary(plan)


PROMOTIONS_SQL = """
SELECT 'total' AS level, '' AS name, count(*) AS items FROM part HAVING count(*) > 0 UNION ALL SELECT 'rule', 'rule ' || (p_size % 4), count(*) FROM part GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'folder', '/' || p_brand, count(*) AS n FROM part GROUP BY 2 ORDER BY n DESC, 2 LIMIT 12)
"""


def retained_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' queues by event type: one type isn't watched any more, one was never looked at, the others were once seen whole."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    queue = e.groupBy(F.col("event_type").alias("root"), "user_id").agg(F.max("event_id").alias("last_seen"))
    watched = e.where("event_type <> 'click'").select(F.col("event_type").alias("root"))
    seen = e.where("event_type <> 'view' and event_id % 3 = 0").groupBy(F.col("event_type").alias("root")).agg(F.floor(F.avg("event_id")).alias("at"))
    return upkeep.retain_queue(queue, watched, seen)


RETAINED_SQL = """
WITH q AS (SELECT event_type AS root, user_id, max(event_id) AS last_seen FROM events GROUP BY 1, 2), s AS (SELECT event_type AS root, floor(avg(event_id))::BIGINT AS at_ FROM events WHERE event_type <> 'view' AND event_id % 3 = 0 GROUP BY 1)
SELECT q.* FROM q LEFT JOIN s USING (root) WHERE root <> 'click' AND (at_ IS NULL OR last_seen >= at_)
"""

QUERIES = {"page_provenance": page_provenance, "recalled_readings": recalled_readings, "refreshed_facts": refreshed_facts, "promotions": promotions, "retained_queue": retained_queue}
ORACLE_SQL = {"page_provenance": PROVENANCE_SQL, "recalled_readings": RECALLED_SQL, "refreshed_facts": REFRESHED_SQL, "promotions": PROMOTIONS_SQL, "retained_queue": RETAINED_SQL}
