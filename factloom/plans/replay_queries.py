"""Queries that walk ledgers back: events as files that go from folder to folder over many runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators import replay


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event puts its file (ten a user) in the folder of its type; two files are an item, 500 events a run."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", (F.col("user_id") * 10 + F.col("event_id") % 10).alias("f"))
    before = F.coalesce(F.lag("event_type").over(W.partitionBy("f").orderBy("event_id")), F.lit("in"))
    path = lambda folder: F.concat(F.lit("/"), folder, F.lit("/"), F.col("f").cast("string"))
    steps = e.withColumn("_before", before).where(F.col("_before") != F.col("event_type"))
    return steps.select(
        F.col("event_id").alias("id"), F.floor(F.col("event_id") / 500).alias("run_id"), F.floor(F.col("f") / 2).alias("item"), path(F.col("_before")).alias("source"),
        path(F.col("event_type")).alias("destination"), F.concat(F.lit("d"), F.col("f").cast("string")).alias("digest"), F.lit("done").alias("status"), F.lit(None).cast("timestamp").alias("undone_at"), "f",
    )


def _disk(journal: DataFrame) -> DataFrame:
    """Where the files are in the end; some changed, some are gone, some folders hold another file of that name."""
    last = journal.groupBy("f").agg(F.max_by("destination", "id").alias("path"))
    own = last.where("f % 11 <> 5").select("path", F.when(F.col("f") % 7 == 3, "changed").otherwise(F.concat(F.lit("d"), F.col("f").cast("string"))).alias("digest"))
    return own.unionByName(last.where("f % 13 = 1").select(F.concat(F.lit("/view/"), F.col("f").cast("string")).alias("path"), F.lit("another").alias("digest")))


_JOURNAL = """steps AS (
    SELECT event_id, event_type, user_id * 10 + event_id % 10 AS f, coalesce(lag(event_type) OVER (PARTITION BY user_id * 10 + event_id % 10 ORDER BY event_id), 'in') AS earlier FROM events
), journal AS (
    SELECT event_id AS id, event_id // 500 AS run_id, f // 2 AS item, '/' || earlier || '/' || f AS source, '/' || event_type || '/' || f AS destination, 'd' || f AS digest, f
    FROM steps WHERE earlier <> event_type
), last_place AS (SELECT f, arg_max(destination, id) AS path FROM journal GROUP BY f),
disk AS (
    SELECT path, max(digest) AS digest FROM (
        SELECT path, CASE WHEN f % 7 = 3 THEN 'changed' ELSE 'd' || f END AS digest FROM last_place WHERE f % 11 <> 5
        UNION ALL SELECT '/view/' || f, 'another' FROM last_place WHERE f % 13 = 1) GROUP BY path
)"""

#: One item after the other over a keyed state: a row for each path, one for each item's outcome, and the clock.
_WALK = f"""{_JOURNAL}, items AS (SELECT run_id, item, row_number() OVER (ORDER BY run_id DESC, item DESC) AS g FROM (SELECT DISTINCT run_id, item FROM journal)),
members AS (SELECT g, id, destination AS here, source AS home, digest, row_number() OVER (PARTITION BY g, destination ORDER BY id DESC) > 1 AS taken_twice,
                   row_number() OVER (PARTITION BY g, source ORDER BY id DESC) > 1 AS needed_twice FROM journal JOIN items USING (run_id, item)),
walk(path, there, digest, g, problem) USING KEY (path) AS (
    SELECT '#', true, NULL::VARCHAR, 0::BIGINT, NULL::VARCHAR UNION ALL SELECT path, true, digest, 0, NULL FROM disk
    UNION (
    WITH met AS (
        SELECT m.*, coalesce(h.there, false) AS is_here, h.digest AS now, coalesce(o.there, false) AS occupied
        FROM walk c JOIN members m ON c.path = '#' AND m.g = c.g + 1 LEFT JOIN recurring.walk h ON h.path = m.here LEFT JOIN recurring.walk o ON o.path = m.home
    ), judged AS (
        SELECT g, coalesce(
            arg_max(CASE WHEN occupied THEN 'original path is occupied: ' || home WHEN NOT is_here THEN 'moved file is missing: ' || here
                         WHEN now IS DISTINCT FROM digest THEN 'file changed since it was sorted: ' || here END, id),
            arg_max(CASE WHEN needed_twice THEN 'original path is occupied: ' || home WHEN taken_twice THEN 'moved file is missing: ' || here END, id)) AS problem
        FROM met GROUP BY g
    )
    SELECT '#', true, NULL, g, NULL FROM judged
    UNION ALL SELECT '!' || g, true, NULL, g, problem FROM judged
    UNION ALL SELECT here, false, NULL, g, NULL FROM met JOIN judged j USING (g) WHERE j.problem IS NULL
    UNION ALL SELECT home, true, digest, g, NULL FROM met JOIN judged j USING (g) WHERE j.problem IS NULL
    )
)"""


def _runs(journal: DataFrame) -> DataFrame:
    return journal.select(F.col("run_id").alias("id")).distinct().select("id", F.lit("sort").alias("action"), F.lit(0).alias("dry_run"))


def undo_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal = _journal(spark, sf_dir)
    return replay.undo_all(journal, _runs(journal), _disk(journal))


UNDO_EVERYTHING_SQL = f"""
WITH RECURSIVE {_WALK}
SELECT run_id, item, j.id, destination AS source, source AS destination, CASE WHEN w.problem IS NULL THEN 'restored' ELSE 'undo-failed' END AS outcome, w.problem
FROM journal j JOIN items USING (run_id, item) JOIN walk w ON w.path = '!' || items.g
"""


def undone_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal = _journal(spark, sf_dir)
    return replay.files_after_undo(journal, _runs(journal), _disk(journal))


UNDONE_DISK_SQL = f"WITH RECURSIVE {_WALK} SELECT path, digest FROM walk WHERE there AND path[1] = '/'"


def _interrupted(journal: DataFrame) -> DataFrame:
    """The journal as a crash left it: the last move of each file is open."""
    last = F.col("id") == F.max("id").over(W.partitionBy("f"))
    operation = F.when(F.col("f") % 3 == 0, "copy").otherwise("move")
    open_ = F.when(F.col("f") % 5 == 0, "planned").when(operation == "copy", "copying").otherwise("moving")
    return journal.withColumns({"operation": operation, "status": F.when(last, open_).otherwise("done"), "dry_run": F.when(F.col("f") % 850 == 425, 1).otherwise(0)})


def _halfway(journal: DataFrame) -> DataFrame:
    """What a crash left on disk: by file, nothing done, done, both ends, neither, or another file."""
    last = journal.groupBy("f").agg(F.max_by(F.struct("source", "destination", "digest"), "id").alias("m"))
    k = F.col("f") % 8
    ends = F.array(
        F.when(k.isin(0, 2, 5, 7), F.struct(F.col("m.source").alias("path"), F.col("m.digest").alias("digest"))),
        F.when(k.isin(1, 2, 4), F.struct(F.col("m.destination").alias("path"), F.col("m.digest").alias("digest"))),
        F.when(k.isin(5, 6), F.struct(F.col("m.destination").alias("path"), F.lit("half").alias("digest"))),
    )
    return last.select(F.inline(F.filter(ends, lambda x: x.isNotNull())))


_CRASH = f"""{_JOURNAL}, crashed AS (
    SELECT *, CASE WHEN f % 3 = 0 THEN 'copy' ELSE 'move' END AS operation, f % 850 = 425 AS dry_run,
           CASE WHEN id <> max(id) OVER (PARTITION BY f) THEN 'done' WHEN f % 5 = 0 THEN 'planned' WHEN f % 3 = 0 THEN 'copying' ELSE 'moving' END AS status FROM journal
), left_over AS (
    SELECT f % 8 AS k, source, destination, digest FROM crashed QUALIFY id = max(id) OVER (PARTITION BY f)
), halfway AS (
    SELECT path, max(digest) AS digest FROM (
        SELECT source AS path, digest FROM left_over WHERE k IN (0, 2, 5, 7) UNION ALL SELECT destination, digest FROM left_over WHERE k IN (1, 2, 4)
        UNION ALL SELECT destination, 'half' FROM left_over WHERE k IN (5, 6)) GROUP BY path
), told AS (
    SELECT c.id, c.run_id, c.operation, s.path IS NOT NULL AS has_source, d.path IS NOT NULL AS has_goal,
           d.path IS NOT NULL AND d.digest = c.digest AND (c.operation = 'copy' OR s.path IS NULL) AS sure
    FROM crashed c LEFT JOIN halfway s ON s.path = c.source LEFT JOIN halfway d ON d.path = c.destination WHERE status IN ('planned', 'moving', 'copying') AND NOT dry_run
), reconciled AS (
    SELECT id, run_id, operation, CASE WHEN NOT sure THEN 'failed' WHEN operation = 'copy' THEN 'copied' ELSE 'done' END AS status,
           CASE WHEN sure THEN 'confirmed after interrupted run' WHEN has_source AND NOT has_goal THEN 'interrupted before filesystem change' ELSE 'interrupted in an ambiguous state' END AS error FROM told
)"""


def reconciled_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal = _journal(spark, sf_dir)
    return replay.reconcile(_interrupted(journal), _halfway(journal))


def reconciled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal = _journal(spark, sf_dir)
    moves = _interrupted(journal)
    runs = journal.select(F.col("run_id").alias("id")).distinct().select("id", F.when(F.col("id") % 4 == 3, "completed").otherwise("running").alias("status"))
    return replay.reconcile_runs(runs, moves, replay.reconcile(moves, _halfway(journal)))


RECONCILED_RUNS_SQL = f"""
WITH {_CRASH}, after AS (SELECT c.run_id, coalesce(r.status, c.status) AS status FROM crashed c LEFT JOIN reconciled r USING (id))
SELECT run_id, CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'partial' ELSE 'recovered' END AS status FROM after WHERE run_id % 4 <> 3
GROUP BY run_id HAVING count(*) FILTER (WHERE status IN ('planned', 'moving', 'copying')) = 0
"""

QUERIES = {"undo_everything": undo_everything, "undone_disk": undone_disk, "reconciled_moves": reconciled_moves, "reconciled_runs": reconciled_runs}
ORACLE_SQL = {
    "undo_everything": UNDO_EVERYTHING_SQL, "undone_disk": UNDONE_DISK_SQL, "reconciled_moves": f"WITH {_CRASH} SELECT * FROM reconciled", "reconciled_runs": RECONCILED_RUNS_SQL,
}
