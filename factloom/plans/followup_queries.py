"""Queries of what became of placed items, and of rules that don't stop or leave items unsorted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import followups
from factloom.operators.rules import load_rules
from factloom.plans.collection_queries import _MOVES, _moves, _table
from factloom.plans.rule_queries import _ITEMS, RULE_FIRST_MATCH_SQL, RULES, documents_with_labels

TRIED = load_rules("""
[rule: large]
when = size >= 2k
into = /large
stop = no
[rule: english]
when = lang = en
into = /english
[rule: stays]
when = size is set
mode = leave
""")


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moves with an item of two members, a size, and a digest that some lack."""
    k = F.col("id")
    return _moves(spark, sf_dir).withColumns({
        "item": F.floor(k / 2), "size": k % 41, "digest": F.when(k % 6 != 0, F.concat(F.lit("d"), (k % 4).cast("string"))), "rule": F.col("event_type"),
    })


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is there now: a file for each path whose last event didn't remove it, as errors do."""
    e = _table(spark, sf_dir, "events")
    path = F.concat(F.lit("/p"), (F.col("event_id") * 5 % 97).cast("string"), F.lit("/u"), (F.col("user_id") % 50).cast("string"))
    k = F.col("k")
    last = e.groupBy(path.alias("path")).agg(F.max("event_id").alias("k"), F.max_by("event_type", "event_id").alias("_type"))
    return last.where("_type <> 'error'").select("path", (k % 41).alias("size"), F.concat(F.lit("d"), (k % 3).cast("string")).alias("digest"))


_SIGNED = f"""{_MOVES}, signed AS (
    SELECT *, id // 2 AS item, id % 41 AS size, CASE WHEN id % 6 <> 0 THEN 'd' || (id % 4) END AS digest, event_type AS rule FROM moves
), files AS (
    SELECT path, k % 41 AS size, 'd' || (k % 3) AS digest FROM (
        SELECT '/p' || (event_id * 5 % 97) || '/u' || (user_id % 50) AS path, max(event_id) AS k, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1)
    WHERE last_type <> 'error'
)"""
_PLACED = """(
    SELECT * FROM signed m WHERE status = 'done' AND undone_at IS NULL AND NOT EXISTS (
        SELECT 1 FROM moves l WHERE l.source = m.destination AND l.id > m.id AND l.status = 'done' AND l.undone_at IS NULL AND l.operation IN ('move', 'rename'))
)"""


def placed_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return followups.corrections(followups.placed_moves(_signed(spark, sf_dir)), _files(spark, sf_dir))


CORRECTIONS_SQL = f"""
WITH {_SIGNED}, gone AS (
    SELECT id, rule, destination AS placed_at, size, digest, split_part(destination, '/', -1) AS name FROM {_PLACED} p WHERE destination NOT IN (SELECT path FROM files)
), hits AS (
    SELECT g.id, count(f.path) AS n, min(f.path) AS least, min(f.path) FILTER (WHERE f.digest = g.digest) AS same
    FROM gone g LEFT JOIN files f ON split_part(f.path, '/', -1) = g.name AND f.size = g.size GROUP BY g.id
), f AS (SELECT g.*, CASE WHEN digest IS NOT NULL THEN same WHEN n = 1 THEN least END AS found_at FROM gone g JOIN hits USING (id))
SELECT id, rule, placed_at, found_at, CASE WHEN found_at IS NULL THEN 'missing' ELSE 'moved' END AS outcome FROM f
"""


def undo_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return followups.undo_plan(_signed(spark, sf_dir), _files(spark, sf_dir))


UNDO_SQL = f"""
WITH {_SIGNED}, told AS (
    SELECT m.run_id, m.item, m.id, m.destination AS source, m.source AS destination,
           CASE WHEN m.source IN (SELECT path FROM files) THEN 'original path is occupied: ' || m.source
                WHEN f.path IS NULL THEN 'moved file is missing: ' || m.destination
                WHEN f.digest IS DISTINCT FROM m.digest THEN 'file changed since it was sorted: ' || m.destination END AS trouble
    FROM signed m LEFT JOIN files f ON f.path = m.destination WHERE m.status = 'done' AND m.undone_at IS NULL
), firsts AS (SELECT run_id, item, arg_max(trouble, id) AS problem FROM told WHERE trouble IS NOT NULL GROUP BY 1, 2)
SELECT t.run_id, t.item, t.id, t.source, t.destination, CASE WHEN problem IS NULL THEN 'restored' ELSE 'undo-failed' END AS outcome, problem
FROM told t LEFT JOIN firsts USING (run_id, item)
"""


def held_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return followups.held_moves(_moves(spark, sf_dir)).select("id", "destination", "facts")


HELD_SQL = f"WITH {_SIGNED} SELECT id, destination, facts FROM {_PLACED} p WHERE holding = 1"


def waiting_for_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of even runs whose number ``k`` isn't zero and whose file is there."""
    m = _moves(spark, sf_dir)
    runs = m.select(F.col("run_id").alias("id"), F.when(F.col("run_id") % 2 == 0, "sort").otherwise("undo").alias("action"))
    return followups.waiting(m, runs, "k", _files(spark, sf_dir)).select("id", "run_id", "destination")


WAITING_SQL = f"""
WITH {_SIGNED} SELECT id, run_id, destination FROM {_PLACED} p
WHERE run_id % 2 = 0 AND json_extract_string(facts, '$.k')::DOUBLE <> 0 AND destination IN (SELECT path FROM files)
"""


def folder_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return followups.mirrored(_files(spark, sf_dir), F.regexp_extract("path", "^(.*)/", 1))


MIRROR_SQL = f"WITH {_SIGNED} SELECT regexp_extract(path, '^(.*)/', 1) AS folder, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY 1"


def rule_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TRIED.explain(documents_with_labels(spark, sf_dir), keep=("doc_id",))


EXPLAIN_SQL = f"""
WITH {_ITEMS}, m AS (SELECT doc_id, size >= 2048 AS m0, coalesce(lower(lang) = 'en', false) AS m1, size IS NOT NULL AS m2 FROM items),
t AS (
    SELECT doc_id, 0 AS k, 'large' AS rule, m0 AS matched, '/large/doc ' || doc_id AS goes FROM m
    UNION ALL SELECT doc_id, 1, 'english', m1, '/english/doc ' || doc_id FROM m
    UNION ALL SELECT doc_id, 2, 'stays', m2, NULL FROM m WHERE NOT m1
)
SELECT doc_id, k, rule, matched, CASE WHEN NOT matched THEN 'when did not match' WHEN k = 2 THEN 'matched; leave in place' ELSE 'matched' END AS reason,
       CASE WHEN matched THEN goes END AS destination FROM t
"""


def _sure(items: DataFrame) -> dict:
    return {f: F.lit(1.0) for f in items.columns} | {"quality": F.when(F.col("source") == "src1", 0.45).otherwise(1.0)}


def rule_unsorted_gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = documents_with_labels(spark, sf_dir)
    return RULES.file(items, _sure(items), keep=("doc_id",), gather_into="/unsorted")


UNSORTED_SQL = f"""
SELECT doc_id, coalesce(rule, '[unsorted]') AS rule, 'move' AS operation, coalesce(destination, '/unsorted/doc ' || doc_id) AS destination,
       rule IS NULL OR rule = 'the rest' AS holding, NULL::VARCHAR AS skipped FROM ({RULE_FIRST_MATCH_SQL})
"""


def rule_unsorted_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = documents_with_labels(spark, sf_dir)
    return RULES.file(items, _sure(items), keep=("doc_id",)).where("skipped is not null").select("doc_id", "skipped")


LEFT_SQL = f"""
SELECT doc_id, CASE WHEN near_miss IS NULL THEN 'no rule matched' ELSE 'no rule matched (closest: ' || near_miss || ')' END AS skipped
FROM ({RULE_FIRST_MATCH_SQL}) WHERE rule IS NULL
"""

QUERIES = {
    "placed_corrections": placed_corrections, "undo_plan": undo_plan, "held_items": held_items, "waiting_for_reading": waiting_for_reading,
    "folder_mirror": folder_mirror, "rule_explain": rule_explain, "rule_unsorted_gathered": rule_unsorted_gathered, "rule_unsorted_left": rule_unsorted_left,
}
ORACLE_SQL = {
    "placed_corrections": CORRECTIONS_SQL, "undo_plan": UNDO_SQL, "held_items": HELD_SQL, "waiting_for_reading": WAITING_SQL,
    "folder_mirror": MIRROR_SQL, "rule_explain": EXPLAIN_SQL, "rule_unsorted_gathered": UNSORTED_SQL, "rule_unsorted_left": LEFT_SQL,
}
