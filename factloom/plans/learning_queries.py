"""Queries of what filed documents teach, and of records that travel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import emerging, evidence, wire
from factloom.operators.rules import load_rules
from factloom.plans.collection_queries import HEADING_TERMS_SQL
from factloom.plans.fact_queries import EVIDENCE_MERGE_SQL, _readings

FILED = load_rules("""
[rule: what the page calls itself: ion]
when = heading contains "ion"
into = /ion
[rule: by hand]
when = lang = de and heading contains "er"
into = /hand
[rule: what the page calls itself: and]
when = heading contains "and" or heading contains "ent"
into = /and
[rule: the rest]
when = heading is set
into = /rest
holding = yes
""")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", text.heading_of(F.col("text")).alias("heading"))


def emerging_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emerging.emerging(_documents(spark, sf_dir), FILED, "doc_id")


def adoption_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emerging.adoption_plan(_documents(spark, sf_dir), FILED, "doc_id")


_EARNED = rf"""terms AS ({HEADING_TERMS_SQL}),
free AS (SELECT term FROM terms WHERE NOT (contains(lower(term), 'ion') OR contains(lower(term), 'and') OR contains(lower(term), 'ent'))),
told AS (
    SELECT doc_id, heading, regexp_extract_all(heading, '[\pL\p{{Nl}}\p{{No}}]{{3,}}') AS ws,
           CASE WHEN contains(lower(heading), 'ion') THEN 0 WHEN lang = 'de' AND contains(lower(heading), 'er') THEN 1 WHEN contains(lower(heading), 'and') OR contains(lower(heading), 'ent') THEN 2 END AS winner,
           CASE WHEN contains(lower(heading), 'ion') THEN 0 WHEN contains(lower(heading), 'and') OR contains(lower(heading), 'ent') THEN 2 END AS by_heading
    FROM (SELECT doc_id, lang, ({{heading}}) AS heading FROM documents) WHERE heading <> ''
), placed AS (
    SELECT *, CASE winner WHEN 1 THEN -1
        WHEN 0 THEN coalesce(list_min([i - 1 FOR i IN range(1, len(ws) + 1) IF contains(lower(ws[i]), 'ion')]), len(ws) + 1)
        WHEN 2 THEN coalesce(list_min([i - 1 FOR i IN range(1, len(ws) + 1) IF contains(lower(ws[i]), 'and') OR contains(lower(ws[i]), 'ent')]), coalesce(nullif(list_position([lower(w) FOR w IN ws], 'and'), 0) - 1, len(ws) + 1))
        ELSE len(ws) + 1 END AS claim FROM told
), earned AS (
    SELECT doc_id, winner, (SELECT arg_min(f.term, list_position([lower(w) FOR w IN ws], lower(f.term))) FROM free f
        WHERE list_position([lower(w) FOR w IN ws], lower(f.term)) BETWEEN 1 AND claim AND regexp_matches(ws[list_position([lower(w) FOR w IN ws], lower(f.term))], '\p{{Lu}}')) AS term FROM placed
), emerged AS (SELECT term, count(*) AS documents, count(winner) AS claimed FROM earned WHERE term IS NOT NULL GROUP BY term HAVING count(*) >= 3)"""
_HEADING = r"""SELECT coalesce(array_to_string([CASE WHEN k > 1 AND ps[k] > ps[k - 1] + 1 THEN '· ' ELSE '' END || tokens[ps[k]] for k in range(1, len(ps) + 1)], ' '), '')
    FROM (SELECT tokens, [i for i in range(1, len(tokens) + 1) if regexp_matches(tokens[i], '\pL{2,}')][1:6] AS ps FROM (SELECT [x for x in regexp_split_to_array(left(text, 500), '\s+') if x <> ''] AS tokens))"""
_EARNED = _EARNED.replace("{heading}", _HEADING)
ADOPTION_SQL = f"""
WITH {_EARNED}, beaten AS (
    SELECT DISTINCT e.term, t.by_heading AS k FROM emerged e JOIN told t ON contains(lower(t.heading), lower(e.term)) WHERE t.by_heading IS NOT NULL
), listed AS (SELECT term, string_agg(CASE k WHEN 0 THEN 'what the page calls itself: ion' ELSE 'what the page calls itself: and' END, ',' ORDER BY k) AS beats, min(k) AS least FROM beaten GROUP BY term)
SELECT term, documents, coalesce(beats, '') AS beats, least(3, least)::INTEGER AS place FROM emerged LEFT JOIN listed USING (term)
"""


def _flat(records: DataFrame) -> DataFrame:
    return records.select("item_id", "name", "value", "source", "confidence", F.array_join("corroborated_by", ",").alias("corroborated_by"), F.size("conflicts").alias("n_conflicts"), "seq")


def wire_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged readings after they went through text and back: nothing is merged again."""
    return _flat(wire.from_wire(wire.to_wire(evidence.merge_facts(_readings(spark, sf_dir)))))


def _record(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return evidence.merge_facts(_readings(spark, sf_dir).where(which)).withColumn("vtype", F.lit("number"))


def replayed_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later reading's difference from an early record, put on the record of all readings but one kind's: gaps are filled, dropped names go, the rest stands."""
    before = _record(spark, sf_dir, "seq % 7 < 2")
    after = wire.drop(_record(spark, sf_dir, "seq % 7 < 5"), "error")
    fresh = _record(spark, sf_dir, "seq % 7 >= 2 and name <> 'view'")
    return _flat(wire.apply_difference(fresh, wire.difference(after, before)))


def _merged(where: str) -> str:
    return f"({EVIDENCE_MERGE_SQL.replace('WHERE value IS NOT NULL', f'WHERE value IS NOT NULL AND {where}')})"


REPLAYED_SQL = f"""
WITH before AS (SELECT * FROM {_merged("event_id % 7 < 2")}), after AS (SELECT * FROM {_merged("event_id % 7 < 5")} WHERE name <> 'error'), fresh AS (SELECT * FROM {_merged("event_id % 7 >= 2 AND event_type <> 'view'")})
SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.item_id = f.item_id AND b.name = f.name AND NOT EXISTS (SELECT 1 FROM after a WHERE a.item_id = b.item_id AND a.name = b.name))
UNION ALL
SELECT * FROM after a WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.item_id = a.item_id AND b.name = a.name) AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.item_id = a.item_id AND f.name = a.name)
"""

QUERIES = {"emerging_terms": emerging_terms, "adoption_places": adoption_places, "wire_round_trip": wire_round_trip, "replayed_reading": replayed_reading}
ORACLE_SQL = {
    "emerging_terms": f"WITH {_EARNED} SELECT * FROM emerged", "adoption_places": ADOPTION_SQL, "wire_round_trip": EVIDENCE_MERGE_SQL, "replayed_reading": REPLAYED_SQL,
}
