"""Queries of plans and audits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.functions.names import name_facts
from factloom.operators import audits, plans
from factloom.operators.rules import load_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers filed under their nation: names that clash are numbered; two nations' first names are taken already."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("/n/"), F.col("s_nationkey").cast("string"), F.lit(".txt")).alias("destination"))
    there = s.sparkSession.createDataFrame([("/N/3.TXT",), ("/n/7.txt",)], "path string")
    return plans.resolve_collisions(s, there).select("id", "final")


PLAN_COLLISIONS_SQL = """
WITH r AS (SELECT s_suppkey AS id, s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + (s_nationkey IN (3, 7))::INT AS n FROM supplier)
SELECT id, '/n/' || k || CASE WHEN n = 1 THEN '' ELSE ' (' || n || ')' END || '.txt' AS final FROM r
"""


def ignored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    path = F.regexp_replace("url", r"^[a-z]+://", "")
    lines = ["# comment", "*.org", "page1*", "!page12*"]
    return p.select("page_id", plans.ignored(path, ("*.org", "page?")).alias("ignored"), plans.ignored_by_rules(path, lines).alias("by_rules"))


IGNORED_SQL = r"""
WITH p AS (SELECT page_id, lower(regexp_replace(url, '^[a-z]+://', '')) AS path FROM pages), s AS (SELECT *, list_concat([path], string_split(path, '/')) AS parts FROM p)
SELECT page_id, len([x for x in parts if regexp_full_match(x, '(?s).*\.org') OR regexp_full_match(x, '(?s)page.')]) > 0 AS ignored,
       CASE WHEN len([x for x in parts if starts_with(x, 'page12')]) > 0 THEN false ELSE len([x for x in parts if starts_with(x, 'page1') OR regexp_full_match(x, '(?s).*\.org')]) > 0 END AS by_rules
FROM s
"""


def name_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, counters and copy marks of names made from orders."""
    o = _table(spark, sf_dir, "orders")
    name = F.element_at(
        F.array(
            F.concat(F.lit("IMG_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".jpg")), F.concat(F.lit("scan "), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit(" (2).pdf")),
            F.concat(F.lit("page_0"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(".tif")), F.concat(F.lit("Report v"), (F.col("o_orderkey") % 9).cast("string"), F.lit(".doc")),
        ),
        (F.col("o_orderkey") % 4 + 1).cast("int"),
    )
    facts = o.select("o_orderkey", name.alias("name")).select("o_orderkey", *name_facts(F.col("name")))
    return facts.select("o_orderkey", "ext", "name_date", "copy_marker", "sequence_prefix", "sequence_number", "version_marker")


NAME_DETECTORS_SQL = """
SELECT o_orderkey, ['jpg', 'pdf', 'tif', 'doc'][(o_orderkey % 4 + 1)::INT] AS ext,
       CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 4 = 1 AND day(o_orderdate) > 12 THEN strftime(o_orderdate, '%Y-%m-%d') END AS name_date,
       CASE WHEN o_orderkey % 4 = 1 THEN '(2)' END AS copy_marker, CASE WHEN o_orderkey % 4 = 2 THEN 'page' END AS sequence_prefix,
       CASE WHEN o_orderkey % 4 = 2 THEN (o_orderkey % 1000)::INT END AS sequence_number, CASE WHEN o_orderkey % 4 = 3 THEN 'v' || (o_orderkey % 9) END AS version_marker
FROM orders
"""

AUDITED = load_rules("[rule: tin]\nwhen = p_type contains dar\ninto = /a\n[rule: ness]\nwhen = p_type contains con\ninto = /b\n[rule: brand]\nwhen = p_brand = 'brand 13' or p_name = 'green'\ninto = /c")


def inside_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.inside_words(_table(spark, sf_dir, "part"), AUDITED)


INSIDE_SQL = """
WITH asked(rule, word) AS (VALUES ('tin', 'dar'), ('ness', 'con')),
h AS (SELECT rule, word, unnest(list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+'))) AS host FROM part, asked WHERE contains(lower(p_type), word)),
c AS (SELECT rule, word, host, count(*) AS n FROM h WHERE contains(host, word) GROUP BY ALL)
SELECT rule, 'p_type' AS fact, word, sum(n)::BIGINT AS inside, array_to_string(list(host ORDER BY n DESC, host)[1:5], ',') AS hosts
FROM c GROUP BY rule, word HAVING coalesce(sum(n) FILTER (WHERE host = word), 0) = 0 AND sum(n) >= 3
"""


def rule_near_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.near_values(_table(spark, sf_dir, "part"), "p_partkey", AUDITED)


NEAR_SQL = """
WITH v AS (SELECT 'p_brand' AS fact, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_name', p_name, count(*) FROM part GROUP BY 2),
a(rule, fact, wanted) AS (VALUES ('brand', 'p_brand', 'brand 13'), ('brand', 'p_name', 'green')),
p AS (SELECT *, regexp_replace(lower(wanted), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') AS y FROM v JOIN a USING (fact))
SELECT rule, fact, wanted, value, n FROM p WHERE length(x) >= 3 AND length(y) >= 3 AND (contains(x, y) OR contains(y, x))
  AND NOT EXISTS (SELECT 1 FROM part WHERE lower(trim(p_brand)) = 'brand 13' OR lower(trim(p_name)) = 'green')
  AND NOT EXISTS (SELECT 1 FROM p q WHERE q.fact = p.fact AND q.wanted = p.wanted AND lower(trim(q.value)) = lower(trim(q.wanted)))
"""


def emerging_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select(text.heading_of(F.col("text")).alias("heading"), F.when(F.col("lang") == "en", "english").alias("rule"))
    return audits.emerging(d, "heading", "rule", ["with", "that"])


EMERGING_SQL = r"""
WITH h AS (
    SELECT lang, [tokens[ps[k]] for k in range(1, len(ps) + 1)] AS ws
    FROM (SELECT lang, tokens, [i for i in range(1, len(tokens) + 1) if regexp_matches(tokens[i], '\pL{2,}')][1:6] AS ps
          FROM (SELECT lang, [x for x in regexp_split_to_array(left(text, 500), '\s+') if x <> ''] AS tokens FROM documents))
), w AS (SELECT lang, unnest(list_distinct([lower(x) for x in ws])) AS term FROM h)
SELECT term, count(*) AS documents, count(*) FILTER (WHERE lang = 'en') AS claimed FROM w
WHERE regexp_full_match(term, '\pL{4,}') AND term NOT IN ('with', 'that') GROUP BY term HAVING count(*) >= 3 ORDER BY documents DESC, term LIMIT 20
"""

QUERIES = {
    "plan_collisions": plan_collisions, "ignored_items": ignored_items, "name_detectors": name_detectors, "inside_words": inside_words, "rule_near_values": rule_near_values, "emerging_categories": emerging_categories,
}
ORACLE_SQL = {
    "plan_collisions": PLAN_COLLISIONS_SQL, "ignored_items": IGNORED_SQL, "name_detectors": NAME_DETECTORS_SQL, "inside_words": INSIDE_SQL, "rule_near_values": NEAR_SQL, "emerging_categories": EMERGING_SQL,
}
