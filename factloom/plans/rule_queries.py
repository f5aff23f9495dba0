"""Queries of the rule language and of rule decisions, over documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.functions.language import compile_condition, facts_of_frame, parse
from factloom.operators.rules import Rule, RuleSet, load_rules

RULES = load_rules(r"""
[rule: rejected]
when = toxic = yes
into = /held/{lang}
[rule: good english]
when = quality = 1 and lang = en and size > 1kb
into = /keep/{lang:upper}/{source}
as = {doc_id:08}.txt
[rule: graded]
when = quality is set and size >= 512b
into = /graded/{quality}/{grade|none}
min_confidence = 0.5
[rule: needs topic]
when = lang in de, fr
into = /topics/{topic}
[rule: the rest]
when = not (toxic = yes) and size between 2k and 64k
into = /rest/{lang}
holding = yes
""")


def documents_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with sparse facts: labels cover some documents only. Labels have one row for a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", F.octet_length("text").cast("long").alias("size"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.join(labels, "doc_id", "left").withColumn("name", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))


def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the rule that claims it, where it goes, and else the nearest miss. The flagship."""
    items = documents_with_labels(spark, sf_dir)
    sure = {f: F.lit(1.0) for f in items.columns} | {"quality": F.when(F.col("source") == "src1", 0.45).otherwise(1.0)}
    return RULES.decide(items, confidence=sure, keep=("doc_id",)).select("doc_id", "rule", "destination", "near_miss")


_ITEMS = """items AS (
    SELECT d.doc_id, d.text, d.lang, d.source, octet_length(encode(d.text)) AS size, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l USING (doc_id)
)"""
RULE_FIRST_MATCH_SQL = f"""
WITH {_ITEMS}, m AS (
    SELECT *, coalesce(toxic = 1, false) AS r1,
           coalesce(quality = 1, false) AND coalesce(lower(lang) = 'en', false) AND size > 1024 AS r2,
           quality IS NOT NULL AND size >= 512 AS w3,
           coalesce(lower(lang) IN ('de', 'fr'), false) AS w4,
           NOT coalesce(toxic = 1, false) AND size BETWEEN 2048 AND 65536 AS r5
    FROM items
), g AS (SELECT *, w3 AND source <> 'src1' AS r3 FROM m)
SELECT doc_id,
       CASE WHEN r1 THEN 'rejected' WHEN r2 THEN 'good english' WHEN r3 THEN 'graded' WHEN r5 THEN 'the rest' END AS rule,
       CASE WHEN r1 THEN '/held/' || lang || '/doc ' || doc_id
            WHEN r2 THEN '/keep/' || upper(lang) || '/' || source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt'
            WHEN r3 THEN '/graded/' || quality || '/none/doc ' || doc_id
            WHEN r5 THEN '/rest/' || lang || '/doc ' || doc_id END AS destination,
       CASE WHEN r1 OR r2 OR r3 OR r5 THEN NULL
            WHEN w3 THEN 'graded: below confidence 0.50: quality 0.45'
            WHEN w4 THEN 'needs topic: destination needs missing fact ''topic''' END AS near_miss
FROM g
"""


def _conditions(df: DataFrame, sources: dict[str, str], key: str) -> DataFrame:
    facts = facts_of_frame(df)
    return df.select(key, *[compile_condition(parse(s), facts)[0].alias(c) for c, s in sources.items()])


UNSET = {
    "ne": "quality != 1", "not_eq": "not quality = 1", "unset": "quality is unset", "either": "quality is unset or toxic = no",
    "not_either": "not (quality = 1 or toxic = yes)", "absent": "nothing = 1", "not_absent": "not nothing != 1",
}


def rule_unset_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conditions(documents_with_labels(spark, sf_dir), UNSET, "doc_id")


RULE_UNSET_SQL = f"""
WITH {_ITEMS}
SELECT doc_id, coalesce(quality <> 1, false) AS ne, NOT coalesce(quality = 1, false) AS not_eq, quality IS NULL AS unset,
       quality IS NULL OR coalesce(toxic = 0, false) AS "either", NOT (coalesce(quality = 1, false) OR coalesce(toxic = 1, false)) AS not_either,
       false AS absent, true AS not_absent
FROM items
"""

LITERALS = {
    "sized": "p_retailprice between 1000 and 1200 and p_size <= 20", "globbed": 'p_brand ~ "brand#?[1-3]"', "listed": "p_size in 1, 5, 10",
    "found": 'p_type re "^[A-Z]+ .*(TIN|COPPER)$"', "holding": "p_name contains aRT", "longer": "p_name > part", "kilo": "p_partkey < 1k", "hours": "p_partkey <= 1h", "texty": "p_brand >= 20",
}


def rule_literals_between_in_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conditions(spark.read.parquet(f"{sf_dir}/part.parquet"), LITERALS, "p_partkey")


RULE_LITERALS_SQL = r"""
SELECT p_partkey, p_retailprice BETWEEN 1000 AND 1200 AND p_size <= 20 AS sized,
       regexp_full_match(lower(p_brand), 'brand#.[1-3]') AS globbed, p_size IN (1, 5, 10) AS listed,
       regexp_matches(p_type, '^[A-Z]+ .*(TIN|COPPER)$') AS found, contains(lower(p_name), 'art') AS holding, p_name > 'part' AS longer,
       p_partkey < 1024 AS kilo, p_partkey <= 3600 AS hours, p_brand >= '20' AS texty
FROM part
"""


def rule_template_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, padding, cases and fallbacks in one template, per order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    facts = facts_of_frame(orders)
    path, problem = paths.render("/orders/{o_orderdate:%Y}/{o_orderdate:%m-%d}/{o_orderpriority:title}/{o_orderstatus:lower}-{o_orderkey:09}-{batch|none}", facts)
    return orders.select("o_orderkey", path.alias("destination"), problem.alias("problem"))


RULE_TEMPLATE_SQL = r"""
SELECT o_orderkey, '/orders/' || strftime(o_orderdate, '%Y') || '/' || strftime(o_orderdate, '%m-%d') || '/' ||
       array_to_string([upper(x[1:1]) || lower(x[2:]) for x in regexp_extract_all(o_orderpriority, '[A-Za-z]+|[^A-Za-z]+')], '') || '/' ||
       lower(o_orderstatus) || '-' || lpad(o_orderkey::VARCHAR, greatest(9, length(o_orderkey::VARCHAR))::INT, '0') || '-none' AS destination,
       NULL::VARCHAR AS problem
FROM orders
"""


def rule_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named groups of a pattern become facts of the destination."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_name").alias("name"), "c_mktsegment")
    rule = Rule("by number", when="name is set", into="/{c_mktsegment}/{block}", rename="{number}", extract=r"name re ^Customer#(?P<block>\d{6})(?P<number>\d*[1-9])$")
    return RuleSet((rule,)).decide(customers, keep=("c_custkey",)).select("c_custkey", "rule", "destination", "near_miss")


RULE_EXTRACT_SQL = r"""
WITH x AS (SELECT *, regexp_matches(c_name, '^Customer#(\d{6})(\d*[1-9])$') AS hit FROM customer)
SELECT c_custkey, CASE WHEN hit THEN 'by number' END AS rule,
       CASE WHEN hit THEN '/' || c_mktsegment || '/' || regexp_extract(c_name, '^Customer#(\d{6})(\d*[1-9])$', 1) || '/' || regexp_extract(c_name, '^Customer#(\d{6})(\d*[1-9])$', 2) END AS destination,
       CASE WHEN NOT hit THEN 'by number: extract did not match name=' || left(c_name, 60) END AS near_miss
FROM x
"""


def rule_usage_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule placed, lost to rules above it or may take next time, over documents as a ledger has them filed."""
    by = F.array(*map(F.lit, ("rejected", "good english", "graded", "the rest", "old rule")))
    at = F.when(F.col("lang").isin("de", "fr"), F.col("doc_id") % 3).otherwise(F.col("doc_id") % 5)
    filed = documents_with_labels(spark, sf_dir).withColumn("filed_by", F.element_at(by, (at + 1).cast("int")))
    return RULES.usage(filed, "filed_by").drop("k")


RULE_USAGE_SQL = f"""
WITH {_ITEMS}, m AS (
    SELECT ['rejected', 'good english', 'graded', 'the rest', 'old rule'][(CASE WHEN lang IN ('de', 'fr') THEN doc_id % 3 ELSE doc_id % 5 END + 1)::INT] AS filed_by,
           [coalesce(toxic = 1, false), coalesce(quality = 1 AND lower(lang) = 'en' AND size > 1024, false), quality IS NOT NULL AND coalesce(size >= 512, false),
            coalesce(lower(lang) IN ('de', 'fr'), false), NOT coalesce(toxic = 1, false) AND coalesce(size BETWEEN 2048 AND 65536, false)] AS held
    FROM items
), known(k, rule, holding) AS (VALUES (0, 'rejected', false), (1, 'good english', false), (2, 'graded', false), (3, 'needs topic', false), (4, 'the rest', true)),
each AS (
    SELECT known.k, known.rule, known.holding, w.rule AS winner, w.k AS wk, filed_by = known.rule AS placed, held[known.k + 1] AND filed_by <> known.rule AS lost
    FROM m CROSS JOIN known LEFT JOIN known w ON w.rule = filed_by
), by_winner AS (
    SELECT k, winner, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, min(wk)) AS nth FROM each WHERE lost AND wk < k GROUP BY k, winner
), per AS (
    SELECT k, rule, holding, count(*) FILTER (WHERE placed) AS placed, count(*) FILTER (WHERE lost AND coalesce(wk < k, false)) AS shadowed,
           count(*) FILTER (WHERE lost AND NOT coalesce(wk < k, false)) AS waiting
    FROM each GROUP BY k, rule, holding
)
SELECT rule, placed, shadowed, winner AS shadowed_by, waiting, NOT holding AND placed = 0 AND waiting = 0 AND shadowed >= 3 AS dead
FROM per LEFT JOIN (SELECT * FROM by_winner WHERE nth = 1) USING (k)
"""


def rule_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RULES.reachability(documents_with_labels(spark, sf_dir))


RULE_REACHABILITY_SQL = """
SELECT 'needs topic' AS rule, count(*) AS declined, 'destination needs missing fact ''topic''' AS reason
FROM documents WHERE lower(lang) IN ('de', 'fr') HAVING count(*) >= 3
"""

QUERIES = {
    "rule_first_match": rule_first_match, "rule_unset_semantics": rule_unset_semantics, "rule_literals_between_in_glob": rule_literals_between_in_glob,
    "rule_template_destination": rule_template_destination, "rule_extract": rule_extract, "rule_usage_dead": rule_usage_dead, "rule_reachability": rule_reachability,
}
ORACLE_SQL = {
    "rule_first_match": RULE_FIRST_MATCH_SQL, "rule_unset_semantics": RULE_UNSET_SQL, "rule_literals_between_in_glob": RULE_LITERALS_SQL,
    "rule_template_destination": RULE_TEMPLATE_SQL, "rule_extract": RULE_EXTRACT_SQL, "rule_usage_dead": RULE_USAGE_SQL, "rule_reachability": RULE_REACHABILITY_SQL,
}
