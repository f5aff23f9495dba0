"""Queries of surveys: scans by size, capped values, naming conventions at the best depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import induction, scans, surveys


def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as images: their keys make sizes, resolutions and tags."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    dpi = F.get(F.array(*map(F.lit, (72.0, 150.0, 300.0, 600.0, 118.11, 300.2))), (k % 6).cast("int"))
    dots = F.when(k % 6 == 4, 300).otherwise(dpi)
    a, b = 2.4 + (F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 460 / 50, 3.4 + (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 680 / 50
    tag = lambda words, every: F.get(F.array(*[F.lit(w) for w in words]), (k % every).cast("int"))
    images = l.select(
        k.alias("id"), F.floor(F.when(k % 2 == 0, a).otherwise(b) * dots).cast("int").alias("width"), F.floor(F.when(k % 2 == 0, b).otherwise(a) * dots).cast("int").alias("height"),
        dpi.alias("x_resolution"), F.when(k % 11 == 0, dpi + 1).when(k % 11 > 4, dpi).alias("y_resolution"), F.when(k % 6 == 4, 3).when(k % 13 == 0, 1).when(k % 3 == 0, 2).alias("resolution_unit"),
        tag(("EPSON", None, "Canon", "Brother"), 7).alias("make"), tag(("Perfection V39", "EOS R6", None, "CanoScan 9000F", "MFC-J4335"), 17).alias("model"),
        tag(("GIMP 2.10", "VueScan 9", "Adobe Photoshop", ""), 5).alias("software"), *[F.when(k % 19 == n, F.lit("1")).otherwise("" if n else None).alias(c) for n, c in enumerate(scans.EXPOSURE)],
    )
    return scans.detect_scans(images, "id")


SCANNED_SQL = """
WITH keyed AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_orderkey AS o, l_partkey AS p, l_linenumber AS n FROM lineitem),
made AS (
    SELECT k, [72.0, 150.0, 300.0, 600.0, 118.11, 300.2][k % 6 + 1]::DOUBLE AS xr, CASE WHEN k % 6 = 4 THEN 300 ELSE [72.0, 150.0, 300.0, 600.0, 118.11, 300.2][k % 6 + 1]::DOUBLE END AS dots,
           2.4::DOUBLE + ((o * 3 + n) % 460)::DOUBLE / 50 AS a, 3.4::DOUBLE + ((p * 7 + n) % 680)::DOUBLE / 50 AS b,
           ['EPSON', NULL, 'Canon', 'Brother'][k % 7 + 1] AS make, ['Perfection V39', 'EOS R6', NULL, 'CanoScan 9000F', 'MFC-J4335'][k % 17 + 1] AS model, ['GIMP 2.10', 'VueScan 9', 'Adobe Photoshop', ''][k % 5 + 1] AS software
    FROM keyed
), seen AS (
    SELECT k AS id, least(floor(a * dots), floor(b * dots)) AS small, greatest(floor(a * dots), floor(b * dots)) AS large,
           coalesce(model IN ('Perfection V39', 'CanoScan 9000F', 'MFC-J4335'), false) OR coalesce(software = 'VueScan 9', false) AS named, coalesce(software IN ('GIMP 2.10', 'Adobe Photoshop'), false) AS edited,
           CASE WHEN k % 11 = 0 THEN NULL WHEN k % 6 = 4 THEN round(xr * 2.54)::INTEGER WHEN k % 13 = 0 THEN NULL ELSE round(xr)::INTEGER END AS dpi0
    FROM made WHERE k % 19 > 4
), sized AS (SELECT *, CASE WHEN dpi0 IN (150, 300, 600) THEN dpi0 END AS dpi FROM seen),
pages(name, a, b, place) AS (VALUES ('A3', 11.693, 16.535, 0), ('A4', 8.268, 11.693, 1), ('A5', 5.827, 8.268, 2), ('A6', 4.134, 5.827, 3), ('B4', 9.843, 13.898, 4), ('B5', 6.929, 9.843, 5), ('Letter', 8.5, 11.0, 6),
    ('Legal', 8.5, 14.0, 7), ('Tabloid', 11.0, 17.0, 8), ('Executive', 7.25, 10.5, 9), ('Folio', 8.5, 13.0, 10)),
prints(name, a, b, place) AS (VALUES ('3.5x5', 3.5, 5.0, 0), ('4x6', 4.0, 6.0, 1), ('5x7', 5.0, 7.0, 2), ('6x8', 6.0, 8.0, 3), ('8x10', 8.0, 10.0, 4), ('8x12', 8.0, 12.0, 5), ('2.5x3.5', 2.5, 3.5, 6), ('6x6', 6.0, 6.0, 7), ('3.5x3.5', 3.5, 3.5, 8)),
fit AS (
    SELECT s.*, (SELECT arg_min(name, place) FROM pages WHERE abs(small / dpi - a::DOUBLE) <= 0.12::DOUBLE AND abs(large / dpi - b::DOUBLE) <= 0.12::DOUBLE) AS page,
           (SELECT arg_min(name, place) FROM prints WHERE abs(small / dpi - a::DOUBLE) <= 0.12::DOUBLE AND abs(large / dpi - b::DOUBLE) <= 0.12::DOUBLE) AS print
    FROM sized s
), told AS (SELECT *, CASE WHEN named OR NOT edited THEN page END AS sheet FROM fit)
SELECT id, CASE WHEN sheet IS NULL AND print IS NOT NULL THEN 'print' ELSE 'page' END AS scan_of, coalesce(sheet, print) AS paper, dpi, CASE WHEN named THEN 'exif' ELSE 'dimensions' END AS evidence
FROM told WHERE sheet IS NOT NULL OR named
"""


def _line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    facts = ("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_extendedprice")
    text = {"l_shipdate": F.date_format("l_shipdate", "yyyy-MM-dd"), "l_extendedprice": F.floor("l_extendedprice").cast("string")}
    pairs = F.array(*[F.struct(F.lit(c).alias("fact"), text.get(c, F.col(c).cast("string")).alias("value")) for c in facts])
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.inline(pairs))


def capped_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveys.capped_facts(_line_facts(spark, sf_dir))


def capped_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveys.capped_values(_line_facts(spark, sf_dir))


#: One reader in order: a running count of values not seen before.
_CAPPED = """facts AS (
    SELECT l_orderkey * 10 + l_linenumber AS pos, unnest([{'fact': 'l_orderkey', 'value': l_orderkey::VARCHAR}, {'fact': 'l_partkey', 'value': l_partkey::VARCHAR}, {'fact': 'l_suppkey', 'value': l_suppkey::VARCHAR},
        {'fact': 'l_returnflag', 'value': l_returnflag}, {'fact': 'l_shipdate', 'value': strftime(l_shipdate, '%Y-%m-%d')}, {'fact': 'l_extendedprice', 'value': floor(l_extendedprice)::BIGINT::VARCHAR}], recursive := true) FROM lineitem
), fresh AS (SELECT *, row_number() OVER (PARTITION BY fact, value ORDER BY pos) = 1 AS is_new FROM facts),
running AS (SELECT *, sum(is_new::INTEGER) OVER (PARTITION BY fact ORDER BY pos) AS known, sum(is_new::INTEGER) OVER (PARTITION BY fact ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM fresh),
capped AS (
    SELECT fact, count(*) AS items, max(known)::BIGINT AS "distinct", coalesce(bool_or(before >= 4000), false) AS overflowed, min(pos) FILTER (WHERE known >= 4000) AS full_at FROM running GROUP BY fact
)"""


def naming_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by several programs and by people: parts, customers and orders."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = lambda c: F.col(c).cast("string")
    parts = t("part").select(F.concat(F.lpad(text("p_partkey"), 8, "1"), F.lit("."), F.regexp_replace("p_brand", "#", "-"), F.lit("_"), F.regexp_replace("p_name", " ", "_")).alias("stem"))
    customers = t("customer").select(F.concat(F.md5(F.col("c_name").cast("binary")), F.lit("_"), F.lower("c_mktsegment"), F.lit("_nation"), text("c_nationkey"), F.lit("_"), text("c_custkey")).alias("stem"))
    orders = t("orders").select(F.concat(F.lit("scan "), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("."), F.substring("o_orderpriority", 3, 20), F.lit(" "), text("o_orderkey")).alias("stem"))
    people = t("nation").select(F.concat(F.lit("My holiday in "), F.col("n_name")).alias("stem"))
    return induction.best_conventions(parts.unionByName(customers).unionByName(orders).unionByName(people), "stem")


CONVENTIONS_SQL = r"""
WITH stems AS (
    SELECT lpad(p_partkey::VARCHAR, 8, '1') || '.' || replace(p_brand, '#', '-') || '_' || replace(p_name, ' ', '_') AS stem FROM part
    UNION ALL SELECT md5(c_name) || '_' || lower(c_mktsegment) || '_nation' || c_nationkey || '_' || c_custkey FROM customer
    UNION ALL SELECT 'scan ' || strftime(o_orderdate, '%Y%m%d') || '.' || substr(o_orderpriority, 3, 20) || ' ' || o_orderkey FROM orders
    UNION ALL SELECT 'My holiday in ' || n_name FROM nation
), split AS (SELECT regexp_split_to_array(stem, '[.…_ ]') AS ts, regexp_extract_all(stem, '[.…_ ]') AS seps, depth FROM stems, (VALUES (2), (3), (4)) d(depth) WHERE stem <> ''),
fields AS (SELECT depth, list_transform(ts[:depth], lambda x, i: {'sep': CASE WHEN i = 1 THEN '' ELSE seps[i - 1] END, 'text': x}) AS fs, len(ts) AS n, seps FROM split),
cut AS (SELECT depth, CASE WHEN n > depth THEN fs ELSE fs[:n - 1] END AS fs, CASE WHEN n > depth THEN seps[depth] WHEN n > 1 THEN seps[n - 1] ELSE '' END AS tail_sep FROM fields),
shaped AS (
    SELECT depth, fs, list_aggregate([f.sep || '<' || CASE WHEN f.text = '' THEN 'empty' WHEN regexp_full_match(f.text, '\d+') THEN 'num' || length(f.text)
        WHEN regexp_full_match(lower(f.text), '[0-9a-f]+') AND length(f.text) IN (32, 40, 64) THEN 'hex' || length(f.text) WHEN regexp_matches(f.text, '\pL') THEN 'word' ELSE 'other' END || '>' FOR f IN fs], 'string_agg', '') AS head, tail_sep
    FROM cut
), machine AS (SELECT depth, fs, coalesce(head, '') || tail_sep || '<tail>' AS signature FROM shaped WHERE regexp_matches(coalesce(head, ''), '<hex\d+>|<num([6-9]|\d{2,})>')),
counted AS (SELECT depth, signature, i - 1 AS field, fs[i].text AS value, count(*) AS c FROM machine, unnest(range(1, len(fs) + 1)) AS u(i) GROUP BY ALL),
per AS (
    SELECT depth, signature, field, sum(c)::BIGINT AS n, count(*) AS groups, coalesce(sum(c) FILTER (WHERE c >= 3), 0) / sum(c) AS concentration, avg(length(value)) AS len,
           sum(length(regexp_replace(value, '\PL', '', 'g'))) / greatest(sum(length(value)), 1) AS letters,
           bool_or(regexp_full_match(value, '\d+') OR (regexp_full_match(lower(value), '[0-9a-f]+') AND length(value) IN (32, 40, 64))) AS numeric_field FROM counted GROUP BY ALL
), chosen AS (
    SELECT *, row_number() OVER (PARTITION BY depth, signature ORDER BY groups / n, field) AS k FROM per
    WHERE n >= 3 AND groups >= 3 AND groups < n AND groups / n <= 0.6::DOUBLE AND NOT numeric_field AND len >= 3 AND letters >= 0.5
), kept AS (SELECT * FROM chosen WHERE k = 1 AND concentration >= 0.4::DOUBLE),
best AS (SELECT depth FROM kept GROUP BY depth ORDER BY sum(n) DESC, depth LIMIT 1)
SELECT depth, signature, n, field::INTEGER AS field, groups, concentration::DOUBLE AS concentration FROM kept JOIN best USING (depth)
"""

QUERIES = {"scanned_pages": scanned_pages, "capped_facts": capped_facts, "capped_value_counts": capped_value_counts, "naming_conventions": naming_conventions}
ORACLE_SQL = {
    "scanned_pages": SCANNED_SQL, "capped_facts": f"WITH {_CAPPED} SELECT * FROM capped",
    "capped_value_counts": f"WITH {_CAPPED} SELECT fact, value, count(*) AS n FROM facts WHERE fact IN (SELECT fact FROM capped WHERE NOT overflowed) GROUP BY 1, 2", "naming_conventions": CONVENTIONS_SQL,
}
