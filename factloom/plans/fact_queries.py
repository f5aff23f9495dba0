"""Queries of evidence, derived facts, and facts taken from URLs, HTML and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import derive, hosts, text
from factloom.functions.hosts import BUCKET, DECORATION, MULTIPART_SUFFIXES
from factloom.operators import evidence


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings: a user is an item, an event type a fact, its value rounded what a reader says."""
    e = _table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"),
        F.round("value", 0).cast("long").cast("string").alias("value"), F.lit("number").alias("vtype"),
        F.concat(F.lit("reader"), (F.col("event_id") % 4).cast("string")).alias("source"),
        F.element_at(F.array(F.lit(0.45), F.lit(0.7), F.lit(0.85), F.lit(0.7)), (F.col("event_id") % 4 + 1).cast("int")).alias("confidence"),
    )


def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = evidence.merge_facts(_readings(spark, sf_dir))
    return merged.select("item_id", "name", "value", "source", "confidence", F.array_join("corroborated_by", ",").alias("corroborated_by"), F.size("conflicts").alias("n_conflicts"), "seq")


EVIDENCE_MERGE_SQL = """
WITH RECURSIVE r AS (
    SELECT user_id AS item_id, event_id AS seq, event_type AS name, round(value, 0)::BIGINT AS v, 'reader' || (event_id % 4) AS source,
           [0.45, 0.7, 0.85, 0.7][(event_id % 4 + 1)::INT]::DOUBLE AS confidence,
           row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k
    FROM events WHERE value IS NOT NULL
), fold AS (
    SELECT item_id, name, k, v, source, confidence, '' AS backers, 0 AS conflicts, seq FROM r WHERE k = 1
    UNION ALL
    SELECT f.item_id, f.name, r.k,
           CASE WHEN abs(f.v - r.v) / greatest(abs(f.v), abs(r.v), 1.0) < 0.02 OR f.v = r.v OR r.confidence <= f.confidence THEN f.v ELSE r.v END,
           CASE WHEN abs(f.v - r.v) / greatest(abs(f.v), abs(r.v), 1.0) < 0.02 OR f.v = r.v OR r.confidence <= f.confidence THEN f.source ELSE r.source END,
           CASE WHEN abs(f.v - r.v) / greatest(abs(f.v), abs(r.v), 1.0) < 0.02 OR f.v = r.v THEN least(1.0, f.confidence + (1 - f.confidence) / 2)
                WHEN r.confidence <= f.confidence THEN f.confidence ELSE r.confidence END,
           CASE WHEN abs(f.v - r.v) / greatest(abs(f.v), abs(r.v), 1.0) < 0.02 OR f.v = r.v THEN CASE WHEN f.backers = '' THEN r.source ELSE f.backers || ',' || r.source END
                WHEN r.confidence <= f.confidence THEN f.backers ELSE '' END,
           CASE WHEN abs(f.v - r.v) / greatest(abs(f.v), abs(r.v), 1.0) < 0.02 OR f.v = r.v THEN f.conflicts ELSE f.conflicts + 1 END, f.seq
    FROM fold f JOIN r ON r.item_id = f.item_id AND r.name = f.name AND r.k = f.k + 1
)
SELECT item_id, name, v::VARCHAR AS value, source, confidence, backers AS corroborated_by, conflicts AS n_conflicts, seq
FROM fold QUALIFY row_number() OVER (PARTITION BY item_id, name ORDER BY k DESC) = 1
"""


def evidence_best_of_ordered_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest reading of each fact, the first of equals: one aggregation, no sort of whole groups."""
    r = _readings(spark, sf_dir)
    best = r.groupBy("item_id", "name").agg(F.max_by(F.struct("value", "source", "confidence", "seq"), F.struct("confidence", (-F.col("seq")).alias("s"))).alias("b"))
    return best.select("item_id", "name", "b.value", "b.source", "b.confidence", "b.seq")


EVIDENCE_BEST_SQL = """
SELECT user_id AS item_id, event_type AS name, round(value, 0)::BIGINT::VARCHAR AS value, 'reader' || (event_id % 4) AS source,
       [0.45, 0.7, 0.85, 0.7][(event_id % 4 + 1)::INT]::DOUBLE AS confidence, event_id AS seq
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY [0.45, 0.7, 0.85, 0.7][(event_id % 4 + 1)::INT] DESC, event_id) = 1
"""


def happened_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    taken = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    named = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    h = derive.happened([("taken", taken, 0.85), ("name_date", named, derive.LIKELY), ("added", F.lit("2000-01-01"), derive.WEAK)])
    return o.select("o_orderkey", h.alias("h")).select("o_orderkey", F.col("h.value").alias("happened"), F.col("h.source").alias("source"), F.col("h.confidence").alias("confidence"), derive.confidence_name(F.col("h.confidence")).alias("band"))


HAPPENED_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2000-01-01' END AS happened,
       CASE WHEN o_orderkey % 3 = 0 THEN 'taken' WHEN o_orderkey % 2 = 0 THEN 'name_date' ELSE 'added' END AS source,
       CASE WHEN o_orderkey % 3 = 0 THEN 0.85 WHEN o_orderkey % 2 = 0 THEN 0.70 ELSE 0.45 END::DOUBLE AS confidence,
       CASE WHEN o_orderkey % 3 = 0 THEN 'strong' WHEN o_orderkey % 2 = 0 THEN 'likely' ELSE 'weak' END AS band
FROM orders
"""


def derived_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, duration and shape classes over line items (price as bytes and seconds, quantity by size as a shape)."""
    l = _table(spark, sf_dir, "lineitem")
    ratio = derive.aspect(F.col("l_quantity"), F.col("l_linenumber") * 6)
    return l.select(
        "l_orderkey", "l_linenumber", derive.size_class(F.col("l_extendedprice") * 1000).alias("size_class"), derive.duration_class(F.col("l_extendedprice") / 10).alias("duration_class"),
        ratio.alias("aspect"), derive.orientation_class(ratio).alias("orientation"), text.human_size((F.col("l_extendedprice") * 1000).cast("long")).alias("human"),
    )


def _bands(value: str, bands, beyond: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {top} THEN '{name}'" for top, name in bands) + f" ELSE '{beyond}' END"


DERIVED_SQL = f"""
WITH x AS (SELECT *, l_extendedprice * 1000 AS b, l_extendedprice / 10 AS s, round(l_quantity / (l_linenumber * 6)::DOUBLE, 4) AS a, trunc(l_extendedprice * 1000)::BIGINT AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, {_bands("b", derive.SIZE_BANDS, "huge")} AS size_class, CASE WHEN s <> 0 THEN {_bands("s", derive.DURATION_BANDS, "epic")} END AS duration_class,
       a AS aspect, CASE WHEN a BETWEEN 0.95 AND 1.05 THEN 'square' WHEN a < 1 THEN 'portrait' ELSE 'landscape' END AS orientation,
       CASE WHEN n >= 1073741824 THEN printf('%.1f', n / 1073741824.0) || ' GB' WHEN n >= 1048576 THEN printf('%.1f', n / 1048576.0) || ' MB'
            WHEN n >= 1024 THEN printf('%.1f', n / 1024.0) || ' KB' ELSE printf('%.0f', n::DOUBLE) || ' B' END AS human
FROM x
"""


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, registrable domain, service and undecorated host of each page, also under made-up front labels."""
    p = _table(spark, sf_dir, "pages")
    host = hosts.url_host(F.col("url"))
    fronted = F.concat(F.element_at(F.array(F.lit("cdn3.img."), F.lit("www."), F.lit(""), F.lit("static.media2.files.")), (F.col("page_id") % 4 + 1).cast("int")), host)
    return p.select("page_id", host.alias("host"), fronted.alias("fronted")).select(
        "page_id", "host", hosts.registrable(F.col("fronted")).alias("registrable"), hosts.source(F.col("fronted")).alias("source"), hosts.strip_decoration(F.col("fronted")).alias("plain")
    )


URL_HOSTS_SQL = f"""
WITH h AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)), '') AS host FROM pages),
f AS (SELECT page_id, host, ['cdn3.img.', 'www.', '', 'static.media2.files.'][(page_id % 4 + 1)::INT] || host AS fronted FROM h),
l AS (SELECT *, [x for x in string_split(rtrim(fronted, '.'), '.') if x <> ''] AS labels FROM f),
d AS (
    SELECT *, CASE WHEN len(labels) <= 2 THEN array_to_string(labels, '.')
                   WHEN len(labels) > 3 AND list_contains({list(MULTIPART_SUFFIXES)}, array_to_string(labels[-3:], '.')) THEN array_to_string(labels[-4:], '.')
                   WHEN list_contains({list(MULTIPART_SUFFIXES)}, array_to_string(labels[-2:], '.')) THEN array_to_string(labels[-3:], '.')
                   ELSE array_to_string(labels[-2:], '.') END AS registrable,
           list_position([not regexp_matches(x, '{DECORATION}') for x in labels], true) AS own
    FROM l
)
SELECT page_id, host, registrable, CASE WHEN regexp_matches(split_part(registrable, '.', 1), '{BUCKET}') THEN registrable ELSE split_part(registrable, '.', 1) END AS source,
       array_to_string(labels[least(coalesce(own, len(labels)), greatest(len(labels) - 1, 1)):], '.') AS plain
FROM d
"""


def html_title_and_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    body = text.html_text(F.col("html"))
    return p.select("page_id", text.html_title(F.col("html")).alias("title"), F.size(F.regexp_extract_all(body, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("words"))


_ENT = "{}"
for _k, _v in text.ENTITIES.items():
    _ENT = f"replace({_ENT}, '{_k}', '{_v.replace(chr(39), chr(39) * 2)}')"
HTML_SQL = rf"""
WITH t AS (
    SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) ELSE regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) END AS named,
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'),
               '(?is)<noscript\b.*?</noscript\s*>', ' ', 'g'), '(?is)<template\b.*?</template\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g') AS body
    FROM pages
)
SELECT page_id, nullif(trim(regexp_replace({_ENT.format("regexp_replace(named, '<[^>]+>', ' ', 'g')")}, '[\s\x{{a0}}]+', ' ', 'g')), '') AS title,
       len(regexp_extract_all({_ENT.format("body")}, '[\pL\pN]+')) AS words
FROM t
"""


def doc_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", text.heading_of(F.col("text")).alias("heading"), text.readable(F.col("text")).alias("readable"))


DOC_HEADING_SQL = r"""
WITH t AS (SELECT doc_id, text, [x for x in regexp_split_to_array(left(text, 500), '\s+') if x <> ''] AS tokens FROM documents),
w AS (SELECT doc_id, text, tokens, [i for i in range(1, len(tokens) + 1) if regexp_matches(tokens[i], '\pL{2,}')][1:6] AS ps FROM t)
SELECT doc_id, coalesce(array_to_string([CASE WHEN k > 1 AND ps[k] > ps[k - 1] + 1 THEN '· ' ELSE '' END || tokens[ps[k]] for k in range(1, len(ps) + 1)], ' '), '') AS heading,
       len(regexp_extract_all(text, '\pL{3,}')) >= 8 AS readable
FROM w
"""


def text_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of every document and page."""
    d = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    p = _table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    e = _table(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("props").alias("text"))
    return d.unionByName(p).unionByName(e).select("id", text.sniff_text(F.col("text")).alias("shape"))


def _sniff_sql() -> str:
    q = lambda p: p.replace("'", "''").replace(r"(?s)^\s*<\?xml", r"(?s)^\s*<\?xml")
    shapes = " ".join(f"WHEN regexp_matches(head, '{q(p)}') THEN '{n}'" for n, p in text.TEXT_SHAPES)
    count = lambda m: f"list_distinct([length(x) - length(replace(x, {m}, '')) for x in ls])"
    delimited = " OR ".join(f"(len({count(m)}) = 1 AND {count(m)}[1] > 0)" for m in ("','", "chr(9)", "';'"))
    return rf"""
WITH x AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages UNION ALL SELECT 'e' || event_id, props FROM events),
y AS (SELECT id, text, left(text, 8192) AS head, [z for z in regexp_split_to_array(left(text, 8192), '\r?\n') if trim(z) <> ''][1:10] AS ls FROM x)
SELECT id, CASE {shapes} WHEN regexp_matches(head, '(?s)^\s*[\[{{]') AND json_valid(text) THEN 'json' WHEN len(ls) >= 2 AND ({delimited}) THEN 'delimited' ELSE 'plain' END AS shape FROM y
"""


QUERIES = {
    "evidence_merge": evidence_merge, "evidence_best_of_ordered_readers": evidence_best_of_ordered_readers, "happened_coalesce": happened_coalesce, "derived_classes": derived_classes,
    "url_hosts": url_hosts, "html_title_and_words": html_title_and_words, "doc_heading": doc_heading, "text_sniff": text_sniff,
}
ORACLE_SQL = {
    "evidence_merge": EVIDENCE_MERGE_SQL, "evidence_best_of_ordered_readers": EVIDENCE_BEST_SQL, "happened_coalesce": HAPPENED_SQL, "derived_classes": DERIVED_SQL,
    "url_hosts": URL_HOSTS_SQL, "html_title_and_words": HTML_SQL, "doc_heading": DOC_HEADING_SQL, "text_sniff": _sniff_sql(),
}
