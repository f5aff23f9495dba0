"""Queries of grouping, of induction by counting, and of the ledger, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import grouping, induction, ledger


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts: the keeper has the best place (languages stand for places) and the smallest id."""
    place = F.when(F.col("lang") == "en", 2).when(F.col("lang") == "de", 1).otherwise(0)
    return grouping.duplicate_groups(_table(spark, sf_dir, "documents"), "doc_id", "text", place, min_size=256)


DUP_EXACT_SQL = """
WITH d AS (SELECT doc_id, octet_length(encode(text)) AS size, sha256(text) AS digest, CASE lang WHEN 'en' THEN 2 WHEN 'de' THEN 1 ELSE 0 END AS place FROM documents),
s AS (SELECT *, max(place) OVER (PARTITION BY digest) AS best FROM d WHERE size >= 256)
SELECT digest, size, count(*) AS copies, first(doc_id ORDER BY place DESC, doc_id) AS keeper, count(*) FILTER (WHERE place < best) AS losers,
       count(*) FILTER (WHERE place = best) - 1 AS undecided, size * count(*) FILTER (WHERE place < best) AS wasted
FROM s GROUP BY digest, size HAVING count(*) > 1
"""


def dup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.first_seen(_table(spark, sf_dir, "documents"), "doc_id", "text")


DUP_FIRST_SQL = "SELECT * FROM (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS duplicate_of FROM documents WHERE text <> '') WHERE id <> duplicate_of"


def folder_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").withColumn("size", F.octet_length("text"))
    return grouping.folder_profiles(d, "source", "lang", "size")


FOLDER_SQL = """
WITH p AS (SELECT source, lang, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS b FROM documents GROUP BY 1, 2),
t AS (SELECT source, sum(n)::BIGINT AS files, sum(b)::BIGINT AS bytes, first(lang ORDER BY b DESC, lang) AS dominant, max(b) AS top FROM p GROUP BY 1)
SELECT source, files, bytes, dominant, top / bytes AS share, CASE WHEN top / bytes >= 0.8 THEN 'strong' WHEN top / bytes >= 0.6 THEN 'likely' ELSE 'mixed' END AS says FROM t
"""


def bundle_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a bundle: its primary is the largest line, then the lowest number."""
    l = _table(spark, sf_dir, "lineitem")
    order = [F.col("l_returnflag") == "R", F.desc("l_extendedprice"), F.col("l_linenumber")]
    return grouping.bundle_primaries(l, ["l_orderkey"], order, ["l_linenumber", "l_extendedprice"])


BUNDLE_SQL = """
SELECT l_orderkey, l_linenumber, l_extendedprice, members FROM (
    SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS members, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R', l_extendedprice DESC, l_linenumber) AS k FROM lineitem
) WHERE k = 1
"""


def name_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "customer").select(F.concat(F.regexp_replace("c_name", "#", "_"), F.lit(".png")).alias("name"))
    return grouping.sequences(names, "name")


NAME_SEQUENCES_SQL = r"SELECT 'Customer_' AS prefix, '.png' AS ext, count(*) AS n, min(regexp_extract(c_name, '\d+$')::BIGINT) AS first, max(regexp_extract(c_name, '\d+$')::BIGINT) AS last FROM customer HAVING count(*) >= 8"


def facet_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("nothing", F.lit(None).cast("string"))
    return induction.assess_facets(docs, {"language": "lang", "origin": "source", "marked": "toxic", "alone": "doc_id", "empty": "nothing"})


FACET_SQL = """
WITH d AS (SELECT doc_id::VARCHAR AS doc_id, source, lang, toxic::VARCHAR AS toxic FROM (SELECT * FROM documents LEFT JOIN labels USING (doc_id))),
v AS (SELECT 'language' AS facet, lang AS value FROM d UNION ALL SELECT 'origin', source FROM d UNION ALL SELECT 'marked', toxic FROM d UNION ALL SELECT 'alone', doc_id FROM d),
c AS (SELECT facet, value, count(*) AS n FROM v WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2),
p AS (SELECT facet, sum(n)::BIGINT AS covered, count(*) AS groups, quantile_cont(n, 0.5)::DOUBLE AS median, (coalesce(sum(n) FILTER (WHERE n >= 3), 0) / sum(n))::DOUBLE AS concentration FROM c GROUP BY 1),
k(facet, fact) AS (VALUES ('language', 'lang'), ('origin', 'source'), ('marked', 'toxic'), ('alone', 'doc_id'), ('empty', 'nothing')),
t AS (SELECT count(*) AS total FROM d)
SELECT facet, coalesce(covered, 0) AS covered, coalesce(groups, 0) AS groups, coalesce(median, 0.0) AS median, coalesce(concentration, 0.0) AS concentration,
       CASE WHEN coalesce(groups, 0) = 0 THEN 'nothing has ' || fact WHEN covered / total < 0.02 THEN printf('only %.1f%% of items have %s', covered / total * 100, fact)
            WHEN groups > 600 THEN printf('would make %d folders', groups) WHEN concentration < 0.4 THEN printf('%.0f%% would be alone in a folder', (1 - concentration) * 100) END AS reason
FROM k LEFT JOIN p USING (facet), t
"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.select("o_orderkey", F.col("c_mktsegment").alias("folder"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.left("c_mktsegment", F.lit(3))).alias("region"))
    pairs = F.array(*[F.struct(F.lit(f).alias("fact"), F.col(f).alias("value")) for f in ("priority", "status", "region")])
    return rows.select("o_orderkey", "folder", F.inline(pairs))


_PLACED = """placed AS (
    SELECT o_orderkey, c_mktsegment AS folder, unnest(['priority', 'status', 'region']) AS fact,
           unnest([o_orderpriority, o_orderstatus, 'n' || c_nationkey || left(c_mktsegment, 3)]) AS value
    FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def value_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return induction.value_population(_placed(spark, sf_dir))


VALUE_POPULATION_SQL = f"WITH {_PLACED} SELECT fact, value, count(*) AS n FROM placed GROUP BY 1, 2"


def preference_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return induction.induce_preferences(_placed(spark, sf_dir))


PREFERENCE_SQL = f"""
WITH {_PLACED}, s AS (SELECT fact, value, folder, count(*) AS support FROM placed GROUP BY ALL),
p AS (SELECT *, support / sum(support) OVER (PARTITION BY fact, value) AS precision FROM s)
SELECT folder, fact, value, support, precision FROM p WHERE support >= 3 AND precision >= 0.8
QUALIFY row_number() OVER (PARTITION BY folder ORDER BY support DESC, precision DESC, fact, value) = 1
"""


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat((F.col("p_partkey") + 1000000).cast("string"), F.lit("."), F.lower(F.regexp_replace("p_brand", "#", "-")), F.lit("_"), F.col("p_type"), F.lit(" "), F.col("p_name")).alias("stem"))


def name_signature_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return induction.signature_clusters(_stems(spark, sf_dir), "stem", 2)


_STEM = "(p_partkey + 1000000)::VARCHAR || '.' || lower(replace(p_brand, '#', '-')) || '_' || p_type || ' ' || p_name"
SIGNATURE_SQL = f"SELECT '<num7>.<word>_<tail>' AS signature, count(*) AS n, min({_STEM}) AS example FROM part HAVING count(*) >= 3"


def convention_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return induction.convention_category(_stems(spark, sf_dir), "stem", 2)


CONVENTION_SQL = """
WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)
SELECT '<num7>.<word>_<tail>' AS signature, 1 AS field, sum(n)::BIGINT AS n, count(*) AS "distinct", (coalesce(sum(n) FILTER (WHERE n >= 3), 0) / sum(n))::DOUBLE AS concentration FROM c
"""


def heading_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", text.heading_of(F.col("text")).alias("heading"))
    return induction.heading_terms(d, "doc_id", "heading")


_HEADINGS = r"""headings AS (
    SELECT doc_id, coalesce(array_to_string([CASE WHEN k > 1 AND ps[k] > ps[k - 1] + 1 THEN '· ' ELSE '' END || tokens[ps[k]] for k in range(1, len(ps) + 1)], ' '), '') AS heading
    FROM (SELECT doc_id, tokens, [i for i in range(1, len(tokens) + 1) if regexp_matches(tokens[i], '\pL{2,}')][1:6] AS ps
          FROM (SELECT doc_id, [x for x in regexp_split_to_array(left(text, 500), '\s+') if x <> ''] AS tokens FROM documents))
)"""
HEADING_TERMS_SQL = rf"""
WITH RECURSIVE {_HEADINGS}, used AS (SELECT doc_id, heading FROM headings WHERE heading <> ''),
words AS (SELECT doc_id, unnest(regexp_extract_all(heading, '[\pL\p{{Nl}}\p{{No}}]{{3,}}')) AS word, generate_subscripts(regexp_extract_all(heading, '[\pL\p{{Nl}}\p{{No}}]{{3,}}'), 1) - 1 AS pos FROM used),
keyed AS (SELECT doc_id, word, pos, lower(strip_accents(word)) AS term FROM words),
parts AS (
    SELECT doc_id, unnest(regexp_split_to_array(chunk, '[_.\-]+')) AS part FROM (SELECT doc_id, unnest(regexp_split_to_array(heading, '\s+')) AS chunk FROM used)
    WHERE NOT regexp_matches(chunk, '(^|[^-])[/\\]|@|[\pL\pN_]\.[\pL\pN_]+\.[\pL\pN_]')
), classed AS (SELECT doc_id, part, regexp_replace(regexp_replace(regexp_replace(part, '[^\pL\p{{Nd}}]', '-', 'g'), '\pL+', 'a', 'g'), '\p{{Nd}}+', '0', 'g') AS c FROM parts),
bare AS (
    SELECT DISTINCT doc_id, lower(strip_accents(unnest(regexp_extract_all(part, '[\pL\p{{Nl}}\p{{No}}]{{3,}}')))) AS term FROM classed
    WHERE len([i FOR i IN range(1, len(c)) IF c[i:i + 1] IN ('a0', '0a')]) < 3
), firsts AS (SELECT doc_id, term, min(pos) AS pos FROM keyed GROUP BY 1, 2),
counted AS (
    SELECT term, count(*) AS n, list_sort(list(pos))[count(*) // 2 + 1] AS middle, avg(pos) AS position, count(b.doc_id) AS bare
    FROM firsts LEFT JOIN bare b USING (doc_id, term) GROUP BY term
), spelled AS (SELECT term, word, count(*) AS c FROM keyed GROUP BY 1, 2),
named AS (
    SELECT term, first(word ORDER BY c DESC, NOT (word = upper(word[1]) || lower(word[2:]) AND word <> lower(word)), word = upper(word) AND word <> lower(word), word) AS spelling,
           coalesce(sum(c) FILTER (WHERE regexp_matches(word, '\p{{Lu}}')), 0) * 2 > sum(c) OR lower(min(word)) = upper(min(word)) AS titled
    FROM spelled GROUP BY term
), fit AS (
    SELECT term, n, middle, position, spelling FROM counted JOIN named USING (term)
    WHERE bare >= 3 AND n >= 3 AND n <= greatest(3.0, (SELECT count(*) FROM used) * 0.6::DOUBLE) AND middle < 3 AND titled
      AND NOT regexp_matches(spelling, '\p{{No}}') AND regexp_matches(spelling, '\pL')
      AND (length(regexp_replace(spelling, '\P{{Latin}}', '', 'g')) < 0.8 * length(regexp_replace(spelling, '\PL', '', 'g')) OR regexp_matches(spelling, '[A-Za-z]'))
), enough AS (SELECT * FROM fit WHERE (SELECT count(*) FROM fit) >= 3),
pairs AS (
    SELECT x.term AS a, y.term AS b, count(*) AS shared FROM firsts x JOIN firsts y USING (doc_id)
    WHERE x.term IN (SELECT term FROM enough) AND y.term IN (SELECT term FROM enough) AND x.term <> y.term GROUP BY 1, 2
), kept0 AS (
    SELECT *, row_number() OVER (ORDER BY position, n DESC, term) AS k FROM enough e WHERE NOT EXISTS (
        SELECT 1 FROM pairs p JOIN enough o ON o.term = p.b WHERE p.a = e.term AND o.n > e.n AND e.n - p.shared <= 0.09999999999999998::DOUBLE * e.n AND o.middle <= e.middle)
), earlier AS (
    SELECT x.k, list(y.k) FILTER (WHERE x.n - p.shared <= 0.09999999999999998::DOUBLE * x.n) AS covering, list(y.k) AS sharing
    FROM kept0 x JOIN pairs p ON p.a = x.term JOIN kept0 y ON y.term = p.b WHERE y.k < x.k AND p.shared >= 0.25 * x.n GROUP BY x.k
), picks(k, claimed) AS (
    SELECT 0::BIGINT, []::BIGINT[]
    UNION ALL
    SELECT p.k + 1, CASE WHEN len(list_intersect(coalesce(e.covering, []), p.claimed)) > 0 OR len(list_intersect(coalesce(e.sharing, []), p.claimed)) >= 2
                         THEN p.claimed ELSE list_append(p.claimed, p.k + 1) END
    FROM picks p LEFT JOIN earlier e ON e.k = p.k + 1 WHERE p.k < (SELECT count(*) FROM kept0)
)
SELECT spelling AS term, n AS documents, position FROM kept0, (SELECT claimed FROM picks ORDER BY k DESC LIMIT 1) WHERE list_contains(claimed, k) ORDER BY position, n DESC, kept0.term LIMIT 40
"""


def shared_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that part names share around the most frequent second word."""
    p = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("spare part of "), "p_brand").alias("heading"))
    return induction.shared_phrases(p, "p_partkey", "heading", "part")


SHARED_PHRASE_SQL = "SELECT 'spare part of' AS phrase, count(*) AS documents FROM part HAVING count(*) >= 3"


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as moves among a few paths."""
    e = _table(spark, sf_dir, "events")
    path = lambda k: F.concat(F.lit("/p"), (k % 97).cast("string"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), F.concat(path(F.col("event_id") * 7), F.lit("/u"), (F.col("user_id") % 50).cast("string")).alias("source"),
        F.concat(path(F.col("event_id") * 5 + 3), F.lit("/u"), (F.col("user_id") % 50).cast("string")).alias("destination"),
        F.when(F.col("event_id") % 11 == 0, "dry-run").otherwise("done").alias("status"), F.element_at(F.array(F.lit("move"), F.lit("copy"), F.lit("rename")), (F.col("event_id") % 3 + 1).cast("int")).alias("operation"),
        F.when(F.col("event_id") % 13 == 0, F.col("ts")).alias("undone_at"), F.col("ts").alias("created_at"), F.col("props").alias("facts"), (F.col("event_id") % 5 == 0).cast("int").alias("holding"), F.col("value").alias("value"), F.col("event_type"),
    )


_MOVES = """moves AS (
    SELECT event_id AS id, user_id AS run_id, '/p' || ((event_id * 7) % 97) || '/u' || (user_id % 50) AS source, '/p' || ((event_id * 5 + 3) % 97) || '/u' || (user_id % 50) AS destination,
           CASE WHEN event_id % 11 = 0 THEN 'dry-run' ELSE 'done' END AS status, ['move', 'copy', 'rename'][(event_id % 3 + 1)::INT] AS operation,
           CASE WHEN event_id % 13 = 0 THEN ts END AS undone_at, ts AS created_at, props AS facts, (event_id % 5 = 0)::INT AS holding, value, event_type FROM events
)"""


def placed_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.placed_moves(_moves(spark, sf_dir)).select("id", "source", "destination", "operation")


PLACED_SQL = f"""WITH {_MOVES} SELECT id, source, destination, operation FROM moves m WHERE status = 'done' AND undone_at IS NULL AND NOT EXISTS (
    SELECT 1 FROM moves l WHERE l.source = m.destination AND l.id > m.id AND l.status = 'done' AND l.undone_at IS NULL AND l.operation IN ('move', 'rename', 'trash'))"""


def ledger_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.search(_moves(spark, sf_dir), "P1", ("source", "destination"), [F.desc("id")]).select("id", "source", "destination")


SEARCH_SQL = f"WITH {_MOVES} SELECT id, source, destination FROM moves WHERE contains(lower(source), 'p1') OR contains(lower(destination), 'p1') ORDER BY id DESC LIMIT 200"


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _moves(spark, sf_dir).select("source", "id", "status", "operation")
    return ledger.latest(m, ["source"], [F.col("id")]).select("source", "id", "status", "operation")


UPSERT_SQL = f"WITH {_MOVES} SELECT source, id, status, operation FROM moves QUALIFY row_number() OVER (PARTITION BY source ORDER BY id DESC) = 1"


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _moves(spark, sf_dir)
    return ledger.worst_costs(m.select(F.col("source").alias("path"), (F.col("value") / 50).alias("seconds"), F.when(F.col("id") % 2 == 0, (F.col("value") * 1000000).cast("long")).alias("growth"), F.col("event_type").alias("reason"), F.col("id").alias("seen")))


_COSTS = f"""{_MOVES}, r AS (SELECT source AS path, value / 50 AS seconds, CASE WHEN id % 2 = 0 THEN trunc(value * 1000000)::BIGINT END AS growth, event_type AS reason, id AS seen FROM moves),
costs AS (SELECT path, max(seconds) AS seconds, max(growth) AS growth, count(*) AS readings, first(reason ORDER BY seconds DESC, seen DESC) AS reason, max(seen) AS last_seen FROM r GROUP BY path)"""


def cost_worst_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(spark, sf_dir)


def expensive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.expensive(_costs(spark, sf_dir)).select("path", "seconds", "growth")


EXPENSIVE_SQL = f"WITH {_COSTS} SELECT path, seconds, growth FROM costs ORDER BY greatest(seconds / 1.0, coalesce(growth, 0) / 16777216.0) DESC, seconds DESC, path LIMIT 50"


def ledger_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.usage(_moves(spark, sf_dir), "created_at", F.octet_length("facts"))


USAGE_SQL = f"""WITH {_MOVES}, u AS (SELECT count(*) AS rows, sum(octet_length(encode(facts)))::BIGINT AS bytes, (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 86400e6 AS days FROM moves)
SELECT rows, bytes, days, CASE WHEN days >= 1 THEN bytes / days ELSE 0.0 END AS bytes_per_day, CASE WHEN days >= 1 THEN bytes / days ELSE 0.0 END * 365 AS projected_year FROM u"""


def ledger_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention, as of the last event."""
    m = _moves(spark, sf_dir)
    last = m.agg(F.max("created_at").alias("_now"))
    return ledger.compact(m.crossJoin(F.broadcast(last)), F.col("_now"), 3, 1).select("id", "status", "facts")


COMPACT_SQL = f"""WITH {_MOVES}, n AS (SELECT max(created_at) AS now FROM moves)
SELECT id, status, CASE WHEN created_at < now - INTERVAL 3 DAY AND NOT (holding = 1 AND undone_at IS NULL) THEN NULL ELSE facts END AS facts
FROM moves, n WHERE NOT (status = 'dry-run' AND created_at < now - INTERVAL 1 DAY)"""


def undoable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _moves(spark, sf_dir)
    runs = m.select(F.col("run_id").alias("id")).distinct().withColumn("action", F.when(F.col("id") % 2 == 0, "sort").otherwise("refile")).withColumn("dry_run", (F.col("id") % 7 == 0).cast("int"))
    return ledger.undoable_runs(runs, m)


UNDOABLE_SQL = f"WITH {_MOVES} SELECT run_id, 'sort' AS action, count(*) AS n FROM moves WHERE status = 'done' AND undone_at IS NULL AND run_id % 2 = 0 AND run_id % 7 <> 0 GROUP BY run_id"


def bundled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of several lines, with how many."""
    l = _table(spark, sf_dir, "lineitem")
    return l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("l_suppkey").alias("suppliers")).where("members > 1")


BUNDLED_SQL = "SELECT l_orderkey, count(*) AS members, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1 HAVING count(*) > 1"


def settle_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("seen"), F.col("event_type").alias("mark"))
    return ledger.settle_islands(e, ["item"], "seen", "mark")


SETTLE_SQL = """
WITH s AS (SELECT user_id AS item, event_id AS seen, event_type AS mark, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
SELECT item, mark, min(seen) AS since, max(seen) AS until, count(*) AS sightings FROM s GROUP BY item, mark, g
"""


def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", ledger.retry_delay((F.col("event_id") % 10).cast("int")).alias("delay"))


RETRY_SQL = "SELECT event_id, least(300, (5 * power(2, least(event_id % 10, 6)))::INT) AS delay FROM events"


def incremental_redecide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that must be decided again: those decided under other rules, changed since, or never."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("fp"))
    decided = d.where(F.col("doc_id") % 5 != 0).select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit(0)).otherwise(F.col("fp")).alias("then"), F.when(F.col("doc_id") % 3 == 0, "old").otherwise("new").alias("rules"))
    joined = d.join(decided, "doc_id", "left")
    why = F.when(F.col("rules").isNull(), "never").when(F.col("rules") != "new", "rules").when(F.col("then") != F.col("fp"), "changed")
    return joined.select("doc_id", why.alias("why")).where("why is not null")


REDECIDE_SQL = "SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'never' WHEN doc_id % 3 = 0 THEN 'rules' WHEN doc_id % 7 = 0 THEN 'changed' END AS why FROM documents) WHERE why IS NOT NULL"


def overridden_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _moves(spark, sf_dir).where("undone_at is not null").select(F.col("event_type").alias("rule"))
    return ledger.overridden_rules(m)


OVERRIDDEN_SQL = f"WITH {_MOVES} SELECT event_type AS rule, count(*) AS n FROM moves WHERE undone_at IS NOT NULL GROUP BY 1"

QUERIES = {
    "dup_exact": dup_exact, "dup_first_seen": dup_first_seen, "folder_profile": folder_profile, "bundle_primary": bundle_primary, "name_sequences": name_sequences,
    "facet_assessment": facet_assessment, "value_population": value_population, "preference_induction": preference_induction, "name_signature_clusters": name_signature_clusters,
    "convention_category": convention_category, "heading_terms": heading_terms, "shared_phrase": shared_phrase, "placed_moves": placed_moves, "ledger_search": ledger_search,
    "upsert_latest": upsert_latest, "cost_worst_reading": cost_worst_reading, "expensive_files": expensive_files, "ledger_usage": ledger_usage, "ledger_compact": ledger_compact,
    "undoable_runs": undoable_runs, "bundled_items": bundled_items, "settle_islands": settle_islands, "retry_backoff": retry_backoff, "incremental_redecide": incremental_redecide,
    "overridden_rules": overridden_rules,
}
ORACLE_SQL = {
    "dup_exact": DUP_EXACT_SQL, "dup_first_seen": DUP_FIRST_SQL, "folder_profile": FOLDER_SQL, "bundle_primary": BUNDLE_SQL, "name_sequences": NAME_SEQUENCES_SQL,
    "facet_assessment": FACET_SQL, "value_population": VALUE_POPULATION_SQL, "preference_induction": PREFERENCE_SQL, "name_signature_clusters": SIGNATURE_SQL,
    "convention_category": CONVENTION_SQL, "heading_terms": HEADING_TERMS_SQL, "shared_phrase": SHARED_PHRASE_SQL, "placed_moves": PLACED_SQL, "ledger_search": SEARCH_SQL,
    "upsert_latest": UPSERT_SQL, "cost_worst_reading": f"WITH {_COSTS} SELECT * FROM costs", "expensive_files": EXPENSIVE_SQL, "ledger_usage": USAGE_SQL, "ledger_compact": COMPACT_SQL,
    "undoable_runs": UNDOABLE_SQL, "bundled_items": BUNDLED_SQL, "settle_islands": SETTLE_SQL, "retry_backoff": RETRY_SQL, "incremental_redecide": REDECIDE_SQL,
    "overridden_rules": OVERRIDDEN_SQL,
}
