"""The thin queries over the driver's tables, one for each operator, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import arrow_tokens, chat, decontaminate, filter_audit, flac, licenses, line_dedup, packing, prefix_trie, secret_scan, sharding, simhash, toxicity
from factloom.llm.common import documents, materialise


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.payload_digests(materialise(flac.texts_to_flac(documents(spark, sf_dir)), "flac-media", "zstd", "24m"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(pa.table({"conv_id": pa.array([-7, -7], pa.int64()), "turn": pa.array([0, 1], pa.int64()), "role": ["user", "assistant"], "text": [said, said]}))
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(extra)))


OP2_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), measured AS (
    SELECT *, length(regexp_replace(text,
        '\\|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|startoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>', '\0x', 'g')) AS escaped
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(escaped + length(role) + 24)::BIGINT AS formatted_chars,
       count(*) FILTER (WHERE role = 'assistant') AS n_examples
FROM measured GROUP BY conv_id
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_toxicity(documents(spark, sf_dir), labels)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


OP4_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), gone AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.doc_id, k.pos, k.line, (g.key IS NOT NULL AND k.doc_id <> g.keeper) AS drops
    FROM keyed k LEFT JOIN gone g ON k.key = g.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE drops) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drops), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def _op5_sql() -> str:
    """Phrases and templates by brute force: every place of every phrase, every line against every template."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    strip = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"({q(p)}, {q(label)})" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"({k}, {q(label)}, {q(t.lower())})" for k, (label, t) in enumerate(licenses.TEMPLATES))
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH low AS (SELECT doc_id, {low.format("coalesce(text, '')")} AS t FROM documents),
worded AS (
    SELECT doc_id, t, [x for x in string_split(regexp_replace(t, '{strip}', ' ', 'g'), ' ') if x <> ''] AS w FROM low
), places AS (
    SELECT doc_id, p.label, i - 1 AS pos
    FROM worded, (VALUES {phrases}) p(phrase, label), unnest(range(1, len(w) + 1)) AS u(i)
    WHERE contains(regexp_replace(t, '{strip}', ' ', 'g'), p.phrase)
      AND array_to_string(w[i:i + len(string_split(p.phrase, ' ')) - 1], ' ') = p.phrase
), base AS (
    SELECT doc_id, count(*) AS n, min(pos) AS f, max(pos) AS l, list(DISTINCT label) AS labels FROM places GROUP BY doc_id
), lines AS (
    SELECT doc_id, list_distinct([x for x in string_split(regexp_replace(line, '{strip}', ' ', 'g'), ' ') if x <> '']) AS w
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM low)
), templates AS (
    SELECT k, label, list_distinct([x for x in string_split(regexp_replace(t, '{strip}', ' ', 'g'), ' ') if x <> '']) AS w
    FROM (VALUES {templates}) x(k, label, t)
), held AS (
    SELECT doc_id, label, len(list_intersect(l.w, t.w))::DOUBLE / len(t.w) AS c FROM lines l, templates t
    WHERE len(list_intersect(l.w, t.w)) >= ceil({licenses.THRESHOLD} * len(t.w) - 1e-9)
), method AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best FROM held GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.f::BIGINT AS first_word, b.l::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
       CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(m.best, 0.0) END::DOUBLE AS score
FROM worded LEFT JOIN base b USING (doc_id) LEFT JOIN method m USING (doc_id)
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrow_tokens.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), 40)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialise(prefix_trie.turn_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "turn-digests")
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6))
    nodes = prefix_trie.trie(prefix_trie.spliced(turns, 100, shared), turns.select("conv_id").distinct())
    return nodes.drop("digest", "parent")


OP11_SQL = r"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(unhex(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))))) AS place,
           {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT conv_id, conv_id - conv_id % 100 AS source,
           xor(list_reduce(list_concat([4294967295::BIGINT], [ord(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
               lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                   lambda r, u: xor(r // 2, CASE WHEN r % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
    SELECT i.conv_id, t.place, t.said FROM ids i JOIN turns t ON t.conv_id = i.source AND t.place <= i.h
    UNION ALL SELECT i.conv_id, t.place, t.said FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.place > i.h
), whole AS (
    SELECT i.conv_id, coalesce(list(r.said ORDER BY r.place) FILTER (WHERE r.place IS NOT NULL), []) AS said FROM ids i LEFT JOIN rebuilt r USING (conv_id) GROUP BY i.conv_id
), prefixes AS (
    SELECT conv_id, d AS depth, said[:d] AS said, d = len(said) AS ends FROM whole, unnest(range(0, len(said) + 1)) AS u(d)
), nodes AS (
    SELECT depth, said, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM prefixes GROUP BY depth, said
), childed AS (
    SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.said[:n.depth] = n.said) AS n_children
    FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND n.said[:p.depth] = p.said
), sums AS (
    SELECT said[:d] AS said, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
           sum(CASE WHEN depth > 0 THEN (n_convs - 1) * length(said[depth].text) ELSE 0 END)::BIGINT AS saved_tokens
    FROM childed, unnest(range(0, depth + 1)) AS u(d) GROUP BY 1
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM childed JOIN sums USING (said)
"""


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select("doc_id", *map(count, secret_scan.BASE_KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


OP12_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
rules AS (SELECT * FROM (VALUES
    (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?[A-Za-z0-9+/_.=-]+'),
    (1, 'access', 'AKIA[A-Z0-9]+'),
    (2, 'hex', '[0-9a-f]+'),
    (3, 'github', 'gh[opsur]_[A-Za-z0-9]{36,255}'),
    (4, 'slack', 'xox[abprs]-[A-Za-z0-9-]{10,250}'),
    (5, 'google', 'AIza[A-Za-z0-9_-]{35}'),
    (6, 'stripe', '[rs]k_live_[A-Za-z0-9]{24,250}'),
    (7, 'private_key', '-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----'),
    (8, 'url_login', '://[A-Za-z0-9._~%-]{1,100}:[A-Za-z0-9._~%!*-]{1,100}@'),
    (9, 'web_token', 'eyJ[A-Za-z0-9_-]{8,500}\.eyJ[A-Za-z0-9_-]{8,900}\.[A-Za-z0-9_-]{8,900}')
) x(k, kind, pattern)), split AS (
    SELECT row, k, kind, regexp_extract_all(t, pattern) AS found, string_split_regex(t, pattern) AS between
    FROM texts, rules WHERE regexp_matches(t, pattern)
), spans AS (
    SELECT row, k, kind, found[i] AS m,
           list_sum([length(x) FOR x IN between[:i]]) + coalesce(list_sum([length(x) FOR x IN found[:i - 1]]), 0) AS start
    FROM split, unnest(range(1, len(found) + 1)) AS u(i)
), fit AS (
    SELECT row, k, kind, start::BIGINT AS start, (start + length(m))::BIGINT AS stop FROM spans
    WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(m, '^[A-Za-z_]+["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8
                    WHEN 'access' THEN length(m) >= 16 WHEN 'hex' THEN length(m) >= 32 ELSE true END
), listed AS (
    SELECT row, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
           string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, k) FILTER (WHERE k < 3) AS base,
           string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, k) AS spans
    FROM fit GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (row)
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w
    FROM documents
), failing AS (
    SELECT part, doc_id, [
        len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
        regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
    FROM words
), marked AS (
    SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM failing LEFT JOIN (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
), masks AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM marked GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (SELECT filter_order, step, filter_order[step] AS f FROM orders, unnest(range(1, 6)) AS u(step)),
placed AS (
    SELECT m.*, filter_order, step, f, fails[ord(f) - 64] AS failed,
           len([k FOR k IN range(1, step) IF fails[ord(filter_order[k]) - 64]]) > 0 AS gone, len([y FOR y IN fails IF y]) AS n_failed
    FROM masks m, steps
), counted AS (
    SELECT part, filter_order, step, f,
           coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failed), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE failed AND NOT gone), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (WHERE failed AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE failed AND n_failed = 1), 0)::BIGINT AS unique_fails,
           coalesce(sum(g) FILTER (WHERE failed AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (WHERE failed AND NOT gone), 0)::BIGINT AS toxic_lost
    FROM placed GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_flac_media": op1_flac_media,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_files": op7_token_files,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_sharding": op9_sharding,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_prefix_trie": op11_conversation_prefix_trie,
    "op12_secret_scan": op12_secret_scan,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": OP2_SQL, "op4_line_dedup": OP4_SQL, "op5_license_scan": _op5_sql(),
    "op11_conversation_prefix_trie": OP11_SQL, "op12_secret_scan": OP12_SQL, "op13_filter_audit": OP13_SQL,
}
