"""Queries over trees of paths that parts make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import trees


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), "p_brand", "p_size")


def folder_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of few names and contents, four folders deep, so that some folders are equal; and folders without files."""
    p, k = _parts(spark, sf_dir), F.col("k")
    text = lambda c: c.cast("string")
    path = F.concat_ws("/", "p_brand", F.concat(F.lit("s"), text(F.col("p_size") % 4)), F.concat(F.lit("t"), text(k % 3)), F.concat(text(F.col("p_size") % 3), F.lit(".txt")))
    files = p.select(path.alias("path"), F.when(k % 50 == 0, "symlink").otherwise("file").alias("kind"), F.sha2(text(F.col("p_size") % 2), 256).alias("digest"))
    bare = p.where("k % 9 = 0").select(F.concat_ws("/", "p_brand", F.lit("empty"), text(k % 2)).alias("path"), F.lit("dir").alias("kind"), F.lit(None).cast("string").alias("digest"))
    return trees.folder_digests(files.unionByName(bare))


def _digests_sql() -> str:
    """The fold written out, level after level."""
    steps = []
    for d in (4, 3, 2, 1):
        below = f" UNION ALL SELECT path, 'dir', files, digest FROM made{d}" if d < 4 else ""
        bare = f" UNION ALL SELECT path, kind, 0, sha256('directory') FROM given WHERE kind = 'dir' AND depth = {d}" + (f" AND path NOT IN (SELECT path FROM made{d})" if d < 4 else "")
        steps.append(f"""level{d} AS (
    SELECT array_to_string(string_split(path, '/')[:-2], '/') AS folder, string_split(path, '/')[-1] AS name, kind, files, digest FROM (
        SELECT path, kind, 1 AS files, digest FROM given WHERE kind <> 'dir' AND depth = {d}{below}{bare})
), some{d} AS (
    SELECT folder, sha256(name)[:4] AS part, sum(files) AS files, sha256(string_agg(name || '/' || kind || '/' || digest || '/', '' ORDER BY name)) AS digest FROM level{d} GROUP BY 1, 2
), made{d - 1} AS (SELECT folder AS path, sum(files)::BIGINT AS files, sha256('directory' || string_agg(part || ':' || digest || '/', '' ORDER BY part)) AS digest FROM some{d} GROUP BY 1)""")
    return f"""
WITH entries AS (
    SELECT p_brand || '/s' || (p_size % 4) || '/t' || (p_partkey % 3) || '/' || (p_size % 3) || '.txt' AS path, CASE WHEN p_partkey % 50 = 0 THEN 'symlink' ELSE 'file' END AS kind,
           sha256((p_size % 2)::VARCHAR) AS digest FROM part
    UNION ALL SELECT p_brand || '/empty/' || (p_partkey % 2), 'dir', '' FROM part WHERE p_partkey % 9 = 0
), given AS (
    SELECT path, max(kind) AS kind, arg_max(digest, kind || '/' || digest) AS digest, len(string_split(path, '/')) AS depth FROM entries GROUP BY path
), {", ".join(steps)}
SELECT * FROM made0 UNION ALL SELECT * FROM made1 UNION ALL SELECT * FROM made2 UNION ALL SELECT * FROM made3
UNION ALL SELECT path, 0, sha256('directory') FROM given WHERE kind = 'dir' AND path NOT IN (SELECT path FROM made0 UNION ALL SELECT path FROM made1 UNION ALL SELECT path FROM made2 UNION ALL SELECT path FROM made3)
"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each brand, size and key class; some parts lie beside markers of projects, in packages, or in hidden and ignored folders."""
    k, none = F.col("k"), F.lit(None).cast("string")
    text = lambda c: c.cast("string")
    p = _parts(spark, sf_dir).withColumn("dirs", F.array("p_brand", F.concat(F.lit("s"), text(F.col("p_size") % 7)), F.concat(F.lit("t"), text(k % 5)), F.concat(F.lit("u"), text(k % 2))))
    at = lambda name, depth: F.concat_ws("/", F.slice("dirs", F.lit(1), depth), name)
    e = lambda name, depth=F.lit(4), is_dir=False, head=none: F.struct(at(name, depth).alias("path"), F.lit(is_dir).alias("is_dir"), head.alias("head"))
    level = (k % 3 + 2).cast("int")
    found = F.array(
        e(F.concat(F.lit("part"), text(k), F.lit(".txt")), (k % 5).cast("int")),
        F.when(k % 37 == 0, e(F.lit("package.json"), level)), F.when(k % 41 == 0, e(F.lit(".git"), level, True)), F.when(k % 43 == 0, e(F.lit("Song.RPP"), level)),
        F.when(k % 13 == 0, e(F.lit("Tool.app/inside/x.bin"), level)), F.when(k % 17 == 0, e(F.lit(".cache/y.txt"), level)), F.when(k % 19 == 0, e(F.lit("build/deep/package.json"), level)),
        F.when(k % 7 == 0, e(F.lit("cv.tex"), F.lit(4), False, F.when(k % 2 == 0, F.lit("% a\n\\documentclass{x}")).otherwise(F.lit("\\input")))), F.when(k % 11 == 0, e(F.lit("own.cls"))),
    )
    return p.select(F.inline(F.filter(found, lambda x: x.isNotNull())))


def walked_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.walk(_tree(spark, sf_dir), 3, ("build",))


WALKED_SQL = r"""
WITH p AS (SELECT p_partkey AS k, [p_brand, 's' || (p_size % 7), 't' || (p_partkey % 5), 'u' || (p_partkey % 2)] AS dirs, p_partkey % 3 + 2 AS level FROM part),
given AS (
    SELECT array_to_string(list_append(dirs[:k % 5], 'part' || k || '.txt'), '/') AS path, false AS is_dir, NULL AS head FROM p
    UNION ALL SELECT array_to_string(list_append(dirs[:level], 'package.json'), '/'), false, NULL FROM p WHERE k % 37 = 0
    UNION ALL SELECT array_to_string(list_append(dirs[:level], '.git'), '/'), true, NULL FROM p WHERE k % 41 = 0
    UNION ALL SELECT array_to_string(list_append(dirs[:level], 'Song.RPP'), '/'), false, NULL FROM p WHERE k % 43 = 0
    UNION ALL SELECT array_to_string(list_append(dirs[:level], 'Tool.app/inside/x.bin'), '/'), false, NULL FROM p WHERE k % 13 = 0
    UNION ALL SELECT array_to_string(list_append(dirs[:level], '.cache/y.txt'), '/'), false, NULL FROM p WHERE k % 17 = 0
    UNION ALL SELECT array_to_string(list_append(dirs[:level], 'build/deep/package.json'), '/'), false, NULL FROM p WHERE k % 19 = 0
    UNION ALL SELECT array_to_string(list_append(dirs, 'cv.tex'), '/'), false, k % 2 = 0 FROM p WHERE k % 7 = 0
    UNION ALL SELECT array_to_string(list_append(dirs, 'own.cls'), '/'), false, NULL FROM p WHERE k % 11 = 0
), known AS (SELECT path, bool_or(is_dir) AS is_dir, coalesce(bool_or(head::BOOLEAN), false) AS head FROM given GROUP BY path),
pieces AS (SELECT *, string_split(path, '/') AS ps FROM known),
folders AS (SELECT DISTINCT ps[:n] AS ps FROM pieces, unnest(range(1, len(ps) + 1)) AS u(n) WHERE n < len(ps) OR is_dir),
names AS (SELECT ps, head FROM pieces UNION ALL SELECT ps, false FROM folders),
judged AS (
    SELECT f.ps, CASE
        WHEN f.ps[-1] LIKE '%.app' THEN 'package directory' WHEN f.ps[-1][1] = '.' OR f.ps[-1] = 'build' THEN ''
        WHEN (SELECT bool_or(n.ps[-1] IN ('.git', 'package.json', 'Song.RPP')) OR (bool_or(n.ps[-1] = 'own.cls') AND bool_or(n.ps[-1] = 'cv.tex' AND n.head)) FROM names n WHERE n.ps[:-2] = f.ps) THEN 'project folder' END AS reason,
        (SELECT CASE WHEN bool_or(n.ps[-1] = '.git') THEN 'repository' WHEN bool_or(n.ps[-1] = 'package.json') THEN 'code' WHEN bool_or(n.ps[-1] = 'Song.RPP') THEN 'audio' ELSE 'latex' END
         FROM names n WHERE n.ps[:-2] = f.ps) AS project
    FROM folders f
), stops AS (SELECT * FROM judged WHERE reason IS NOT NULL)
SELECT path, false AS is_dir, NULL AS reason, NULL AS project FROM pieces
WHERE NOT is_dir AND len(ps) <= 4 AND NOT EXISTS (SELECT 1 FROM stops s WHERE len(s.ps) < len(pieces.ps) AND pieces.ps[:len(s.ps)] = s.ps)
UNION ALL
SELECT array_to_string(ps, '/'), true, reason, CASE WHEN reason = 'project folder' THEN project END FROM stops t
WHERE reason <> '' AND len(ps) <= 4 AND NOT EXISTS (SELECT 1 FROM stops s WHERE len(s.ps) < len(t.ps) AND t.ps[:len(s.ps)] = s.ps)
"""


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as films in the folders of their priorities, with subtitles under many tags."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    stem = F.concat(F.lit("Film."), F.floor(k / 8).cast("string"))
    ends = F.array(*[F.lit(x) for x in (".mkv", ".en.srt", ".face.ass", ".face.en.ass", "-poster.jpg", ".Director.srt", ".old.face.srt", ".txt")])
    return o.where("o_orderkey % 13 <> 0").select(k.alias("id"), F.col("o_orderpriority").alias("dir"), F.concat(stem, F.get(ends, (k % 8).cast("int"))).alias("name"))


def adopted_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = _media(spark, sf_dir).withColumn("dir", F.lit("films"))
    return trees.stems_with_adopted(media).select("id", "name", "stem")


ADOPTED_SQL = r"""
WITH media AS (
    SELECT o_orderkey AS id, 'Film.' || (o_orderkey // 8) || ['.mkv', '.en.srt', '.face.ass', '.face.en.ass', '-poster.jpg', '.Director.srt', '.old.face.srt', '.txt'][o_orderkey % 8 + 1] AS name FROM orders WHERE o_orderkey % 13 <> 0
), stems AS (
    SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(name, '\.[^.]*$', ''), '(?i)[-_](poster|fanart|banner|thumb|cover|folder|art|backdrop|logo|clearart|proof)$', ''),
                    '(?i)\.([a-z]{2,3}(-[a-z]{2,4})?)(\.(forced|sdh|cc|hi|default))?$', '')) AS stem, string_split(name, '.')[-1] AS ext FROM media
)
SELECT id, name, CASE WHEN NOT EXISTS (SELECT 1 FROM stems o WHERE o.stem = s.stem AND o.ext NOT IN ('srt', 'ass'))
                       AND regexp_matches(stem, '^.+\.[a-z][a-z0-9-]{1,15}$') AND EXISTS (SELECT 1 FROM stems o WHERE o.stem = regexp_replace(s.stem, '\.[^.]*$', '') AND o.ext = 'mkv')
                      THEN regexp_replace(stem, '\.[^.]*$', '') ELSE stem END AS stem FROM stems s
"""

QUERIES = {"folder_digests": folder_digests, "walked_tree": walked_tree, "adopted_subtitles": adopted_subtitles}
ORACLE_SQL = {"folder_digests": _digests_sql(), "walked_tree": WALKED_SQL, "adopted_subtitles": ADOPTED_SQL}
