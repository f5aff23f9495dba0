"""Views, upserts, retention and audits over the ledger of what was done with items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOVING = ("move", "rename", "trash")


def placed_moves(moves: DataFrame) -> DataFrame:
    """Moves that are done or copied, stand, and whose destination no later standing move took away again.

    The anti join has an equality on the path, so it is a hash join of the moves with themselves; the order is a residual.
    """
    standing = moves.where(F.col("status").isin("done", "copied") & F.col("undone_at").isNull())
    later = standing.where((F.col("status") == "done") & F.col("operation").isin(*MOVING)).select(F.col("source").alias("_from"), F.col("id").alias("_id"))
    return standing.join(later, (F.col("destination") == F.col("_from")) & (F.col("_id") > F.col("id")), "left_anti")


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """An upsert seen as a table: each key's last row. The key's rows are reduced before they are shuffled."""
    fields = [F.col(c) for c in df.columns if c not in key]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    won = df.groupBy(*key).agg(F.max_by(F.struct(*fields), rank).alias("_row"))
    return won.select(*key, "_row.*")


def worst_costs(readings: DataFrame) -> DataFrame:
    """(path, seconds, growth, readings, reason, last_seen): the worst reading of each path; the reason is that of the slowest."""
    return readings.groupBy("path").agg(
        F.max("seconds").alias("seconds"), F.max("growth").alias("growth"), F.count(F.lit(1)).alias("readings"),
        F.max_by("reason", F.struct("seconds", "seen", "reason")).alias("reason"), F.max("seen").alias("last_seen"),
    )


def expensive(costs: DataFrame, slow_seconds: float = 1.0, greedy_bytes: float = 16 * 2**20, limit: int = 50) -> DataFrame:
    """The costliest files: by how far past either threshold, then by seconds, then by path."""
    score = F.greatest(F.col("seconds") / slow_seconds, F.coalesce(F.col("growth"), F.lit(0)) / greedy_bytes)
    return costs.orderBy(F.desc(score), F.desc("seconds"), "path").limit(max(1, min(limit, 500)))


def search(moves: DataFrame, text: str, columns: tuple[str, ...], order: list[Column], limit: int = 200) -> DataFrame:
    """Moves with the text in one of the columns, ASCII case apart, newest first. The text is literal, whatever it holds."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(c).contains(text.lower())
    return moves.where(F.coalesce(hit, F.lit(False))).orderBy(*order).limit(limit)


def usage(moves: DataFrame, created: str, size: Column) -> DataFrame:
    """One row: rows, bytes, days, bytes_per_day (0 for less than a day of history) and what a year would add."""
    days = (F.unix_micros(F.max(created).cast("timestamp")) - F.unix_micros(F.min(created).cast("timestamp"))) / 86_400e6
    base = moves.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.coalesce(days, F.lit(0.0)).alias("days"))
    rate = F.when(F.col("days") >= 1, F.col("bytes") / F.col("days")).otherwise(0.0)
    return base.select("rows", "bytes", "days", rate.alias("bytes_per_day"), (rate * 365).alias("projected_year"))


def compact(moves: DataFrame, now: Column, keep_facts_days: int = 90, keep_dry_run_days: int = 7) -> DataFrame:
    """The ledger after retention: old dry runs go, old facts are emptied unless a held item may still need them."""
    before = lambda days: F.col("created_at") < now - F.make_dt_interval(F.lit(days))
    kept = moves.where(~((F.col("status") == "dry-run") & before(keep_dry_run_days)))
    needed = (F.col("holding") == 1) & F.col("undone_at").isNull()
    return kept.withColumn("facts", F.when(before(keep_facts_days) & ~needed, None).otherwise(F.col("facts")))


def undoable_runs(runs: DataFrame, moves: DataFrame, actions: tuple[str, ...] = ("sort",)) -> DataFrame:
    """(run_id, action, n): runs of these actions with moves that are done and not undone."""
    standing = moves.where((F.col("status") == "done") & F.col("undone_at").isNull()).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return runs.where((F.col("dry_run") == 0) & F.col("action").isin(*actions)).select(F.col("id").alias("run_id"), "action").join(standing, "run_id")


def overridden_rules(corrections: DataFrame) -> DataFrame:
    """(rule, n): rules that were corrected, most often first."""
    return corrections.where(F.coalesce(F.col("rule"), F.lit("")) != "").groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule")


def settle_islands(seen: DataFrame, key: list[str], order: str, mark: str) -> DataFrame:
    """(key, mark, since, until, sightings): runs of sightings in which an item's mark stays the same.

    The batch twin of settling: a change begins a new island, even back to an earlier mark.
    """
    by = W.partitionBy(*key).orderBy(order)
    changed = F.coalesce((~F.col(mark).eqNullSafe(F.lag(mark).over(by))).cast("int"), F.lit(1))
    numbered = seen.withColumn("_new", F.when(F.lag(order).over(by).isNull(), 1).otherwise(changed)).withColumn("_island", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "_island").agg(F.first(mark).alias(mark), F.min(order).alias("since"), F.max(order).alias("until"), F.count(F.lit(1)).alias("sightings")).drop("_island")


def retry_delay(attempts: Column) -> Column:
    """Seconds before the next try: 5, doubled with each failure, five minutes at most."""
    return F.least(F.lit(300), (F.lit(5) * F.pow(F.lit(2.0), F.least(attempts, F.lit(6)))).cast("int"))
