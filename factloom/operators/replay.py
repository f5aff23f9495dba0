"""Walking a ledger back: every run undone in turn, and what a crash left between intent and confirmation.

Undoing run after run depends on state: what an undone move frees or fills decides the
next. Items are tried in one order, and each touches few paths, so the state that an item meets on
a path is that of the last earlier item that touched it and went back. All items are judged at once as if all went back,
a window a path; then those on the paths of items whose outcome has changed, until none changes, and in the end
all once more for their problems. An item is settled once those it rests on are, so rounds are as many as the longest
chain of failures, not as the runs, and each costs what has changed in the last one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.ledger import undoable_runs
from factloom.state import cut

#: Rounds after which their small tables are written as one.
LOGS = 8
#: What a null path is called among the touches, as no file can be.
NOWHERE = "\0"
OCCUPIED, MISSING, CHANGED = "original path is occupied: ", "moved file is missing: ", "file changed since it was sorted: "


def _paths_now(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").isNotNull()).groupBy("path").agg(F.max("digest").alias("digest"))


def _named() -> Column:
    return F.nullif(F.col("path"), F.lit(NOWHERE))


def _touches(back: DataFrame) -> DataFrame:
    """(path, run_id, item, parts): what each item's members take from a path or bring to it, the last move first."""
    part = lambda path, brings: F.struct(F.coalesce(path, F.lit(NOWHERE)).alias("path"), F.struct("id", F.lit(brings).alias("brings"), "digest").alias("part"))
    each = back.select("run_id", "item", F.inline(F.array(part("source", False), part("destination", True))))
    listed = F.sort_array(F.collect_list("part"), asc=False)  # the members of one item on one path
    return each.groupBy("path", "run_id", "item").agg(listed.alias("parts"))


def _kept(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, written once by these keys and in their order, so that what joins them by these keys comes to them."""
    conf, adaptive = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(adaptive)
    conf.set(adaptive, "false")  # an adaptive plan doesn't say how its rows lie, so they would be shuffled for each join
    try:
        return cut(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys))
    finally:
        conf.set(adaptive, was)


def _met(touches: DataFrame, now: DataFrame, **assumed: str) -> DataFrame:
    """The touches with what there is at the path when the item's turn comes, for each column that says which items are assumed to go back."""
    takes = F.struct(F.lit(False).alias("there"), F.lit(None).cast("string").alias("digest"))
    brought = F.filter("parts", lambda p: p["brings"])
    after = F.when(F.size(brought) > 0, F.struct(F.lit(True).alias("there"), F.get(brought, F.lit(0))["digest"].alias("digest"))).otherwise(takes)
    moved = touches.select("path", "run_id", "item", "parts", *[F.when(F.col(ok), after).alias(f"_after_{ok}") for ok in assumed.values()])
    parts = "array<struct<id: bigint, brings: boolean, digest: string>>"
    given = F.struct(F.lit(True).alias("there"), "digest")
    first = now.select(
        "path", *[F.lit(None).cast("long").alias(c) for c in ("run_id", "item")], F.lit(None).cast(parts).alias("parts"), *[given.alias(f"_after_{ok}") for ok in assumed.values()]
    )
    turn = W.partitionBy("path").orderBy(F.desc_nulls_first("run_id"), F.desc_nulls_first("item")).rowsBetween(W.unboundedPreceding, -1)
    met = moved.unionByName(first).withColumns({name: F.last(f"_after_{ok}", ignorenulls=True).over(turn) for name, ok in assumed.items()})
    return met.where("parts is not null").select("path", "run_id", "item", "parts", *assumed)


def _told(met: str) -> Column:
    """The first problem of an item's members on a path, in the order of undoing, with what was met there."""
    there = F.coalesce(F.col(met)["there"], F.lit(False))
    told = lambda p, late, kind, text: F.struct(F.lit(late).alias("late"), (-p["id"]).alias("turn"), F.lit(kind).alias("kind"), F.concat(F.lit(text), _named()).alias("text"))

    def problem(p: Column, k: Column) -> Column:
        again = F.exists(F.slice("parts", F.lit(1), k), lambda q: q["brings"] == p["brings"])
        return (
            F.when(p["brings"] & there, told(p, 0, 0, OCCUPIED)).when(~p["brings"] & ~there, told(p, 0, 1, MISSING))
            .when(~p["brings"] & ~F.col(met)["digest"].eqNullSafe(p["digest"]), told(p, 0, 2, CHANGED))
            .when(again & p["brings"], told(p, 1, 0, OCCUPIED)).when(again, told(p, 1, 1, MISSING))  # its own members are in each other's way
        )

    return F.array_min(F.transform("parts", problem))


TOUCH, ITEM = ["path", "run_id", "item"], ["run_id", "item"]


def _latest(said: list[DataFrame], until: int) -> DataFrame:
    """(path, run_id, item, round, was, ok): what was last said of the items on their paths, before that round and in it."""
    ok = lambda r: F.max_by(F.when(F.col("round") <= r, F.col("ok")), F.when(F.col("round") <= r, F.col("round")))
    return reduce(DataFrame.unionByName, said).groupBy(*TOUCH).agg(F.max("round").alias("round"), ok(until - 1).alias("was"), ok(until).alias("ok"))


def _differing(touches: DataFrame, places: DataFrame, now: DataFrame, failing: DataFrame) -> DataFrame:
    """(run_id, item): the items that don't go back, from those ``failing`` (run_id, item, n: touches in the way) if all do.

    Each round looks at the paths of those items alone whose outcome has changed in the last one, judges what touches them with the outcomes before and after,
    and counts for each item the touches that are in its way. Nothing else is moved or written again.
    """
    counted = [failing.select("run_id", "item", F.col("n").alias("d"), F.lit(0).alias("round"))]
    changed, said, k = failing.select("run_id", "item", F.lit(False).alias("ok")), [], 0
    while not changed.isEmpty():
        k += 1
        said.append(_kept(places.join(changed, ITEM).select(*TOUCH, F.lit(k).alias("round"), "ok"), "path"))
        paths = said[-1].select("path").distinct()
        on = lambda df: df.join(paths, "path", "left_semi")
        known = _latest([on(x) for x in said], k).drop("round")
        here = on(touches).join(known, TOUCH, "left").withColumns({c: F.coalesce(c, F.lit(True)) for c in ("was", "ok")})
        judged = _met(here, on(now), before="was", after="ok").select("run_id", "item", *[_told(c).isNotNull().cast("int").alias(c) for c in ("before", "after")])
        counted.append(cut(judged.where("before <> after").groupBy(*ITEM).agg(F.sum(F.col("after") - F.col("before")).cast("long").alias("d"), F.lit(k).alias("round"))))
        sums = reduce(DataFrame.unionByName, counted).join(counted[-1].select(*ITEM), ITEM, "left_semi").groupBy(*ITEM).agg(
            F.sum("d").alias("n"), F.sum(F.when(F.col("round") < k, F.col("d")).otherwise(0)).alias("_n")
        )
        changed = cut(sums.where("(n > 0) <> (_n > 0)").select("run_id", "item", (F.col("n") == 0).alias("ok")))
        if k % LOGS == 0:  # many small tables become one
            said = [_kept(_latest(said, k).select(*TOUCH, "round", "ok"), "path")]
            counted = [cut(reduce(DataFrame.unionByName, counted).groupBy(*ITEM).agg(F.sum("d").alias("d"), F.lit(k).alias("round")))]
    return reduce(DataFrame.unionByName, counted).groupBy(*ITEM).agg(F.sum("d").alias("n")).where("n > 0").select(*ITEM)


def _judged(touches: DataFrame, now: DataFrame, failing: DataFrame | None = None) -> DataFrame:
    """(run_id, item, problem, n): the first problem, in the order of undoing, and on how many paths there is one, of items with any; ``failing`` has those assumed not to go back."""
    assumed = touches.withColumn("ok", F.lit(True)) if failing is None else touches.join(failing.withColumn("ok", F.lit(False)), TOUCH, "left").withColumn("ok", F.coalesce("ok", F.lit(True)))
    told = _met(assumed, now, met="ok").select("run_id", "item", _told("met").alias("_first")).where("_first is not null")
    return told.groupBy(*ITEM).agg(F.min("_first")["text"].alias("problem"), F.count(F.lit(1)).alias("n"))


def _replayed(moves: DataFrame, runs: DataFrame, files: DataFrame, actions: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The moves to walk back, their touches, the paths now, and (run_id, item, problem) of the items that don't go back."""
    chosen = undoable_runs(runs, moves, actions).select("run_id")
    back = moves.where((F.col("status") == "done") & F.col("undone_at").isNull()).join(chosen, "run_id", "left_semi").select(
        F.col("run_id").cast("long").alias("run_id"), F.coalesce(F.col("item").cast("long"), F.lit(0)).alias("item"), F.col("id").cast("long").alias("id"),
        F.col("destination").alias("source"), F.col("source").alias("destination"), "digest",
    )
    touches, now = _kept(_touches(back), "path"), _kept(_paths_now(files), "path")
    places = _kept(touches.select(*TOUCH), *ITEM)
    first = cut(_judged(touches, now))
    gone = _differing(touches, places, now, first)
    return back, touches, now, cut(_judged(touches, now, places.join(gone, ITEM)).select("run_id", "item", "problem"))


def undo_all(moves: DataFrame, runs: DataFrame, files: DataFrame, actions: tuple[str, ...] = ("sort",)) -> DataFrame:
    """(run_id, item, id, source, destination, outcome, problem): every run of these actions walked back, the newest first.

    ``moves``: run_id, item, id, source, destination, digest, status, undone_at; ``runs``: id, action, dry_run; ``files``: path, digest of what is there now.
    A run's items go back by falling number, each as a whole or not at all, and meet what earlier ones left: a path they freed or filled. ``problem`` is the first
    that an item meets, as in ``undo_plan``; it is its members' if two of them take or need one path. A null item is item 0, a null path of a move is none.
    A path twice in ``files`` counts once, with its greatest digest.
    """
    back, _, _, judged = _replayed(moves, runs, files, actions)
    return back.join(judged.withColumn("_fails", F.lit(True)), ITEM, "left").select(
        "run_id", "item", "id", "source", "destination", F.when(F.col("_fails"), "undo-failed").otherwise("restored").alias("outcome"), "problem",
    )


def files_after_undo(moves: DataFrame, runs: DataFrame, files: DataFrame, actions: tuple[str, ...] = ("sort",)) -> DataFrame:
    """(path, digest) of what is there once every run is walked back."""
    _, touches, now, judged = _replayed(moves, runs, files, actions)
    brought = F.filter("parts", lambda p: p["brings"])
    after = touches.join(judged.select(*ITEM), ITEM, "left_anti").select(
        "path", F.struct((-F.col("run_id")).alias("r"), (-F.col("item")).alias("i")).alias("turn"), (F.size(brought) > 0).alias("there"), F.get(brought, F.lit(0))["digest"].alias("digest"),
    )
    last = after.groupBy("path").agg(F.max_by(F.struct("there", "digest"), "turn").alias("_last"))
    kept = now.join(last.select("path"), "path", "left_anti")
    return kept.unionByName(last.where("_last.there").select(_named().alias("path"), F.col("_last.digest").alias("digest")))


INCOMPLETE = ("planned", "moving", "copying")


def reconcile(moves: DataFrame, files: DataFrame) -> DataFrame:
    """(id, run_id, operation, status, error): what becomes of moves that a crash left between intent and confirmation.

    ``moves``: id, run_id, operation, source, destination, digest, status, dry_run (null: no). A destination that holds the move's digest confirms it, for a move once its source is
    gone; a source alone says that nothing was done yet; all else is ambiguous and needs inspection. Both ends' state comes from ``files`` (path, digest), joined by path.
    """
    open_ = moves.where(F.col("status").isin(*INCOMPLETE) & (F.coalesce(F.col("dry_run"), F.lit(0)) == 0))
    now = _paths_now(files)
    seen = open_.join(now.select(F.col("path").alias("source"), F.lit(True).alias("_left")), "source", "left").join(
        now.select(F.col("path").alias("destination"), F.lit(True).alias("_right"), F.col("digest").alias("_now")), "destination", "left"
    )
    copy, left, right = F.col("operation").eqNullSafe("copy"), F.col("_left").isNotNull(), F.col("_right").isNotNull()
    confirmed = right & F.col("_now").eqNullSafe(F.col("digest")) & (copy | ~left)
    status = F.when(confirmed & copy, "copied").when(confirmed, "done").otherwise("failed")
    error = (
        F.when(confirmed, "confirmed after interrupted run").when(left & ~right, "interrupted before filesystem change").otherwise("interrupted in an ambiguous state")
    )
    return seen.select("id", "run_id", "operation", status.alias("status"), error.alias("error"))


def reconcile_runs(runs: DataFrame, moves: DataFrame, reconciled: DataFrame) -> DataFrame:
    """(run_id, status): runs that were running and have nothing open any more: ``partial`` with failures, else ``recovered``."""
    now = moves.join(reconciled.select("id", F.col("status").alias("_new")), "id", "left").select("run_id", F.coalesce("_new", "status").alias("status"))
    counted = now.groupBy("run_id").agg(F.count_if(F.col("status").isin(*INCOMPLETE)).alias("open"), F.count_if(F.col("status").isin("failed", "undo-failed")).alias("bad"))
    running = runs.where(F.col("status") == "running").select(F.col("id").alias("run_id")).join(counted, "run_id", "left")
    return running.where(F.coalesce("open", F.lit(0)) == 0).select("run_id", F.when(F.col("bad") > 0, "partial").otherwise("recovered").alias("status"))
