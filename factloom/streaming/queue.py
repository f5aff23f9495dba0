"""The waiting queue as a stream: snapshots of watched folders go in, items that have settled come out, a bounded number of them at a time.

A snapshot of a root is a row for each path it holds, all with the time of the look, and one row without a path that says the look is whole. State is
kept for each root and bucket of paths, so a root of any size is many keys: for each
path its mark, the rules in force, and since when both stand. A whole look is the clock: what it lacks is removed, what has stood for long
enough is settled. A root that can't be looked at sends nothing, so its queue stays as it was.

The sink keeps what is settled and not yet claimed in the shared folder, a table for each batch made from the
last one's and the batch's events. Running a batch again, as Spark does after a failure, writes the same tables anew.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

BUCKETS = 64
EVENTS = "root string, path string, mark string, rules string, since double, at double, event string"
_STATE = "mark string, rules string, since double, seen double, told boolean"
#: The state of a processor with maps needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Settling(StatefulProcessor):
    """Of rows (path, mark, rules, seen) of one root and bucket, the events of its paths."""

    def __init__(self, settle_seconds: float):
        self.settle_seconds = settle_seconds

    def init(self, handle) -> None:
        self.items = handle.getMapState("items", "path string", _STATE)
        self.clock = handle.getValueState("clock", "seen double")

    def handleInputRows(self, key: tuple, rows: Iterable, timer_values) -> Iterator[Row]:
        root = key[0]
        seen: dict[float, dict[str, tuple]] = defaultdict(dict)
        whole = set()
        for r in rows:
            if r.path is None:
                whole.add(r.seen)
            else:
                told = (r.mark or "", r.rules or "")
                seen[r.seen][r.path] = max(told, seen[r.seen].get(r.path, told))
        last = self.clock.get()[0] if self.clock.exists() else float("-inf")
        for at in sorted(seen.keys() | whole):
            if at < last:
                continue  # a look that an earlier batch has closed
            for path, (mark, rules) in sorted(seen.get(at, {}).items()):
                yield from self._sighted(root, path, mark, rules, at)
            if at in whole:
                yield from self._closed(root, at)
                last = at
        if whole:
            self.clock.update((last,))

    def _sighted(self, root: str, path: str, mark: str, rules: str, at: float) -> Iterator[Row]:
        before = tuple(self.items.getValue((path,))) if self.items.containsKey((path,)) else None
        if before and before[:2] == (mark, rules):
            self.items.updateValue((path,), (mark, rules, before[2], max(at, before[3]), before[4]))
            return
        if before and before[4]:
            yield self._event(root, path, before, at, "changed")
        self.items.updateValue((path,), (mark, rules, at, at, False))

    def _closed(self, root: str, at: float) -> Iterator[Row]:
        for (path,), value in [(tuple(k), tuple(v)) for k, v in self.items.iterator()]:
            if value[3] < at:
                self.items.removeKey((path,))
                yield self._event(root, path, value, at, "removed")
            elif not value[4] and at - value[2] >= self.settle_seconds:
                self.items.updateValue((path,), (*value[:4], True))
                yield self._event(root, path, value, at, "settled")

    @staticmethod
    def _event(root: str, path: str, value: tuple, at: float, event: str) -> Row:
        return Row(root=root, path=path, mark=value[0], rules=value[1], since=value[2], at=at, event=event)

    def close(self) -> None:
        pass


def settling_events(looks: DataFrame, settle_seconds: float, buckets: int = BUCKETS) -> DataFrame:
    """EVENTS of a stream of looks (root, path, mark, rules, seen): ``settled`` once a path's mark and rules have stood for so long, ``changed`` if they no longer do, ``removed`` if a whole look lacks the path.

    A row with a null path closes the look of its root and time. Equal rows count once; of several marks of one look the greatest counts; null marks and rules are empty. Rows of a look that
    is closed by an earlier batch are passed over, and rows without a root or a time. The session needs ``STORE``.
    """
    rows = looks.where("root is not null and seen is not null").select("root", "path", "mark", "rules", F.col("seen").cast("double").alias("seen"))
    own = F.when(F.col("path").isNull(), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")))
    return rows.withColumn("bucket", F.explode(own)).groupBy("root", "bucket").transformWithState(Settling(settle_seconds), EVENTS, "Append", "None")


class ClaimingSink:
    """For ``foreachBatch``: claims at most ``ceiling`` settled items of each root a batch, the longest settled first, and carries the others over.

    In ``folder``: ``events``, ``waiting`` and ``claimed``, each with a folder for each batch. ``claimed`` has ``first`` where its root and rules have
    no earlier claims, so that they can be shown before they are carried out.
    """

    def __init__(self, folder: str, ceiling: int = 100, salts: int = 32):
        self.folder, self.ceiling, self.salts = folder.rstrip("/"), ceiling, salts

    def _before(self, session, name: str, batch: int) -> list[str]:
        """The folders that batches before this one have written, in order."""
        context = session.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        store = place.getFileSystem(context._jsc.hadoopConfiguration())
        if not store.exists(place):
            return []
        numbers = sorted(int(s.getPath().getName()) for s in store.listStatus(place))
        return [f"{self.folder}/{name}/{k}" for k in numbers if k < batch]

    def __call__(self, events: DataFrame, batch: int) -> None:
        session = events.sparkSession
        at = lambda name: f"{self.folder}/{name}/{batch}"
        events.write.mode("overwrite").parquet(at("events"))
        rows = session.read.parquet(at("events"))
        earlier = self._before(session, "waiting", batch)
        if earlier:
            rows = rows.unionByName(session.read.parquet(earlier[-1]))
        last = rows.groupBy("root", "path").agg(F.max_by(F.struct("mark", "rules", "since", "at", "event"), F.struct("at", F.col("event") == "settled")).alias("_last"))
        waiting = last.where("_last.event = 'settled'").select("root", "path", "_last.*")
        order = [F.col("since"), F.col("path")]
        salted = W.partitionBy("root", F.pmod(F.xxhash64("path"), F.lit(self.salts))).orderBy(*order)
        some = waiting.withColumn("_k", F.row_number().over(salted)).where(F.col("_k") <= self.ceiling)
        chosen = some.withColumn("_k", F.row_number().over(W.partitionBy("root").orderBy(*order))).where(F.col("_k") <= self.ceiling).drop("_k")
        claims = self._before(session, "claimed", batch)
        if claims:
            known = session.read.parquet(*claims).select("root", "rules").distinct().withColumn("_known", F.lit(True))
            chosen = chosen.join(known, ["root", "rules"], "left").withColumn("first", F.col("_known").isNull()).drop("_known")
        else:
            chosen = chosen.withColumn("first", F.lit(True))
        chosen.write.mode("overwrite").parquet(at("claimed"))
        claimed = session.read.parquet(at("claimed")).select("root", "path")
        waiting.join(claimed, ["root", "path"], "left_anti").write.mode("overwrite").parquet(at("waiting"))


def run_queue(looks: DataFrame, folder: str, settle_seconds: float, ceiling: int = 100, buckets: int = BUCKETS, trigger: dict | None = None):
    """Start the stream with its checkpoint and its tables in ``folder``; returns the running query. Started again on the same folder, it goes on where it was."""
    session = looks.sparkSession
    session.conf.set(*STORE)
    writer = settling_events(looks, settle_seconds, buckets).writeStream.outputMode("append").option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint")
    return writer.foreachBatch(ClaimingSink(folder, ceiling)).trigger(**(trigger or {"availableNow": True})).start()
