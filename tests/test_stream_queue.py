import pytest

from factloom.streaming import queue

LOOKS = "root string, path string, mark string, rules string, seen double"


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def look(root, at, paths, rules="r", whole=True):
    return [(root, p, m, rules, float(at)) for p, m in paths.items()] + ([(root, None, None, None, float(at))] if whole else [])


def run(spark, tmp_path, looks, ceiling=100):
    """Add looks to the source and let the stream come to its end, with a query of its own each time."""
    spark.createDataFrame(looks, LOOKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOOKS).parquet(str(tmp_path / "in"))
    q = queue.run_queue(stream, str(tmp_path / "out"), 10, ceiling, 2)
    q.awaitTermination(120)
    assert q.exception() is None


def rows(spark, tmp_path, name):
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / name / "*")).collect())


def test_restarts_removals_and_roots_that_are_away(spark, tmp_path, few_partitions):
    same = {f"/f{k}": "m" for k in range(5)}
    run(spark, tmp_path, look("a", 0, same) + look("b", 0, {"/x": "1"}))
    run(spark, tmp_path, look("a", 5, same | {"/f1": "changed"}) + look("b", 5, {}, whole=False))  # b is away
    run(spark, tmp_path, look("a", 12, {k: v for k, v in (same | {"/f1": "changed"}).items() if k != "/f2"}) + look("b", 12, {"/x": "1"}), ceiling=2)
    events = [(r[0], r[1], r[2], r[4], r[5], r[6]) for r in rows(spark, tmp_path, "events")]
    assert events == [("a", "/f0", "m", 0.0, 12.0, "settled"), ("a", "/f2", "m", 0.0, 12.0, "removed"), ("a", "/f3", "m", 0.0, 12.0, "settled"), ("a", "/f4", "m", 0.0, 12.0, "settled"), ("b", "/x", "1", 0.0, 12.0, "settled")]
    claimed = lambda: [(r[0], r[1]) for r in sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "out" / "claimed" / "*")).select("root", "path").collect())]
    assert claimed() == [("a", "/f0"), ("a", "/f3"), ("b", "/x")]  # two of a at a time
    run(spark, tmp_path, look("a", 20, {"/f0": "m", "/f1": "changed", "/f3": "m", "/f4": "m"}) + look("a", 30, {"/f0": "m", "/f1": "changed", "/f3": "m", "/f4": "m"}, rules="new"))
    assert claimed() == [("a", "/f0"), ("a", "/f3"), ("b", "/x")]  # no row twice; what waited is taken back, as the rules changed
    told = [(r[1], r[5], r[6]) for r in rows(spark, tmp_path, "events") if r[5] == 30.0]
    assert {t[2] for t in told} == {"changed"} and len(told) == 4  # other rules begin the wait again
    run(spark, tmp_path, look("a", 40, {"/f0": "m"}, rules="new"))
    assert ("/f0", 40.0, "settled") in {(r[1], r[5], r[6]) for r in rows(spark, tmp_path, "events")}


def test_a_batch_that_runs_again_writes_the_same(spark, tmp_path):
    sink = queue.ClaimingSink(str(tmp_path / "out"), ceiling=3, salts=2)
    events = lambda k, kind="settled": spark.createDataFrame([("a", f"/f{i}", "m", "r", float(i), 10.0 + k, kind) for i in range(5 * k, 5 * k + 5)] + [("b", "/only", "m", f"r{k}", 0.0, 10.0 + k, kind)], queue.EVENTS)
    at = lambda name, k: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / name / str(k))).collect())
    sink(events(0), 0)
    sink(events(1), 1)
    once = {(n, k): at(n, k) for n in ("waiting", "claimed") for k in (0, 1)}
    sink(events(1), 1)
    sink(events(0), 0)
    assert {key: at(*key) for key in once} == once
    paths = lambda k: [r[1] for r in once["claimed", k] if "/f" in str(r)]
    names = lambda k: {r["path"]: r["first"] for r in spark.read.parquet(str(tmp_path / "out" / "claimed" / str(k))).collect()}
    assert names(0) == {"/f0": True, "/f1": True, "/f2": True, "/only": True} and paths(0)
    assert names(1) == {"/f3": False, "/f4": False, "/f5": False, "/only": True}  # carried over, the longest settled first
    sink(events(2, "removed"), 2)
    sink(spark.createDataFrame([("a", "/f6", "m", "r", 6.0, 20.0, "removed")], queue.EVENTS), 3)
    assert set(names(2)) == {"/f6", "/f7", "/f8"} and set(names(3)) == {"/f9"}
    sink(spark.createDataFrame([], queue.EVENTS), 4)
    assert at("claimed", 4) == [] and at("waiting", 4) == []
