from pyspark.sql import functions as F

from factloom.operators import plans


def test_collisions_settle_chained_clashes(spark):
    rows = [(1, "/a/x.txt"), (2, "/a/X.txt"), (3, "/a/x (2).txt"), (4, "/a/x.txt"), (5, "/b/y"), (6, "/b/y"), (7, "/c/taken.md")]
    plan = spark.createDataFrame(rows, "id long, destination string")
    there = spark.createDataFrame([("/c/TAKEN.md",), ("/c/taken (2).md",)], "path string")
    got = {r.id: r.final for r in plans.resolve_collisions(plan, there).collect()}
    assert got[1] == "/a/x.txt" and got[3] == "/a/x (2).txt" and got[5] == "/b/y" and got[6] == "/b/y (2)"
    keys = [f.lower() for f in got.values()]
    assert len(set(keys)) == len(rows) and not set(keys) & {"/c/taken.md", "/c/taken (2).md"}


def test_collisions_that_need_rounds_equal_a_walk(spark):
    """Every suffixed name is wanted by another item, too, so numbers move on round after round."""
    rows = [(k, f"/a/x{' (%d)' % (k % 7) if k % 7 > 1 else ''}.txt") for k in range(60)]
    there = [("/a/X (3).txt",), ("/a/x (5) (2).txt",)]
    got = {r.id: r.final for r in plans.resolve_collisions(spark.createDataFrame(rows, "id long, destination string"), spark.createDataFrame(there, "path string")).collect()}
    finals = [f.lower() for f in got.values()]
    assert len(got) == len(rows) and len(set(finals)) == len(rows) and not {p.lower() for p, in there} & set(finals)
    for k, wanted in rows:
        assert got[k].startswith(wanted[:-4]) and got[k].endswith(".txt")
    firsts = {w: min(k for k, x in rows if x == w) for _, w in rows}
    assert all(got[k] == w for w, k in firsts.items() if w != "/a/x (3).txt")


def test_a_name_taken_too_often_is_given_up(spark, monkeypatch):
    monkeypatch.setattr(plans, "MOST_SUFFIXES", 3)
    got = {r.id: r.final for r in plans.resolve_collisions(spark.createDataFrame([(k, "/x.md") for k in range(5)], "id long, destination string"), spark.createDataFrame([], "path string")).collect()}
    assert got == {0: "/x.md", 1: "/x (2).md", 2: "/x (3).md", 3: None, 4: None}


def test_members_follow_their_primary(spark):
    rows = [("film.mkv", "film.mkv"), ("film.mkv", "film.en.srt"), ("film.mkv", "cover.jpg")]
    df = spark.createDataFrame(rows, "p string, m string").withColumn("d", F.lit("/films/A Film (1999).mkv"))
    assert [r.final for r in plans.member_destinations(df, "p", "m", "d").collect()] == ["/films/A Film (1999).mkv", "/films/A Film (1999).en.srt", "/films/cover.jpg"]


def test_reasons_and_roots(spark):
    rows = [(".hidden", 10.0, False), ("a/b.part", 10.0, False), ("a/b", 1.0, False), ("a/b", 10.0, True), ("a/b", None, False), ("a/b", 10.0, False)]
    df = spark.createDataFrame(rows, "path string, age double, link boolean")
    got = [r.r for r in df.select(plans.skip_reason(F.col("path"), F.col("age"), 3, F.col("link")).alias("r")).collect()]
    assert got == ["ignored", "ignored", "not settled", "symbolic link", "could not be read", None]
    paths = spark.createDataFrame([("/w/in/x",), ("/w/inner",), ("/w",), ("/z",)], "p string")
    assert [r.r for r in paths.select(plans.source_root(F.col("p"), ["/w", "/w/in"]).alias("r")).collect()] == ["/w/in", "/w", "/w", None]


def test_bundles(spark):
    names = [("film.mkv", 900), ("film.en.srt", 2), ("film.nfo", 1), ("note.txt", 5), ("big.part1.rar", 50), ("big.part2.rar", 50), ("solo.part1.rar", 9), ("a.jpg", 3), ("a.png", 4)]
    df = spark.createDataFrame([("d", n, s) for n, s in names], "dir string, name string, size long")
    got = {r.primary: (r.n, r.size, r.reason) for r in plans.bundles(df).collect()}
    assert got == {"film.mkv": (3, 903, "sidecars"), "note.txt": (1, 5, "single"), "big.part1.rar": (2, 100, "archive in parts"), "solo.part1.rar": (1, 9, "single"), "a.jpg": (1, 3, "single"), "a.png": (1, 4, "single")}
    assert plans.bundles(df.limit(0)).count() == 0
