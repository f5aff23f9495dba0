from pyspark.sql import functions as F

from factloom.functions.provenance import provenance
from factloom.operators import upkeep


def test_where_a_file_came_from(spark):
    rows = [
        (1, "/home/me/Downloads/a", ["https://cdn.shop.example/x", "https://shop.example"], "0083;65a5f2c0;Google Chrome;id", None), (2, "/home/me/Downloads/a", None, None, None), (3, "/home/me/Dropbox/a", ["https://x.example/y"], None, None),
        (4, "C:\\Users\\me\\Desktop\\a", None, None, "[ZoneTransfer]\nZoneId=3\nHostUrl=https://h.example/z"), (5, "/x/y", None, "q;zz;An Odd Program", None), (6, "/x/y", None, None, "ZoneId=1"), (7, None, None, None, None), (8, "/media/stick/a", None, "", ""),
        (9, "/x/y", None, "0;0;sharingd", None), (10, "/Dropbox/y", None, "0;1;WhatsApp", None),
    ]
    df = spark.createDataFrame(rows, "k int, path string, froms array<string>, quarantine string, zone string")
    got = {r.k: r.p.asDict() for r in df.select("k", provenance(F.col("path"), F.col("froms"), F.col("quarantine"), F.col("zone")).alias("p")).collect()}
    pick = lambda k, *names: tuple(got[k][n] for n in names)
    assert pick(1, "place", "from_app", "origin", "origin_confidence", "quarantined", "from_url", "referrer") == ("downloads", "Chrome", "download", 0.85, True, "https://cdn.shop.example/x", "https://shop.example")
    assert got[1]["downloaded"].year == 2024 and got[5]["downloaded"] is None and got[9]["downloaded"] is None
    assert pick(2, "origin", "origin_confidence", "quarantined") == ("download", 0.45, None)
    assert pick(3, "cloud", "origin", "origin_confidence") == ("Dropbox", "cloud", 0.7) and pick(10, "cloud", "origin") == ("Dropbox", "message")
    assert pick(4, "place", "origin", "quarantined", "from_url") == ("desktop", "download", True, "https://h.example/z")
    assert pick(5, "from_app", "origin") == ("An Odd Program", "download") and pick(6, "origin", "quarantined") == ("network", False) and pick(9, "from_app", "origin") == ("AirDrop", "airdrop")
    assert all(v is None or v is False for v in got[7].values()) and pick(8, "removable", "origin", "quarantined") == (True, None, None)


def test_readings_are_recalled_for_files_as_they_are(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "1"), ("c", ""), ("d", None)], "path string, fingerprint string")
    readings = spark.createDataFrame([("a", "t", "1", "old", 1), ("a", "t", "1", "new", 2), ("a", "u", "0", "x", 3), ("b", "t", "1", "x", 1), ("c", "t", "", "x", 1), ("d", "t", None, "x", 1)], "path string, tool string, fingerprint string, delta string, made_at long")
    got = {(r.path, r.tool): (r.delta, r.recalled) for r in upkeep.recall_readings(files, readings, ["t", "u"]).collect()}
    assert got == {(p, t): ("new", True) if (p, t) == ("a", "t") else (None, False) for p in "abcd" for t in "tu"}


def test_facts_of_waiting_items_are_read_anew(spark):
    held = spark.createDataFrame([(1, "/a", {"heading": "x", "place": "p"}), (2, "/b", {"heading": "x"}), (3, "/c", {"pages": "1"}), (4, "/gone", {"pages": "1"}), (5, "/d", None), (6, "/e", {"place": "p"})], "id long, destination string, facts map<string,string>")
    fresh = spark.createDataFrame([("/a", {"heading": "y", "place": "q", "author": "z"}), ("/b", {"heading": "x", "other": "1"}), ("/c", {}), ("/d", {"heading": "h"}), ("/e", None)], "path string, facts map<string,string>")
    assert {r.id: r.facts for r in upkeep.refresh_held(held, fresh).collect()} == {1: {"heading": "y", "place": "p", "author": "z"}, 3: {}, 5: {"heading": "h"}}


def test_queues_and_promotions(spark):
    queue = spark.createDataFrame([("a", 5.0, "x"), ("a", 9.0, "y"), ("b", 1.0, "z"), ("c", 9.0, "w")], "root string, last_seen double, path string")
    watched, seen = spark.createDataFrame([("a",), ("b",), ("a",)], "root string"), spark.createDataFrame([("a", 9.0), ("a", 3.0), ("c", 1.0)], "root string, at double")
    assert {r.path for r in upkeep.retain_queue(queue, watched, seen).collect()} == {"y", "z"}
    plan = spark.createDataFrame([(k, f"r{k % 2}", f"/f{k % 20}/x") for k in range(50)], "id long, rule string, destination string")
    got = [(r.level, r.name, r["items"]) for r in upkeep.promotion_summary(plan, 3).collect()]
    assert sorted(got) == [("folder", "/f0", 3), ("folder", "/f1", 3), ("folder", "/f2", 3), ("rule", "r0", 25), ("rule", "r1", 25), ("total", "", 50)]
    assert upkeep.promotion_summary(plan.limit(0)).count() == 0
