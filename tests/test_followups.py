from factloom.operators import followups
from factloom.operators.rules import load_rules

MOVE = "run_id long, item long, id long, source string, destination string, digest string, status string, undone_at string, operation string, size long, rule string, holding int, facts string, extra string"
FILE = "path string, size long, digest string, extra string"


def move(k, source, destination, digest="d", run=1, item=None, **more):
    row = {"status": "done", "undone_at": None, "operation": "move", "size": 5, "rule": "r", "holding": 0, "facts": None, "extra": "x"} | more
    return (run, k if item is None else item, k, source, destination, digest, *[row[c] for c in ("status", "undone_at", "operation", "size", "rule", "holding", "facts", "extra")])


def test_corrections_follow_the_digest_and_never_guess(spark):
    placed = spark.createDataFrame([
        move(1, "/in/a", "/out/a"), move(2, "/in/b", "/out/b"), move(3, "/in/c", "/out/c", None), move(4, "/in/e", "/out/e", ""), move(5, "/in/f", "/out/f"),
        move(6, "/in/g", None), move(7, "/in/h", "/out/h"),
    ], MOVE)
    files = spark.createDataFrame([
        ("/out/a", 5, "d", None), ("/y/b", 5, "d", None), ("/x/b", 5, "d", None), ("/w/b", 5, "other", None), ("/x/c", 5, "any", None), ("/x/c", 5, "any", None),
        ("/x/e", 5, "1", None), ("/y/e", 5, "2", None), ("/x/f", 6, "d", None), (None, 5, "d", None), ("/x/h", 5, None, None),
    ], FILE)
    got = {r["id"]: (r["found_at"], r["outcome"]) for r in followups.corrections(placed, files).collect()}
    assert got == {2: ("/x/b", "moved"), 3: ("/x/c", "moved"), 4: (None, "missing"), 5: (None, "missing"), 7: (None, "missing")}
    assert followups.corrections(placed, files.limit(0)).count() == 6 and followups.corrections(placed.limit(0), files).count() == 0


def test_an_item_goes_back_whole_or_not_at_all(spark):
    moves = spark.createDataFrame([
        move(1, "/in/a", "/out/a", item=1), move(2, "/in/b", "/out/b", item=1), move(3, "/in/c", "/out/c", item=2), move(4, "/in/d", "/out/d", item=3),
        move(5, "/in/e", "/out/e", None, item=4), move(6, "/in/f", "/out/f", item=5, undone_at="then"), move(7, "/in/g", "/out/g", item=6),
    ], MOVE)
    files = spark.createDataFrame([("/out/a", 1, "d", None), ("/out/c", 1, "new", None), ("/out/d", 1, "d", None), ("/in/d", 1, "d", None), ("/out/e", 1, None, None), ("/out/g", 1, "d", None), ("/out/g", 1, "d", None)], FILE)
    got = {r["id"]: r["problem"] for r in followups.undo_plan(moves, files).collect()}
    lost = "moved file is missing: /out/b"
    assert got == {1: lost, 2: lost, 3: "file changed since it was sorted: /out/c", 4: "original path is occupied: /in/d", 5: None, 7: None}


def test_held_and_waiting(spark):
    moves = spark.createDataFrame([
        move(1, "/in/a", "/out/a", holding=1, facts='{"ocr": true}'), move(2, "/out/a", "/else/a", holding=None, facts="{"), move(3, "/in/b", "/out/b", holding=1, facts='{"ocr": true}', status="copied"),
        move(4, "/in/c", "/out/c", facts='{"ocr": false}'), move(5, "/in/d", "/out/d", run=2, facts='{"ocr": true}'),
    ], MOVE)
    runs = spark.createDataFrame([(1, "sort"), (2, "undo")], "id long, action string")
    assert [r["id"] for r in followups.held_moves(moves).collect()] == [3]
    assert [r["id"] for r in followups.waiting(moves, runs, "ocr").collect()] == [3]
    assert followups.waiting(moves, runs, "ocr", spark.createDataFrame([], "path string")).count() == 0


def test_rules_that_do_not_stop_and_items_left(spark):
    rules = load_rules("[rule: a]\nwhen = size > 1\ninto = /a\nstop = no\n[rule: b]\nwhen = size > 2\nmode = leave\n[rule: c]\nwhen = size > 0\ninto = /c\nholding = yes\n")
    items = spark.createDataFrame([(1, 3, "x", "/r"), (2, 2, "y", "/r"), (3, None, "z", "/r"), (4, None, None, None)], "id long, size long, name string, source_root string")
    tried = [(r["id"], r["rule"], r["matched"]) for r in rules.explain(items, keep=("id",)).orderBy("id", "k").collect()]
    assert tried[:5] == [(1, "a", True), (1, "b", True), (2, "a", True), (2, "b", False), (2, "c", True)] and len(tried) == 11
    filed = {r["id"]: (r["rule"], r["destination"], r["holding"], r["skipped"]) for r in rules.file(items, keep=("id",), gather_into="odd").collect()}
    assert filed == {1: ("a", "/a/x", False, None), 2: ("a", "/a/y", False, None), 3: ("[unsorted]", "/r/odd/z", True, None), 4: (None, None, False, "no rule matched")}
