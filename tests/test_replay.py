import random

import pytest

from factloom.operators import replay

MOVES = "id long, run_id long, item long, source string, destination string, digest string, status string, undone_at timestamp"
RUNS, FILES = "id long, action string, dry_run int", "path string, digest string"


def brute(moves, runs, files, actions=("sort",)):
    """One run after the other, one item after the other, on a disk that is a dictionary."""
    disk = {}
    for path, digest in files:
        if path is not None:
            disk[path] = max(digest, disk.get(path, digest), key=lambda d: (d is not None, d or ""))
    wanted = {i for i, action, dry in runs if action in actions and dry == 0}
    told = {}
    for run in sorted({m[1] for m in moves if m[1] in wanted}, reverse=True):
        own = [m for m in moves if m[1] == run and m[6] == "done" and m[7] is None]
        for item in sorted({m[2] for m in own}, reverse=True):
            members = sorted((m for m in own if m[2] == item), reverse=True)
            problem = None
            for i, _, _, home, here, digest, *_ in members:
                if home in disk:
                    problem = f"original path is occupied: {home}"
                elif here not in disk:
                    problem = f"moved file is missing: {here}"
                elif disk[here] != digest:
                    problem = f"file changed since it was sorted: {here}"
                if problem:
                    break
            if not problem:
                after = dict(disk)
                for i, _, _, home, here, digest, *_ in members:
                    if home in after:
                        problem = f"original path is occupied: {home}"
                    elif here not in after:
                        problem = f"moved file is missing: {here}"
                    if problem:
                        break
                    del after[here]
                    after[home] = digest
                if not problem:
                    disk = after
            told.update({m[0]: ("undo-failed" if problem else "restored", problem) for m in members})
    return told, disk


def both(spark, moves, runs, files):
    m, r, f = spark.createDataFrame(moves, MOVES), spark.createDataFrame(runs, RUNS), spark.createDataFrame(files, FILES)
    told = {x.id: (x.outcome, x.problem) for x in replay.undo_all(m, r, f).collect()}
    return told, {x.path: x.digest for x in replay.files_after_undo(m, r, f).collect()}


def test_a_chain_over_three_runs_is_walked_back(spark):
    moves = [(1, 1, 1, "/in/a", "/x/a", "d", "done", None), (2, 2, 1, "/x/a", "/y/a", "d", "done", None), (3, 3, 1, "/y/a", "/z/a", "d", "done", None), (4, 3, 2, "/in/b", "/x/a", "e", "done", None)]
    runs = [(k, "sort", 0) for k in (1, 2, 3)]
    told, disk = both(spark, moves, runs, [("/z/a", "d"), ("/x/a", "e")])
    assert {k: v[0] for k, v in told.items()} == {k: "restored" for k in (1, 2, 3, 4)} and disk == {"/in/a": "d", "/in/b": "e"}
    told, disk = both(spark, moves, runs, [("/z/a", "changed"), ("/x/a", "e")])
    assert (told, disk) == brute(moves, runs, [("/z/a", "changed"), ("/x/a", "e")]) and told[1] == ("undo-failed", "moved file is missing: /x/a")


@pytest.mark.parametrize("seed", range(3))
def test_random_ledgers_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    paths = [f"/{a}/{b}" for a in "pqr" for b in range(8)]
    at = {p: f"d{k % 5}" for k, p in enumerate(rng.sample(paths, 12))}
    moves = []
    for i in range(60):  # mostly moves that could have been, some that couldn't
        here = rng.choice(sorted(at)) if rng.random() < 0.9 else rng.choice(paths)
        there = rng.choice(paths)
        digest = at.get(here, "d0")
        moves.append((i, i // 9, rng.randrange(4), here, there, digest, rng.choice(["done"] * 9 + ["failed"]), None))
        if there not in at and here in at:
            at[there] = at.pop(here)
    files = list(at.items()) + [(rng.choice(paths), "d1"), (None, "d1")]
    runs = [(k, "regroup" if k == 3 else "sort", 1 if k == 5 else 0) for k in range(7)]
    assert both(spark, moves, runs, files) == brute(moves, runs, files)
    assert both(spark, [], runs, files) == ({}, brute([], runs, files)[1])


def test_every_cell_of_the_reconciling_table(spark):
    cases = [(left, right, op) for left in (0, 1) for right in ("none", "same", "other") for op in ("move", "copy")]
    moves = [(k, 1, op, f"/s{k}", f"/t{k}", "d", "moving", 0) for k, (_, _, op) in enumerate(cases)] + [(50, 2, "move", "/a", "/b", None, "planned", None), (51, 3, "move", "/a", "/b", "d", "moving", 1), (52, 4, "move", "/a", "/b", "d", "done", 0)]
    files = [(f"/s{k}", "d") for k, (left, _, _) in enumerate(cases) if left] + [(f"/t{k}", "d" if right == "same" else "e") for k, (_, right, _) in enumerate(cases) if right != "none"]
    m = spark.createDataFrame(moves, "id long, run_id long, operation string, source string, destination string, digest string, status string, dry_run int")
    done = replay.reconcile(m, spark.createDataFrame(files, FILES))
    got = {r.id: (r.status, r.error) for r in done.collect()}
    sure, nothing, unclear = "confirmed after interrupted run", "interrupted before filesystem change", "interrupted in an ambiguous state"
    want = {}
    for k, (left, right, op) in enumerate(cases):
        if right == "same" and (op == "copy" or not left):
            want[k] = ("copied" if op == "copy" else "done", sure)
        else:
            want[k] = ("failed", nothing if left and right == "none" else unclear)
    assert got == want | {50: ("failed", unclear)}
    runs = spark.createDataFrame([(1, "running"), (2, "running"), (3, "running"), (4, "completed"), (5, "running")], "id long, status string")
    assert {r.run_id: r.status for r in replay.reconcile_runs(runs, m, done).collect()} == {1: "partial", 2: "partial", 5: "recovered"}


def test_rounds_look_at_what_changed_alone(spark, monkeypatch):
    """A chain of failures takes a round for each link; files beside it are judged at the start and the end."""
    links, beside = 5, 200
    moves = [(k, k, 1, f"/{k}/a", f"/{k + 1}/a", "d", "done", None) for k in range(links)] + [(100 + k, 0, 10 + k, f"/in/{k}", f"/x/{k}", "d", "done", None) for k in range(beside)]
    runs, files = [(k, "sort", 0) for k in range(links)], [(f"/{links}/a", "changed")] + [(f"/x/{k}", "d") for k in range(beside)]
    seen, met = [], replay._met
    monkeypatch.setattr(replay, "_met", lambda touches, *given, **named: seen.append(touches.count()) or met(touches, *given, **named))
    m, r, f = spark.createDataFrame(moves, MOVES), spark.createDataFrame(runs, RUNS), spark.createDataFrame(files, FILES)
    told = {x.id: (x.outcome, x.problem) for x in replay.undo_all(m, r, f).collect()}
    assert told == brute(moves, runs, files)[0] and len(seen) >= links
    assert sum(seen) <= 2 * 2 * len(moves) + 10 * links
