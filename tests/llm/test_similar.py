import random
from collections import defaultdict

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_groups(rows):
    """Smallest id of each chain of texts with Jaccard 0.8 or more over five-word shingles."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    near, ids = defaultdict(set), sorted(sets)
    for a in ids:
        for b in ids:
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                near[a].add(b)
    out = {}
    for i in ids:
        todo = [] if i in out else [i]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = i
                todo += near[x]
    return out


def test_near_dedup_stage_equals_brute_force_jaccard(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = [(1, None), (2, "  "), (3, "one two"), (4, "One  two"), (5, "two one")]
    common = [word() for _ in range(30)]
    for base in range(40):
        own = [word() for _ in range(rnd.choice([4, 8, 25, 60, 150]))] + (common if base % 2 else [])
        for copy in range(6):
            now = list(own)
            for _ in range(copy if copy < 5 else 12):
                now[rnd.randrange(len(now))] = word()
            rows.append((100 + base * 10 + copy, " ".join(now)))
    rnd.shuffle(rows)
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    groups = brute_groups(rows)
    got = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, frame, "").collect()}
    assert got == {i for i, g in groups.items() if i == g}
    assert 50 < len(got) < 200
