import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.functions.folding import fold, folded
from factloom.operators import terms

SCHEMA = "id long, heading string"


def brute(headings, owner=(), person=(), titled=True):
    """The rule one heading after the other, and the elimination one term after the other."""
    docs, bare, places, spelled = defaultdict(set), defaultdict(set), defaultdict(list), defaultdict(Counter)
    used = [(i, h) for i, h in headings if h]
    word = re.compile(r"[^\W\d_]{3,}")
    for i, h in used:
        seen = {}
        for at, w in enumerate(word.findall(h)):
            seen.setdefault(fold(w), at)
            spelled[fold(w)][w] += 1
        for k, at in seen.items():
            docs[k].add(i)
            places[k].append(at)
        for chunk in h.split():
            if not re.search(r"(?<!-)[/\\]|@|\w\.\w+\.\w", chunk):
                for part in re.split(r"[_.\-]+", chunk):
                    if sum(a.isdigit() and b.isalpha() or a.isalpha() and b.isdigit() for a, b in zip(part, part[1:])) < 3:
                        for w in word.findall(part):
                            bare[fold(w)].add(i)
    middle = {k: sorted(v)[len(v) // 2] for k, v in places.items()}
    found = []
    for k, own in docs.items():
        name = min(spelled[k], key=lambda w: (-spelled[k][w], not w.istitle(), w.isupper(), w))
        letters = [c for c in name if c.isalpha()]
        latin = [c for c in letters if unicodedata.name(c).startswith("LATIN ")]
        plain = any("a" <= c.lower() <= "z" for c in letters)
        capital = sum(n for w, n in spelled[k].items() if any(c.isupper() for c in w)) * 2 > sum(spelled[k].values())
        ceiling = max(3, len(used) * (0.1 if k in map(fold, owner) else 0.6))
        if k not in map(fold, person) and len(bare[k]) >= 3 and 3 <= len(own) <= ceiling and middle[k] < 3 and (plain or len(latin) < 0.8 * len(letters)) and (capital or not titled):
            found.append((sum(places[k]) / len(own), -len(own), k, name))
    if len(found) < 3:
        return []
    found.sort()
    narrow = {k for *_, k, _ in found for *_, o, _ in found if o != k and len(docs[o]) > len(docs[k]) and len(docs[k] - docs[o]) <= (1 - 0.9) * len(docs[k]) and middle[o] <= middle[k]}
    claimed, out = [], []
    for position, n, k, name in found:
        if k in narrow or any(len(docs[k] - c) <= (1 - 0.9) * len(docs[k]) for c in claimed) or sum(len(docs[k] & c) >= 0.25 * len(docs[k]) for c in claimed) >= 2:
            continue
        claimed.append(docs[k])
        out.append((name, -n, position))
    return out[:40]


def found(spark, headings, **names):
    return [tuple(r) for r in terms.heading_terms(spark.createDataFrame(headings, SCHEMA), "id", "heading", **names).collect()]


@pytest.mark.parametrize("seed", range(4))
def test_terms_of_random_headings(spark, seed):
    rng = random.Random(seed)
    kinds = [[rng.choice("ABCDEFGH") + "".join(rng.choice("aeiourst") for _ in range(5)) for _ in range(5)] for _ in range(9)]
    names = ["Schmidt", "Muenchen", "Österreich", "www.page.host.example", "a/b/Loginname", "x1y2z3Token", "notes", "YOUR", "Your", "2019", "Ípsilon"]
    rows = []
    for i in range(140):
        kind = kinds[min(int(rng.expovariate(0.4)), 8)]
        words = kind[: rng.choice([1, 2, 3, 4, 5])] + [rng.choice(names) for _ in range(rng.randrange(3))] + [rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(2))]
        if rng.random() < 0.3:
            rng.shuffle(words)
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    rows += [(900, None), (901, ""), (902, "  ")]
    for names_ in ({}, {"titled": False, "owner": ["Schmidt"], "person": ["OSTERREICH"]}):
        got = found(spark, rows, **names_)
        assert [(w, n, pytest.approx(p)) for w, n, p in got] == brute(rows, **names_)
        assert len(got) >= 3


def test_one_word_of_a_template_stays(spark):
    rows = [(i, f"Loonbrief Kantoor Afhaling {'Anna' if i % 2 else 'Boris'}") for i in range(20)] + [(20 + i, f"{kind} Anna") for i, kind in enumerate(["Rechnung"] * 9 + ["Certificate"] * 9)]
    assert [w for w, *_ in found(spark, rows)] == [w for w, *_ in brute(rows)] == ["Loonbrief", "Certificate", "Rechnung"]


def test_rounds_decide_as_one_after_the_other(spark):
    """A chain in which each term's fate hangs on the one before."""
    rng = random.Random(5)
    members = {f"t{k:02d}": set(rng.sample(range(30), rng.randrange(4, 9))) | ({k, k + 1, k + 2} if k else set()) for k in range(40)}
    given = [(t, len(m), 0, float(k)) for k, (t, m) in enumerate(members.items())]
    frame = spark.createDataFrame(given, "term string, documents long, middle int, position double")
    pairs = spark.createDataFrame([(t, d) for t, m in members.items() for d in m], "term string, document long")
    narrow = {t for t, m in members.items() for o, x in members.items() if o != t and len(x) > len(m) and len(m - x) <= (1 - 0.9) * len(m)}
    claimed, want = [], []
    for t, m in members.items():
        if t not in narrow and not any(len(m - c) <= (1 - 0.9) * len(m) for c in claimed) and sum(len(m & c) >= 0.25 * len(m) for c in claimed) < 2:
            claimed.append(m)
            want.append(t)
    assert sorted(r.term for r in terms.without_templates(frame, pairs).collect()) == want and 1 < len(want) < 30


def test_folding_is_the_unicode_rule(spark):
    words = ["Straße", "RECHNUNG", "Tamás", "ﬁne", "Ĳssel", "Ñandú", "Ωμέγα", "ǅ", "Ⅷ", "ｆｕｌｌ", "ё", "Đường", "é", "日本", "", "ÀÉÎ õ"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(folded(F.col("w"))).collect()
    assert [r[0] for r in got] == [fold(w) for w in words]
