import random
import re

import pytest

from factloom.operators import emerging, evidence, wire
from factloom.operators.rules import load_rules

RULES = load_rules("""
[rule: what the page calls itself: Stadtwerke]
when = heading contains "Stadtwerke"
into = /Stadtwerke
[rule: payslips]
when = heading contains "Loonbrief" and lang = nl
into = /payslips
[rule: what the page calls itself: Rechnung]
when = heading contains "Rechnung"
into = /Rechnung
[rule: the rest]
when = heading is set
into = /rest
holding = yes
""")
SCHEMA = "id long, heading string, lang string, waits boolean"


def documents(spark):
    rows = [f"Mahnung Stadtwerke {n}" for n in ("Nord", "Sued", "West", "Ost")] + [f"Rechnung Stadtwerke {n}" for n in ("Nord", "Sued", "West")]
    rows += [f"Bescheid {n} Amt" for n in ("Erster", "Zweiter", "Dritter")] + [f"Loonbrief Zahlung {n}" for n in ("a", "b", "c", "d")] + [f"mahnung {n}" for n in ("klein", "kleiner")] + [None, ""]
    return spark.createDataFrame([(i, h, "nl" if h and h.startswith("Loon") else "de", i % 2 == 0) for i, h in enumerate(rows)], SCHEMA)


def test_a_word_counts_where_it_stands_before_the_claim(spark):
    found = {r.term: (r.documents, r.claimed) for r in emerging.emerging(documents(spark), RULES, "id").collect()}
    # Mahnung stands before Stadtwerke, which claims it; Loonbrief is filed by hand; Rechnung has its own rule; a lower-case mahnung teaches nothing
    assert found == {"Mahnung": (4, 4), "Bescheid": (3, 0)}
    waiting = {r.term: r.documents for r in emerging.emerging(documents(spark), RULES, "id", waiting_col="waits", at_least=1).collect()}
    assert waiting == {"Mahnung": 2, "Bescheid": 1}
    assert emerging.emerging(documents(spark).limit(0), RULES, "id").count() == 0


def test_new_rules_go_above_all_they_must_beat(spark):
    plan = {r.term: (r.beats, r.place) for r in emerging.adoption_plan(documents(spark), RULES, "id").collect()}
    assert plan == {"Mahnung": ("what the page calls itself: Stadtwerke", 0), "Bescheid": ("", 3)}
    beaten = {(r.word, r.k, r.documents) for r in emerging.outranked(documents(spark), RULES, ["rechnung", "Nord"], "id").collect()}
    assert beaten == {("rechnung", 0, 3), ("Nord", 0, 2)}
    none = load_rules('[rule: payslips]\nwhen = lang = xx\ninto = /x\n')
    assert {r.place for r in emerging.adoption_plan(documents(spark), none, "id").collect()} == {1}


def test_claims_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["Alpha", "Beta", "gamma", "Stadtwerke", "Rechnungen", "Delta", "Epsilon", "Loonbrief", "12", "ab"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))), rng.choice(["nl", "de", None]), True) for i in range(300)]
    got = {r.id: (r.term, r.winner) for r in emerging.earned_terms(spark.createDataFrame(rows, SCHEMA), RULES, "id", titled=False).collect()}
    terms = [t for t, _ in emerging.unnamed_terms(spark.createDataFrame(rows, SCHEMA), RULES, "id", titled=False)]
    assert terms and not {"Stadtwerke", "Rechnungen"} & set(terms)
    for i, heading, lang, _ in rows:
        said = re.findall(r"[^\W\d_]{3,}", heading)
        at = lambda text: next((k for k, w in enumerate(said) if text in w.lower()), None)
        low = heading.lower()
        winner = 0 if "stadtwerke" in low else 1 if "loonbrief" in low and lang == "nl" else 2 if "rechnung" in low else None
        claim = {0: at("stadtwerke"), 1: -1, 2: at("rechnung"), None: len(said) + 1}[winner]
        first = [w for k, w in enumerate(said) if k < claim and w in terms and w[0].isupper() and w not in said[:k]]
        assert got[i] == (first[0] if first else None, winner), heading


def facts(spark, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(6), k, rng.choice("abcde"), rng.choice(["x", "X.", "y", "7", "é\n\"", ""]), "string", f"r{k % 3}", rng.choice([0.45, 0.7, 0.85])) for k in range(150)]
    return spark.createDataFrame(rows, "item_id long, seq long, name string, value string, vtype string, source string, confidence double")


def plain(df):
    return sorted(str(r.asDict(recursive=True)) for r in df.select("item_id", *wire.COLUMNS).collect())


def test_a_record_comes_back_as_it_was(spark):
    record = evidence.merge_facts(facts(spark)).withColumn("vtype", evidence.F.lit("string"))
    assert plain(wire.from_wire(wire.to_wire(record))) == plain(record) and wire.to_wire(record).count() == 6
    assert any("corroborated_by': ['r" in r for r in plain(record)) and any("rejected" in r for r in plain(record))
    for bad in ("[]", "{}", "no", None, '{"version": 2, "facts": []}'):
        with pytest.raises(Exception, match="not a record"):
            wire.from_wire(spark.createDataFrame([(1, bad)], "item_id long, wire string")).collect()


def test_differences_fill_gaps_and_carry_drops(spark):
    record = lambda seed: evidence.merge_facts(facts(spark, seed)).withColumn("vtype", evidence.F.lit("string"))
    before, after = record(1).where("name in ('a', 'b', 'c')"), record(2).where("name <> 'b'")
    delta = wire.difference(after, before)
    assert {(r.name) for r in delta.where("dropped").collect()} == {"b"}
    fresh = record(3).where("name in ('a', 'b')")
    key = lambda df: {(r.item_id, r.name): str(r.asDict(recursive=True)) for r in df.select("item_id", *wire.COLUMNS).collect()}
    own, late, early = key(fresh), key(after), key(before)
    gone = {k for k in early if k not in late}
    want = {k: v for k, v in own.items() if k not in gone} | {k: v for k, v in late.items() if k not in own and k not in early}
    assert key(wire.apply_difference(fresh, delta)) == want
    assert key(wire.apply_difference(before, wire.difference(after, before))).keys() == late.keys() | (early.keys() & late.keys())
    assert key(wire.apply_difference(fresh, delta.limit(0))) == own and key(wire.apply_difference(fresh.limit(0), delta)) == {k: v for k, v in late.items() if k not in early}
    assert {r.name for r in wire.drop(fresh, "a").collect()} == {"b"}
