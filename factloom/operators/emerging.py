"""Categories that documents have proved since the rules were written: words no rule names that stand before whatever claims the document, and where their rules must go.

All is said of the documents in one projection: the words of a heading with their places, the first rule that holds, and where in the heading
that rule found its own word. A word counts in a document only if it comes before that place. Candidates and rules are few
and go into the expressions; documents are only counted.
"""

from __future__ import annotations

from functools import reduce

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.language import compile_condition, facts_of_frame, leaves_of
from factloom.operators.rules import Rule, RuleSet
from factloom.operators.terms import CAP, MIN_OCCURRENCES, heading_terms, words_of

# How the names of rules begin that were learnt from a word; all others were written by someone who knew what the documents are.
LEARNT = ("what the page calls itself: ", "what these files are called: ")


def _filing(rules: RuleSet) -> list[tuple[int, Rule]]:
    """The rules that name what they file, with their numbers; a holding rule claims everything and names nothing."""
    return [(k, r) for k, r in enumerate(rules.rules) if not r.holding]


def _probed(df: DataFrame) -> DataFrame:
    """With the facts that any document is asked with: a name and a kind."""
    return df.withColumns({c: F.lit(v) for c, v in (("name", "probe"), ("kind", "document")) if c not in df.columns})


def first_holding(df: DataFrame, rules: RuleSet) -> Column:
    """The number of the first filing rule whose condition holds, or null; gates, confidences and destinations aren't asked."""
    facts = facts_of_frame(df)
    own = _filing(rules)
    return F.coalesce(*[F.when(compile_condition(r.condition, facts)[0], F.lit(k)) for k, r in own], F.lit(None).cast("int"))


def _alone(text: str) -> str:
    return "".join(re.findall(r"[^\W\d_]{3,}", text.lower()))


def _inside(words: Column, text: str) -> Column:
    """The first place of a word that holds the text, or null."""
    return F.array_min(F.transform(words, lambda w, i: F.when(F.lower(w).contains(text), i)))


def _place(words: Column, word: str) -> Column:
    """The first place of a word, case apart; a word that isn't there stands behind all others."""
    at = F.array_position(F.transform(words, F.lower), word.lower())
    return F.when(at > 0, at - 1).otherwise(F.size(words) + 1)


def claimed_at(words: Column, winner: Column, rules: RuleSet, fact: str) -> Column:
    """Where in a heading the rule that claims it found what it wants: before everything for a rule that someone wrote, at the end for none."""
    places = F.when(winner.isNull(), F.size(words) + 1)
    for k, r in _filing(rules):
        if not r.name.startswith(LEARNT):
            place = F.lit(-1)
        else:
            asked = [_alone(str(leaf.args[0])) for leaf in leaves_of(r.condition) if leaf.op == "contains" and leaf.fact == fact]
            inside = [_inside(words, a) for a in asked if a]
            place = F.coalesce(F.least(*inside, F.lit(None).cast("int"), F.lit(None).cast("int")), _place(words, r.name.split(": ")[-1]))
        places = places.when(winner == k, place)
    return places.cast("long")


def unnamed_terms(headings: DataFrame, rules: RuleSet, key: str, fact: str = "heading", **options) -> list[tuple[str, int]]:
    """(term, documents) of the heading terms that no filing rule would claim, in their order; ``options`` are those of ``heading_terms``, whose ``cap`` bounds them."""
    terms = heading_terms(headings, key, fact, **options)
    probe = _probed(terms.withColumn(fact, F.col("term")).drop("position"))
    named = first_holding(probe.select(fact, "name", "kind"), rules)
    rows = probe.select("term", "documents", named.isNotNull().alias("named")).limit(options.get("cap", CAP)).collect()
    return [(r.term, r.documents) for r in rows if not r.named]


def earned_terms(documents: DataFrame, rules: RuleSet, key: str, fact: str = "heading", waiting_col: str | None = None, **options) -> DataFrame:
    """(id, term, winner): the term that each document counts for, if any, and the number of the rule that claims it now.

    A document counts for the first of the unnamed terms in its heading, written with a capital there (or in a script without), that stands before the claim.
    All headings teach the terms; with ``waiting_col`` only documents that wait count.
    """
    some = documents.where(F.coalesce(F.col(fact), F.lit("")) != "")
    terms = [t for t, _ in unnamed_terms(some, rules, key, fact, **options)]
    asked = _probed(some if waiting_col is None else some.where(F.col(waiting_col)))
    winner = first_holding(asked, rules)
    told = asked.select(F.col(key).alias("id"), words_of(F.col(fact)).alias("_words"), winner.alias("winner"))
    told = told.withColumn("_at", claimed_at(F.col("_words"), F.col("winner"), rules, fact))
    low = F.transform("_words", F.lower)
    wanted = {t.lower(): t for t in terms}
    fits = F.filter(
        F.transform("_words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))),
        lambda x: F.lower(x["w"]).isin(*wanted or ("",)) & (x["i"] < F.col("_at")) & (F.array_position(low, F.lower(x["w"])) == x["i"] + 1) & (x["w"].rlike(r"\p{Lu}") | (F.lower(x["w"]) == F.upper(x["w"]))),
    )
    spelled = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair]) if wanted else F.lit(None).cast("map<string,string>")
    return told.select("id", F.element_at(spelled, F.lower(F.get(fits, F.lit(0))["w"])).alias("term"), "winner")


def emerging(documents: DataFrame, rules: RuleSet, key: str, fact: str = "heading", waiting_col: str | None = None, at_least: int = MIN_OCCURRENCES, **options) -> DataFrame:
    """(term, documents, claimed): terms that enough documents have earned, and how many of these a rule claims by a later word."""
    earned = earned_terms(documents, rules, key, fact, waiting_col, **options).where("term is not null")
    return earned.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.count("winner").alias("claimed")).where(F.col("documents") >= at_least)


def outranked(documents: DataFrame, rules: RuleSet, words: list[str], key: str, fact: str = "heading") -> DataFrame:
    """(word, rule, k, documents): the rules that claim, by the heading alone, documents whose headings hold the words; a rule for a word must stand above them."""
    low = F.lower(F.col(fact))
    held = F.filter(F.array(*[F.when(low.contains(w.lower()), w) for w in words] or [F.lit(None).cast("string")]), lambda w: w.isNotNull())
    probe = _probed(documents.where(F.coalesce(F.col(fact), F.lit("")) != "").select(fact))
    claimed = probe.select(F.explode(held).alias("word"), first_holding(probe, rules).alias("k")).where("k is not null")
    names = F.create_map(*[F.lit(x) for k, r in _filing(rules) for x in (k, r.name)]) if _filing(rules) else F.lit(None).cast("map<int,string>")
    return claimed.groupBy("word", "k").agg(F.count(F.lit(1)).alias("documents")).select("word", F.element_at(names, F.col("k")).alias("rule"), "k", "documents")


def adoption_plan(documents: DataFrame, rules: RuleSet, key: str, fact: str = "heading", at_least: int = MIN_OCCURRENCES, **options) -> DataFrame:
    """(term, documents, beats, place): emerging terms with the rules they must beat and the number of the rule that their own goes above.

    That is the first rule that holds what is left, or one above it that claims the term's documents; without either the rule goes to the
    end. A rule below the one that claims its documents would never fire.
    """
    found = emerging(documents, rules, key, fact, None, at_least, **options)
    words = [r.term for r in found.select("term").collect()]  # as many as heading_terms returns at most
    beaten = outranked(documents, rules, words, key, fact).groupBy(F.col("word").alias("term")).agg(F.array_sort(F.collect_set(F.struct("k", "rule"))).alias("_b"))
    holding = min((k for k, r in enumerate(rules.rules) if r.holding), default=len(rules.rules))
    place = F.least(F.lit(holding), F.get("_b", F.lit(0))["k"])
    return found.join(beaten, "term", "left").select("term", "documents", F.array_join(F.transform(F.coalesce("_b", F.array().cast("array<struct<k:int,rule:string>>")), lambda b: b["rule"]), ",").alias("beats"), place.alias("place"))
