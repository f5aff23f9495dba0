"""Audits of rules by replaying their comparisons over what is known: words inside words, near misses of values, new categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.language import compile_condition, facts_of_frame, leaves_of
from factloom.functions.text import nearly
from factloom.operators.induction import long_facts
from factloom.operators.rules import RuleSet

AT_LEAST = 3


def inside_words(items: DataFrame, rules: RuleSet, at_least: int = AT_LEAST) -> DataFrame:
    """(rule, fact, word, inside, hosts): ``contains`` words that no item has as a word of its own, only inside longer ones.

    ``hosts`` are the five most frequent of the words they stand in.
    """
    asked = [(r.name, leaf.fact, str(leaf.args[0]).lower()) for r in rules.rules for leaf in leaves_of(r.condition) if leaf.op == "contains" and leaf.fact in items.columns]
    if not asked:
        return items.sparkSession.createDataFrame([], "rule string, fact string, word string, inside long, hosts string")
    text = lambda fact: F.lower(F.col(fact).cast("string"))
    said = items.select(F.inline(F.array(*[F.struct(F.lit(f).alias("fact"), text(f).alias("text")) for f in dict.fromkeys(f for _, f, _ in asked)])))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    hosts = said.select("fact", F.explode(words).alias("host")).groupBy("fact", "host").agg(F.count(F.lit(1)).alias("n"))  # one scan, whatever the words
    every = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(f).alias("fact"), F.lit(w).alias("word")) for r, f, w in dict.fromkeys(asked)])
    counts = hosts.select("host", "n", F.inline(F.filter(every, lambda a: (a["fact"] == F.col("fact")) & F.col("host").contains(a["word"]))))
    per = counts.groupBy("rule", "fact", "word").agg(
        F.sum(F.when(F.col("host") == F.col("word"), F.col("n")).otherwise(0)).alias("whole"), F.sum(F.when(F.col("host") != F.col("word"), F.col("n")).otherwise(0)).alias("inside"),
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "host"))), 1, 5).alias("_h"),
    )
    return per.where((F.col("whole") == 0) & (F.col("inside") >= at_least)).select("rule", "fact", "word", "inside", F.array_join(F.transform("_h", lambda h: h["host"]), ",").alias("hosts"))


def near_values(items: DataFrame, key: str, rules: RuleSet) -> DataFrame:
    """(rule, fact, wanted, value, n): values that nearly equal what a never-true equality of a rule wants, for rules that match no item at all.

    The wanted values come from the rules, so that side is small and goes to every executor.
    """
    facts = facts_of_frame(items)
    matched = items.agg(*[F.coalesce(F.max(compile_condition(r.condition, facts)[0]), F.lit(False)) for r in rules.rules]).first() if rules.rules else ()
    never = [r for r, held in zip(rules.rules, matched) if not held]
    wanted = [(r.name, leaf.fact, str(v)) for r in never for leaf in leaves_of(r.condition) if leaf.op in ("=", "in") and leaf.fact in items.columns for v in leaf.args if isinstance(v, str)]
    spark = items.sparkSession
    if not wanted:
        return spark.createDataFrame([], "rule string, fact string, wanted string, value string, n long")
    values = long_facts(items, key, sorted({f for _, f, _ in wanted})).groupBy("fact", "value").agg(F.count(F.lit(1)).alias("n"))
    asked = spark.createDataFrame(sorted(set(wanted)), "rule string, fact string, wanted string")
    pairs = values.join(F.broadcast(asked), "fact")
    exact = pairs.where(F.lower(F.trim("value")) == F.lower(F.trim("wanted"))).select("rule", "fact", "wanted").distinct()
    return pairs.where(nearly(F.col("wanted"), F.col("value"))).join(F.broadcast(exact), ["rule", "fact", "wanted"], "left_anti").select("rule", "fact", "wanted", "value", "n")


def emerging(items: DataFrame, heading_col: str, claimed_by: str, known: list[str], at_least: int = AT_LEAST, cap: int = 20) -> DataFrame:
    """(term, documents, claimed): heading words no rule knows, that stand in enough items, with how many of them a rule claims already."""
    words = items.select(F.explode(F.array_distinct(F.split(F.lower(heading_col), r"(?U)\s+"))).alias("term"), claimed_by).where(F.col("term").rlike(r"^\p{L}{4,}$") & ~F.col("term").isin([k.lower() for k in known] or [""]))
    found = words.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.count(claimed_by).alias("claimed")).where(F.col("documents") >= at_least)
    return found.orderBy(F.desc("documents"), "term").limit(cap)
