"""Ordered rules over facts: gates, extraction, destinations, first match and the nearest miss.

A rule set compiles to one struct column per rule, (matched, reason, destination),
so deciding a table of any size is one projection: no join and no shuffle, and
Spark reads only the columns that some rule names.
"""

from __future__ import annotations

import configparser
import hashlib
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import paths
from factloom.functions.language import (
    Always, Fact, LanguageError, bind, compile_condition, facts_of, facts_of_frame, java_pattern, literal, names, parse,
)

NO_MATCH = "when did not match"
#: Times that a rule must have been shadowed before it is called dead.
TRIALS = 3
#: Facts that say what an item is called and where it lies; extraction may not make them.
PROTECTED = ("name", "stem", "ext", "dir", "path", "source_root", "size", "modified", "added", "age", "kind", "format")
# The keys that the sections of a rules text may have.
RULE_KEYS = ("when", "into", "as", "extract", "mode", "stop", "holding", "min_confidence", "newer_than", "older_than", "only_on")


@dataclass(frozen=True)
class Rule:
    name: str
    when: str = ""
    into: str | None = None
    rename: str | None = None
    extract: str | None = None
    mode: str = "move"
    stop: bool = True
    holding: bool = False
    min_confidence: float = 0.0
    newer_than: float | None = None  # days
    older_than: float | None = None
    only_on: tuple[str, ...] = ()
    condition: object = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "condition", parse(self.when))
        if self.mode not in ("move", "copy", "leave"):
            raise LanguageError(f"rule {self.name!r}: unknown mode {self.mode!r}")
        if self.mode != "leave" and self.into is None:
            raise LanguageError(f"rule {self.name!r} has no destination")
        subject, pattern = self.extraction
        if subject and (not re.compile(pattern).groupindex or set(re.compile(pattern).groupindex) & set(PROTECTED)):
            raise LanguageError(f"rule {self.name!r}: an extract needs named groups, none of them protected")

    @property
    def extraction(self) -> tuple[str | None, str]:
        if not self.extract:
            return None, ""
        m = re.fullmatch(r"\s*(\S+)\s+re\s+(.+?)\s*", self.extract, re.DOTALL)
        if not m:
            raise LanguageError(f"rule {self.name!r}: an extract is FACT re PATTERN")
        return m[1], m[2].strip("\"'")

    @property
    def path_facts(self) -> list[str]:
        """The facts its destination rests on: those of its templates, and what is extracted from in place of what is extracted."""
        own = dict.fromkeys(paths.template_facts(self.into) + paths.template_facts(self.rename))
        subject, pattern = self.extraction
        if subject:
            for g in re.compile(pattern).groupindex:
                own.pop(g, None)
            own[subject] = None
        return list(own)

    @property
    def facts(self) -> list[str]:
        gates = ["age"] if self.newer_than is not None or self.older_than is not None else []
        return list(dict.fromkeys(gates + facts_of(self.condition) + self.path_facts))

    def evaluate(self, facts: Mapping[str, Fact], confidence: Mapping[str, Column] | Column | None = None, platform: str = "linux") -> Column:
        """struct(matched, reason, destination, rests_on); the first gate that fails gives the reason.

        ``confidence``: a map column from fact to confidence, or a column for each fact; facts without one count 0.
        """
        why: list[Column] = []
        if self.only_on and platform not in self.only_on:
            why.append(F.lit(f"not enabled on {platform}"))
        age = facts["age"].number if "age" in facts else F.lit(None).cast("double")
        if self.newer_than is not None:
            why.append(F.when(~F.coalesce(age < self.newer_than, F.lit(False)), f"not newer than {self.newer_than:g} days"))
        if self.older_than is not None:
            why.append(F.when(~F.coalesce(age > self.older_than, F.lit(False)), f"not older than {self.older_than:g} days"))
        held, rests_on = compile_condition(self.condition, facts)
        why.append(F.when(~held, NO_MATCH))
        if confidence is not None:
            of = (lambda f: confidence.get(f, F.lit(0.0))) if isinstance(confidence, Mapping) else (lambda f: confidence[f])
            level = F.coalesce(F.create_map(*[x for f in self.facts for x in (F.lit(f), F.coalesce(of(f), F.lit(0.0)))]), F.create_map()) if self.facts else F.create_map()
            shown = [F.when(F.nullif(facts[f].text, F.lit("")).isNotNull(), names(f)).otherwise(names()) for f in self.path_facts if f in facts]
            asked = F.array_sort(reduce(F.array_union, shown, rests_on))
            weak = F.filter(F.transform(asked, lambda f: F.struct(f.alias("f"), F.element_at(level, f).alias("at"))), lambda x: x["at"] < self.min_confidence)
            told = lambda w: F.array_join(F.transform(w, lambda x: F.format_string("%s %.2f", x["f"], x["at"])), ", ")
            why.append(bind(weak, lambda w: F.when(F.size(w) > 0, F.concat(F.lit(f"below confidence {self.min_confidence:.2f}: "), told(w)))))
        facts = dict(facts)
        subject, pattern = self.extraction
        if subject:
            text = facts[subject].text if subject in facts else F.lit(None).cast("string")
            java = java_pattern(pattern)
            why.append(F.when(text.isNull(), f"extract needs missing fact '{subject}'"))
            why.append(F.when(~text.rlike(java), F.concat(F.lit(f"extract did not match {subject}="), F.left(text, F.lit(60)))))
            for group, i in re.compile(pattern).groupindex.items():
                found = F.nullif(F.regexp_extract(text, java, i), F.lit(""))
                facts[group] = Fact(F.coalesce(found, facts[group].text) if group in facts else found, T.StringType())
        destination = F.lit(None).cast("string")
        if self.mode != "leave":
            folder, problem = paths.render(self.into, facts)
            why.append(problem)
            if self.rename:
                file, problem = paths.render(self.rename, facts)
                why.append(problem)
            else:
                file = paths.sanitise(facts["name"].text) if "name" in facts else F.lit("_")
            if not self.into.startswith("/"):
                root = next((facts[f].text for f in ("source_root", "dir") if f in facts), F.lit(None).cast("string"))
                why.append(F.when(root.isNull(), "relative destination has no source root"))
                folder = F.concat(root, F.lit("/"), folder)
            destination = F.concat(folder, F.lit("/"), F.coalesce(file, F.lit("_")))
        fine = "matched; leave in place" if self.mode == "leave" else "matched"
        found = F.struct(F.coalesce(*[w.cast("string") for w in why]).alias("problem"), destination.alias("to"), rests_on.alias("on"))
        return bind(found, lambda x: F.struct(
            x["problem"].isNull().alias("matched"), F.coalesce(x["problem"], F.lit(fine)).alias("reason"),
            F.when(x["problem"].isNull(), x["to"]).alias("destination"), x["on"].alias("rests_on"),
        ))


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...]
    digest: str = ""

    @property
    def facts(self) -> list[str]:
        return list(dict.fromkeys(f for r in self.rules for f in r.facts))

    def evaluations(self, facts, confidence=None, platform="linux") -> list[Column]:
        return [r.evaluate(facts, confidence, platform) for r in self.rules]

    def decide(self, df: DataFrame, confidence=None, platform: str = "linux", keep: tuple[str, ...] = ()) -> DataFrame:
        """The kept columns, and rule, mode, destination and near_miss of each row.

        The first rule that matches decides; without one, ``near_miss`` is the
        reason of the first rule whose condition held and a later gate refused.
        """
        each = df.select(*keep, *[e.alias(f"_e{k}") for k, e in enumerate(self.evaluations(facts_of_frame(df), confidence, platform))])
        cols = [F.col(f"_e{k}") for k in range(len(self.rules))]
        none = F.lit(None).cast("string")
        first = lambda value: F.coalesce(*[F.when(c["matched"], value(r, c)) for r, c in zip(self.rules, cols)], none)
        won = first(lambda r, c: F.lit(r.name))
        missed = F.coalesce(*[F.when(~c["matched"] & (c["reason"] != NO_MATCH), F.concat(F.lit(f"{r.name}: "), c["reason"])) for r, c in zip(self.rules, cols)], none)
        return each.select(
            *keep, won.alias("rule"), first(lambda r, c: F.lit(r.mode)).alias("mode"),
            first(lambda r, c: c["destination"]).alias("destination"), F.when(won.isNull(), missed).alias("near_miss"),
        )

    def explain(self, df: DataFrame, confidence=None, platform: str = "linux", keep: tuple[str, ...] = ()) -> DataFrame:
        """The kept columns and (k, rule, matched, reason, destination) of each rule that is tried, in order.

        The first rule that matches and has ``stop`` is the last one tried; a matching rule without it lets the next be tried as well.
        """
        tried = [
            F.struct(F.lit(k).alias("k"), F.lit(r.name).alias("rule"), e["matched"].alias("matched"), e["reason"].alias("reason"), e["destination"].alias("destination"))
            for k, (r, e) in enumerate(zip(self.rules, self.evaluations(facts_of_frame(df), confidence, platform)))
        ]
        each = df.select(*keep, F.array(*tried).alias("_each"))
        ends = [F.when(F.col("_each")[k]["matched"], F.lit(k + 1)) for k, r in enumerate(self.rules) if r.stop]
        return each.select(*keep, F.inline(F.slice("_each", F.lit(1), F.coalesce(*ends, F.lit(len(tried))))))

    def file(self, df: DataFrame, confidence=None, platform: str = "linux", keep: tuple[str, ...] = (), gather_into: str | None = None) -> DataFrame:
        """The kept columns and (rule, operation, destination, holding, skipped): what is done with each item.

        An item that no rule decides is skipped with the reason of the nearest miss, or, with ``gather_into``, moved there under
        its name, held, by the rule ``[unsorted]``; a relative folder lies in the item's ``source_root``, and an item without one is skipped.
        An item that a rule leaves in place is skipped.
        """
        root = [F.col("source_root").alias("_root")] if "source_root" in df.columns else [F.lit(None).cast("string").alias("_root")]
        named = [paths.sanitise(F.col("name")).alias("_name") if "name" in df.columns else F.lit("_").alias("_name")]
        decided = self.decide(df.select("*", *root, *named), confidence, platform, (*keep, "_root", "_name"))
        none, nothing = F.col("rule").isNull(), F.lit(None).cast("string")
        left = F.coalesce(F.col("mode") == "leave", F.lit(False))
        into = nothing
        if gather_into is not None:
            folder = F.lit(gather_into) if gather_into.startswith("/") else F.concat(F.col("_root"), F.lit(f"/{gather_into}"))
            into = F.concat(folder, F.lit("/"), F.coalesce("_name", F.lit("_")))
        gathered = none & into.isNotNull()
        holds = F.col("rule").isin(*[r.name for r in self.rules if r.holding]) if any(r.holding for r in self.rules) else F.lit(False)
        why = F.when(none, F.coalesce(F.concat(F.lit("no rule matched (closest: "), F.col("near_miss"), F.lit(")")), F.lit("no rule matched")))
        return decided.select(
            *keep, F.when(gathered, "[unsorted]").otherwise(F.col("rule")).alias("rule"),
            F.when(gathered, "move").when(~left, F.col("mode")).alias("operation"),
            F.when(gathered, into).when(~left, F.col("destination")).alias("destination"),
            (gathered | (F.coalesce(holds, F.lit(False)) & ~left)).alias("holding"),
            F.when(~gathered, why.when(left, F.concat(F.lit("rule "), F.col("rule"), F.lit(" says leave")))).alias("skipped"),
        )

    def usage(self, filed: DataFrame, rule_col: str) -> DataFrame:
        """(k, rule, placed, shadowed, shadowed_by, waiting, dead) of each rule over items that were filed, ``rule_col`` names by which rule.

        Conditions alone are replayed, without gates: was a rule reachable at all? Placed: it filed the item. Of the other
        rules that match, those below the one that filed it are shadowed, ``shadowed_by`` is the most frequent of these;
        those above it wait, and so do all when the rule that filed it is gone: the item is theirs next time. Dead: never placed
        or waiting, shadowed ``TRIALS`` times or more, and not holding. Null facts are absent; an item without a rule was filed by one that is gone.
        """
        facts = {k: v for k, v in facts_of_frame(filed).items() if k != rule_col}
        held = F.array(*[compile_condition(r.condition, facts)[0] for r in self.rules])
        position = F.create_map(*[F.lit(x) for k, r in enumerate(self.rules) for x in (r.name, k)])
        rows = filed.select(F.element_at(position, F.col(rule_col)).alias("winner"), F.posexplode(held).alias("k", "hit"))
        placed = F.coalesce(F.col("winner") == F.col("k"), F.lit(False))
        rows = rows.where(F.col("hit") | placed).withColumn("placed", placed)
        pairs = rows.groupBy("k", "winner", "placed").agg(F.count(F.lit(1)).alias("n"))
        above = F.coalesce(F.col("winner") < F.col("k"), F.lit(False))
        of = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).cast("long")
        per = pairs.groupBy("k").agg(
            of(F.col("placed")).alias("placed"), of(above).alias("shadowed"), of(~F.col("placed") & ~above).alias("waiting"),
            F.max(F.when(above, F.struct("n", (-F.col("winner")).alias("w")))).alias("_by"),
        )
        known = filed.sparkSession.createDataFrame([(k, r.name, r.holding) for k, r in enumerate(self.rules)], "k int, rule string, holding boolean")
        name_of = F.element_at(names(*[r.name for r in self.rules]), (F.lit(1) - F.col("_by.w")).cast("int"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        dead = ~F.col("holding") & (zero("placed") == 0) & (zero("waiting") == 0) & (zero("shadowed") >= TRIALS)
        return known.join(F.broadcast(per), "k", "left").select(
            "k", "rule", zero("placed").alias("placed"), zero("shadowed").alias("shadowed"),
            F.when(F.col("_by").isNotNull(), name_of).alias("shadowed_by"), zero("waiting").alias("waiting"), dead.alias("dead"),
        )

    def reachability(self, df: DataFrame, confidence=None, least: int = 3) -> DataFrame:
        """(rule, declined, reason): rules whose condition holds ``least`` times or more and that never decide, with the most frequent refusal."""
        cols = self.evaluations(facts_of_frame(df), confidence)
        winner = F.coalesce(*[F.when(c["matched"], F.lit(k)) for k, c in enumerate(cols)])
        each = F.array(*[F.struct(c["matched"].alias("matched"), c["reason"].alias("reason")) for c in cols])
        rows = df.select(winner.alias("winner"), F.posexplode(each).alias("k", "e")).where(F.col("e.reason") != NO_MATCH)
        counts = rows.groupBy("k", "e.reason", "e.matched").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("winner") == F.col("k"), 1)).alias("won"))
        per = counts.groupBy("k").agg(
            F.sum(F.when(~F.col("matched"), F.col("n")).otherwise(0)).cast("long").alias("declined"), F.sum("won").alias("won"),
            F.max_by(F.when(~F.col("matched"), F.col("reason")), F.when(~F.col("matched"), F.struct("n", F.col("reason").alias("r")))).alias("reason"),
        )
        return per.where((F.col("won") == 0) & (F.col("declined") >= least)).select(
            F.element_at(names(*[r.name for r in self.rules]), F.col("k") + 1).alias("rule"), "declined", "reason"
        )


def load_rules(text: str) -> RuleSet:
    """A rule set from its INI text: a ``[rule: name]`` section for each, no unknown key, no name twice."""
    parser = configparser.RawConfigParser(interpolation=None, strict=True)
    try:
        parser.read_string(text)
    except configparser.Error as e:
        raise LanguageError(str(e)) from e
    rules = []
    for section in parser.sections():
        if section in ("settings", "watch"):
            continue
        m = re.fullmatch(r"rule:\s*(.+?)\s*", section)
        if not m:
            raise LanguageError(f"unknown section [{section}]")
        own = dict(parser.items(section))
        if unknown := sorted(set(own) - set(RULE_KEYS)):
            raise LanguageError(f"rule {m[1]!r}: unknown key {unknown[0]!r}")
        days = lambda k, own=own: None if k not in own else float(literal(own[k])) / (86400 if re.search("[a-zA-Z]", own[k]) else 1)
        yes = lambda k, default, own=own: literal(own[k]) is True if k in own else default
        rules.append(Rule(
            m[1], own.get("when", ""), own.get("into"), own.get("as"), own.get("extract"), own.get("mode", "move"), yes("stop", True), yes("holding", False),
            float(own.get("min_confidence", 0)), days("newer_than"), days("older_than"), tuple(filter(None, re.split(r"[,\s]+", own.get("only_on", "")))),
        ))
    seen = [r.name.lower() for r in rules]
    if twice := next((x for x in seen if seen.count(x) > 1), None):
        raise LanguageError(f"two rules are called {twice!r}")
    return RuleSet(tuple(rules), hashlib.sha256(text.encode()).hexdigest())


__all__ = ["Always", "Rule", "RuleSet", "load_rules", "NO_MATCH"]
