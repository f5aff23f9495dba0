"""The `when` language: an ordered-rule predicate over facts, compiled to Spark columns.

Grammar: ``or`` binds loosest, then ``and``, then ``not``; parentheses group; an
empty source is always true. A comparison is a fact's name and one of

    = != < <= > >=   ~ GLOB   re|matches PATTERN   contains TEXT
    in A, B, ...     between A and B     is set    is unset

Literals: yes/true/on and no/false/off are booleans even when quoted; a number may carry
a size unit (base 1024, result in bytes) or a duration unit (result in seconds).
A bare ``m`` or ``s`` is time.

An absent fact (null) makes every comparison false, ``!=`` too, and ``not`` of that is
true: each leaf is closed over null before anything is combined. A condition
compiles to two columns: whether it holds, and which facts that answer rests on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LanguageError(ValueError):
    """A condition that can't be read; the message says where."""


# Units of sizes (bytes) and durations (seconds).
SIZE_UNITS = {"b": 1, "k": 2**10, "kb": 2**10, "mb": 2**20, "g": 2**30, "gb": 2**30, "tb": 2**40}
TIME_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
TRUE_WORDS, FALSE_WORDS = ("yes", "true", "on"), ("no", "false", "off")

#: What a number looks like to a comparison; stricter than Spark's own casts, which read 5d as a number.
NUMERIC = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$"


def literal(text: str) -> bool | float | int | str:
    word = text.lower()
    if word in TRUE_WORDS or word in FALSE_WORDS:
        return word in TRUE_WORDS
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([a-z]{1,2})?", word)
    if not m:
        return text
    amount, unit = float(m[1]), m[2]
    if unit:
        factor = SIZE_UNITS.get(unit, TIME_UNITS.get(unit))
        if factor is None:
            raise LanguageError(f"unknown unit {unit!r}")
        return amount * factor
    return int(amount) if amount.is_integer() else amount


# -- the tree ---------------------------------------------------------------


@dataclass(frozen=True)
class Leaf:
    fact: str
    op: str
    args: tuple = ()


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Never:
    part: object


@dataclass(frozen=True)
class Always:
    pass


def facts_of(node) -> list[str]:
    """The facts a condition names, in order, once each."""
    if isinstance(node, Leaf):
        return [node.fact]
    inner = node.parts if isinstance(node, (Both, Either)) else (node.part,) if isinstance(node, Never) else ()
    return list(dict.fromkeys(f for p in inner for f in facts_of(p)))


def leaves_of(node) -> list[Leaf]:
    if isinstance(node, Leaf):
        return [node]
    inner = node.parts if isinstance(node, (Both, Either)) else (node.part,) if isinstance(node, Never) else ()
    return [leaf for p in inner for leaf in leaves_of(p)]


# -- reading ----------------------------------------------------------------

#: One piece of a source; a number is tried before a word, so an unquoted date falls apart.
_PIECES = (
    ("blank", r"\s+"),
    ("quoted", r'"[^"]*"|\'[^\']*\''),
    ("number", r"\d+(?:\.\d+)?(?:[A-Za-z]{1,2})?"),
    ("compare", r"<=|>=|!=|[=<>~]"),
    ("mark", r"[(),]"),
    ("word", r"[^\s(),]+"),
)
_PIECE = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PIECES))
_JOINERS = ("and", "or", "not")
_RESERVED = (*_JOINERS, "is", "set", "unset", "in", "between", "re", "matches", "contains")


class _Reader:
    """A source's pieces as (kind, text, column), read from left to right with one piece of foresight."""

    def __init__(self, source: str):
        self.source = source
        self.pieces = []
        for m in _PIECE.finditer(source):
            kind, text = m.lastgroup, m[0]
            if kind == "word" and text.lower() in _RESERVED:
                kind = text.lower()
            if kind != "blank":
                self.pieces.append((kind, text[1:-1] if kind == "quoted" else text, m.start() + 1))
        self.pieces.reverse()

    def next_is(self, *kinds: str, text: str | None = None) -> bool:
        return bool(self.pieces) and self.pieces[-1][0] in kinds and (text is None or self.pieces[-1][1] == text)

    def pop(self) -> tuple[str, str, int]:
        if not self.pieces:
            raise LanguageError(f"expression ended early: {self.source!r}")
        return self.pieces.pop()

    def skip(self, kind: str, text: str | None = None) -> bool:
        if self.next_is(kind, text=text):
            self.pieces.pop()
            return True
        return False

    def chain(self, joiner: str, make: type, part: Callable):
        parts = [part()]
        while self.skip(joiner):
            parts.append(part())
        return parts[0] if len(parts) == 1 else make(tuple(parts))

    def condition(self):
        return self.chain("or", Either, lambda: self.chain("and", Both, self.single))

    def single(self):
        if self.skip("not"):
            return Never(self.single())
        if self.skip("mark", "("):
            inside = self.condition()
            kind, text, column = self.pop()
            if text != ")" or kind != "mark":
                raise LanguageError(f"expected ) at column {column}")
            return inside
        return self.leaf()

    def value(self):
        return literal(self.pop()[1])

    def leaf(self) -> Leaf:
        kind, fact, column = self.pop()
        if kind in (*_JOINERS, "number", "compare", "mark"):
            raise LanguageError(f"expected a fact name, found {fact!r} at column {column}")
        kind, text, column = self.pop()
        if kind == "is":
            state, word, _ = self.pop()
            if state not in ("set", "unset"):
                raise LanguageError(f"expected 'set' or 'unset' after 'is', found {word!r}")
            return Leaf(fact, f"is {state}")
        if kind == "in":
            options = [self.value()]
            while self.skip("mark", ","):
                options.append(self.value())
            return Leaf(fact, "in", tuple(options))
        if kind == "between":
            low = self.value()
            if not self.skip("and"):
                raise LanguageError(f"'between' needs 'and': {self.source}")
            return Leaf(fact, "between", (low, self.value()))
        if kind in ("re", "matches", "contains"):
            return Leaf(fact, "contains" if kind == "contains" else "re", (self.pop()[1],))
        if kind != "compare":
            raise LanguageError(f"expected a comparison after {fact!r}, found {text!r} at column {column}")
        return Leaf(fact, text, (self.value(),))


def parse(source: str | None):
    reader = _Reader(source or "")
    if not reader.pieces:
        return Always()
    tree = reader.condition()
    if reader.pieces:
        _, text, column = reader.pop()
        raise LanguageError(f"unexpected {text!r} at column {column}")
    return tree


# -- compiling --------------------------------------------------------------


def java_pattern(pattern: str) -> str:
    """A pattern of Python's as Java reads it, with Unicode classes; the first check is Python's own."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise LanguageError(f"cannot read pattern {pattern!r}: {e}") from e
    return "(?U)" + pattern.replace("(?P<", "(?<")


def glob_pattern(glob: str) -> str:
    """A whole-string pattern for a glob of * ? and [sets]."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inner = glob[i + 1:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner.replace("^", "\\^", 1) if inner[0] == "^" else inner) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


@dataclass(frozen=True)
class Fact:
    """A fact's column with its Spark type, which decides how it is compared."""

    column: Column
    kind: T.DataType

    @property
    def is_boolean(self) -> bool:
        return isinstance(self.kind, T.BooleanType)

    @property
    def is_numeric(self) -> bool:
        return isinstance(self.kind, T.NumericType)

    @property
    def text(self) -> Column:
        return self.column.cast("string")

    @property
    def number(self) -> Column:
        if self.is_boolean:
            return F.lit(None).cast("double")
        if self.is_numeric:
            return self.column.cast("double")
        return F.when(self.text.rlike(NUMERIC), F.regexp_replace(F.trim(self.text), "_", "").try_cast("double"))

    @property
    def boolean(self) -> Column:
        if self.is_boolean:
            return self.column
        if self.is_numeric:
            return F.when(self.column == 1, True).when(self.column == 0, False)
        word = F.lower(F.trim(self.text))
        return F.when(word.isin(*TRUE_WORDS, "1"), True).when(word.isin(*FALSE_WORDS, "0"), False)

    def equals(self, value) -> Column:
        if isinstance(value, bool):
            return self.boolean == F.lit(value)
        if self.is_boolean:
            as_bool = {1: True, 0: False}.get(value) if isinstance(value, (int, float)) else {**dict.fromkeys((*TRUE_WORDS, "1"), True), **dict.fromkeys((*FALSE_WORDS, "0"), False)}.get(str(value).strip().lower())
            return F.lit(False) if as_bool is None else self.column == F.lit(as_bool)
        if isinstance(value, (int, float)) and self.is_numeric:
            return F.abs(self.column.cast("double") - F.lit(float(value))) < 1e-9
        return F.lower(F.trim(self.text)) == F.lit(str(value).strip().lower())

    def ordered(self, op: str, value) -> Column:
        compare = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}[op]
        as_number = float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else float(value.strip().replace("_", "")) if isinstance(value, str) and re.match(NUMERIC, value) else None
        by_text = compare(self.text, F.lit(str(value)))
        if as_number is None:
            return by_text
        return F.when(self.number.isNotNull(), compare(self.number, F.lit(as_number))).otherwise(by_text)


def _absent() -> Fact:
    return Fact(F.lit(None).cast("string"), T.StringType())


def _holds(leaf: Leaf, fact: Fact) -> Column:
    c, args = fact.column, leaf.args
    if leaf.op == "is set":
        return c.isNotNull()
    if leaf.op == "is unset":
        return c.isNull()
    if leaf.op == "in":
        held = reduce(lambda a, b: a | b, [F.coalesce(fact.equals(v), F.lit(False)) for v in args])
    elif leaf.op == "between":
        numbers = [v for v in args if isinstance(v, (int, float)) and not isinstance(v, bool)]
        held = fact.number.between(*map(float, numbers)) if len(numbers) == 2 else F.lit(False)
    elif leaf.op == "~":
        held = F.lower(fact.text).rlike(glob_pattern(str(args[0]).lower()))
    elif leaf.op == "re":
        held = fact.text.rlike(java_pattern(args[0]))
    elif leaf.op == "contains":
        held = F.lower(fact.text).contains(str(args[0]).lower())
    elif leaf.op == "=":
        held = fact.equals(args[0])
    elif leaf.op == "!=":
        held = c.isNotNull() & ~F.coalesce(fact.equals(args[0]), F.lit(False))
    else:
        held = fact.ordered(leaf.op, args[0])
    return F.coalesce(held, F.lit(False))


def names(*facts: str) -> Column:
    return F.array(*map(F.lit, facts)).cast("array<string>")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _truth(node, facts: Mapping[str, Fact]) -> Column:
    if isinstance(node, Always):
        return F.lit(True)
    if isinstance(node, Leaf):
        return _holds(node, facts.get(node.fact) or _absent())
    if isinstance(node, Never):
        return ~_truth(node.part, facts)
    parts = [_truth(p, facts) for p in node.parts]
    return reduce(lambda a, b: a & b, parts) if isinstance(node, Both) else reduce(lambda a, b: a | b, parts)


def _outcome(node, facts: Mapping[str, Fact]) -> Column:
    """struct(held, on) of a condition; each part of it stands in the expression once."""
    pair = lambda held, on: F.struct(held.alias("held"), on.alias("on"))
    if isinstance(node, Always):
        return pair(F.lit(True), names())
    if isinstance(node, Leaf):
        fact = facts.get(node.fact) or _absent()
        return pair(_holds(node, fact), F.when(fact.column.isNotNull(), names(node.fact)).otherwise(names()))
    if isinstance(node, Never):
        return bind(_outcome(node.part, facts), lambda x: pair(~x["held"], x["on"]))
    parts = F.array(*[_outcome(p, facts) for p in node.parts])
    if isinstance(node, Both):
        go_on = lambda sofar, x: F.when(sofar["held"], pair(x["held"], F.array_union(sofar["on"], x["on"]))).otherwise(sofar)
    else:
        go_on = lambda sofar, x: F.when(sofar["held"], sofar).when(x["held"], x).otherwise(pair(F.lit(False), F.array_union(sofar["on"], x["on"])))
    return F.aggregate(parts, pair(F.lit(isinstance(node, Both)), names()), go_on)


def compile_condition(node, facts: Mapping[str, Fact]) -> tuple[Column, Column]:
    """(holds, rests_on): the truth of a condition, never null, and the facts present that decided it.

    A fact that isn't in ``facts`` is absent. A false ``and`` rests on its first false part and those
    before it; a true ``or`` on its first true part alone, a false one on all parts.
    Both expressions grow in proportion to the condition.
    """
    return _truth(node, facts), _outcome(node, facts)["on"]


def facts_of_frame(df) -> dict[str, Fact]:
    """Every column of a frame as a fact of its name."""
    return {f.name: Fact(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
