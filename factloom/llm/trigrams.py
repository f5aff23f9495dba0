"""What trigrams a regular expression's matches must hold: a Boolean condition, and its evaluation on posting lists.

The condition is built bottom up. Of each part of the expression are known: the
exact strings it matches, if these are few; else what its matches can begin and
end with, and a condition on trigrams in their inside. Joining two parts adds the trigrams across the seam. Where
nothing is known, the condition is that of any text, so it never loses a match.

All is in bytes of UTF-8 with A-Z as a-z, for expressions and texts alike.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exact strings and beginnings or ends that are kept of a part, and members of a set that are written out.
MOST_STRINGS, MOST_MEMBERS = 48, 8


@dataclass(frozen=True)
class Condition:
    """``all`` or ``any`` of trigrams and further conditions; all of none holds for any text."""

    kind: str
    of: frozenset

    def __bool__(self) -> bool:
        """Whether it asks for anything."""
        return self != ANY


ANY = Condition("all", frozenset())


def both(*conditions: Condition) -> Condition:
    of = frozenset().union(*(c.of if c.kind == "all" else [c] for c in conditions))
    if len(of) == 1 and isinstance(one := next(iter(of)), Condition):
        return one  # an alternative that stands alone
    return Condition("all", of)


def either(conditions: list[Condition]) -> Condition:
    if not all(conditions):
        return ANY
    if len(set(conditions)) == 1:
        return conditions[0]
    of = frozenset().union(*(c.of if c.kind == "any" else [c] for c in conditions))
    return Condition("any", frozenset(c for c in of if not any(x is not c and x.of < c.of for x in of)))  # A or (A and B) is A


def of_string(s: bytes) -> Condition:
    return Condition("all", frozenset(s[k:k + 3] for k in range(len(s) - 2)))


def of_strings(strings: frozenset[bytes]) -> Condition:
    return either([of_string(s) for s in strings])


@dataclass(frozen=True)
class Part:
    """What is known of a part of an expression; ``exact`` is None if its strings aren't."""

    exact: frozenset[bytes] | None
    begin: frozenset[bytes]
    end: frozenset[bytes]
    inside: Condition = ANY


NOTHING = frozenset([b""])
UNKNOWN, EMPTY = Part(None, NOTHING, NOTHING), Part(NOTHING, NOTHING, NOTHING)


def _short(part: Part) -> Part:
    """The same with less of it kept: what is dropped of strings is said in the condition first."""
    exact, begin, end, inside = part.exact, part.begin, part.end, part.inside
    if exact is not None and len(exact) > MOST_STRINGS:
        begin, end, inside, exact = exact, exact, both(inside, of_strings(exact)), None
    if exact is None:
        inside = both(inside, of_strings(begin), of_strings(end))
        begin, end = frozenset(s[:2] for s in begin), frozenset(s[-2:] for s in end)
        begin, end = (x if len(x) <= MOST_STRINGS else NOTHING for x in (begin, end))
    return replace(part, exact=exact, begin=begin, end=end, inside=inside)


def _cross(a: frozenset[bytes], b: frozenset[bytes]) -> frozenset[bytes]:
    return frozenset(x + y for x, y in product(a, b))


def _then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None:
        both_ = _cross(a.exact, b.exact)
        return _short(Part(both_, both_, both_, both(a.inside, b.inside)))
    seam = of_strings(_cross(a.end if a.exact is None else a.exact, b.begin if b.exact is None else b.exact))
    begin = a.begin if a.exact is None else _cross(a.exact, b.begin)
    end = b.end if b.exact is None else _cross(a.end, b.exact)
    return _short(Part(None, begin, end, both(a.inside, b.inside, seam)))


def _whole(part: Part) -> Condition:
    return both(part.inside, of_strings(part.exact)) if part.exact is not None else both(part.inside, of_strings(part.begin), of_strings(part.end))


def _or(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts):
        exact = frozenset().union(*(p.exact for p in parts))
        return _short(Part(exact, exact, exact, either([p.inside for p in parts])))
    begin, end = (frozenset().union(*(getattr(p, side) if p.exact is None else p.exact for p in parts)) for side in ("begin", "end"))
    return _short(Part(None, begin, end, either([_whole(p) for p in parts])))


def _literal(code: int) -> bytes:
    raw = chr(code).encode()
    return raw.lower() if raw.isascii() else raw


def _set(members: list) -> Part:
    found: set[bytes] = set()
    for kind, value in members:
        if kind is sre.LITERAL:
            found.add(_literal(value))
        elif kind is sre.RANGE and value[1] - value[0] < MOST_MEMBERS:
            found.update(_literal(c) for c in range(value[0], value[1] + 1))
        else:
            return UNKNOWN
    return Part(*[frozenset(found)] * 3) if len(found) <= MOST_MEMBERS else UNKNOWN


def _part(kind, value) -> Part:
    if kind is sre.LITERAL:
        return Part(*[frozenset([_literal(value)])] * 3)
    if kind is sre.IN:
        return _set(value)
    if kind is sre.SUBPATTERN:
        return _sequence(value[-1])
    if kind is sre.ATOMIC_GROUP:
        return _sequence(value)
    if kind is sre.BRANCH:
        return _or([_sequence(x) for x in value[1]])
    if kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return EMPTY
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = value
        one = _sequence(inner)
        if (least, most) == (0, 1):
            return _or([EMPTY, one])
        own = [one] * min(least, 3)
        return reduce(_then, own if least == most <= 3 else [*own, UNKNOWN], EMPTY)
    return UNKNOWN


def _sequence(items) -> Part:
    return reduce(_then, (_part(*x) for x in items), EMPTY)


def condition(pattern: str) -> Condition:
    """What a text must hold for the expression to match in it; ANY where no trigram is sure."""
    return _whole(_sequence(parser.parse(pattern)))


def trigrams_of(c: Condition) -> set[bytes]:
    return set().union(*(trigrams_of(x) if isinstance(x, Condition) else {x} for x in c.of))


def holds(c: Condition, present: set[bytes]) -> bool:
    """The condition on the trigrams of one text."""
    met = (holds(x, present) if isinstance(x, Condition) else x in present for x in c.of)
    return all(met) if c.kind == "all" else any(met)


def code(trigram: bytes) -> int:
    return int.from_bytes(trigram, "big")


def postings_of(c: Condition, postings: Column, every: Column) -> Column:
    """The condition on posting lists (a map from trigram codes to places): lists are intersected and united; ``every`` is the list of all places."""
    if not c:
        return every
    none = F.array().cast("array<int>")
    ordered = sorted(c.of, key=lambda x: (isinstance(x, Condition), str(x)))
    lists = [postings_of(x, postings, every) if isinstance(x, Condition) else F.coalesce(F.try_element_at(postings, F.lit(code(x))), none) for x in ordered]
    return reduce(F.array_intersect if c.kind == "all" else F.array_union, lists)
