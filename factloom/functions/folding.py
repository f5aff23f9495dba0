"""Words without case and accents, so that spellings of one word meet."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(word: str) -> str:
    """The rule: lower case, compatibility decomposition, no combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


@cache
def _tables() -> tuple[str, str, dict[str, str]]:
    """Letters and marks that folding changes to one character or none, and letters that it changes to several. Composed Hangul, whose parts aren't accents, stays."""
    one, none, several = {}, [], {}
    for k in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, min(sys.maxunicode, 0x2FA1E) + 1)):
        c = chr(k)
        if not unicodedata.category(c).startswith(("L", "M", "N")):
            continue
        f = fold(c)
        if f == "":
            none.append(c)
        elif f != c and len(f) == 1:
            one[c] = f
        elif f != c:
            several[c] = f
    return "".join([*one, *none]), "".join(one.values()), several


def folded(text: Column) -> Column:
    """As ``fold``; texts of ASCII alone are only lower-cased."""
    before, after, several = _tables()
    spread = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    low = F.lower(text)
    long = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(spread, c), c)), "")
    some = F.when(low.rlike("[" + "".join(several) + "]"), long).otherwise(low)
    return F.when(F.octet_length(text) == F.char_length(text), low).otherwise(F.translate(some, before, after))
