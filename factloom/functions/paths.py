"""Names and destinations: components made safe for any file system, templates filled from facts."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.language import Fact, LanguageError, bind

LIMIT, KEPT_EXTENSION = 120, 8
# Names that one system or another keeps for itself.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{k}" for k in range(1, 10)), *(f"lpt{k}" for k in range(1, 10)))


def sanitise(c: Column) -> Column:
    """A text as one path component: separators to -, illegal characters gone, blanks collapsed, length bounded, never empty.

    Texts are taken as they are normalised; Spark has no function for composed forms.
    """
    c = F.regexp_replace(F.regexp_replace(c, r"[/\\]", "-"), r'[<>:"|?*\x00-\x1f\x7f]', "")
    c = F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), r"[. ]+$", "")
    c = bind(c, lambda x: F.when(F.lower(F.substring_index(x, ".", 1)).isin(*RESERVED), F.concat(F.lit("_"), x)).otherwise(x))

    def shortened(x: Column) -> Column:
        cut = lambda end: F.concat(F.regexp_replace(F.left(x, F.lit(LIMIT) - F.char_length(end)), r"[. ]+$", ""), end)
        return bind(F.regexp_extract(x, rf"(\.[^.]{{0,{KEPT_EXTENSION}}})$", 1), cut)

    return bind(c, lambda x: F.when(F.char_length(x) > LIMIT, shortened(x)).when(x == "", "_").otherwise(x))


def title_case(c: Column) -> Column:
    """Every run of letters capitalised, whatever stands before it."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, F.lit(2), F.char_length(x))))), "")


# Date codes of strftime and their Spark patterns.
DATE_CODES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "p": "a", "I": "hh"}


def spark_date_pattern(codes: str) -> str:
    """A strftime format as a pattern of date_format; other text is quoted."""
    out = []
    for code, text in re.findall(r"%(.)|([^%]+)", codes):
        if text:
            out.append("'" + text.replace("'", "''") + "'")
        elif code == "%":
            out.append("'%'")
        elif code in DATE_CODES:
            out.append(DATE_CODES[code])
        else:
            raise LanguageError(f"unknown date code %{code}")
    return "".join(out)


def as_moment(c: Column) -> Column:
    """A date or time that the text begins with, else null."""
    text = F.regexp_replace(c.cast("string"), r"^(\d{4})[:.](\d{2})[:.](\d{2})", "$1-$2-$3")
    return F.coalesce(F.try_to_timestamp(F.left(text, F.lit(19)), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.left(text, F.lit(10)), F.lit("yyyy-MM-dd")))


_TOKEN = re.compile(r"\{([^{}]*)\}")


def template_facts(template: str | None) -> list[str]:
    return list(dict.fromkeys(re.split("[:|]", t)[0].strip() for t in _TOKEN.findall(template or "")))


def _token(spec: str, facts: Mapping[str, Fact]) -> tuple[Column, Column]:
    """(value, problem) of one token; problem says why there is no value."""
    left, bar, fallback = spec.partition("|")
    name, colon, style = left.partition(":")
    name, style = name.strip(), style.strip()
    if not name:
        raise LanguageError("empty template token")
    fact = facts.get(name)
    held = F.nullif(fact.text, F.lit("")) if fact else F.lit(None).cast("string")
    value = F.coalesce(held, F.lit(fallback)) if bar else held
    missing = F.when(value.isNull(), F.lit(f"destination needs missing fact '{name}'"))
    if not colon:
        return value, missing
    if style in ("upper", "lower", "title"):
        shown = {"upper": F.upper, "lower": F.lower, "title": title_case}[style](value)
    elif "%" in style:
        dated = fact is not None and not bar and isinstance(fact.kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
        shown = F.date_format(fact.column if dated else as_moment(value), spark_date_pattern(style))
    elif m := re.fullmatch(r"0?(\d+)d?", style):
        digits = F.when(value.rlike(r"^\d+$"), F.lpad(value, F.greatest(F.lit(int(m[1])), F.char_length(value)), "0" if style[0] == "0" else " "))
        shown = digits if fact is not None and fact.is_numeric else F.lit(None).cast("string")
    else:
        raise LanguageError(f"unknown format {style!r}")
    return shown, F.coalesce(missing, F.when(shown.isNull(), F.concat(F.lit(f"destination: cannot format {name}="), value)))


def render(template: str, facts: Mapping[str, Fact]) -> tuple[Column, Column]:
    """(path, problem): the template filled in, each component sanitised after its tokens; path is null where a problem isn't.

    ``.`` is dropped and ``..`` refused in the template itself; from a fact they are made harmless like anything else.
    """
    parts, problems = [], []
    for component in filter(None, re.split(r"[/\\]+", template)):
        if component == ".":
            continue
        if component == "..":
            raise LanguageError(f"a destination cannot contain '..': {template!r}")
        pieces = []
        for i, piece in enumerate(_TOKEN.split(component)):
            if i % 2:
                value, problem = _token(piece, facts)
                problems.append(problem)
                pieces.append(value)
            elif piece:
                pieces.append(F.lit(piece))
        parts.append(sanitise(F.concat(*pieces)))
    path = reduce(lambda a, b: F.concat(a, F.lit("/"), b), parts) if parts else F.lit("" if template.startswith("/") else "_")
    if template.startswith("/"):
        path = F.concat(F.lit("/"), path)
    problem = F.coalesce(*problems) if problems else F.lit(None).cast("string")
    return F.when(problem.isNull(), path), problem
