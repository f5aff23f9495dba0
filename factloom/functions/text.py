"""What a text says of itself: headings, readability, shape, and the words of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERHEAD, HEADING_WORDS, NUMBER_GAP = 500, 6, "·"
SPACES = r"(?U)\s+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda x: x != "")


def heading_of(text: Column) -> Column:
    """The first six words of the first 500 characters; other tokens between two words leave a mark."""
    window = tokens(F.left(text, F.lit(LETTERHEAD)))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("gap"))

    def step(acc, token):
        word = token.rlike(r"\p{L}{2,}")
        gap = F.when(acc["gap"] & (F.size(acc["kept"]) > 0), F.array(F.lit(NUMBER_GAP))).otherwise(F.array().cast("array<string>"))
        taken = F.struct(F.concat(acc["kept"], gap, F.array(token)).alias("kept"), (acc["n"] + 1).alias("n"), F.lit(False).alias("gap"))
        passed = F.struct(acc["kept"].alias("kept"), acc["n"].alias("n"), F.lit(True).alias("gap"))
        return F.when(acc["n"] >= HEADING_WORDS, acc).when(word, taken).otherwise(passed)

    return F.array_join(F.aggregate(window, start, step, lambda acc: acc["kept"]), " ")


def title_then_top(title: Column, top: Column) -> Column:
    """The title's first six words, then up to six of the top's that it doesn't say."""
    said = F.slice(tokens(title), 1, HEADING_WORDS)
    low = F.transform(said, F.lower)
    rest = F.slice(F.filter(tokens(top), lambda w: ~F.array_contains(low, F.lower(w))), 1, HEADING_WORDS)
    return F.when(F.coalesce(title, F.lit("")) == "", top).otherwise(F.array_join(F.concat(said, rest), " "))


def readable(text: Column) -> Column:
    """Eight words of three letters at least."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(\p{L}{3,})"), F.lit(1))) >= 8


# Text shapes in the order they are tried.
TEXT_SHAPES = (
    ("html", r"(?is)^\s*(<!doctype html|<html)"), ("svg", r"(?is)^\s*(<\?xml.*?)?<svg"), ("xml", r"(?s)^\s*<\?xml"), ("shell", r"^#!.*\b(ba|z|k)?sh\b"),
    ("python", r"^#!.*\bpython"), ("rtf", r"^\{\\rtf"), ("pem", r"^-----BEGIN "), ("calendar", r"^BEGIN:VCALENDAR"), ("contact", r"^BEGIN:VCARD"),
    ("email", r"(?m)\A(From|Received|Return-Path|Message-ID|Subject): .*\n"), ("diff", r"(?m)\A(diff --git|--- .*\n\+\+\+ )"), ("subtitle", r"\A\d+\r?\n\d\d:\d\d:\d\d[,.]\d{3} --> "),
)


def delimited(text: Column) -> Column:
    """The delimiter (comma, tab, semicolon in this order) that stands equally often on each of the first ten lines, two at least; else null."""
    lines = F.slice(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""), 1, 10)

    def evenly(mark: str) -> Column:
        counts = F.transform(lines, lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(mark), F.lit(""))))
        return (F.size(lines) >= 2) & (F.size(F.array_distinct(counts)) == 1) & (F.get(counts, F.lit(0)) > 0)

    return F.coalesce(*[F.when(evenly(m), m) for m in (",", "\t", ";")])


def sniff_text(text: Column) -> Column:
    """The shape of a text: a known form, JSON, delimited values, or plain."""
    head = F.left(text, F.lit(8192))
    shape = F.lit(None).cast("string")
    for name, pattern in reversed(TEXT_SHAPES):
        shape = F.when(head.rlike(pattern), name).otherwise(shape)
    json = head.rlike(r"(?s)^\s*[\[{]") & F.try_parse_json(text).isNotNull()
    return F.coalesce(shape, F.when(json, "json"), F.when(delimited(head).isNotNull(), "delimited"), F.lit("plain"))


# The entities that are undone; others stay as they are written.
ENTITIES = {"&nbsp;": "\xa0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def unescape(c: Column) -> Column:
    for name, value in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


def html_text(markup: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags gone, entities undone."""
    body = F.regexp_replace(markup, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    return unescape(F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " "))


def html_title(markup: Column) -> Column:
    """What a page's title says, else its first h1; tags gone, blanks collapsed, null without either."""
    inside = lambda tag: F.regexp_extract(markup, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    has = markup.rlike(r"(?is)<title[^>]*>.*?</title>")
    named = F.when(has, inside("title")).otherwise(inside("h1"))
    return F.nullif(F.trim(F.regexp_replace(unescape(F.regexp_replace(named, r"<[^>]+>", " ")), SPACES, " ")), F.lit(""))


def markdown_title(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^ {0,3}#\s+(.+?)\s*#*\s*$", 1)), F.lit(""))


def name_information(stem: Column) -> Column:
    """The share of a name's tokens that a person can use: neither digits nor hexadecimal with digits."""
    parts = F.regexp_extract_all(stem, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    useful = F.filter(parts, lambda x: ~x.rlike(r"^\d+$") & ~(x.rlike(r"(?i)^[0-9a-f]{4,}$") & x.rlike(r"\d")) & x.rlike(r"\p{L}"))
    return F.when(F.size(parts) == 0, 0.0).otherwise(F.size(useful) / F.size(parts))


def copy_marked(stem: Column) -> Column:
    return stem.rlike(r" ?\(\d{1,3}\)$")


def nearly(a: Column, b: Column) -> Column:
    """Letters and digits of one contain those of the other, three at least on both sides."""
    flat = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    x, y = flat(a), flat(b)
    return (F.char_length(x) >= 3) & (F.char_length(y) >= 3) & (x.contains(y) | y.contains(x))


def human_size(n: Column) -> Column:
    """Bytes in the largest unit of 1024 that leaves one whole, with a decimal above bytes; a tie goes to the even digit."""
    out = F.concat(F.format_string("%.0f", n.cast("double")), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", F.bround(n / float(1024**k), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out
