"""The words that documents lead with: which of them name a category, by counting, and which only come along with another.

Everything is counted in one pass over the words and one over pairs of words of a heading. Headings are a few words long, so the pairs are few.
What a word's documents share with another's is a set overlap, found by joining surviving words on
the document: only pairs that meet in one are counted. The elimination goes by
rank, each word's fate resting on earlier ones it shares documents with; words are decided in
rounds, each as soon as what is still open can't change it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.folding import fold, folded
from factloom.state import cut

# The bars of counting, what a word and an address are, and how often letters and digits change places in a generated token.
MIN_OCCURRENCES, MIN_TERMS, MAX_SHARE, OWNER_SHARE = 3, 3, 0.6, 0.1
FRONT, CAP = 3, 40
#: A word is another's template if at most so much of its documents lack the other; it is no category of its own if it shares so much with two.
LACKING, SHARED = 1 - 0.9, 0.25
WORD = r"[\p{L}\p{Nl}\p{No}]{3,}"
ADDRESS = r"(?U)(?<!-)[/\\]|@|\w\.\w+\.\w"
SWITCH = r"(?<=\p{Nd})(?=\p{L})|(?<=\p{L})(?=\p{Nd})"
SWITCHES = 3


def words_of(heading: Column) -> Column:
    return F.regexp_extract_all(heading, F.lit(f"({WORD})"), F.lit(1))


def standing_words(heading: Column) -> Column:
    """The words of a heading outside addresses, paths and generated tokens."""
    chunks = F.filter(F.split(heading, r"(?U)\s+"), lambda c: ~c.rlike(ADDRESS))
    parts = F.flatten(F.transform(chunks, lambda c: F.split(c, r"[_.\-]+")))
    return F.flatten(F.transform(F.filter(parts, lambda p: F.regexp_count(p, F.lit(SWITCH)) < SWITCHES), words_of))


def is_a_word(word: Column) -> Column:
    """Not numbers or signs, and in Latin script not of accented letters alone, which are glyph numbers read as text."""
    count = lambda p: F.regexp_count(word, F.lit(p))
    latin = count(r"\p{IsLatin}") >= 0.8 * count(r"\p{L}")
    return ~word.rlike(r"\p{No}") & word.rlike(r"\p{L}") & (~latin | word.rlike("[A-Za-z]"))


def _spelling_order(word: Column, n: Column) -> Column:
    """The commonest spelling first, of equally common ones that in title case, then one that isn't all capitals."""
    low = F.lower(word)
    title = (word == F.concat(F.upper(F.left(word, F.lit(1))), F.substring(low, 2, 1 << 20))) & (word != low)
    return F.struct(-n, ~title, (word == F.upper(word)) & (word != low), word)


def term_counts(headings: DataFrame, key: str, heading_col: str) -> DataFrame:
    """(term, documents, bare, middle, position, spelling, titled): every word's counts over all headings.

    ``bare`` counts documents in which the word stands outside addresses; ``middle`` is the upper median of its
    first places, ``position`` their mean; ``titled`` tells whether most of its occurrences have a capital.
    """
    said = headings.select(key, words_of(F.col(heading_col)).alias("_words"), F.transform(standing_words(F.col(heading_col)), folded).alias("_standing"))
    each = said.select(key, F.posexplode("_words").alias("at", "word"), "_standing").withColumn("term", folded(F.col("word")))
    firsts = each.groupBy(key, "term").agg(F.min("at").alias("at"), F.max(F.array_contains("_standing", F.col("term"))).alias("bare"))
    places = firsts.groupBy("term", "at").agg(F.count(F.lit(1)).alias("n"), F.count_if("bare").alias("bare"))
    listed = F.sort_array(F.collect_list(F.struct("at", "n")))  # an entry for each place in a heading
    counted = places.groupBy("term").agg(F.sum("n").alias("documents"), F.sum("bare").alias("bare"), F.sum(F.col("at") * F.col("n")).alias("_sum"), listed.alias("_places"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("middle"))
    step = lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.when(acc["middle"].isNull() & (acc["seen"] + x["n"] > F.floor(F.col("documents") / 2)), x["at"]).otherwise(acc["middle"]).alias("middle"))
    middle = F.aggregate("_places", start, step, lambda acc: acc["middle"])
    counted = counted.select("term", "documents", "bare", middle.alias("middle"), (F.col("_sum") / F.col("documents")).alias("position"))
    spelled = each.groupBy("term", "word").agg(F.count(F.lit(1)).alias("n"))
    capital = F.sum(F.when(F.col("word").rlike(r"\p{Lu}"), F.col("n")).otherwise(0)) * 2 > F.sum("n")
    caseless = F.lower(F.min("word")) == F.upper(F.min("word"))
    spelling = spelled.groupBy("term").agg(F.min_by("word", _spelling_order(F.col("word"), F.col("n"))).alias("spelling"), (capital | caseless).alias("titled"))
    return counted.join(spelling, "term")


def overlaps(members: DataFrame, item: str, of: str) -> DataFrame:
    """(a, b, both): for items a, b that share any ``of``, in how many; each pair both ways round. ``members`` has each (item, of) once.

    The self-join is on ``of``, so it makes the squares of their numbers of items: for few items each.
    """
    one, other = members.select(F.col(of).alias("_of"), F.col(item).alias("a")), members.select(F.col(of).alias("_of"), F.col(item).alias("b"))
    return one.join(other, "_of").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))


def without_templates(terms: DataFrame, members: DataFrame) -> DataFrame:
    """The terms that stand for themselves, of (term, documents, middle, position); ``members`` are their (term, document).

    First a term yields to a wider one that heads nearly all its documents and stands as far to the front. Then, in the order
    of position, a term goes if an earlier one that stays heads nearly all its documents, or two of them a quarter each.
    """
    rank = F.struct("position", -F.col("documents"), "term").alias("rank")
    of = lambda side: terms.select(F.col("term").alias(side), F.struct(F.col("documents").alias("n"), "middle", rank).alias(f"_{side}"))
    pairs = cut(overlaps(members, "term", "document").join(of("a"), "a").join(of("b"), "b"))  # a's documents against b's
    lacking = F.col("_a.n") - F.col("both") <= F.lit(LACKING) * F.col("_a.n")
    yields = pairs.where((F.col("_b.n") > F.col("_a.n")) & lacking & (F.col("_b.middle") <= F.col("_a.middle"))).select(F.col("a").alias("term")).distinct()
    left = cut(terms.join(yields, "term", "left_anti"))
    earlier = pairs.where((F.col("_b.rank") < F.col("_a.rank")) & (F.col("both") >= SHARED * F.col("_a.n"))).select(F.col("a").alias("term"), F.col("b").alias("earlier"), lacking.alias("covers"))
    alive = left.select("term")
    open_ = cut(earlier.join(alive, "term", "left_semi").join(alive.withColumnRenamed("term", "earlier"), "earlier", "left_semi"))
    fate = cut(alive.join(open_.select("term").distinct(), "term", "left_anti").select("term", F.lit(True).alias("kept")))
    n = open_.count()
    while n:
        told = open_.join(fate.select(F.col("term").alias("earlier"), "kept"), "earlier", "left")
        stands, waits = F.col("kept"), F.col("kept").isNull()
        seen = told.groupBy("term").agg(
            (F.max(F.coalesce(stands & F.col("covers"), F.lit(False))) | (F.count_if(stands) >= 2)).alias("goes"),
            (F.max(waits & F.col("covers")) | (F.count_if(stands) + F.count_if(waits) >= 2)).alias("may_go"),
        )
        new = cut(seen.where(F.col("goes") | ~F.col("may_go")).select("term", (~F.col("goes")).alias("kept")))
        fate = cut(fate.unionByName(new))
        open_ = cut(open_.join(new.select("term"), "term", "left_anti"))
        n = open_.count()
    return left.join(fate.where("kept").select("term"), "term", "left_semi")


def heading_terms(headings: DataFrame, key: str, heading_col: str, min_occurrences: int = MIN_OCCURRENCES, max_share: float = MAX_SHARE, cap: int = CAP,
                  owner: Sequence[str] = (), owner_share: float = OWNER_SHARE, person: Sequence[str] = (), titled: bool = True, min_terms: int = MIN_TERMS) -> DataFrame:
    """(term, documents, position): the words that enough headings lead with to be categories, those that stand first first; at most ``cap``.

    A term is in enough headings and not in too many (``owner``'s names: far fewer; a ``person``'s: none), often enough outside an address, usually
    near the front, a word, and with ``titled`` mostly written with a capital. Fewer than ``min_terms`` of
    them are none. Boilerplate goes (``without_templates``). Null and empty headings don't count; ``key`` tells headings apart.
    """
    some = cut(headings.select(F.col(key).alias("document"), F.col(heading_col).alias("heading")).where(F.coalesce("heading", F.lit("")) != ""))  # headings are made of texts, once
    total = some.agg(F.count(F.lit(1)).alias("total"))
    least = F.lit(min_occurrences)
    ceiling = F.greatest(least.cast("double"), F.col("total") * max_share)
    if owner:
        own = F.greatest(least.cast("double"), F.col("total") * owner_share) if owner_share > 0 else F.lit(-1.0)
        ceiling = F.when(F.col("term").isin(*map(fold, owner)), own).otherwise(ceiling)
    fits = (F.col("bare") >= least) & (F.col("documents") >= least) & (F.col("documents") <= ceiling) & (F.col("middle") < FRONT) & is_a_word(F.col("spelling"))
    if person:
        fits = fits & ~F.col("term").isin(*map(fold, person))
    if titled:
        fits = fits & F.col("titled")
    terms = cut(term_counts(some, "document", "heading").crossJoin(F.broadcast(total)).where(fits).drop("total"))  # one row of one number
    if terms.count() < min_terms:
        return terms.select(F.col("spelling").alias("term"), "documents", "position").limit(0)
    members = some.select("document", F.explode(F.array_distinct(F.transform(words_of(F.col("heading")), folded))).alias("term"))
    kept = without_templates(terms, members.join(terms.select("term"), "term", "left_semi"))
    return kept.orderBy("position", F.desc("documents"), "term").limit(cap).select(F.col("spelling").alias("term"), "documents", "position")
