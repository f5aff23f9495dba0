"""What a collection's facts and names suggest, found by counting: facets, preferences, conventions, terms, phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.terms import heading_terms as heading_terms  # terms are found by counting, too

MIN_COVERAGE, MAX_GROUPS, MIN_CONCENTRATION, MIN_OCCURRENCES = 0.02, 600, 0.4, 3
MIN_SUPPORT, MIN_PRECISION = 3, 0.8


def long_facts(df: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """(key, fact, value): a row for each fact that is there, values as text."""
    pairs = F.array(*[F.struct(F.lit(f).alias("fact"), F.col(f).cast("string").alias("value")) for f in facts])
    return df.select(key, F.inline(pairs)).where(F.col("value").isNotNull() & (F.col("value") != ""))


def assess_facets(df: DataFrame, facets: dict[str, str]) -> DataFrame:
    """(facet, covered, groups, median, concentration, reason) of grouping by each fact; reason is null where the facet is worth it.

    ``facets``: name -> the fact grouped by. The value counts are one aggregation for all facets;
    median and concentration are over the counts, not the items.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    pairs = F.array(*[F.struct(F.lit(n).alias("facet"), F.col(f).cast("string").alias("value")) for n, f in facets.items()])
    counts = df.select(F.inline(pairs)).where(F.col("value").isNotNull() & (F.col("value") != "")).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("facet").agg(
        F.sum("n").alias("covered"), F.count(F.lit(1)).alias("groups"), F.percentile("n", F.lit(0.5)).alias("median"),
        (F.sum(F.when(F.col("n") >= MIN_OCCURRENCES, F.col("n")).otherwise(0)) / F.sum("n")).alias("concentration"),
    )
    known = df.sparkSession.createDataFrame(list(facets.items()), "facet string, fact string")
    joined = known.join(per, "facet", "left").crossJoin(F.broadcast(total))  # one row of one number
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = F.coalesce(F.col("concentration"), F.lit(0.0))
    coverage = zero("covered") / F.col("total")
    reason = (
        F.when(zero("groups") == 0, F.concat(F.lit("nothing has "), "fact"))
        .when(coverage < MIN_COVERAGE, F.format_string("only %.1f%% of items have %s", coverage * 100, F.col("fact")))
        .when(zero("groups") > MAX_GROUPS, F.format_string("would make %d folders", F.col("groups")))
        .when(share < MIN_CONCENTRATION, F.format_string("%.0f%% would be alone in a folder", (1 - share) * 100))
    )
    return joined.select("facet", zero("covered").alias("covered"), zero("groups").alias("groups"), F.coalesce("median", F.lit(0.0)).alias("median"), share.alias("concentration"), reason.alias("reason"))


def value_population(facts: DataFrame) -> DataFrame:
    """(fact, value, n) over long facts."""
    return facts.groupBy("fact", "value").agg(F.count(F.lit(1)).alias("n"))


def induce_preferences(placed: DataFrame, among: DataFrame | None = None, min_support: int = MIN_SUPPORT, min_precision: float = MIN_PRECISION) -> DataFrame:
    """(folder, fact, value, support, precision): per folder the fact that best foretells it; ties by fact and value.

    ``placed``: long facts with the folder each item was put in; ``among``: the population to be precise against (default: placed).
    """
    support = placed.groupBy("fact", "value", "folder").agg(F.count(F.lit(1)).alias("support"))
    own = support.groupBy("fact", "value").agg(F.sum("support").alias("n"))
    if among is not None:
        everywhere = among.select("fact", "value", F.col("n").alias("m"))
        own = own.join(everywhere, ["fact", "value"], "left").select("fact", "value", F.coalesce("m", "n").alias("n"))
    found = support.where(F.col("support") >= min_support).join(own, ["fact", "value"]).withColumn("precision", F.col("support") / F.col("n")).where(F.col("precision") >= min_precision)
    best = W.partitionBy("folder").orderBy(F.desc("support"), F.desc("precision"), "fact", "value")
    return found.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("folder", "fact", "value", "support", "precision")


SEPARATORS = r"[.…_ ]"


def field_class(text: Column) -> Column:
    """The coarse class of a field of a name."""
    n = F.char_length(text).cast("string")
    return (
        F.when(text == "", "empty").when(text.rlike(r"^\p{Nd}+$"), F.concat(F.lit("num"), n))
        .when(text.rlike(r"(?i)^[0-9a-f]+$") & F.char_length(text).isin(32, 40, 64), F.concat(F.lit("hex"), n))
        .when(text.rlike(r"\p{L}"), "word").otherwise("other")
    )


def name_fields(stem: Column, fields: int) -> Column:
    """array<struct<separator, text>>: the first fields of a name, and the rest as its tail."""
    texts = F.split(stem, SEPARATORS, fields + 1)
    marks = F.regexp_extract_all(stem, F.lit(f"({SEPARATORS})"), F.lit(1))
    return F.transform(texts, lambda t, i: F.struct(F.coalesce(F.get(marks, i - 1), F.lit("")).alias("separator"), t.alias("text")))


def signature(stem: Column, fields: int) -> Column:
    """The shape of a name's start: separators and classes; the tail is never classed, as titles vary."""
    parts = name_fields(stem, fields)
    last = F.size(parts) - 1
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p["separator"], F.lit("<"), F.when(i == last, F.lit("tail")).otherwise(field_class(p["text"])), F.lit(">"))), "")


def signature_clusters(names: DataFrame, stem_col: str, fields: int, at_least: int = MIN_OCCURRENCES) -> DataFrame:
    """(signature, n, example) of shapes that several names share; the example is the smallest name."""
    return names.groupBy(signature(F.col(stem_col), fields).alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.min(stem_col).alias("example")).where(F.col("n") >= at_least)


def convention_category(names: DataFrame, stem_col: str, fields: int) -> DataFrame:
    """(signature, field, n, distinct, concentration): per shape the word field with the lowest ratio of distinct values, if concentrated."""
    parts = names.select(signature(F.col(stem_col), fields).alias("signature"), F.posexplode(name_fields(F.col(stem_col), fields)).alias("field", "p"), F.size(name_fields(F.col(stem_col), fields)).alias("_n"))
    words = parts.where((F.col("field") < F.col("_n") - 1) & (field_class(F.col("p.text")) == "word")).groupBy("signature", "field", F.lower("p.text").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    per = words.groupBy("signature", "field").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct"), (F.sum(F.when(F.col("c") >= MIN_OCCURRENCES, F.col("c")).otherwise(0)) / F.sum("c")).alias("concentration")
    ).where((F.col("concentration") >= MIN_CONCENTRATION) & (F.col("n") >= MIN_OCCURRENCES))
    first = W.partitionBy("signature").orderBy(F.col("distinct") / F.col("n"), "field")
    return per.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


MIN_VALUES, MAX_RATIO, MIN_LENGTH, MIN_LETTERS = 3, 0.6, 3, 0.5
#: A shape that software made has a checksum or a long number in it.
MACHINE_MADE = r"<hex\d+>|<num(?:[6-9]|\d{2,})>"


def best_conventions(names: DataFrame, stem_col: str, depths: tuple[int, ...] = (2, 3, 4), at_least: int = MIN_OCCURRENCES) -> DataFrame:
    """(depth, signature, n, field, groups, concentration): the naming conventions at the depth that explains most names, of equal ones the shallowest.

    A convention is a shape that software makes, shared by enough names, with a field that repeats and looks like a name: of such fields that with the
    fewest values for its names, the first of equals, if enough names share their value. The shapes of all depths are counted in one
    pass. A field's letters and mean length are over all its values. Null and empty names count for nothing.
    """
    stem = F.col(stem_col)
    shapes = F.array(*[F.struct(F.lit(d).alias("depth"), signature(stem, d).alias("signature"), name_fields(stem, d).alias("parts")) for d in depths])
    each = names.where(F.coalesce(stem, F.lit("")) != "").select(F.inline(shapes)).where(F.col("signature").rlike(MACHINE_MADE))
    fields = each.select("depth", "signature", F.posexplode(F.slice("parts", F.lit(1), F.size("parts") - 1)).alias("field", "part")).groupBy("depth", "signature", "field", F.col("part.text").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    length, letters = F.char_length("value"), F.regexp_count(F.col("value"), F.lit(r"\p{L}"))
    per = fields.groupBy("depth", "signature", "field").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("groups"), (F.sum(F.when(F.col("c") >= MIN_OCCURRENCES, F.col("c")).otherwise(0)) / F.sum("c")).alias("concentration"),
        F.avg(length).alias("_length"), (F.sum(letters) / F.greatest(F.sum(length), F.lit(1))).alias("_letters"), F.min(field_class(F.col("value"))).alias("_class"),
    )
    category = (
        (F.col("n") >= at_least) & F.col("groups").between(MIN_VALUES, F.col("n") - 1) & (F.col("groups") / F.col("n") <= MAX_RATIO)
        & ~F.col("_class").rlike("^(num|hex)") & (F.col("_length") >= MIN_LENGTH) & (F.col("_letters") >= MIN_LETTERS)
    )
    chosen = F.struct(F.col("groups") / F.col("n"), "field", "n", "groups", "concentration")
    best = per.where(category).groupBy("depth", "signature").agg(F.min(chosen).alias("_b")).select("depth", "signature", "_b.n", "_b.field", "_b.groups", "_b.concentration")
    conventions = best.where(F.col("concentration") >= MIN_CONCENTRATION)
    score = conventions.groupBy("depth").agg(F.sum("n").alias("score"))
    first = score.agg(F.min(F.struct(-F.col("score"), F.col("depth").alias("depth")))["depth"].alias("depth"))  # one row
    return conventions.join(F.broadcast(first), "depth")


def shared_phrases(headings: DataFrame, key: str, heading_col: str, word: str, least_share: float = 0.9, longest: int = 6) -> DataFrame:
    """(phrase, documents): the longest runs of up to six tokens around a word that nearly all headings with it share, three at least."""
    having = headings.select(key, F.split(F.lower(heading_col), r"(?U)\s+").alias("t")).where(F.array_contains("t", word))
    total = having.agg(F.count(F.lit(1)).alias("total"))
    parts = int(headings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = having.where(F.col(key).isNotNull()).repartition(parts, key).groupBy(key).agg(F.collect_set("t").alias("ts"))  # one row a key, before there are more
    bar = F.ceil(least_share * F.col("total"))
    words = per.select(F.explode(F.array_distinct(F.flatten("ts"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))
    common = words.where(F.col("n") >= bar).agg(F.collect_list("w").alias("common"))  # no run is in more documents than each of its words; few can be in so many
    runs = lambda t, n: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.slice(t, i, n))).otherwise(F.array().cast("array<array<string>>"))
    all_runs = F.array_distinct(F.flatten(F.transform("ts", lambda t: F.flatten(F.transform(F.sequence(F.lit(2), F.lit(longest)), lambda n: runs(t, n))))))
    able = F.filter(all_runs, lambda g: F.array_contains(g, word) & (F.size(F.array_except(g, F.col("common"))) == 0))
    grams = per.crossJoin(F.broadcast(common)).select(F.explode(able).alias("g"))
    said = grams.groupBy("g").agg(F.count(F.lit(1)).alias("documents")).withColumn("n", F.size("g")).crossJoin(F.broadcast(total))
    enough = said.where((F.col("documents") >= bar) & (F.col("documents") >= 3))
    longest_n = enough.agg(F.max("n").alias("n"))
    return enough.join(F.broadcast(longest_n), "n").select(F.array_join("g", " ").alias("phrase"), "documents")
