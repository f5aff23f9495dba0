import pytest
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.functions.language import LanguageError, compile_condition, facts_of, facts_of_frame, literal, parse
from factloom.operators.rules import Rule, RuleSet, load_rules

ROW = "select 'Image' kind, 65.0d duration, 5000L size, 'IMG_1.PNG' name, '07' code, true lossless, cast(null as string) gone, '2024-05-01 10:00:00' taken, 'yes' flag, '1_0' odd, '5d' unit"


def truth(spark, source):
    df = spark.sql(ROW)
    return df.select(compile_condition(parse(source), facts_of_frame(df))[0].alias("t")).first().t


@pytest.mark.parametrize("source, want", [
    ("", True), ("kind = image", True), ("kind != image", False), ("gone = 1", False), ("gone != 1", False), ("not gone = 1", True), ("not gone != 1", True), ("gone is unset", True),
    ("gone is set or kind is set", True), ("duration > 1m", True), ("duration between 60 and 66", True), ("size >= 4k", True), ("size < 4kb", False), ('name ~ "img_?.png"', True), ("name ~ IMG", False),
    ('name re "^IMG"', True), ('name matches "^img"', False), ("name contains g_1", True), ("lossless = yes", True), ('lossless = "on"', True), ("lossless = 1", True), ("lossless != no", True), ("flag = true", True),
    ("code = 7", False), ("code = 07", False), ("code <= 7", True), ("kind in video, IMAGE", True), ("kind = image and (size > 1mb or lossless = yes)", True), ("taken > 2024", True), ("odd > 9", True), ("unit > 3", True),
    ("unit between 1 and 9", False), ("kind between 1 and 2", False), ("nowhere is unset and not nowhere is set", True), ("a = 1 or kind = image and gone = 1", False),
])
def test_truth(spark, source, want):
    assert truth(spark, source) is want


@pytest.mark.parametrize("source", ["kind =", "kind image", "(kind = image", "kind = image)", "kind is maybe", "size > 3xx", "= 3", "kind between 1 or 2", 'name re "("', "and kind = 1"])
def test_errors(spark, source):
    with pytest.raises(LanguageError):
        truth(spark, source)


def test_literals_and_facts():
    assert (literal("1m"), literal("2mb"), literal("3s"), literal("1.5k"), literal("Yes"), literal("x1"), literal("7")) == (60, 2 << 20, 3, 1536, True, "x1", 7)
    assert facts_of(parse("a = 1 and not (b is set or a > 2)")) == ["a", "b"]


@pytest.mark.parametrize("source, want", [
    ("kind = image and size > 1", ["kind", "size"]), ("kind = video and size > 1", ["kind"]), ("kind = image or size > 1", ["kind"]), ("kind = video or size > 1", ["size"]),
    ("kind = video or size < 1", ["kind", "size"]), ("not kind = video", ["kind"]), ("gone is unset", []),
])
def test_what_an_answer_rests_on(spark, source, want):
    df = spark.sql(ROW)
    assert sorted(df.select(compile_condition(parse(source), facts_of_frame(df))[1].alias("u")).first().u) == want


@pytest.mark.parametrize("template, want", [
    ("/a/{kind:upper}/{taken:%Y-%m}", "/a/IMAGE/2024-05"), ("x/./{gone|none}", "x/none"), ("{size:08}", "00005000"), ("{gone}", None), ("{kind:%Y}", None), ("{name:title}", "Img_1.Png"), ("//", "/"),
])
def test_templates(spark, template, want):
    df = spark.sql(ROW)
    value, problem = paths.render(template, facts_of_frame(df))
    row = df.select(value.alias("v"), problem.alias("p")).first()
    assert (row.v.rstrip("/") or "/" if row.v else row.v) == want and (row.p is None) == (want is not None)


def test_hostile_components(spark):
    rows = spark.createDataFrame([("..",), ("a/b\\c",), (" con.txt ",), ("x" * 300 + ".jpeg",), ("",), ("a:*?b.  ",), ("tab\there",)], "v string")
    got = [r.s for r in rows.select(paths.sanitise(F.col("v")).alias("s")).collect()]
    assert got == ["_", "a-b-c", "_con.txt", "x" * 115 + ".jpeg", "_", "ab", "tabhere"]
    with pytest.raises(LanguageError):
        paths.render("a/../b", {})


def test_gates_in_order(spark):
    items = spark.sql("select 1 id, 3.0d age, 'n' name, 'v' value union all select 2, 7.0d, 'n', 'v' union all select 3, null, 'n', 'v' union all select 4, 1.0d, 'n', null")
    rules = RuleSet((Rule("young", "value is set", "/y", newer_than=7), Rule("old", "value is set", "/o", older_than=5), Rule("odd", into="/{missing}"), Rule("mac", into="/m", only_on=("macos",))))
    got = {r.id: (r.rule, r.destination, r.near_miss) for r in rules.decide(items, keep=("id",)).collect()}
    assert got == {1: ("young", "/y/n", None), 2: ("old", "/o/n", None), 3: (None, None, "young: not newer than 7 days"), 4: (None, None, "old: not older than 5 days")}


def test_rules_text():
    with pytest.raises(LanguageError):
        load_rules("[rule: a]\nwhen = x = 1\ninto = /a\nwen = 2")
    with pytest.raises(LanguageError):
        load_rules("[rule: a]\ninto = /a\n[rule: A]\ninto = /b")
    with pytest.raises(LanguageError):
        load_rules("[rule: a]\ninto = /a\nextract = name re (?P<name>.*)")
    rules = load_rules("[settings]\nx = 1\n[rule: a]\nwhen = x = 1\ninto = /a\nnewer_than = 2w\nstop = no")
    assert rules.rules[0].newer_than == 14 and rules.rules[0].stop is False and len(rules.digest) == 64
