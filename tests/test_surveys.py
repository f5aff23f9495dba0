import random

import pytest

from factloom.operators import induction, scans, surveys

IMAGES = ("id long, width int, height int, x_resolution double, y_resolution double, resolution_unit int, make string, model string, software string, "
          "exposure_time string, aperture string, iso string, focal_length string, lens string")


def image(i, w, h, dpi, **tags):
    given = {"y_resolution": dpi, "resolution_unit": 2} | tags
    return (i, w, h, dpi, *(given.get(c.split()[0]) for c in IMAGES.split(", ")[4:]))


def test_scans(spark):
    a4 = (2480, 3508)
    rows = [
        image(1, *a4, 300.0), image(2, *a4[::-1], 300.0, y_resolution=None), image(3, *a4, 300.0, iso="200"), image(4, *a4, 72.0), image(5, *a4, 300.0, software="Adobe Photoshop"),
        image(6, *a4, 300.0, software="GIMP", make="CanoScan"), image(7, *a4, 118.11, resolution_unit=3), image(8, *a4, 300.0, resolution_unit=1), image(9, 1200, 1800, 300.0), image(10, 1200, 1800, 300.0, model="Perfection V39"),
        image(11, 10, 10, 72.0, software="vuescan"), image(12, *a4, 300.0, y_resolution=310.0), image(13, None, 5, 300.0), image(14, 0, 0, 300.0, make="scanner"), image(15, 2480 + 36, 3508 - 36, 300.0), image(16, 2480 + 37, 3508, 300.0), image(1, *a4, 300.0),
        image(None, 2550, 3300, 300.2),
    ]
    got = sorted((tuple(r) for r in scans.detect_scans(spark.createDataFrame(rows, IMAGES), "id").collect()), key=str)
    want = [(1, "page", "A4", 300, "dimensions")] * 2 + [(2, "page", "A4", 300, "dimensions"), (6, "page", "A4", 300, "exif"), (7, "page", "A4", 300, "dimensions"), (10, "print", "4x6", 300, "exif"), (11, "page", None, None, "exif"),
                                                         (14, "page", None, None, "exif"), (15, "page", "A4", 300, "dimensions"), (None, "page", "Letter", 300, "dimensions")]
    assert got == sorted(want, key=str)


def test_near_join_equals_all_pairs(spark):
    rng = random.Random(1)
    left = [(i, rng.choice([None, rng.uniform(-3, 3)]) if i % 9 == 0 else rng.uniform(-3, 3), round(rng.uniform(-3, 3), 1)) for i in range(300)]
    right = [(i, rng.uniform(-3, 3), round(rng.uniform(-3, 3), 1)) for i in range(60)] + [(99, None, 0.0)]
    got = scans.near_join(spark.createDataFrame(left, "i long, a double, b double"), spark.createDataFrame(right, "j long, c double, d double"), {"a": "c", "b": "d"}, 0.2)
    want = sorted((i, j) for i, a, b in left for j, c, d in right if a is not None and c is not None and abs(a - c) <= 0.2 and abs(b - d) <= 0.2)
    assert sorted((r.i, r.j) for r in got.collect()) == want and len(want) > 50


@pytest.mark.parametrize("cap", [1, 5, 40])
def test_a_cap_is_met_as_by_one_reader(spark, cap):
    rng = random.Random(cap)
    facts, at = [], 0
    for at in range(400):
        for fact, values in (("few", cap), ("just", cap), ("over", cap + 1), ("many", 10 * cap), ("long", 3)):
            if fact == "just" and at >= cap:
                continue
            value = str(at if fact == "just" else rng.randrange(values))
            facts.append((fact, "x" * 130 + value if fact == "long" else None if rng.random() < 0.05 and fact != "just" else value, at))
    known, over, n = {}, {}, {}
    for fact, value, at in facts:
        if value is None:
            continue
        n[fact] = n.get(fact, 0) + 1
        own = known.setdefault(fact, {})
        if len(own) >= cap:
            over[fact] = True
        own.setdefault(value[:120], at)
    got = {r.fact: tuple(r)[1:] for r in surveys.capped_facts(spark.createDataFrame(facts, "fact string, value string, at long"), cap).collect()}
    assert got == {f: (n[f], len(v), over.get(f, False), sorted(v.values())[cap - 1] if len(v) >= cap else None) for f, v in known.items()}
    assert got["just"][2] is False  # its last value comes with its last item
    values = surveys.capped_values(spark.createDataFrame(facts, "fact string, value string, at long"), cap).collect()
    assert {r.fact for r in values} == {f for f in known if not over.get(f)}


def test_conventions_at_the_depth_that_explains_most(spark):
    rng = random.Random(3)
    names = [f"{10**7 + k}.{rng.choice(['flaich', 'codyblue', 'multyashka', 'anna'])}_{rng.choice(['a', 'the'])} {k} title" for k in range(40)]
    alone = [f"img {rng.randrange(10**7, 10**8)}.{k} {rng.choice(['red', 'green', 'blue'])} x" for k in range(12)]  # only depth 4 sees the colour
    names += ["My own words here", "more words", "", None, "Invoice 2019 may"] + [f"song {k} of mine" for k in range(9)]
    got = {(r.depth, r.signature): (r.n, r.field, r.groups) for r in induction.best_conventions(spark.createDataFrame([(n,) for n in names], "stem string"), "stem").collect()}
    assert got == {(2, "<num8>.<word>_<tail>"): (40, 1, 4)}
    both = [tuple(r)[:5] for r in induction.best_conventions(spark.createDataFrame([(n,) for n in names + alone], "stem string"), "stem").collect()]
    assert {r[0] for r in both} == {4} and len(both) == 3  # four fields explain the most of these together
    got = [tuple(r)[:5] for r in induction.best_conventions(spark.createDataFrame([(n,) for n in alone], "stem string"), "stem").collect()]
    assert all(depth == 4 and field == 3 and groups == 3 for depth, _, _, field, groups in got)
    assert induction.best_conventions(spark.createDataFrame([], "stem string"), "stem").count() == 0
