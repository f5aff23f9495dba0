import textwrap

from factloom.llm import licenses


def test_wrapped_templates_are_found(spark):
    rows, want = [], {}
    for k, (label, t) in enumerate(licenses.TEMPLATES):
        for width in (20, 40):
            wrapped = textwrap.wrap(t, width)
            for j, mark in enumerate(("", "# ", " * ")):
                i = 1000 * k + 10 * width + j
                rows.append((i, "some other words stand here\n" + "\n".join(mark + x for x in wrapped) + "\n\nand others behind"))
                want[i] = label
    every = {w for _, t in licenses.TEMPLATES for w in t.lower().split()}
    rows.append((-1, "\n".join(f"{w} " + "other words between " * 5 for w in sorted(every))))  # the words of all templates, but far from each other
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score == 1.0 for i, label in want.items())
    assert got[-1].labels == "" and got[-1].score == 0.0
