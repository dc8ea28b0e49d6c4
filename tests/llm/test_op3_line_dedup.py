from collections import Counter, defaultdict

import pytest

from textloom.llm import op3_line_dedup as op


def brute(rows, ratio=0.1, least=2):
    pages, seen = Counter(), defaultdict(Counter)
    bare = lambda x: x.strip(" \t\r")
    for _, text, host in rows:
        pages[host or ""] += 1
        seen[host or ""].update({bare(x) for x in (text or "").split("\n")} - {""})
    out = []
    for k, text, host in rows:
        lines = [] if text is None else text.split("\n")
        bad = {x for x, n in seen[host or ""].items() if n >= least and n > ratio * pages[host or ""]}
        kept = [x for x in lines if bare(x) not in bad]
        out.append((k, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


ROWS = (
    [(i, f"Menu \n\n body {i}\nMenu\r\nfooter" + ("\nrare" if i % 30 == 0 else ""), "a") for i in range(60)]
    + [(100 + i, "Menu\nx", "b") for i in range(4)]
    + [(200 + i, f"Menu\nfooter {i}", None) for i in range(8)]
    + [(300, None, "a"), (301, "", "a"), (302, "\n", "a"), (303, "Menu", "c"), (1, "Menu\nsame", "a"), (1, "Menu\nsame", "a")]
    + [(400, "word " * 100000 + "\nMenu", "a"), (401, "Menu\n" * 5000, "a")]
)


@pytest.mark.parametrize("most", [0, 1000])
def test_brute_force(spark, most):
    df = spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, source string, lines_ int")
    got = [tuple(r) for r in op.clean_lines(df, broadcast_lines=most).collect()]
    assert sorted(got, key=repr) == brute(ROWS)


def test_hosts_of_few_pages(spark):
    rows = [(i, f"Menu\nown {i}", "b") for i in range(4)] + [(9, "Menu\nalone", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.clean_text) for r in op.clean_lines(df).collect()) == [(0, "own 0"), (1, "own 1"), (2, "own 2"), (3, "own 3"), (9, "Menu\nalone")]


@pytest.mark.parametrize("most", [0, 1000])
@pytest.mark.parametrize("name", ["host", "host_", "_host", "lines_", "_lines", "salt_", "_salt", "salt__", "here_", "n"])
def test_drop_boilerplate_keeps_columns(spark, name, most):
    df = spark.createDataFrame([(*r, len(r[1] or ""), "q") for r in ROWS], f"doc_id long, text string, source string, n_chars long, {name} string")
    out = op.drop_boilerplate(df, broadcast_lines=most)
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    rows = out.collect()
    assert sorted((r.doc_id, r.text) for r in rows if r.text is not None) == sorted((x[0], x[3]) for x in brute(ROWS) if x[3] is not None)
    assert all(r.n_chars == len(r.text or "") for r in rows) and len(rows) == len(ROWS)


def test_empty_table(spark):
    assert op.clean_lines(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_no_python_runs(spark, sf_dir):
    plan = op.op3_line_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
