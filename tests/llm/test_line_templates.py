import re
from collections import defaultdict

from retailoom.llm import line_templates
from tests.llm.conftest import row, words


def brute(rows, lead=3, min_docs=10, constant=0.5):
    lines = []
    for r in {(r[0], r[1]) for r in rows}:
        for at, line in enumerate((r[1] or "").split("\n")):
            if ws := words(line):
                lines.append((r, at, tuple("<*>" if re.search("[0-9]", w) else w for w in ws)))
    leaf = lambda ws: (len(ws), ws[:lead])
    of_leaf, by_line, support = defaultdict(set), defaultdict(set), defaultdict(int)
    for doc, _, ws in lines:
        of_leaf[leaf(ws)].add(doc)
        by_line[ws].add(doc)
    for ws, held in by_line.items():
        for i, w in enumerate(ws):
            support[leaf(ws), i, w] += len(held)
    template = lambda ws: tuple(w if w != "<*>" and support[leaf(ws), i, w] >= min_docs else "<*>" for i, w in enumerate(ws))
    held = defaultdict(set)
    for doc, _, ws in lines:
        t = template(ws)
        if len(of_leaf[leaf(ws)]) >= min_docs and sum(w != "<*>" for w in t) >= constant * len(t):
            held[leaf(ws), t].add(doc)
    out = defaultdict(set)
    for doc, at, ws in lines:
        if len(held.get((leaf(ws), template(ws)), ())) >= min_docs:
            out[doc].add(at)
    return out


def with_logs(rows):
    logs = [row(900 + i, f"Posted by user{i} on 2020-01-{i:02d} in the forum\nOnly {'q' * (i + 1)} here\nthe menu of the {chr(97 + i)} site\nPosted by user1 on 3 in the forum") for i in range(25)]
    return rows + logs


def test_query_equals_brute_force(spark, docs, rows):
    both = with_logs(rows)
    want = brute(both)
    expected = []
    for r in both:
        gone = sorted(want.get((r[0], r[1]), ()))
        expected.append((r[0], sum(bool(words(x)) for x in (r[1] or "").split("\n")), len(gone), " ".join(map(str, gone))))
    got = [tuple(r) for r in line_templates.query(spark.createDataFrame(both, docs.schema)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert {r[0] for r in got if r[2]} >= set(range(900, 925))


def test_lines_are_dropped_from_the_texts(spark, docs, rows):
    both = with_logs(rows)
    left = line_templates.without_recurring(spark.createDataFrame(both, docs.schema))
    assert left.columns == docs.columns and left.count() == len(both)
    texts = {r[0]: r[1] for r in left.collect()}
    assert texts[905] == "Only qqqqqq here" and texts[400] == [r[1] for r in rows if r[0] == 400][0] and texts[500] is None


def test_a_full_filter_changes_nothing(spark, docs, rows):
    frame = spark.createDataFrame(with_logs(rows), docs.schema)
    counts = [sorted((r.h, r.template) for r in line_templates.recurring(frame, filter_bits=bits)[1].collect()) for bits in (6, 20)]
    assert counts[0] == counts[1] and counts[0]


def test_no_rows(no_docs):
    assert line_templates.query(no_docs).count() == 0
    assert line_templates.without_recurring(no_docs).count() == 0
