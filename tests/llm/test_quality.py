import re
from collections import Counter, defaultdict

from retailoom.llm import quality
from tests.llm.conftest import row, words


def normal(line):
    return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower())).strip(" \t\n\x0b\x0c\r")


def brute(rows, min_docs=4, share=0.08, max_docs=6):
    hosts, held = defaultdict(set), defaultdict(set)
    for r in rows:
        hosts[r[3]].add(r[1] or "")
        for line in (r[1] or "").split("\n"):
            if words(line):
                held[r[3], normal(line)].add(r[1] or "")
    out = []
    for r in rows:
        ws, lines = words(r[1]), [x for x in (r[1] or "").split("\n") if words(x)]
        grams = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
        many = Counter(grams)
        repeated = len({p for i, g in enumerate(grams) if many[g] > 1 for p in range(i, i + 5)})
        gone = sum(len(words(x)) for x in lines if len(held[r[3], normal(x)]) > max(min_docs, min(share * len(hosts[r[3]]), max_docs)))
        failed = len(ws) < 10 or 100 * repeated > 20 * len(ws)
        out.append((r[0], len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in r[1] or ""), len(lines) - len(set(lines)), repeated,
                    failed, not failed and gone < 0.7 * len(ws), gone))
    return sorted(out, key=repr)


def boilerplate(rows):
    extra = [row(900 + i, "Page 1 of 2 # menu\n" + f"body {"q" * (i + 1)} words differ here and there so it is fine\nCopyright 20{i:02d} all rights kept by the owner") for i in range(30)]
    extra += [row(950 + i, f"Copyright 19{i:02d} all rights  kept by the owner\nsome {i}\nPAGE 7 of 9 # menu") for i in range(5)]
    return rows + extra


def test_query_equals_brute_force(spark, docs, rows):
    both = boilerplate(rows)
    got = sorted([tuple(r) for r in quality.query(spark.createDataFrame(both, docs.schema)).collect()], key=repr)
    assert got == brute(both)
    assert any(r[8] for r in got) and any(not r[6] and not r[7] for r in got)


def test_rules_take_effect(spark, docs, rows):
    both = boilerplate(rows)
    kept = quality.apply_rules(spark.createDataFrame(both, docs.schema))
    assert kept.columns == docs.columns
    out = kept.collect()
    assert sorted([repr(r[0]) for r in out]) == sorted(repr(r[0]) for r in brute(both) if r[7])
    texts = {r[0]: r[1] for r in out}
    assert texts[905] == "body qqqqqq words differ here and there so it is fine" and 951 not in texts
    assert all(r[4] == len(r[1]) for r in out)


def test_no_python_in_the_plan(docs):
    plan = quality.verdicts(docs)._jdf.queryExecution().toString() + quality.text_rules(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_no_rows(no_docs):
    assert quality.query(no_docs).count() == 0
    assert quality.apply_rules(no_docs).count() == 0


def test_the_limit_does_not_grow_with_the_host(spark, docs):
    many = [row(i, " ".join(f"own{'x' * (i + 1)}y{'z' * k}" for k in range(12)) + ("\nsubscribe to the list now" if i < 7 else "")
                + ("\nfour hold this line" if i < 4 else "")) for i in range(200)]
    passage = "\n".join(" ".join(f"{c}{d}" for d in "abcdefghi") for c in "pqrst")
    many += [row(300 + i, f"{passage}\nown tail {'z' * (i + 1)}") for i in range(7)]
    got = {r.doc_id: r for r in quality.query(spark.createDataFrame(many, docs.schema)).collect()}
    assert [got[i].n_removed_words for i in (0, 3, 6, 7)] == [5, 5, 5, 0] and got[0].kept  # 3 % of the host's texts
    assert all(got[300 + i].n_removed_words == 45 and not got[300 + i].base_failed and not got[300 + i].kept for i in range(7))
    texts = {r.doc_id: r.text for r in quality.apply_rules(spark.createDataFrame(many, docs.schema)).collect()}
    assert "subscribe" not in "".join(texts.values()) and "four hold this line" in texts[0] and 300 not in texts


def test_large_host_line_in_few_percent(spark, docs):
    """A 200-text host: a line in 7 of its texts (3.5 %) is over the limit, one in 6 stays."""
    # letters name the texts: digit runs count as one token, and would make these lines equal
    rows = [row(2000 + i, f"text {'ab'[i // 100]}{chr(97 + i // 10 % 10)}{chr(97 + i % 10)} of the big host with its own words here {'x' * (i % 9)}\n"
                + ("shared footer line of seven\n" if i < 7 else "") + ("line of six only\n" if 10 <= i < 16 else "")
                + f"and a last line {'ab'[i // 100]}{chr(97 + i // 10 % 10)}{chr(97 + i % 10)}", source="big") for i in range(200)]
    got = sorted([tuple(r) for r in quality.query(spark.createDataFrame(rows, docs.schema)).collect()], key=repr)
    assert got == brute(rows)
    removed = {r[0]: r[8] for r in got}
    assert all(removed[2000 + i] == 5 for i in range(7)) and all(removed[2000 + i] == 0 for i in range(7, 200))
