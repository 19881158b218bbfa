"""Spelling variants against a brute force over all pairs of words."""

import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from retailoom.llm import spelling
from tests.llm.conftest import SCHEMA, row

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1:] == short for i in range(len(long_)))


def brute(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        f = form[w]
        out.add((w, f, root, words[w], len(near[w]), None if f is None else words[f]))
    return out


def variant_rows():
    text = " ".join(["Spelling"] * 9 + ["speling"] * 4 + ["spellingg"] * 3 + ["spellinng"] * 2 + ["SPELLING"] * 2
                    + ["colour"] * 3 + ["colours"] * 7 + ["coloured"] * 3 + ["Ünïcode"] * 4 + ["ünïcode"] * 3 + ["xxxxx"] * 3 + ["xxxx"] * 9)
    return [row(900 + i, text) for i in range(3)] + [row(None, text), row(990, None), row(991, "")]


def result(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_equal_to_brute_force(spark, rows):
    all_rows = rows + variant_rows()
    docs = spark.createDataFrame(all_rows, SCHEMA).repartition(4)
    got = result(spelling.query(docs))
    assert got == brute(all_rows)
    assert any(f is not None for _, f, *_ in got)


def test_split_groups_lose_no_pair(spark, rows):
    all_rows = rows + variant_rows()
    docs = spark.createDataFrame(all_rows, SCHEMA)
    assert result(spelling.spelling_forms(docs, group_words=2)) == brute(all_rows)


def test_empty_and_clashing_columns(spark, no_docs):
    assert spelling.query(no_docs).collect() == []
    clash = spark.createDataFrame(variant_rows(), SCHEMA).withColumn("word", F.lit("zzzzz")).withColumn("n", F.lit(1))
    assert result(spelling.query(clash)) == brute(variant_rows())


def test_group_scan_equals_one_query_scan():
    import random
    rng = random.Random(4)
    for _ in range(200):
        listed = sorted({"".join(rng.choice("abéc") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 50))})
        asked = [w for w in listed if rng.random() < 0.6]
        want = {(q, w) for q in asked for w in listed if one_edit(q, w)}
        assert set(spelling.near_in_sorted(listed, asked)) == want
        assert set(spelling.near_in_group(listed, asked, block=rng.choice([1, 7, 4096]))) == want
