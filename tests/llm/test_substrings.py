import hashlib
import random

import numpy as np

from retailoom.llm import substrings
from retailoom.llm.common import with_text_hash
from tests.llm.conftest import row, words


def brute(rows, window):
    first = {}
    for doc, text, *_ in rows:
        ws = words(text)
        for i in range(len(ws) - window + 1):
            if doc is not None:
                key = tuple(ws[i:i + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text, *_ in rows:
        ws = words(text)
        gone = set()
        for i in range(len(ws) - window + 1):
            if doc is not None and first[tuple(ws[i:i + window])] < doc:
                gone.update(range(i, i + window))
        left = [w for i, w in enumerate(ws) if i not in gone]
        out.append((doc, len(ws), len(ws) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query_equals_brute_force(docs, rows):
    got = sorted([tuple(r) for r in substrings.query(docs).collect()], key=repr)
    assert got == brute(rows, 50)


def test_random_repeats_with_small_windows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 37)
    rng = random.Random(3)
    pool = [[rng.choice("abcdefgh") for _ in range(60)] for _ in range(5)]
    rows = []
    for i in range(80):
        ws = []
        for _ in range(rng.randint(1, 5)):
            part = rng.choice(pool)
            a = rng.randint(0, 40)
            ws += part[a:a + rng.randint(5, 60)] + [rng.choice("abcxyz") for _ in range(rng.randint(0, 6))]
            if rng.random() < 0.3:
                ws += [rng.choice("ab")] * rng.randint(2, 70)
        rows.append(row(i, " ".join(ws)))
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    for window in (8, 20):
        got = substrings.without_repeats(frame, window).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got], key=repr) == brute(rows, window)


def test_equal_windows_choose_the_same_symbol():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    one = np.concatenate([rng.integers(0, 1 << 62, 90).astype(np.uint64), shared, rng.integers(0, 1 << 62, 40).astype(np.uint64)])
    seg = np.zeros(len(one), np.int32)
    found = substrings.anchors(one, seg, np.arange(len(one)) <= len(one) - 50)
    alone = substrings.anchors(shared, seg[:300], np.arange(300) <= 250)
    inner = {(int(n), int(p) - 90) for n, p, a, b in zip(*found) if a >= 90 and b <= 340}
    assert inner <= {(int(n), int(p)) for n, p, _, _ in zip(*alone)}
    assert len(found[0]) < len(one) / 3


def test_no_rows(no_docs):
    assert substrings.query(no_docs).count() == 0
