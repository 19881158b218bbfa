import math
from collections import Counter, defaultdict

from retailoom.llm import mixing
from tests.llm.conftest import words


def shares(rows):
    total = Counter()
    for r in rows:
        total[r[3]] += len(words(r[1]))
    return total


def brute_exponent(total, fits):
    low, high = 0.0, 1.0
    if fits(0.0):
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def weights(total, a):
    raised = {s: (t / sum(total.values())) ** a for s, t in total.items() if t}
    return {s: v / sum(raised.values()) for s, v in raised.items()}


def test_query_meets_the_repetition_limit(docs, rows):
    total = shares(rows)
    a = brute_exponent(total, lambda a: max(weights(total, a)[s] / total[s] for s in total) / min(weights(total, a)[s] / total[s] for s in total) <= 2)
    got = mixing.query(docs).collect()
    assert len(got) == len(set(map(tuple, [r[:4] for r in rows])))
    want = weights(total, a)
    mixed = Counter()
    for r in got:
        assert abs(r.weight - want[r.source]) < 1e-5
        assert r.copies in (1, 2)
        mixed[r.source] += r.copies * r.n_tokens * sum(x[0] == r.doc_id and x[3] == r.source and len(words(x[1])) == r.n_tokens for x in rows if r.doc_id == 7) if r.doc_id == 7 else r.copies * r.n_tokens
    budget = max(total[s] / want[s] for s in total)
    for s in total:
        largest = max(len(words(r[1])) for r in rows if r[3] == s)
        assert mixed[s] <= round(want[s] * budget) + 1 and mixed[s] >= want[s] * budget - 2 * largest


def test_entropy_target_and_small_budget(docs, rows):
    total = shares(rows)
    for target in (1.0, 1.25):
        a = brute_exponent(total, lambda a: -sum(w * math.log(w) for w in weights(total, a).values()) <= target)
        want = weights(total, a)
        got = mixing.copies(docs, None, target, budget=sum(total.values()) / 4).collect()
        assert all(abs(r.weight - want[r.source]) < 1e-5 for r in got)
        used = Counter()
        for r in got:
            used[r.source] += r.copies * r.n_tokens * r.n_rows
        assert all(used[s] <= round(want[s] * sum(total.values()) / 4) for s in total)


def test_blocks_are_whole_but_one(docs):
    got = mixing.copies(docs).collect()
    per_block = defaultdict(set)
    for r in got:
        per_block[r.source, r.block].add(r.copies)
    for source in {r.source for r in got}:
        assert sum(len(v) > 1 for (s, _), v in per_block.items() if s == source) <= 1


def test_mix_repeats_rows_with_all_columns(docs, rows):
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    copies = {(r.doc_id, r.source, r.n_tokens): r.copies for r in mixing.query(docs).collect()}
    want = Counter()
    for r in rows:
        want[r] += copies[r[0], r[3], len(words(r[1]))]
    assert Counter(map(tuple, mixed.collect())) == want


def test_no_rows_and_no_words(spark, docs, no_docs):
    assert mixing.query(no_docs).count() == 0
    assert mixing.mixed(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert sorted(r.copies for r in mixing.query(blank).collect()) == [1, 1]
