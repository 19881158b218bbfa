import math
from collections import Counter

import numpy as np

from retailoom.llm import lm
from tests.llm.conftest import words


def brute(rows, order, backoff=0.4):
    total = Counter()
    own = []
    for r in rows:
        ws = words(r[1])
        mine = Counter(tuple(ws[i:i + n]) for n in range(1, order + 1) for i in range(len(ws) - n + 1))
        own.append((r[0], ws, mine))
        total += mine
    everything = sum(len(ws) for _, ws, _ in own)
    out = []
    for doc, ws, mine in own:
        value = 0.0
        for i in range(len(ws)):
            score = backoff ** order / max(everything - len(ws), 1)
            for n in range(1, order + 1):
                if i - n + 1 < 0:
                    break
                g = tuple(ws[i - n + 1:i + 1])
                c = total[g] - mine[g]
                if c > 0:
                    h = total[g[:-1]] - mine[g[:-1]] if n > 1 else everything - len(ws)
                    score = backoff ** (order - n) * c / h
            value += math.log10(score)
        out.append((doc, len(ws), round(value / len(ws), 6) if ws else None))
    return out


def same(got, want):
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2] == w[2] or abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))


def test_query_equals_brute_force(docs, rows):
    same([tuple(r) for r in lm.query(docs).collect()], brute(rows, lm.ORDER))


def test_orders_and_many_chunks(docs, rows):
    for order, size in ((1, 9000), (3, 3000)):
        same([tuple(r) for r in lm.scores(docs, order, chunk_bytes=size).collect()], brute(rows, order))


def test_no_rows_and_no_words(spark, no_docs):
    assert lm.query(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id bigint, text string")
    assert [r.score for r in lm.query(blank).collect()] == [None, None]


def test_sorted_hashes_come_back():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 5000):
        for top in (1 << 20, 1 << 50, (1 << 64) - 1):
            keys = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
            assert (lm.unpack_sorted(lm.pack_sorted(keys), len(keys)) == keys).all()
    edge = np.array([0, 1, (1 << 48) - 1, 1 << 48, (1 << 64) - 1], np.uint64)
    assert (lm.unpack_sorted(lm.pack_sorted(edge), 5) == edge).all()


def test_query_counts_phrases_of_three_words(spark):
    rows = [(1, "red green blue"), (2, "red green blue"), (3, "cold green sky"), (4, "cold green blue")]
    got = [tuple(r) for r in lm.query(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    same(got, brute(rows, 3))
    total = dict((g[0], g[2]) for g in got)
    # "blue" after "red green": in the one other text that has it, always
    assert abs(3 * total[1] - (math.log10(0.4 ** 2 * 1 / 9) + math.log10(0.4) + math.log10(1))) < 1e-5


def test_rows_of_one_id_are_dealt_to_many_chunks(spark, monkeypatch):
    rows = [(None, f"alone {'x' * i} word") for i in range(40)] + [(7, "the same id and text")] * 40
    seen = []

    frames = type(spark.range(0))

    def watched(frame, *columns, inner=frames.repartition):
        seen.append(frame)
        return inner(frame, *columns)

    monkeypatch.setattr(frames, "repartition", watched)
    got = lm.scores(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, chunk_bytes=200)
    same([tuple(r) for r in got.collect()], [(d, n, s) for d, n, s in brute(rows, 2)])
    for which in ("doc_id is null", "doc_id = 7"):
        held = [r["count"] for r in seen[0].filter(which).groupBy("chunk").count().collect()]
        assert len(held) > 3 and max(held) < 20


def test_texts_are_written_once_and_meet_without_a_shuffle(spark, docs):
    """One copy of the texts on disk, about five bytes and a half an n-gram, one for its two counts."""
    got = lm.scores(docs, 3, chunk_bytes=20000)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Bucketed: true") >= 2
    assert not any("text" in line for line in plan.splitlines() if "Exchange" in line)
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, (1 << 64) - 1, 200_000, dtype=np.uint64))
    assert len(lm.pack_sorted(keys)) < 6.2 * len(keys)
    counts = np.where(rng.random(200_000) < 0.999, 1, 70_000)
    packed = lm.small_ints(counts)
    assert len(packed) < 0.2 * len(counts) and (lm.ints(packed, len(counts)) == counts).all()
    assert lm.ints(lm.small_ints(counts[:0]), 0).tolist() == [] and lm.ints(lm.small_ints(counts[:1]), 1).tolist() == [1]


def test_dealing_leaves_no_setting_and_no_table(spark, docs):
    from retailoom.llm.common import DEAL_ONCE
    before = {k: spark.conf.get(k) for k in DEAL_ONCE}
    tables = {t.name for t in spark.catalog.listTables()}
    lm.scores(docs, 1).count()
    assert {k: spark.conf.get(k) for k in DEAL_ONCE} == before
    assert {t.name for t in spark.catalog.listTables()} == tables
