import zlib
from collections import Counter
from itertools import combinations

import numpy as np

import __spark_entry__
import corpus_pipeline
from retailoom.llm import mixing, quality
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_quality import boilerplate, brute as verdicts
from tests.llm.test_simhash import brute_print, roots
from tests.llm.test_tokens import ids_of


def test_run_equals_brute_force_stage_by_stage(spark, docs, rows, tmp_path):
    rows = [r for r in boilerplate(rows) if r[0] is not None]
    good = {v[0] for v in verdicts(rows) if v[7]}
    held = next(r for r in rows if r[0] in good and len(r[1].split()) >= 45)
    items = [(1, " ".join(held[1].split()[2:42])), (2, "nobody has these five words or more")]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    kept = Counter(v[0] for v in verdicts(rows) if v[7])
    cleaned = [tuple(r) for r in quality.apply_rules(spark.createDataFrame(rows, docs.schema)).collect()]
    assert Counter(r[0] for r in cleaned) == kept
    prints = {r: brute_print(r[1]) for r in cleaned}
    distinct = sorted(set(prints.values()))
    root = roots(distinct, [(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= 2])
    first = {}
    for r, p in prints.items():
        if root[p] not in first or r[0] < first[root[p]][0]:
            first[root[p]] = r
    bad = {d for d, *_ in contaminated(list(first.values()), items)}
    clean = [r for r in first.values() if r[0] not in bad]
    assert held[0] in bad
    times = {(r.doc_id, r.source): r.copies for r in mixing.query(spark.createDataFrame(clean, docs.schema)).collect()}
    want = sorted([(r[0], len(ids_of(r[1])), zlib.crc32(np.array(ids_of(r[1]), "<u4").tobytes())) for r in clean for _ in range(times[r[0], r[3]])])
    assert sorted((r[0], r[2], r[3]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r[1]):
        assert r[1] == at
        at += r[2]


def test_stages_return_the_columns_of_documents(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, "").columns == docs.columns


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n.split("_")[0][2:].isdigit() for n in names) == 13
