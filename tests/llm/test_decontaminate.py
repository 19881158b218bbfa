from retailoom.llm import decontaminate
from tests.llm.conftest import row


def grams(text):
    kept = "".join(c for c in (text or "").lower() if not (33 <= ord(c) < 127 and not c.isalnum()))
    from tests.llm.conftest import words
    return words(kept)


def brute(rows, items, n=5, threshold=0.8):
    out = set()
    for item, text in items:
        ws = grams(text)
        k = min(n, len(ws))
        want = {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)} if ws else set()
        for doc, body, *_ in rows:
            have = grams(body)
            found = len(want & {tuple(have[i:i + k]) for i in range(len(have) - k + 1)})
            if want and found >= threshold * len(want) - 1e-9:
                out.add((doc, item, len(want), found))
    return out


def test_query_equals_brute_force(spark, docs, rows):
    body = [r[1] for r in rows if r[0] == 400][0].split()
    items = [(1, " ".join(body[5000:5040])), (2, " ".join(body[100:140] + ["never"] * 2 + body[142:160])), (3, "Two, words!"), (4, None), (5, ""),
             (6, "one"), (7, "words that no document has at all"), (None, " ".join(body[20:60])), (8, " ".join(body[200:230] + body[900:930])), (9, "!!! ...")]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    for bits in (8, 23):
        got = decontaminate.contaminated(docs, frame, filter_bits=bits).collect()
        assert {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got} == brute(rows, items)
    left = decontaminate.without_contaminated(docs, frame)
    bad = {(d,) for d, *_ in brute(rows, items)}
    assert left.columns == docs.columns
    assert {r[0] for r in left.collect() if r[0] is not None} == {r[0] for r in rows if r[0] is not None and (r[0],) not in bad}
    assert sum(r[0] is None for r in left.collect()) == 3


def test_size_classes_lose_nothing_at_the_threshold(spark):
    base = [f"t{i}" for i in range(200)]
    items, rows = [], []
    for size in (5, 6, 9, 14, 24, 37, 63):
        items.append((size, " ".join(base[:size])))
        for cut in range(0, 12):
            rows.append(row(size * 100 + cut, " ".join(["z"] * 50 + base[:max(size - cut, 0)] + ["y"] * 30)))
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contaminated(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), frame).collect()
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got} == brute(rows, items)


def test_no_rows(spark, docs, no_docs):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert decontaminate.query(no_docs, items).count() == 0
    assert decontaminate.query(docs, items.limit(0)).count() == 0
    assert decontaminate.without_contaminated(docs, items.limit(0)).count() == docs.count()
