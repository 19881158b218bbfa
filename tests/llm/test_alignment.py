"""Cross-tokenizer alignment against a brute force with both libraries."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retailoom.llm import alignment
from retailoom.llm.common import ranges, slices
from retailoom.llm.token_counts import byte_symbols
from tests.llm.conftest import SCHEMA, row


def brute(texts):
    a = Tokenizer.from_file(public_tokenizers.path(alignment.A_TOKENIZER))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B_TOKENIZER))
    back = {s: i for i, s in enumerate(byte_symbols())}

    def a_bytes(i):
        return bytes(back[c] for c in a.id_to_token(i))

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for t in texts:
        t = t or ""
        ai, bi = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        target = (" " + t).encode()
        if not t or b"".join(map(a_bytes, ai)) != target or b"".join(map(b_bytes, bi)) != target:
            docs.append((0, 0, 0, [], ""))
            continue
        ea, eb, pos = {}, {}, 0
        for i in ai:
            pos += len(a_bytes(i))
            ea.setdefault(pos, []).append(i)
        pos = 0
        for i in bi:
            pos += len(b_bytes(i))
            eb.setdefault(pos, []).append(i)
        cuts = sorted(set(ea) & set(eb))
        links = [(x, y) for c in cuts for x in ea[c] for y in eb[c]]
        groups, ga, gb, ca, cb = [], [], [], 0, 0
        pos_a = pos_b = 0
        ia = ib = 0
        for c in cuts:
            ga, gb = [], []
            while ia < len(ai) and pos_a + len(a_bytes(ai[ia])) <= c:
                pos_a += len(a_bytes(ai[ia]))
                ga.append(ai[ia])
                ia += 1
            while ib < len(bi) and pos_b + len(b_bytes(bi[ib])) <= c:
                pos_b += len(b_bytes(bi[ib]))
                gb.append(bi[ib])
                ib += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        docs.append((len(ai), len(bi), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(l for d in docs for l in d[3])
    top = {}
    for (x, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return [(na, nb, ng, len(links), sum(count[l] == top[l[1]] for l in links), sum(count[l] for l in links), h)
            for na, nb, ng, links, h in docs]


def test_equal_to_brute_force(spark, rows):
    extra = [row(800, "Hello  world, <s> and <|endoftext|> inside"), row(801, "héllo 日本 😀\ttab\nline"), row(802, "x" * 3000),
             row(803, "Hello  world, <s> and <|endoftext|> inside"), row(804, "ﬁ ligature normalised away")]
    all_rows = rows + extra
    docs = spark.createDataFrame(all_rows, SCHEMA).repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                 for r in alignment.query(docs).collect())
    want = sorted((r[0] is None, r[0] or 0, *b) for r, b in zip(all_rows, brute([r[1] for r in all_rows])))
    assert got == want
    assert any(g[2] == 0 for g in got) and any(g[2] > 0 for g in got)


def test_dense_buckets_use_bitmaps():
    import numpy as np
    positions = np.arange(0, 10000, 2, dtype="<u2")
    bits = np.zeros(1 << alignment.BUCKET_BITS, bool)
    bits[positions] = True
    assert alignment.popcount(np.packbits(bits).tobytes()) == 5000
    assert alignment.popcount(positions[:100].tobytes()) == 100


def test_empty_and_clashing_columns(spark, no_docs):
    assert alignment.query(no_docs).collect() == []
    clash = spark.createDataFrame([row(1, "a b"), row(None, None)], SCHEMA).withColumn("a", F.lit(1)).withColumn("doc_no", F.lit(5))
    got = sorted((r.doc_id is None, r.n_a, r.n_links) for r in alignment.query(clash).collect())
    assert got == [(False, 2, 2), (True, 0, 0)]


def test_merger_ids_equal_the_library():
    import random

    from retailoom.llm.token_counts import PairMerger
    rng = random.Random(9)
    texts = [" " + "".join(rng.choice("ab c\n'<|>éü日😀0123") for _ in range(rng.randint(0, 70))) for _ in range(300)]
    texts += [" <|endoftext|> x", " " + "z" * 4000, " "]
    a = Tokenizer.from_file(public_tokenizers.path(alignment.A_TOKENIZER))
    a.encode_special_tokens = True
    got = [x.tolist() for x in PairMerger(alignment.A_TOKENIZER).encode_plain(texts)]
    assert got == [e.ids for e in a.encode_batch(texts, add_special_tokens=False)]


def test_documents_reach_a_worker_in_small_batches(spark, docs, monkeypatch):
    key, seen, keep = "spark.sql.execution.arrow.maxRecordsPerBatch", [], alignment.staged
    monkeypatch.setattr(alignment, "staged", lambda df: (seen.append(spark.conf.get(key)), keep(df))[1])
    before = spark.conf.get(key)
    got = alignment.document_links(docs.limit(20))
    assert seen == [str(alignment.BATCH_ROWS)] and spark.conf.get(key) == before
    assert got.count() == 20


def test_ranges_are_the_slices_of_known_sizes():
    values = [b"ab", None, b"", "é".encode() * 3, b"x" * 9, b"y", b"z" * 4]
    found = list(ranges([len(v or b"") for v in values], 5))
    assert found == list(slices(values, 5)) and found[0][0] == 0 and found[-1][1] == len(values)
    assert list(ranges([], 5)) == []


def test_containers_do_not_copy_links_for_planes_that_lack_them():
    """One high multiplicity among many single links: memory follows the links, not links times planes."""
    import tracemalloc

    import numpy as np
    n = 200_000
    doc, one = np.arange(n, dtype=np.int64), np.ones(n, np.int32)
    times = one.copy()
    times[7] = 1023
    tracemalloc.start()
    got = alignment.containers(doc, one, one, times)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * n
    held = {(r["plane"], r["bucket"]): r["card"] for r in got.to_pylist()}
    assert sum(c for (p, _), c in held.items() if p == -1) == sum(c for (p, _), c in held.items() if p == 0) == n
    assert all(held[k, 0] == 1 for k in range(1, 10)) and len(held) == 2 * 4 + 9


def test_texts_of_a_slice_are_aligned_side_by_side():
    """Figures and links of many texts equal those of each text alone, and tokens without bytes too."""
    import random

    import numpy as np
    align = alignment.aligner(alignment.A_TOKENIZER, alignment.B_TOKENIZER)
    rng = random.Random(4)
    texts = ["", "one", "x ﬁ y", "a  b\tc\n", "<s> 日本 <|endoftext|>"] + ["".join(rng.choice("ab c1é;,") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    whole = [c.to_pylist() for c in align.batch(texts)]
    alone = [[c.to_pylist()[0] for c in align.batch([t])] for t in texts]
    assert [list(r) for r in zip(*whole)] == alone
    for t, (n_a, n_b, n_groups, n_links, digest, *_), want in zip(texts, alone, brute(texts)):
        assert (n_a, n_b, n_groups, n_links, digest) == (*want[:4], want[6])
    # the slow way for tokens without bytes gives the same where there are none
    calls, keep = [], align.align_slowly
    a, a_n = align.merger.encode_flat([" " + t for t in texts])
    for i, (first, last) in enumerate(zip(np.cumsum(a_n) - a_n, np.cumsum(a_n))):
        if alone[i][0]:
            got = keep(a[first:last].tolist(), align.b.encode(texts[i]))
            assert list(got[:5]) == alone[i][:5]
            assert sorted(zip(*got[5:])) == list(zip(*alone[i][5:]))
            calls.append(i)
    assert len(calls) > 100
