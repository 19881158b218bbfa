import uuid
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from retailoom.llm import tokens
from retailoom.llm.common import shared_folder

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def test_query_equals_the_library(docs, rows):
    want, start = [], 0
    got = sorted([tuple(r) for r in tokens.query(docs).collect()], key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([r[0] for r in rows], key=lambda i: -1 if i is None else i)
    left = {}
    for r in rows:
        ids = ids_of(r[1])
        left.setdefault(r[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for doc, at, n, crc in got:
        assert at == start
        start += n
        left[doc].remove((n, crc))
    assert not any(left.values())


def test_ids_come_back(spark, docs, rows):
    path = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
    tokens.write_tokens(docs, path)
    got = tokens.read_tokens(spark, path).collect()
    want = sorted(np.array(ids_of(r[1]), "<u4").tobytes() for r in rows)
    assert sorted(bytes(r.ids) for r in got) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é\n\t 's1<|endoftext|> 😀!"), max_size=40), max_size=6))
def test_units_are_the_library(texts):
    texts += ["a <|endoftext|> b's  c \n d", "a thing, thing. thing### thing's don't, été... x1. \u01c5! ''; #1 a.b, ,,", "x " + "ab" * 900 + " y " + "é" * 700, "ends with ", " starts"]
    got = [np.frombuffer(b, "<u2").tolist() for b in tokens.encoder("byte_bpe_50k.json").encode(texts)]
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=900), st.integers(0, 3))
def test_blocks_round_trip(ids, spread):
    ids = np.array([i if i % 3 else i // (1 + spread * 20) for i in ids], np.int64)
    counts = np.bincount(ids, minlength=301)
    for limit in (9, 16):
        lengths = tokens.code_lengths(counts, limit)
        used = lengths[counts > 0].astype(float)
        assert lengths.max(initial=0) <= limit and (2.0 ** -used).sum() <= 1
        payload, checkpoints = tokens.pack(ids, tokens.canonical_codes(lengths), lengths)
        if len(ids):
            assert tokens.Decoder(lengths).decode(payload, checkpoints, len(ids)).tolist() == ids.tolist()


def test_lengths_are_optimal_without_a_tight_limit():
    import heapq
    counts = np.array([5, 9, 12, 13, 16, 45, 0, 1, 1, 300])
    heap = [(int(c), i, 0) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], a[1], 0))
    assert int((tokens.code_lengths(counts, 16) * counts).sum()) == total
    lengths = tokens.code_lengths(2 ** np.arange(20), 6)
    assert lengths.max() <= 6 and (2.0 ** -lengths.astype(float)).sum() <= 1


def test_no_rows(no_docs):
    assert tokens.query(no_docs).count() == 0
