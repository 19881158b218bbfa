"""Token counts against the library's own encoding."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from retailoom.llm import token_counts

from tests.llm.conftest import SCHEMA, row


def library_counts(texts):
    t = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_merges_equal_the_library_on_awkward_texts():
    rng = random.Random(11)
    texts = ["", " ", "a", "hello<|endoftext|>world", "<|endoftext|><|endoftext|>", "<|endoftext", "aaaaaaaaaaaaaaaaa",
             "   x  \n\n  y\t\t", "日本語のテキスト 😀😀 ü", "'s'll 've 'S", "a" * 5000, "ab" * 2000, "  word  　 x"]
    texts += ["".join(rng.choice("ab c\n'<|>éü日😀0123.,") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    merger = token_counts.PairMerger(token_counts.TOKENIZER)
    assert merger.counts(texts) == library_counts(texts)
    # a warm cache gives the same counts again, and one text at a time as well
    assert merger.counts(texts) == library_counts(texts)
    assert [merger.counts([t])[0] for t in texts[:40]] == library_counts(texts[:40])


def test_query_rows_and_cases(spark, docs, rows):
    out = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.query(docs).collect()}
    texts = [r[1] for r in rows]
    expected = {(r[0], len((r[1] or "").encode()), n, n > 512) for r, n in zip(rows, library_counts(texts))}
    assert out == expected
    assert token_counts.query(docs).count() == len(rows)  # repeated rows stay, null ids and texts give rows


def test_empty_and_clashing_columns(spark, no_docs):
    assert token_counts.query(no_docs).collect() == []
    clash = spark.createDataFrame([row(1, "a b c")], SCHEMA).withColumn("n_tokens", F.lit(7)).withColumn("n_bytes", F.lit(-1))
    assert [(r.doc_id, r.n_tokens) for r in token_counts.query(clash).collect()] == [(1, 3)]
