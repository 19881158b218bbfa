"""Benchmark decontamination: size-partitioned MinHash containment search, exact check.

Text is lower-cased, ASCII punctuation is removed, and five consecutive words make a shingle;
an item of fewer words is one shingle of all its words. A document holds an item when at least
``threshold`` of the item's distinct shingles occur in it.

Search: items are partitioned by their number of distinct shingles into classes (2^c-1, 2^c].
An item's signature is its bottom-k MinHash (the k smallest shingle hashes), where k comes from
the upper bound of its class: k = floor((1 - threshold) * 2^c) + 1. A document that holds the
item misses at most k - 1 of its shingles, so it contains at least one of the k: the search
loses nothing, however long the document is. Whole documents probe a bit filter of fixed size
over all signatures; only documents with a hit go on, with those of their shingles that pass a
second filter over all item shingles. Check: these meet the items' shingles by text, and the
distinct ones are counted.

The filters have ``2 ** FILTER_BITS`` bits whatever the number of items (bounded broadcast);
false positives only cost work. Null or empty texts and items without words have no shingles
and match nothing. Rows with a null id are matched too and stay apart by their text; rows that
share id and text count once. Extra columns are ignored. No items or no documents give no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailoom.llm.common import (TEXT_HASH, WordHashes, arrow_batch, drop_rows, ngram_hashes, signed, slices, staged,
                                  with_text_hash)

SHINGLE = 5
THRESHOLD = 0.8
FILTER_BITS = 23
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a lower-cased text without ASCII punctuation."""
    return text.translate(None, PUNCTUATION).split() if text else []


def normalized(col: str = "text"):
    return F.lower(col).cast("binary").alias("text")


def item_shingles(items: DataFrame, n: int, threshold: float) -> DataFrame:
    """Distinct shingles of every item: item_id, n_words, n_shingles, shingle, h, in_signature."""
    ddl = "item_id bigint, n_words int, n_shingles bigint, shingle binary, h bigint, in_signature boolean"

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                k = min(n, len(words))
                hashes = ngram_hashes(cache.of(words), k)
                found = {}
                for i, h in enumerate(hashes.tolist()):
                    found.setdefault(b" ".join(words[i:i + k]), h)
                size_class = 1 << (len(found) - 1).bit_length()
                size = int((1 - threshold) * size_class + 1e-9) + 1
                ranked = sorted(found.items(), key=lambda e: (e[1], e[0]))
                rows += [(item, k, len(found), s, h, at < size) for at, (s, h) in enumerate(ranked)]
            if rows:
                cols = list(zip(*rows))
                cols[4] = signed(np.array(cols[4], np.uint64))
                yield arrow_batch(ddl, *cols)

    return items.select(F.col("item_id").cast("bigint"), normalized()).mapInArrow(run, ddl)


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bit array of fixed size with the position of every hash set; merged by Spark."""
    at = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    merged = hashes.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")) \
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words = np.zeros(1 << (bits - 6), np.int64)
    for row in merged.collect():  # at most 2 ** (bits - 6) rows
        words[row["word"]] = row["bits"]
    return words


def passes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(words) * 64 - 1)
    return (words.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def contaminated(docs: DataFrame, items: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Documents that hold an item: doc_id, text hash, item_id, n_shingles, n_found, containment."""
    spark = docs.sparkSession
    shingles = staged(item_shingles(items, n, threshold))
    lengths = sorted(r[0] for r in shingles.select("n_words").distinct().collect())  # 1 to n
    signature = spark.sparkContext.broadcast(bit_filter(shingles.filter("in_signature"), filter_bits))
    whole = spark.sparkContext.broadcast(bit_filter(shingles, filter_bits))
    ddl = f"doc_id bigint, {TEXT_HASH} bigint, shingle binary, h bigint"

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for begin, end in slices(texts):
                words = [words_of(t) for t in texts[begin:end]]
                hashes = cache.of([w for ws in words for w in ws])
                owner = np.repeat(np.arange(begin, end), [len(ws) for ws in words])
                starts = np.searchsorted(owner, np.arange(begin, end))
                rows, found = [], []
                for k in lengths:
                    grams = ngram_hashes(hashes, k)
                    if len(grams):
                        hit = np.flatnonzero(passes(whole.value, grams) & (owner[:len(grams)] == owner[k - 1:]))
                        rows += [(i, k) for i in hit.tolist()]
                        found.append(grams[hit])
                if not rows:
                    continue
                grams = np.concatenate(found)
                of = owner[[i for i, _ in rows]]
                hit_docs = np.unique(of[passes(signature.value, grams)])
                kept = {}
                for (i, k), h, d, ok in zip(rows, signed(grams).tolist(), of.tolist(), np.isin(of, hit_docs).tolist()):
                    if ok:
                        at = i - int(starts[d - begin])
                        kept.setdefault((d, b" ".join(words[d - begin][at:at + k])), h)
                if kept:
                    at = pa.array([d for d, _ in kept], pa.int64())
                    yield arrow_batch(ddl, batch.column(0).take(at), batch.column(1).take(at), [s for _, s in kept], list(kept.values()))

    rows = with_text_hash(docs).select(F.col("doc_id").cast("bigint"), TEXT_HASH, normalized())
    evidence = rows.mapInArrow(run, ddl)
    # several items may share a shingle, so the item side is unique per (shingle, item) only
    meets = evidence.join(shingles, ["shingle", "h"])
    counted = meets.groupBy("doc_id", TEXT_HASH, "item_id", "n_shingles").agg(
        F.count_distinct("shingle").alias("n_found"), F.max("in_signature").alias("searched"))
    return counted.filter(F.col("searched") & (F.col("n_found") >= F.col("n_shingles") * threshold - 1e-9)).select(
        "doc_id", TEXT_HASH, "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def without_contaminated(docs: DataFrame, items: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that hold no item, with the columns of docs."""
    return drop_rows(docs, contaminated(docs, items, n, threshold).select("doc_id", TEXT_HASH).distinct())


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contaminated(docs, items).drop(TEXT_HASH)


ORACLE = r"""
with d as (
  select doc_id, text, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
i as (
  select item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from benchmark),
lens as (select distinct least(5, len(w)) k from i where len(w) > 0),
s as (select distinct item_id, k, list_aggregate(w[p:p + k - 1], 'string_agg', ' ') s
      from (select item_id, w, least(5, len(w)) k, unnest(range(1, len(w) - least(5, len(w)) + 2)) p from i where len(w) > 0)),
n as (select item_id, count(*) n_shingles from s group by 1),
g as (select distinct doc_id, text, k, list_aggregate(w[p:p + k - 1], 'string_agg', ' ') s
      from (select doc_id, text, w, k, unnest(range(1, len(w) - k + 2)) p from d, lens where len(w) >= k))
select doc_id, s.item_id, n_shingles, count(distinct s.s) n_found, count(distinct s.s) / n_shingles containment
from g join s on g.s = s.s and g.k = s.k join n on n.item_id = s.item_id
group by doc_id, text, s.item_id, n_shingles having count(distinct s.s) >= 0.8 * n_shingles - 1e-9
"""
