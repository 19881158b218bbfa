"""Stupid-backoff scores of documents from n-gram counts over the whole corpus.

Every document is scored by the counts of all other documents (its own are taken off), so a
text is not its own evidence. With order N, the score of a word is the relative frequency of
the longest n-gram ending at it that occurs elsewhere, times ``BACKOFF`` for each order skipped;
a word that occurs nowhere else scores ``BACKOFF ** N`` divided by the other documents' words. The
first words of a text, short of history, count as backed off. A document's score is the mean log10 of its words.

Documents are dealt into chunks by hash of a row number, whatever their ids. A chunk holds its distinct n-grams once, cut
by hash into buckets. A bucket sums the counts of all chunks (the count table of that part of
all n-grams) and answers each chunk in the order asked; the answers meet the n-grams of the
chunk's documents again, and are summed per document. Rows are packed arrays, so a frequent
n-gram costs one entry a chunk, and neither chunks nor buckets depend on how often it occurs.
The texts are written once as a table bucketed by chunk, so neither meeting moves them.
Numbers of chunks and buckets follow the size of the corpus. N-grams are known by 64-bit hashes.

Null and empty texts have no words: score null. Rows with null ids take part as documents of
their own; repeated rows are documents each. Extra columns are ignored. No rows give no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailoom.llm.common import WordHashes, arrow_batch, arrow_schema, ngram_hashes, slices, staged_buckets

ORDER = 3
BACKOFF = 0.4
CHUNK_BYTES = 8 << 20
# files of the bucketed table of texts; more chunks share them
MAX_BUCKETS = 10_000
# bytes of a step between sorted hashes that are as good as random
LOW_BYTES = 5
NOTHING = np.zeros(0, np.uint64)


def chunk_ngrams(texts: list[bytes | None], order: int):
    """Per order: n-gram hashes of all texts and the row of each; then words of each row."""
    cache = WordHashes()
    words, counts = [], []
    for begin, end in slices(texts):
        split = [(t or b"").split() for t in texts[begin:end]]
        counts += map(len, split)
        words.append(cache.of([w for ws in split for w in ws]))
    hashes = np.concatenate(words) if words else NOTHING
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    grams = []
    for n in range(1, order + 1):
        h = ngram_hashes(hashes, n)
        inside = rows[:len(h)] == rows[n - 1:] if len(h) else np.zeros(0, bool)
        grams.append((h, inside))
    return grams, rows, np.array(counts, np.int64)


def distinct_ngrams(grams) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([h[inside] for h, inside in grams]), return_counts=True)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are equal ranges of the hash, so sorted hashes are sorted by bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def squeezed(planes: np.ndarray) -> bytes:
    """Rows of bytes, one after the other, compressed."""
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def loose(data: bytes, planes: int, n: int) -> np.ndarray:
    """The rows of ``squeezed``, a column for each."""
    raw = pa.decompress(data, decompressed_size=planes * n, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(planes, n).T


def small_ints(counts: np.ndarray) -> bytes:
    """Counts by byte place, lowest first, as many as the largest needs, compressed."""
    width = max(1, -(-int(counts.max(initial=0)).bit_length() // 8))
    return bytes([width]) + squeezed(counts.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def ints(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    out = np.zeros((n, 8), np.uint8)
    out[:, :data[0]] = loose(data[1:], data[0], n)
    return out.reshape(-1).view("<i8")


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending hashes as the low bytes of their steps, then the other bytes by place, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return steps[:, :LOW_BYTES].tobytes() + squeezed(steps[:, LOW_BYTES:].T)


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :LOW_BYTES] = np.frombuffer(data, np.uint8, LOW_BYTES * n).reshape(-1, LOW_BYTES)
    steps[:, LOW_BYTES:] = loose(data[LOW_BYTES * n:], 8 - LOW_BYTES, n)
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def table(ddl: str, rows: list[tuple]) -> pa.Table:
    if not rows:
        return arrow_schema(ddl).empty_table()
    return pa.Table.from_batches([arrow_batch(ddl, *zip(*rows))])


def chunk_of(parts: int) -> Column:
    """Chunk of a row by its number: rows of one id, of no id, or alike in all, spread as others do."""
    return F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")


def scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, score (mean log10) of every row."""
    base = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    base = base.withColumn("row", F.monotonically_increasing_id())
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // chunk_bytes))
    chunk = chunk_of(parts).alias("chunk")
    # written once: the rows of a chunk stay the same when a task is repeated
    chunks = staged_buckets(base.select(chunk, "doc_id", "text"), "chunk", min(parts, MAX_BUCKETS))
    everything = chunks.agg(F.sum(F.regexp_count(F.decode("text", "UTF-8"), F.lit("[^\\x20\\x09-\\x0D]+")))).first()[0] or 0
    asked_ddl = "bucket int, chunk int, n int, hashes binary, counts binary"
    answer_ddl = "chunk int, bucket int, n int, counts binary"

    def ask(group: pa.Table) -> pa.Table:
        grams, _, sizes = chunk_ngrams(group.column("text").to_pylist(), order)
        keys, counts = distinct_ngrams(grams)
        number = group.column("chunk")[0].as_py()
        bucket = bucket_of(keys, parts)
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
        rows = [(int(bucket[a]), number, int(b - a), pack_sorted(keys[a:b]), small_ints(counts[a:b])) for a, b in zip(cuts, cuts[1:])]
        return table(asked_ddl, rows)

    def answer(group: pa.Table) -> pa.Table:
        rows = list(zip(*[group.column(c).to_pylist() for c in ("chunk", "bucket", "n", "hashes", "counts")]))
        keys = np.concatenate([unpack_sorted(r[3], r[2]) for r in rows])
        counts = np.concatenate([ints(r[4], r[2]) for r in rows])
        _, at = np.unique(keys, return_inverse=True)
        sums = np.bincount(at, weights=counts).astype(np.int64)[at]
        cuts = np.cumsum([r[2] for r in rows])
        return table(answer_ddl, [(r[0], r[1], r[2], small_ints(sums[end - r[2]:end])) for r, end in zip(rows, cuts)])

    ddl = "doc_id bigint, n_words bigint, score double"

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return arrow_schema(ddl).empty_table()
        grams, rows, sizes = chunk_ngrams(group.column("text").to_pylist(), order)
        keys, spread = np.unique(np.concatenate([h[inside] for h, inside in grams]), return_inverse=True)
        told = sorted(zip(*[answers.column(c).to_pylist() for c in ("bucket", "n", "counts")]))
        totals = np.concatenate([ints(c, n) for _, n, c in told]) if told else np.zeros(0, np.int64)
        totals = np.append(totals, 0)  # for runs across two texts, which are no n-grams
        others = (everything - sizes)[rows]
        value = np.log10(backoff ** order / np.maximum(others, 1))
        history = others
        for n, (h, inside) in enumerate(grams, 1):
            if not len(h):
                continue
            place = np.full(len(h), len(keys))
            place[inside], spread = spread[:inside.sum()], spread[inside.sum():]
            _, at, own = np.unique(rows[:len(h)].astype(np.int64) * (len(keys) + 1) + place, return_inverse=True, return_counts=True)
            count = totals[place] - own[at]
            seen = np.flatnonzero(count > 0)
            value[seen + n - 1] = np.log10(backoff ** (order - n) * count[seen] / history[seen])
            history = count
        summed = np.bincount(rows, weights=value, minlength=len(sizes))
        mean = [float(s / n) if n else None for s, n in zip(summed.tolist(), sizes.tolist())]
        return pa.Table.from_batches([arrow_batch(ddl, group.column("doc_id").combine_chunks(), sizes, mean)])

    asked = chunks.groupBy("chunk").applyInArrow(ask, asked_ddl)
    answers = asked.groupBy("bucket").applyInArrow(answer, answer_ddl)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, ddl)


def query(docs: DataFrame) -> DataFrame:
    return scores(docs).withColumn("score", F.round("score", 6))


ORACLE = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
t as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) q from d),
b as (select *, lag(x) over (partition by doc_id order by q) h1, lag(x, 2) over (partition by doc_id order by q) h2 from t),
u as (select x, count(*) c from t group by 1), uo as (select doc_id, x, count(*) c from t group by 1, 2),
p as (select h1, x, count(*) c from b where h1 is not null group by 1, 2), po as (select doc_id, h1, x, count(*) c from b where h1 is not null group by 1, 2, 3),
r as (select h2, h1, x, count(*) c from b where h2 is not null group by 1, 2, 3),
ro as (select doc_id, h2, h1, x, count(*) c from b where h2 is not null group by 1, 2, 3, 4),
n as (select count(*) n from t), o as (select doc_id, (select n from n) - count(*) n from t group by 1),
s as (select b.doc_id, case when r.c - ro.c > 0 then log10((r.c - ro.c) / (pc.c - pco.c))
    when p.c - po.c > 0 then log10(0.4e0 * (p.c - po.c) / (hu.c - ho.c))
    when u.c - uo.c > 0 then log10(0.4e0 * 0.4e0 * (u.c - uo.c) / o.n)
    else log10(0.4e0 * 0.4e0 * 0.4e0 / greatest(o.n, 1)) end s
  from b join o on o.doc_id = b.doc_id join u on u.x = b.x join uo on uo.x = b.x and uo.doc_id = b.doc_id
  left join r on r.h2 = b.h2 and r.h1 = b.h1 and r.x = b.x left join ro on ro.h2 = b.h2 and ro.h1 = b.h1 and ro.x = b.x and ro.doc_id = b.doc_id
  left join p pc on pc.h1 = b.h2 and pc.x = b.h1 left join po pco on pco.h1 = b.h2 and pco.x = b.h1 and pco.doc_id = b.doc_id
  left join p on p.h1 = b.h1 and p.x = b.x left join po on po.h1 = b.h1 and po.x = b.x and po.doc_id = b.doc_id
  left join u hu on hu.x = b.h1 left join uo ho on ho.x = b.h1 and ho.doc_id = b.doc_id)
select d.doc_id, len(w) n_words, round(avg(s), 6) score from d left join s on s.doc_id = d.doc_id group by 1, 2
"""
