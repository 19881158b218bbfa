"""SimHash near-duplicates: pigeonhole blocks, Hamming check, connected classes.

Fingerprint: words of the text with A-Z lowered, runs of three words (all words when fewer),
repeats included, hashed by XXH64 with seed 42; a bit is set when it is set in over half of
the hashes. No word: fingerprint zero. Two fingerprints link at ``max_bits`` or fewer differing
bits.

The 64 bits are cut into ``max_bits + 2`` blocks. A pair within ``max_bits`` agrees in at least
two blocks, so every pair of blocks is a join key over distinct fingerprints; pairs that meet
are verified by their Hamming distance. A bucket of more than ``BUCKET`` fingerprints is not
paired: its members meet through fingerprints at most ``max_bits / 2`` bits away from both,
which is the same relation (a shared one lies within ``max_bits`` of both, and any such pair
has one), so no bucket makes a square and no link is lost.

Null and empty texts have no words. Rows with a null id take part; their class is the smallest
non-null id reachable, null if there is none. Repeated rows share a class. Extra columns are
ignored. No rows give no rows.
"""

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailoom.llm.common import TEXT_HASH, arrow_batch, keep_rows, staged, unstage, with_text_hash

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BUCKET = 64
ROWS_AT_ONCE = 1 << 15


def fingerprint(text: bytes | None, n: int = SHINGLE) -> bytes:
    """Big-endian bytes of the fingerprint of one text."""
    words = text.lower().split() if text else []
    if not words:
        return bytes(8)
    digest = xxhash.xxh64_digest
    if len(words) <= n:
        return digest(b" ".join(words), SEED)
    runs = zip(*[words[i:] for i in range(n)])
    hashes = np.frombuffer(b"".join([digest(b" ".join(run), SEED) for run in runs]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), ROWS_AT_ONCE):
        ones += np.unpackbits(hashes[at:at + ROWS_AT_ONCE], axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, text hash and fingerprint (as a signed long) of every row."""
    ddl = f"doc_id bigint, {TEXT_HASH} bigint, fp bigint"

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            prints = np.frombuffer(b"".join([fingerprint(t, n) for t in texts]), ">i8").astype(np.int64)
            yield arrow_batch(ddl, batch.column(0), batch.column(1), prints)

    rows = with_text_hash(docs).select(F.col("doc_id").cast("bigint"), TEXT_HASH, F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, ddl)


def block_masks(max_bits: int) -> list[int]:
    """Masks of all pairs of the ``max_bits + 2`` blocks of a fingerprint, as signed longs."""
    cuts = np.linspace(0, 64, max_bits + 3).astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(cuts, cuts[1:])]
    masks = [a | b for a, b in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b), a < b, that join all distinct fingerprints within ``max_bits``.

    Small buckets give every linked pair; in large ones a linked pair is joined through a third
    member that is linked to both.
    """
    masks = block_masks(max_bits)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("part", "key"))
    sizes = keyed.groupBy("part", "key").count()
    shared = keyed.join(sizes.filter("count > 1"), ["part", "key"])
    small = shared.filter(F.col("count") <= bucket).select("part", "key", "fp")
    pairs = (
        small.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b"), ["part", "key"])
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
        .select("a", "b")
    )
    flips = [0]
    for k in range(1, max_bits // 2 + 1):
        flips += [sum(1 << i for i in at) for at in combinations(range(64), k)]
    flips = [f - (1 << 64) if f >> 63 else f for f in flips]
    meeting = shared.filter(F.col("count") > bucket).select("fp").distinct().select(
        "fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("near"))
    if max_bits % 2:  # an odd bound needs one side to reach a bit further
        ones = [1 << i for i in range(63)] + [-(1 << 63)]
        meeting = meeting.unionByName(meeting.select("fp", F.explode(F.array(*[F.col("near").bitwiseXOR(F.lit(f)) for f in ones])).alias("near"))).distinct()
        far = meeting.withColumnRenamed("fp", "b").join(meeting.withColumnRenamed("fp", "a"), "near").filter(
            (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")
        return pairs.unionByName(far).distinct()
    least = meeting.groupBy("near").agg(F.min("fp").alias("a"))
    stars = meeting.join(least, "near").filter(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Class (smallest member) of every node of the links (a, b), by alternating stars.

    Each round points the neighbours of a node at the smallest node near it; a round that
    changes nothing ends it. Every round is a written table, so a lost executor costs one round.
    """
    def toward_least(two_way: DataFrame, larger_only: bool) -> DataFrame:
        near = two_way.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        moved = two_way.join(near, "u").filter(F.col("v") > F.col("u") if larger_only else F.col("v") != F.col("m"))
        out = moved.select(F.col("m").alias("a"), F.col("v").alias("b"))
        if not larger_only:
            out = out.unionByName(near.filter("u <> m").select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.filter("a < b").distinct()

    def state(table: DataFrame):
        return tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    table = staged(edges)
    before = state(table)
    while before[0]:
        both = table.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(table.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = staged(toward_least(both, True))
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        after = staged(toward_least(down, False))
        unstage(table)
        unstage(large)
        table, last, before = after, before, state(after)
        if before == last:
            break
    return table.select(F.col("b").alias("fp"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, n: int = SHINGLE, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Class of every row: doc_id, text hash, fp, component_id (smallest id reachable)."""
    rows = staged(fingerprints(docs, n))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    classes = components(links(distinct.select("fp"), max_bits, bucket))
    rooted = distinct.join(classes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    table = staged(rooted.join(least, "root").select("fp", "component_id", "root"))
    return rows.join(table, "fp")


def without_near_duplicates(docs: DataFrame, n: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each class: the smallest id, then the smaller text hash; all columns of docs."""
    rows = near_duplicates(docs, n, max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", TEXT_HASH)
    first = rows.groupBy("root").agg(F.min(order).alias("first")).select("first.*")
    kept = with_text_hash(keep_rows(docs, first))
    return kept.dropDuplicates(["doc_id", TEXT_HASH]).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
