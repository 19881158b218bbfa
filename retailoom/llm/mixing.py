"""Mixing sources to target weights: temperature, bisected exponent, budgeted block permutations.

Source token shares p are raised to an exponent and normalised: w = p^a / sum p^a. The exponent
in [0, 1] is bisected to the smallest (flattest mix) at which no source is repeated more than
``max_repetition`` times, or to the one whose weights have ``target_entropy`` (nats). The budget
defaults to the least number of tokens at which no source is cut below one pass, so the mix
drops no document; a smaller budget samples sources down.

A source's quota is its weight times the budget: whole passes over all its documents, then part
of one more. For that part the source is cut by hash into about sqrt(documents) blocks, the
blocks are put in hashed order, whole blocks are taken while they fit, and the block that no
longer fits is taken document by document in hashed order while they fit. Sums of blocks run
over at most sqrt(documents) rows, so no source is gathered in one task.

Null text counts as empty; a null source is a source of its own. A source without words has no
share: its documents pass once. Repeated rows are counted and stay together. Rows with null ids
are told apart by text. Extra columns are ignored (kept by ``mixed``). No rows give no rows.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailoom.llm.common import TEXT_HASH, same_row, staged, with_text_hash, word_count

MAX_REPETITION = 2.0
SEED = 8
STEPS = 64
PASSES = 5


def document_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, source, n_rows (repeated rows), n_tokens of one row."""
    rows = with_text_hash(docs).select("doc_id", TEXT_HASH, "source", word_count(F.col("text")).alias("n_tokens"))
    return rows.groupBy("doc_id", TEXT_HASH, "source").agg(F.count("*").alias("n_rows"), F.max("n_tokens").alias("n_tokens"))


def find_exponent(totals: DataFrame, max_repetition: float | None, target_entropy: float | None, budget: float | None) -> float:
    """Bisect the exponent; each pass tries a whole grid of exponents in one aggregate.

    Both measures fall as the exponent grows: repetition towards 1, entropy towards that of the
    shares themselves. The answer is rounded to 6 digits up, so it does not hang on the order of sums.
    """
    shares = totals.filter("tokens > 0").select((F.col("tokens") / totals.agg(F.sum("tokens")).scalar()).alias("p"))
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        grid = [low + (high - low) * i / STEPS for i in range(STEPS + 1)]
        row = shares.agg(*[F.struct(
            F.sum(F.pow("p", F.lit(a))).alias("z"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias("zlog"),
            F.max(F.pow("p", F.lit(a - 1))).alias("top"), F.min(F.pow("p", F.lit(a - 1))).alias("least")) for a in grid]).first()
        if row[0]["z"] is None:
            return 1.0
        def fits(i: int) -> bool:
            m = row[i]
            if target_entropy is not None:
                return math.log(m["z"]) - grid[i] * m["zlog"] / m["z"] <= target_entropy + 1e-12
            passes = m["top"] / m["least"] if budget is None else m["top"] * budget / (m["z"] * everything)
            return passes <= max_repetition + 1e-12
        first = next((i for i in range(STEPS + 1) if fits(i)), STEPS)
        low, high = grid[max(first - 1, 0)], grid[first]
        if first == 0:
            return low
    return min(1.0, -(-high * 1e6 // 1) / 1e6)


def quotas(docs: DataFrame, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, budget: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Token table of the documents, and per source: weight, quota, passes, rest, blocks."""
    tokens = staged(document_tokens(docs))
    totals = staged(tokens.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_rows")).alias("tokens"), F.count("*").alias("n_docs")))
    a = find_exponent(totals, max_repetition, target_entropy, budget)
    everything = totals.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    raised = totals.withColumn("raised", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(everything or 1)), F.lit(a))).otherwise(0.0))
    sums = raised.agg(F.sum("raised").alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("raised"))).alias("full")).first()
    z = sums["z"] or 1.0
    size = float(budget) if budget is not None else (sums["full"] or 0.0) * z
    weighted = raised.withColumn("weight", F.col("raised") / F.lit(z)).withColumn("quota", F.round(F.col("weight") * F.lit(size)).cast("bigint"))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("bigint")
    out = weighted.withColumn("passes", whole).withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("passes") * F.col("tokens")).otherwise(0))
    return tokens, staged(out.withColumn("n_blocks", F.ceil(F.sqrt("n_docs")).cast("bigint")).select(
        F.col("source").alias("of_source"), "weight", "quota", "passes", "rest", "n_blocks"))


def copies(docs: DataFrame, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """How often each document stands in the mix: doc_id, text hash, source, n_tokens, weight, block, copies."""
    tokens, plan = quotas(docs, max_repetition, target_entropy, budget)
    rows = tokens.join(plan, F.col("source").eqNullSafe(F.col("of_source")))
    rows = rows.withColumn("order", F.xxhash64("doc_id", TEXT_HASH, F.lit(seed)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", TEXT_HASH, F.lit(seed + 1)), F.col("n_blocks")))
    rows = rows.withColumn("mass", F.col("n_tokens") * F.col("n_rows")).drop("of_source")
    blocks = rows.groupBy("source", "block", "rest").agg(F.sum("mass").alias("block_mass"))
    blocks = blocks.withColumn("turn", F.xxhash64("source", "block", F.lit(seed + 2)))
    run = Window.partitionBy("source").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = blocks.withColumn("until", F.sum("block_mass").over(run)).withColumn("before", F.col("until") - F.col("block_mass"))
    fate = placed.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), (F.col("until") <= F.col("rest")).alias("all_in"),
                         F.when((F.col("before") < F.col("rest")) & (F.col("until") > F.col("rest")), F.col("rest") - F.col("before")).alias("room"))
    rows = rows.join(fate, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    inside = Window.partitionBy("source", "block").orderBy("order", "doc_id", TEXT_HASH).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows.filter("room is not null").withColumn("extra", (F.sum("mass").over(inside) <= F.col("room")).cast("int"))
    whole = rows.filter("room is null").withColumn("extra", (F.col("all_in") & (F.col("rest") > 0)).cast("int"))
    return whole.unionByName(cut).select("doc_id", TEXT_HASH, "source", "n_rows", "n_tokens", "weight", "block", (F.col("passes") + F.col("extra")).alias("copies"))


def mixed(docs: DataFrame, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """The mix itself: each document as often as its quota says, with the columns of docs."""
    times = copies(docs, max_repetition, target_entropy, budget).filter("copies > 0").select(
        "doc_id", TEXT_HASH, F.col("source").alias("__source"), F.col("copies").alias("__copies"))
    keyed = with_text_hash(docs)
    both = keyed.join(times, same_row(keyed, times) & keyed["source"].eqNullSafe(times["__source"]))
    repeated = both.select(*[keyed[f"`{c}`"] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy"))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return copies(docs).select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "copies")
