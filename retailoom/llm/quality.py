"""Quality rules in DataFrame functions only: text rules and cross-document line frequency.

Lines are normalised (lower case, digit runs as 0, white space runs as one space, trimmed) and
hashed. A line is over the limit of its host (column ``source``) when more than
``max(MIN_DOCS, min(MAX_SHARE * documents of the host, MAX_DOCS))`` distinct documents hold it,
exact copies of one text counting as one document; so no host, however large, lets a line stay
in more than ``MAX_DOCS`` documents. Lines over the limit are removed; a document is depleted
when at least ``DEPLETED`` of its words stood in such lines.

Text rules: fewer than ten words, or over a fifth of the words in repeated five-word windows.

Null text counts as empty: no words, base_failed. A null host is a host of its own. Lines
without a word are never counted nor removed. Repeated rows get the same verdict each. Extra
columns are ignored (kept by ``apply_rules``). No rows give no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailoom.llm.common import TEXT_HASH, WHITE, WHITE_RUN, staged, with_text_hash

WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
MIN_DOCS = 4
MAX_SHARE = 0.08
MAX_DOCS = 6
DEPLETED = 0.7
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """Words of a text; no empty entries, whatever the white space at its ends."""
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WHITE_RUN))


def with_repeat_words(grams: DataFrame) -> DataFrame:
    """Add n_repeat_words: words covered by windows whose hash (column g) occurs twice or more.

    Only texts with a repeat sort their windows: equal neighbours in (hash, position) order are
    repeats, and sorted repeat positions overlap by less than the window. Each step is a column
    of its own, so it is computed once.
    """
    pair = "array<struct<h:bigint,i:int>>"
    sorted_ = grams.withColumn("pairs", F.when(F.size(F.array_distinct("g")) == F.size("g"), F.array().cast(pair)).otherwise(
        F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = sorted_.withColumn("same", F.filter(
        F.zip_with("pairs", F.slice("pairs", 2, F.greatest(F.size("pairs") - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
        lambda x: x.isNotNull()))
    at = same.withColumn("at", F.sort_array(F.array_distinct(F.flatten("same"))))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda acc, p: F.struct((acc["n"] + F.least(p - acc["last"], F.lit(WINDOW))).alias("n"), p.alias("last")), lambda acc: acc["n"])
    return at.withColumn("n_repeat_words", covered.cast("bigint"))


def normal_line(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), WHITE_RUN, " "), "[0-9]+", "0"), F.lit(WHITE))


def text_rules(docs: DataFrame) -> DataFrame:
    """One row per document row: counts of the whole text and base_failed."""
    text = F.coalesce("text", F.lit(""))
    base = with_text_hash(docs).select("doc_id", "source", TEXT_HASH, text.alias("text"))
    split = base.select("*", words(F.col("text")).alias("w"))
    grams = split.select("doc_id", "source", TEXT_HASH, "text", F.size("w").alias("n"), F.when(F.size("w") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("g"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    chars = F.char_length("text")
    out = with_repeat_words(grams).select(
        "doc_id", "source", TEXT_HASH, F.col("n").cast("bigint").alias("n_words"),
        F.char_length(F.translate("text", WHITE, "")).cast("bigint").alias("word_chars"),
        (chars - F.char_length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def line_rows(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: doc_id, text hash, host, position, hash, words."""
    parts = with_text_hash(docs).select("doc_id", TEXT_HASH, "source", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = parts.select("doc_id", TEXT_HASH, "source", "at", normal_line(F.col("line")).alias("line")).filter("line <> ''")
    spaces = F.char_length("line") - F.char_length(F.translate("line", " ", ""))
    return lines.select("doc_id", TEXT_HASH, "source", "at", F.xxhash64("line").alias("line_hash"), (spaces + 1).cast("bigint").alias("line_words"))


def lines_over_limit(lines: DataFrame, rows: DataFrame, min_docs: int, max_share: float, max_docs: int) -> DataFrame:
    """(host, line hash) pairs held by too many distinct texts of the host; ``rows`` has all texts' hashes."""
    texts = rows.groupBy("source", TEXT_HASH).agg(F.lit(1).alias("one")).groupBy("source").agg(F.count("*").alias("host_docs"))
    # distinct per host, line and text first: partial sums meet any hot line or host early
    held = lines.groupBy("source", "line_hash", TEXT_HASH).agg(F.lit(1).alias("one")).groupBy("source", "line_hash").agg(F.count("*").alias("line_docs"))
    held = held.filter(F.col("line_docs") > min_docs)
    return held.join(texts.withColumnRenamed("source", "host"), F.col("source").eqNullSafe(F.col("host"))).filter(
        F.col("line_docs") > F.greatest(F.lit(float(min_docs)), F.least(F.col("host_docs") * max_share, F.lit(float(max_docs))))).select("host", F.col("line_hash").alias("over"))


def removed_lines(docs: DataFrame, rows: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """Lines over the limit, a row per document row that has any: positions and words removed."""
    lines = staged(line_rows(docs))
    over = lines_over_limit(lines, rows, min_docs, max_share, max_docs)
    hit = lines.join(over, F.col("source").eqNullSafe(F.col("host")) & (F.col("line_hash") == F.col("over"))).dropDuplicates(["doc_id", TEXT_HASH, "source", "at"])
    return hit.groupBy("doc_id", TEXT_HASH, "source").agg(F.collect_list("at").alias("removed"), F.sum("line_words").alias("removed_words"))


def verdicts(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS, depleted: float = DEPLETED) -> DataFrame:
    """Text rules, removed line positions and the verdict of every row."""
    # written once: a later filter on the verdict must not be pushed into the text expressions
    rules = staged(text_rules(docs))
    gone = removed_lines(docs, rules, min_docs, max_share, max_docs).select(F.col("doc_id").alias("__id"), F.col(TEXT_HASH).alias("__h"), F.col("source").alias("__s"), "removed", "removed_words")
    out = rules.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(TEXT_HASH) == F.col("__h")) & F.col("source").eqNullSafe(F.col("__s")), "left")
    out = out.drop("__id", "__h", "__s").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") < depleted * F.col("n_words")))


def apply_rules(docs: DataFrame) -> DataFrame:
    """Kept documents without their lines over the limit, with the columns of docs.

    ``n_chars``, where there is one, becomes the length of the new text.
    """
    keys = staged(verdicts(docs).filter("kept").groupBy("doc_id", TEXT_HASH, "source").agg(F.first("removed").alias("removed")))
    keys = keys.select(F.col("doc_id").alias("__id"), F.col(TEXT_HASH).alias("__h"), F.col("source").alias("__s"), F.col("removed").alias("__gone"))
    keyed = with_text_hash(docs)
    kept = keyed.join(keys, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(TEXT_HASH) == F.col("__h")) & F.col("source").eqNullSafe(F.col("__s")))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    kept = kept.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                                 F.col("removed_words").alias("n_removed_words"))


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from documents),
g as (select doc_id, p, list_aggregate(w[p:p + 4], 'string_agg', ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) p from d where len(w) >= 5)),
r as (select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, g) n from g) where n > 1),
c as (select doc_id, count(distinct q) n from (select doc_id, unnest(range(p, p + 5)) q from r) group by 1),
li as (select doc_id, source, t, trim(regexp_replace(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) x,
         len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) n from (select doc_id, source, t, unnest(l) x from d)),
h as (select source, count(distinct t) nd from d group by 1),
o as (select li.source, x from li join h on h.source is not distinct from li.source group by 1, 2, nd having count(distinct t) > greatest(4, least(0.08 * nd, 6))),
gone as (select doc_id, sum(n) n from li join o on o.source is not distinct from li.source and o.x = li.x group by 1)
select d.doc_id, len(w) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols,
  len(l) - len(list_distinct(l)) n_dup_lines, coalesce(c.n, 0) n_repeat_words,
  len(w) < 10 or 100 * coalesce(c.n, 0) > 20 * len(w) base_failed,
  not (len(w) < 10 or 100 * coalesce(c.n, 0) > 20 * len(w)) and coalesce(gone.n, 0) < 0.7 * len(w) kept,
  cast(coalesce(gone.n, 0) as bigint) n_removed_words
from d left join c on c.doc_id = d.doc_id left join gone on gone.doc_id = d.doc_id
"""
