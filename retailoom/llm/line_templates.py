"""Line dedup by a log-template tree.

A line is parsed by its number of tokens and its first ``LEAD`` tokens; tokens with a digit are
variable fields, written ``<*>``. Lines of one leaf of this tree of fixed depth differ in later
tokens only. In a leaf, a token stays part of the template where at least ``MIN_DOCS`` documents
have it at that place, else the field is variable as well. A template recurs when at least
``MIN_DOCS`` documents have a line of it and at least ``CONSTANT`` of its tokens are constant; the
lines of recurring templates are dropped from all documents. Being sums over all lines, templates
do not depend on the order of lines.

Leaves are counted for all lines as narrow rows. A bit filter of fixed size over the leaves that
enough documents share then picks the lines to look at on a second scan; false positives are
filtered by the exact join. Equal lines of a leaf are one row with their number of documents, so
frequent lines and copied documents cost one row, and sums are partial before they are shuffled.

Null texts have no lines. Lines without a token are never counted nor dropped. Rows sharing id and
text count as one document. Extra columns are ignored. No rows give no rows.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailoom.llm.common import TEXT_HASH, arrow_batch, signed, staged, unstage, with_text_hash
from retailoom.llm.decontaminate import FILTER_BITS, bit_filter, passes

LEAD = 3
MIN_DOCS = 10
CONSTANT = 0.5
FIELD = b"<*>"
HAS_DIGIT = re.compile(rb"[0-9]")


def masked(tokens: list[bytes]) -> list[bytes]:
    return [FIELD if HAS_DIGIT.search(t) else t for t in tokens]


def leaf_key(tokens: list[bytes], lead: int) -> int:
    return xxhash.xxh64_intdigest(b"%d %s" % (len(tokens), b" ".join(masked(tokens[:lead]))))


def line_tokens(text: bytes | None):
    """(position, tokens) of each line with a token."""
    for at, line in enumerate((text or b"").split(b"\n")):
        if tokens := line.split():
            yield at, tokens


def _rows(docs: DataFrame) -> DataFrame:
    return with_text_hash(docs).select(F.col("doc_id").cast("bigint"), TEXT_HASH, F.col("text").cast("binary"))


def leaves(docs: DataFrame, lead: int = LEAD) -> DataFrame:
    """The leaves a document has lines in: doc_id, text hash, h (leaf)."""
    ddl = f"doc_id bigint, {TEXT_HASH} bigint, h bigint"

    def run(batches):
        for batch in batches:
            owner, keys = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                own = {leaf_key(tokens, lead) for _, tokens in line_tokens(text)}
                owner += [i] * len(own)
                keys += own
            at = pa.array(owner, pa.int64())
            yield arrow_batch(ddl, batch.column(0).take(at), batch.column(1).take(at), signed(np.array(keys, np.uint64)))

    return _rows(docs).mapInArrow(run, ddl)


def lines_in(docs: DataFrame, shared: DataFrame, lead: int, filter_bits: int) -> DataFrame:
    """Lines whose leaf passes the filter: doc_id, text hash, at, h, line (variable fields masked)."""
    words = docs.sparkSession.sparkContext.broadcast(bit_filter(shared, filter_bits))
    ddl = f"doc_id bigint, {TEXT_HASH} bigint, at int, h bigint, line binary"

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = list(line_tokens(text))
                keys = np.array([leaf_key(tokens, lead) for _, tokens in found], np.uint64)
                for j in np.flatnonzero(passes(words.value, keys)).tolist() if found else []:
                    rows.append((i, found[j][0], int(signed(keys[j:j + 1])[0]), b" ".join(masked(found[j][1]))))
            if rows:
                owner, at, keys, lines = zip(*rows)
                owner = pa.array(owner, pa.int64())
                yield arrow_batch(ddl, batch.column(0).take(owner), batch.column(1).take(owner), at, keys, lines)

    return _rows(docs).mapInArrow(run, ddl).join(shared, "h")


def recurring(docs: DataFrame, lead: int = LEAD, min_docs: int = MIN_DOCS, constant: float = CONSTANT, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Lines in shared leaves with their template, and the recurring templates (h, template)."""
    per_doc = leaves(docs, lead).groupBy("h", "doc_id", TEXT_HASH).agg(F.lit(1).alias("one"))
    shared = staged(per_doc.groupBy("h").count().filter(F.col("count") >= min_docs).select("h"))
    lines = staged(lines_in(docs, shared, lead, filter_bits).withColumn("line_id", F.xxhash64("h", "line")))
    by_text = lines.groupBy("line_id", "h", "line", "doc_id", TEXT_HASH).agg(F.lit(1).alias("one"))
    distinct = by_text.groupBy("line_id", "h", "line").agg(F.count("*").alias("n_docs"))
    fields = distinct.select("line_id", "h", "n_docs", F.posexplode(F.split(F.decode("line", "UTF-8"), " ")).alias("place", "token"))
    # a constant field is one number: narrow rows, however long lines and tokens are
    fields = staged(fields.filter(F.col("token") != FIELD.decode()).select("line_id", "n_docs", F.xxhash64("h", "place", "token").alias("field")))
    # every line has one token at a place, so the documents of a field are those of its lines
    known = fields.groupBy("field").agg(F.sum("n_docs").alias("support")).filter(F.col("support") >= min_docs).select("field")
    templates = fields.join(known, "field", "left_semi").groupBy("line_id").agg(F.bit_xor("field").alias("template"), F.count("*").alias("n_constant"))
    length = F.size(F.split(F.decode("line", "UTF-8"), " "))
    sized = lines.select("doc_id", TEXT_HASH, "at", "h", "line_id", length.alias("n_tokens"))
    # a document may have several lines of one template: count documents, not lines
    held = staged(sized.join(templates, "line_id").filter(F.col("n_constant") >= constant * F.col("n_tokens")).select("doc_id", TEXT_HASH, "at", "h", "template"))
    unstage(lines)
    unstage(fields)
    per_doc = held.groupBy("h", "template", "doc_id", TEXT_HASH).agg(F.lit(1).alias("one"))
    often = per_doc.groupBy("h", "template").count().filter(F.col("count") >= min_docs)
    return held, staged(often.select("h", "template"))  # written, so that the join may split a frequent template


def dropped_lines(docs: DataFrame, lead: int = LEAD, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """Positions of the dropped lines, a row per document that has any."""
    held, often = recurring(docs, lead, min_docs, constant)
    hit = held.join(often, ["h", "template"], "left_semi")
    return hit.groupBy("doc_id", TEXT_HASH).agg(F.sort_array(F.collect_set("at")).alias("dropped"))


def without_recurring(docs: DataFrame, lead: int = LEAD, min_docs: int = MIN_DOCS, constant: float = CONSTANT) -> DataFrame:
    """All rows, with the columns of docs, texts without their dropped lines."""
    gone = dropped_lines(docs, lead, min_docs, constant)
    keyed = with_text_hash(docs)
    both = keyed.join(gone.select(F.col("doc_id").alias("__id"), F.col(TEXT_HASH).alias("__h"), F.col("dropped").alias("__gone")),
                      keyed["doc_id"].eqNullSafe(F.col("__id")) & (keyed[TEXT_HASH] == F.col("__h")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return both.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    """doc_id, lines with a token, dropped lines, positions of the dropped lines."""
    gone = staged(dropped_lines(docs))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col(TEXT_HASH).alias("__h"), "dropped")
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    rows = with_text_hash(docs).select("doc_id", TEXT_HASH, lines.cast("bigint").alias("n_lines"))
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(TEXT_HASH) == F.col("__h")), "left")
    return both.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"), F.concat_ws(" ", F.transform("dropped", lambda x: x.cast("string"))).alias("dropped"))


ORACLE = r"""
with l as (select doc_id, pos, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') w
  from (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) pos from documents)),
m as (select doc_id, pos, list_transform(w, lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) w from l where len(w) > 0),
k as (select *, cast(len(w) as varchar) || ' ' || array_to_string(w[1:3], ' ') leaf, array_to_string(w, ' ') line from m),
shared as (select leaf from k group by 1 having count(distinct doc_id) >= 10),
c as (select leaf, line, any_value(w) w, count(distinct doc_id) n from k where leaf in (select leaf from shared) group by 1, 2),
t as (select leaf, line, n, unnest(w) token, unnest(range(len(w))) place from c),
known as (select leaf, place, token from t where token <> '<*>' group by 1, 2, 3 having sum(n) >= 10),
f as (select t.leaf, t.line, t.place, coalesce(known.token, '<*>') field from t left join known on known.leaf = t.leaf and known.place = t.place and known.token = t.token),
template as (select leaf, line, list(field order by place) template from f group by 1, 2 having avg(case when field <> '<*>' then 1 else 0 end) >= 0.5),
held as (select doc_id, pos, leaf, template from k join template using (leaf, line)),
often as (select leaf, template from held group by 1, 2 having count(distinct doc_id) >= 10),
gone as (select doc_id, count(*) n, string_agg(cast(pos as varchar), ' ' order by pos) dropped from held join often using (leaf, template) group by 1)
select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(gone.n, 0) n_dropped, coalesce(dropped, '') dropped
from documents d left join (select doc_id, count(*) n_lines from m group by 1) x on x.doc_id = d.doc_id left join gone on gone.doc_id = d.doc_id
"""
