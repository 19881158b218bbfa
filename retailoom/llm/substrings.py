"""Substring dedup by recompression.

A window is ``WINDOW`` consecutive words of one document. Words covered by a window whose words
also stand, as a window, in a document with a smaller doc_id are removed; windows are judged on
the input.

Recompression rewrites the words level by level: in a run round, a run of one symbol becomes a
symbol named after (symbol, length); in a pair round, each symbol falls to the left or right
class by its name and a left symbol followed by a right one becomes a symbol named after the
pair. Names are hashes of what they stand for, so all tasks give equal runs and pairs the same
name and a round needs no dictionary to be shuffled. With every symbol goes the range of words
it depends on: itself and the neighbours that decided its fate. A symbol whose range lies in a
window is an interior symbol: it stands at the same place wherever these words stand.

Each window is known by one interior symbol of the highest level it has (the smallest name
among several). As this choice depends on the words of the window alone, equal windows choose
the same symbol at the same place. A symbol occurrence stands for its windows together, with a
fingerprint of all their words (the reach). Then, in Spark:

1. symbols are grouped by name: only names in two documents or more go on;
2. a name with one reach has equal windows everywhere: all but the smallest document repeat it;
3. of a name with several reaches, all but the smallest document of each reach repeat it; that
   document's own windows are compared one by one by a 128-bit fingerprint of their words.

Sums by name, reach or window are partial sums first; no group is gathered. Long texts are cut
into segments that overlap by a window, which changes nothing.

Null and empty texts have no words. A row with a null id neither loses words nor takes them from
others. Rows sharing an id count as one document and never repeat each other. Extra columns are
ignored. No rows give no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailoom.llm.common import TEXT_HASH, WordHashes, arrow_batch, joined_hashes, mix, signed, slices, staged, unstage, with_text_hash

WINDOW = 50
ROUNDS = 14
RUN_ROUNDS = (0, 4, 8, 12)
SEGMENT = 100_000
FAR = 1 << 29  # twice this still fits 32 bits
ODD = np.uint64(0x9E3779B97F4A7C15)
ODD_TOO = np.uint64(0xD1342543DE82EF95)


def shifted(values: np.ndarray, by: int, edge: np.ndarray, outside: int) -> np.ndarray:
    """Value of the neighbour before (by = 1) or after (by = -1); ``outside`` at segment ends."""
    out = np.roll(values, by)
    out[edge] = outside
    return out


def compress_runs(sym, lo, hi, seg, level):
    same = (sym[1:] == sym[:-1]) & (seg[1:] == seg[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    length = np.diff(np.concatenate([head, [len(sym)]]))
    tail = head + length - 1
    first = np.concatenate([[True], seg[1:] != seg[:-1]])
    last = np.concatenate([seg[1:] != seg[:-1], [True]])
    # a run ends where its neighbours differ, so it depends on both
    before, after = shifted(lo, 1, first, -FAR), shifted(hi, -1, last, FAR)
    names = sym[head].copy()
    run = length > 1
    names[run] = joined_hashes([names[run], length[run].astype(np.uint64), np.full(run.sum(), 2 * level + 1, np.uint64)])
    return names, np.minimum(lo[head], before[head]), np.maximum(hi[tail], after[tail]), seg[head]


def compress_pairs(sym, lo, hi, seg, level):
    left = (mix(sym + np.uint64(level * int(ODD) % (1 << 64))) >> np.uint64(17)) & np.uint64(1) == 1
    inner = seg[1:] == seg[:-1]
    pair = left[:-1] & ~left[1:] & inner
    opens = np.concatenate([pair, [False]])
    kept = np.flatnonzero(~np.concatenate([[False], pair]))
    after = np.minimum(kept + 1, len(sym) - 1)
    first, last = np.concatenate([[True], ~inner]), np.concatenate([~inner, [True]])
    opening, lefts = opens[kept], left[kept]
    # a single left symbol depends on what follows it, a single right one on what precedes it
    before, behind = shifted(lo, 1, first, -FAR)[kept], shifted(hi, -1, last, FAR)[kept]
    new_lo = np.where(lefts, lo[kept], np.minimum(before, lo[kept]))
    new_hi = np.where(opening, hi[after], np.where(lefts, np.maximum(behind, hi[kept]), hi[kept]))
    names = sym[kept].copy()
    names[opening] = joined_hashes([sym[kept[opening]], sym[after[opening]], np.full(opening.sum(), 2 * level, np.uint64)])
    return names, new_lo, new_hi, seg[kept]


def levels(hashes: np.ndarray, seg: np.ndarray, rounds: int = ROUNDS):
    """(names, first word, end word of the range depended on) of each level."""
    at = np.arange(len(hashes), dtype=np.int32)
    state = hashes, at, at + np.int32(1), seg
    out = [state[:3]]
    for level in range(rounds):
        if level in RUN_ROUNDS:
            state = compress_runs(*state, level)
        state = compress_pairs(*state, level)
        out.append(state[:3])
    return out


def anchors(hashes: np.ndarray, seg: np.ndarray, starts: np.ndarray, window: int = WINDOW):
    """Chosen symbols: name, place and level mixed into one hash, first and last window.

    ``starts`` marks the positions where a window begins.
    """
    open_ = starts.copy()
    found = []
    for level, (names, lo, hi) in reversed(list(enumerate(levels(hashes, seg)))):
        inside = np.flatnonzero(hi - lo <= window)
        todo = np.flatnonzero(open_)
        if not len(todo):
            break
        if not len(inside):
            continue
        lo, hi, key = lo[inside], hi[inside], mix(names[inside] + np.uint64(level))
        a = np.searchsorted(lo, todo, "left")
        b = np.searchsorted(hi, todo + window, "right") - 1
        has = a <= b
        todo, a, b = todo[has], a[has], b[has]
        if not len(todo):
            continue
        best, least = a.copy(), key[a]
        for step in range(1, int((b - a).max()) + 1):
            more = np.flatnonzero(a + step <= b)
            at = a[more] + step
            better = key[at] < least[more]
            best[more[better]], least[more[better]] = at[better], key[at[better]]
        open_[todo] = False
        order = np.argsort(best, kind="stable")
        groups, begin = np.unique(best[order], return_index=True)
        end = np.concatenate([begin[1:], [len(order)]]) - 1
        found.append((key[groups], lo[groups], todo[order[begin]], todo[order[end]]))
    if not found:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


class Reaches:
    """Fingerprints of word ranges, from prefix sums of a polynomial over the word hashes."""

    def __init__(self, hashes: np.ndarray, odd: np.uint64):
        n = len(hashes)
        inverse = np.uint64(pow(int(odd), -1, 1 << 64))
        power = np.cumprod(np.full(n, odd, np.uint64)) if n else hashes
        self.back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, inverse, np.uint64))])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ odd) * power, dtype=np.uint64)])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin])


def segments(counts: list[int], window: int):
    """(row, first word, end word) of every segment; its windows start in its first SEGMENT words."""
    for row, n in enumerate(counts):
        for at in range(0, max(n - window + 1, 0), SEGMENT):
            yield row, at, min(at + SEGMENT + window - 1, n)


def anchor_rows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each chosen symbol occurrence: name, reach, first and last window."""
    ddl = f"doc_id bigint, {TEXT_HASH} bigint, name bigint, reach bigint, w0 int, w1 int"

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for begin, end in slices(texts):
                by_row = [cache.of((t or b"").split()) for t in texts[begin:end]]
                parts = list(segments([len(h) for h in by_row], window))
                if not parts:
                    continue
                hashes = np.concatenate([by_row[r][a:b] for r, a, b in parts])
                sizes = np.array([b - a for _, a, b in parts])
                seg = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
                base = np.cumsum(sizes) - sizes
                starts = np.arange(len(hashes)) - base[seg] <= sizes[seg] - window
                name, lo, w0, w1 = anchors(hashes, seg, starts, window)
                of = seg[w0]
                reach = joined_hashes([Reaches(hashes, ODD).of(w0, w1 + window), (lo - w0).astype(np.uint64), (w1 - w0).astype(np.uint64)])
                shift = np.array([a for _, a, _ in parts])[of] - base[of]
                rows = pa.array(begin + np.array([r for r, _, _ in parts])[of])
                yield arrow_batch(ddl, batch.column(0).take(rows), batch.column(1).take(rows), signed(name), signed(reach), w0 + shift, w1 + shift)

    rows = with_text_hash(docs).filter("doc_id is not null").select(F.col("doc_id").cast("bigint"), TEXT_HASH, F.col("text").cast("binary"))
    return rows.mapInArrow(run, ddl)


def window_rows(docs: DataFrame, ranges: DataFrame, window: int = WINDOW) -> DataFrame:
    """128-bit fingerprints of the windows in the given ranges: doc_id, text hash, w, f1, f2."""
    ddl = f"doc_id bigint, {TEXT_HASH} bigint, w int, f1 bigint, f2 bigint"
    wanted = ranges.groupBy("doc_id", TEXT_HASH).agg(F.collect_list("w0").alias("w0"), F.collect_list("w1").alias("w1"))
    keyed = with_text_hash(docs).select(F.col("doc_id").cast("bigint"), TEXT_HASH, F.col("text").cast("binary").alias("text"))

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            for doc, text_hash, text, w0, w1 in zip(*[c.to_pylist() for c in batch.columns]):
                hashes = cache.of(text.split())
                w = np.flatnonzero(covered(len(hashes), w0, w1, 1))
                f1, f2 = (signed(Reaches(hashes, odd).of(w, w + window)) for odd in (ODD, ODD_TOO))
                yield arrow_batch(ddl, np.full(len(w), doc), np.full(len(w), text_hash), w, f1, f2)

    rows = keyed.join(wanted, ["doc_id", TEXT_HASH]).select("doc_id", TEXT_HASH, "text", "w0", "w1")
    return rows.mapInArrow(run, ddl)


def covered(n: int, w0: list[int], w1: list[int], width: int) -> np.ndarray:
    """Mask over n positions of the ranges [w0, w1 + width)."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.asarray(w0, np.int64), 1)
    np.add.at(edges, np.minimum(np.asarray(w1, np.int64) + width, n), -1)
    return np.cumsum(edges[:-1]) > 0


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows [w0, w1] of documents whose words stand in a document with a smaller id."""
    chosen = staged(anchor_rows(docs, window))
    names = chosen.groupBy("name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.min("reach").alias("r0"), F.max("reach").alias("r1"))
    # tables of unique keys are written, so that a join may split the rows of a frequent key
    names = staged(names.filter("least < most").select("name", "least", (F.col("r0") != F.col("r1")).alias("differs")))
    shared = staged(chosen.join(names, "name"))
    unstage(chosen)
    alike = shared.filter(~F.col("differs") & (F.col("doc_id") > F.col("least")))
    several = shared.filter("differs")
    firsts = staged(several.groupBy("name", "reach").agg(F.min("doc_id").alias("first")))
    placed = several.join(firsts, ["name", "reach"])
    later = placed.filter("doc_id > first")
    windows = staged(window_rows(docs, placed.filter("doc_id = first"), window))
    least = windows.groupBy("f1", "f2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    least = staged(least.select("f1", "f2", "least"))
    single = windows.join(least, ["f1", "f2"]).filter("doc_id > least").select("doc_id", TEXT_HASH, F.col("w").alias("w0"), F.col("w").alias("w1"))
    columns = ["doc_id", TEXT_HASH, "w0", "w1"]
    return alike.select(*columns).unionByName(later.select(*columns)).unionByName(single)


def _with_removed(docs: DataFrame, ddl: str, work, window: int) -> DataFrame:
    """Run ``work(words, kept mask)`` over every row; its values follow doc_id and text hash."""
    found = repeated_windows(docs, window).groupBy("doc_id", TEXT_HASH).agg(F.collect_list("w0").alias("w0"), F.collect_list("w1").alias("w1"))
    keyed = with_text_hash(docs).select(F.col("doc_id").cast("bigint"), TEXT_HASH, F.col("text").cast("binary").alias("text"))
    rows = keyed.join(found, ["doc_id", TEXT_HASH], "left").select("doc_id", TEXT_HASH, "text", "w0", "w1")
    ddl = f"doc_id bigint, {TEXT_HASH} bigint, " + ddl

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            w0, w1 = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            out = []
            for text, a, b in zip(texts, w0, w1):
                words = (text or b"").split()
                out.append(work(words, ~covered(len(words), a, b, window) if a else None))
            yield arrow_batch(ddl, batch.column(0), batch.column(1), *zip(*out)) if out else arrow_batch(ddl, *[[]] * (2 + ddl.count(",") - 1))

    return rows.mapInArrow(run, ddl)


def kept_words(words: list[bytes], kept: np.ndarray | None) -> list[bytes]:
    return words if kept is None else [words[i] for i in np.flatnonzero(kept).tolist()]


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text hash, number of words, removed words and the text left (words joined by one space)."""
    def work(words, kept):
        left = kept_words(words, kept)
        return len(words), len(words) - len(left), b" ".join(left).decode()
    return _with_removed(docs, "n_words bigint, n_removed bigint, text string", work, window)


def query(docs: DataFrame) -> DataFrame:
    def work(words, kept):
        left = kept_words(words, kept)
        return len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()
    return _with_removed(docs, "n_words bigint, n_removed bigint, kept_sha256 string", work, WINDOW).drop(TEXT_HASH)


ORACLE = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
win as (select doc_id, p, list_aggregate(w[p:p + 49], 'string_agg', ' ') s from (select doc_id, w, unnest(range(1, len(w) - 48)) p from d where len(w) >= 50)),
least as (select s, min(doc_id) f from win group by 1),
gone as (select distinct doc_id, q from (select win.doc_id, unnest(range(p, p + 50)) q from win join least using (s) where f < doc_id)),
word as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) q from d),
kept as (select doc_id, string_agg(x, ' ' order by q) t, count(*) n from word anti join gone using (doc_id, q) group by 1)
select d.doc_id, len(w) n_words, len(w) - coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept on kept.doc_id = d.doc_id
"""
