"""Spelling variants: words one edit apart, found by a sorted-list dynamic programme.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased (nothing else is
changed). A run whose crc32 of ``<doc_id>:<run>`` (UTF-8, unsigned; a null doc_id is written as
nothing) is divisible by 97 loses its code point at place ``h % length`` (from 0): a fixed rule
that plants misspellings. Words are the distinct results of at least ``MIN_CHARS`` code points
that occur at least ``MIN_COUNT`` times in all texts.

Near words differ by exactly one inserted, deleted or replaced code point. Every such pair shares
its first three code points, or its last two (both words have five or more), so the vocabulary is
scanned twice: grouped by the first three code points, and reversed, grouped by the last two.
Within a group the words are sorted; the scan for one query walks the sorted list as a trie,
keeps the banded rows of the edit matrix for the current prefix, reuses the rows of the common
prefix of adjacent words, and skips every word below a prefix whose band already exceeds one
edit (a bisection to the end of that prefix's range). ``near_in_group`` runs this scan for all
queries of a group side by side: the trie nodes of each depth come from the adjacent common
prefixes, each (query, node) pair holds one band, and a pruned pair drops the node's whole range
of words. A group larger than ``GROUP_WORDS`` is
split: its queries are dealt over buckets by hash, and each bucket holds the whole group's
sorted list, so no pair is lost.

A word's form is its near word of largest count (ties: smallest in code-point order) when that
count is at least twice its own; its root follows forms to the last one. Forms at least double the
count at each step, so chains are short; roots are found by pointer jumping, each round a
written table.

Cases: null or empty texts give no words; very long texts and runs are read whole; repeated rows
count each time; a null doc_id hashes as ``:<run>``; ties of counts resolve by code-point order;
extra columns are ignored; no rows give no words.
"""

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailoom.llm.common import staged, unstage

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
PLANT_EVERY = 97
MIN_CHARS = 5
MIN_COUNT = 3
FORM_RATIO = 2
# words of one (side, key) group held by one task as queries; larger groups split their queries
GROUP_WORDS = 20_000
FAR = 2


def _step(prev: tuple, c: str, i: int, q: str) -> tuple:
    """Band (D[i][i-1], D[i][i], D[i][i+1]) of the edit matrix from the band of row i-1, capped at FAR."""
    m = len(q)
    a = min(prev[1] + 1, prev[0] + (c != q[i - 2]) if i >= 2 else FAR, FAR) if i - 1 <= m else FAR
    b = min(prev[2] + 1, a + 1, prev[1] + (c != q[i - 1]), FAR) if i <= m else FAR
    e = min(b + 1, prev[2] + (c != q[i]), FAR) if i + 1 <= m else FAR
    return a, b, e


def near_in_sorted(words: list[str], queries: list[str]) -> list[tuple[str, str]]:
    """(query, word) for every word of the sorted list one edit from a query."""
    out = []
    for q in queries:
        m = len(q)
        rows = [(FAR, 0, 1 if m >= 1 else FAR)]
        cur = ""
        i = 0
        while i < len(words):
            w = words[i]
            keep = 0
            limit = min(len(cur), len(w))
            while keep < limit and cur[keep] == w[keep]:
                keep += 1
            del rows[keep + 1:]
            cur = w[:keep]
            pruned = False
            for c in w[keep:]:
                band = _step(rows[-1], c, len(rows), q)
                rows.append(band)
                cur += c
                if min(band) >= FAR:
                    i = bisect_left(words, cur[:-1] + chr(ord(cur[-1]) + 1), i + 1)
                    pruned = True
                    break
            if pruned:
                continue
            at = m - (len(w) - 1)
            if 0 <= at <= 2 and rows[-1][at] == 1:
                out.append((q, w))
            i += 1
    return out


def _codes(words: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(words), width), pad, np.int32)
    for i, w in enumerate(words):
        out[i, :len(w)] = [ord(c) for c in w]
    return out


def near_in_group(words: list[str], queries: list[str], block: int = 4096) -> list[tuple[str, str]]:
    """(query, word) pairs one edit apart: the sorted-list scan run for many queries side by side.

    The sorted words form a trie through their adjacent common prefixes: at depth d the nodes are
    the words whose common prefix with the one before is shorter than d. Each (query, node) pair
    holds the band of the edit matrix for that prefix, so words below one node share its rows;
    children take their band from their parent's, and a pair whose band exceeds one edit is
    dropped with the whole range of words below it. Queries go in blocks of ``block``.
    """
    if not words or not queries:
        return []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max())
    codes = _codes(words, width, 0)
    same = codes[1:] == codes[:-1]
    first_diff = np.where(same.all(axis=1), width, same.argmin(axis=1))
    lcp = np.concatenate([[0], np.minimum(first_diff, np.minimum(lengths[1:], lengths[:-1]))])
    positions = np.arange(len(words))
    levels = []  # per depth: node start positions, parent node of each, char, word ends here
    node_of = np.zeros(len(words), np.int64)
    for d in range(1, width + 1):
        starts = np.flatnonzero((lengths >= d) & ((positions == 0) | (lcp < d)))
        deep = lengths >= d
        ids = np.cumsum(np.isin(positions, starts)) - 1
        parents = node_of[starts]
        levels.append((starts, parents, codes[starts, d - 1], lengths[starts] == d))
        node_of = np.where(deep, ids, -1)
    # the empty word, if listed, is one edit from every one-character query
    out = [(x, "") for x in queries if len(x) == 1] if lengths[0] == 0 else []
    for b0 in range(0, len(queries), block):
        qs = queries[b0:b0 + block]
        m = np.fromiter(map(len, qs), np.int64, len(qs))
        qcodes = _codes(qs, int(m.max()) + 2, -2)
        q = np.arange(len(qs))
        node = np.zeros(len(qs), np.int64)
        a = np.full(len(qs), FAR, np.int64)
        bb = np.zeros(len(qs), np.int64)
        e = np.where(m >= 1, 1, FAR)
        for d, (starts, parents, chars, ends) in enumerate(levels, start=1):
            if not len(q):
                break
            lo, hi = np.searchsorted(parents, node, "left"), np.searchsorted(parents, node, "right")
            counts = hi - lo
            rep = np.repeat(np.arange(len(q)), counts)
            offsets = np.concatenate([[0], np.cumsum(counts)[:-1]])
            child = lo[rep] + (np.arange(len(rep)) - offsets[rep])
            q, pa, pb, pe = q[rep], a[rep], bb[rep], e[rep]
            mm = m[q]
            c = chars[child]
            cost = lambda k: (c != qcodes[q, np.clip(k, 0, qcodes.shape[1] - 1)]).astype(np.int64)
            na = np.where(d - 1 <= mm, np.minimum(pb + 1, pa + cost(d - 2) if d >= 2 else FAR), FAR)
            na = np.minimum(na, FAR)
            nb = np.where(d <= mm, np.minimum(np.minimum(pe + 1, na + 1), pb + cost(d - 1)), FAR)
            nb = np.minimum(nb, FAR)
            ne = np.where(d + 1 <= mm, np.minimum(nb + 1, pe + cost(d)), FAR)
            ne = np.minimum(ne, FAR)
            at = mm - (d - 1)
            band = np.stack([na, nb, ne])
            hit = ends[child] & (at >= 0) & (at <= 2)
            hit[hit] = band[at[hit], np.flatnonzero(hit)] == 1
            for qi, wi in zip(q[hit].tolist(), starts[child[hit]].tolist()):
                out.append((qs[qi], words[wi]))
            live = np.minimum(np.minimum(na, nb), ne) < FAR
            q, node, a, bb, e = q[live], child[live], na[live], nb[live], ne[live]
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: planted results of all runs, counted over all texts, long and frequent enough.

    Each run is planted where it stands and counted by word, so the only shuffle holds the
    distinct words of each task (partial aggregation), never the runs themselves.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(RUN), 0)).alias("run"))
    lowered = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = lowered.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    planted = F.expr(
        f"CASE WHEN h % {PLANT_EVERY} = 0 THEN concat(substring(run, 1, int(h % char_length(run))), "
        "substring(run, int(h % char_length(run)) + 2)) ELSE run END")
    words = hashed.select(planted.alias("word")).where(F.char_length("word") >= MIN_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.where(F.col("n") >= MIN_COUNT)


def near_pairs(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, near: every ordered pair of words one edit apart, each once."""
    keyed = words.select(F.lit(0).alias("side"), F.substring("word", 1, 3).alias("key"), F.col("word").alias("form")).unionByName(
        words.select(F.lit(1).alias("side"), F.substring(F.reverse("word"), 1, 2).alias("key"), F.reverse("word").alias("form")))
    sizes = keyed.groupBy("side", "key").agg(F.ceil(F.count(F.lit(1)) / group_words).cast("int").alias("parts"))
    dealt = keyed.join(sizes, ["side", "key"]).select(
        "side", "key", "form", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("bucket"),
        F.pmod(F.xxhash64("form"), F.col("parts")).alias("mine"))
    dealt = dealt.select("side", "key", "bucket", "form", (F.col("bucket") == F.col("mine")).alias("is_query"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        listed = sorted(pdf["form"].tolist())
        queries = pdf.loc[pdf["is_query"], "form"].tolist()
        found = near_in_group(listed, queries)
        if pdf["side"].iat[0] == 1:
            found = [(q[::-1], w[::-1]) for q, w in found]
        return pd.DataFrame(found, columns=["word", "near"])

    pairs = dealt.groupBy("side", "key", "bucket").applyInPandas(scan, "word string, near string")
    return pairs.distinct()


def spelling_forms(docs: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = staged(word_counts(docs))
    pairs = near_pairs(words, group_words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    takes = F.col("best.near_n") >= FORM_RATIO * F.col("n")
    forms = staged(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(takes, F.col("best.near")).alias("form"),
        F.when(takes, F.col("best.near_n")).cast("bigint").alias("form_n")))
    unstage(words)
    roots = follow(forms.select("word", F.coalesce("form", "word").alias("to")))
    out = forms.join(roots, "word").select("word", "form", "root", F.col("n").cast("bigint").alias("n"), "n_near", "form_n")
    return out


def follow(links: DataFrame) -> DataFrame:
    """word, root: pointer jumping over (word, to) until every pointer stands still."""
    step, written = links, None
    while True:
        nxt = staged(step.alias("a").join(step.alias("b"), F.col("a.to") == F.col("b.word")).select(
            F.col("a.word").alias("word"), F.col("b.to").alias("to"), (F.col("a.to") != F.col("b.to")).alias("moved")))
        moved = nxt.where("moved").limit(1).count()
        if written is not None:
            unstage(written)
        written, step = nxt, nxt.select("word", "to")
        if not moved:
            return step.select("word", F.col("to").alias("root"))


def query(docs: DataFrame) -> DataFrame:
    return spelling_forms(docs)
