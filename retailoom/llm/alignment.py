"""Cross-tokenizer alignment: links between the tokens of two vocabularies, counted by pair bitmaps.

Each text is encoded twice without special tokens (their strings inside a text are plain text):
``" " + text`` by the byte-level vocabulary (A), and ``text`` by the piece vocabulary (B), which
adds the leading space itself. A's ids come from the rank-synchronous merger of ``token_counts``
over the same file (the library's ids, tested; about half its time here), B's from the library. A token's bytes are its A entry decoded from the byte alphabet, or
its B piece in UTF-8 with U+2581 as a space and ``<0xHH>`` as byte HH. Where both sequences spell
``" " + text`` exactly, the byte offsets at which an A token and a B token both end cut them into
groups, and each such pair of tokens ending together is a link.

Corpus counts go through an inverted index of id pairs. Documents are numbered once (a written
table, so a lost executor renumbers nothing). Each task turns its links into compressed document
bitmaps per (A id, B id, plane, bucket of 65536 numbers): sorted 16-bit positions below 4096
documents, a 65536-bit map above. Plane -1 holds the documents that have the pair; plane k the
documents whose multiplicity of the pair has bit k set. Containers of one bucket made by two tasks
hold different documents, as do different buckets, so the OR of all is their union and popcounts add: a pair's document count is the popcount of
plane -1, its link count the sum of 2^k times the popcount of plane k. The postings of each
document then take the scores back: the pair's count, and whether it is the highest count of its
B id. Joins on a pair are salted, since one pair (the space before a common word) can hold a
third of all links.

Cases: null, empty, or texts whose A or B bytes differ from ``" " + text`` (a normalised or
unknown piece) have no tokens: zeros and an empty ``groups_sha256``. Null and repeated ids are
separate documents, each counted. Very long texts are encoded whole. Extra columns are ignored;
no rows give no rows.
"""

import hashlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailoom.llm.common import arrow_rows, ranges, staged
from retailoom.llm.token_counts import PairMerger, byte_symbols

A_TOKENIZER = "byte_bpe_50k.json"
B_TOKENIZER = "piece_bpe_32k.model"
BUCKET_BITS = 16
ARRAY_LIMIT = 4096
SALT = 16
# bytes of text encoded together (a longer text alone)
SLICE_BYTES = 1 << 20
# documents a task sends to its worker at once
BATCH_ROWS = 1000
# links a task turns into containers at once
FLUSH_LINKS = 500_000
SPACE_PIECE = "▁"

_aligners: dict[tuple[str, str], "Aligner"] = {}

DOC_DDL = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
           "link_a array<int>, link_b array<int>, link_m array<int>")
DOC_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("link_a", pa.list_(pa.int32())), ("link_b", pa.list_(pa.int32())), ("link_m", pa.list_(pa.int32()))])


def _path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class Aligner:
    """Both encoders of a worker and the bytes of every token of each."""

    def __init__(self, a_name: str, b_name: str):
        import json

        import sentencepiece
        # A is encoded by rank-synchronous merging of the same vocabulary (equal ids, tested)
        self.merger = PairMerger(_path(a_name))
        back = {s: b for b, s in enumerate(byte_symbols())}
        with open(_path(a_name), encoding="utf-8") as f:
            spec = json.load(f)
        vocab = dict(spec["model"]["vocab"])
        vocab.update({t["content"]: t["id"] for t in spec.get("added_tokens", [])})
        del spec
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            a_bytes[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        del vocab
        self.b = sentencepiece.SentencePieceProcessor(model_file=_path(b_name))
        b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_PIECE, " ").encode())
        # only flat arrays are kept: a worker holds each table once, without a Python object per entry
        self.a_size = len(a_bytes)
        self.a_len = np.array([len(x) for x in a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in b_bytes], np.int64)
        self.a_flat, self.a_off = _flat(a_bytes)
        self.b_flat, self.b_off = _flat(b_bytes)
        # decimal digits and a comma of every A id, then of every B id (shifted by the size of A)
        digits = [b"%d," % i for i in range(len(a_bytes))] + [b"%d," % i for i in range(len(b_bytes))]
        self.d_flat, self.d_off = _flat(digits)
        self.d_len = np.array([len(x) for x in digits], np.int64)

    def align(self, texts: list[str], a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray) -> tuple:
        """All texts side by side, their ids in turn: n_a, n_b, n_groups, n_links, digests, and the
        links as (text, a id, b id, multiplicity), ascending by text."""
        n = len(texts)
        raw = [(" " + t).encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, n)
        a_of, b_of = np.repeat(np.arange(n), a_n), np.repeat(np.arange(n), b_n)
        a_len, b_len = self.a_len[a], self.b_len[b]
        spelt = (size > 1) & (np.bincount(a_of, a_len, n) == size) & (np.bincount(b_of, b_len, n) == size)
        # only texts of the right length on both sides line up byte by byte
        same = spelt.copy()
        target = np.frombuffer(b"".join(r for r, ok in zip(raw, spelt) if ok), np.uint8)
        where, ends = np.flatnonzero(spelt), np.cumsum(size[spelt])
        for flat, off, lens, ids, of in ((self.a_flat, self.a_off, a_len, a, a_of), (self.b_flat, self.b_off, b_len, b, b_of)):
            on = spelt[of]
            wrong = np.flatnonzero(_gather(flat, off, lens[on], ids[on]) != target)
            same[where[np.searchsorted(ends, wrong, "right")]] = False
        empty = np.zeros(n, bool)
        empty[a_of[a_len == 0]] = empty[b_of[b_len == 0]] = True
        fast = same & ~empty
        counts = np.zeros((4, n), np.int64)
        digests = [""] * n
        links = [self._align_fast(a[fast[a_of]], b[fast[b_of]], np.flatnonzero(fast), a_n, b_n, counts, digests)]
        a_ends, b_ends = np.cumsum(a_n), np.cumsum(b_n)
        for i in np.flatnonzero(same & empty).tolist():
            *counts[:, i], digests[i], la, lb, lm = self.align_slowly(
                a[a_ends[i] - a_n[i]:a_ends[i]].tolist(), b[b_ends[i] - b_n[i]:b_ends[i]].tolist())
            links.append((np.full(len(la), i), np.array(la, np.int64), np.array(lb, np.int64), np.array(lm, np.int64)))
        if len(links) > 1:
            links = [tuple(map(np.concatenate, zip(*links)))]
            order = np.argsort(links[0][0], kind="stable")
            links = [tuple(x[order] for x in links[0])]
        return *counts, digests, links[0]

    def _align_fast(self, a, b, docs, a_n, b_n, counts, digests) -> tuple:
        """Texts without empty tokens, one after the other: every byte offset ends at most one token a side."""
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        total = int(a_end[-1]) + 1 if len(a_end) else 1
        ends_a, ends_b = np.zeros(total, bool), np.zeros(total, bool)
        ends_a[a_end], ends_b[b_end] = True, True
        a_cut, b_cut = ends_b[a_end], ends_a[b_end]  # tokens that end where one of the other side ends
        doc = np.repeat(docs, a_n[docs])[a_cut]
        counts[0, docs], counts[1, docs] = a_n[docs], b_n[docs]
        counts[2] = counts[3] = np.bincount(doc, minlength=counts.shape[1])
        b_size = len(self.b_len)
        keys, times = np.unique((doc * self.a_size + a[a_cut]) * b_size + b[b_cut], return_counts=True)
        pairs, link_b = np.divmod(keys, b_size)
        link_doc, link_a = np.divmod(pairs, self.a_size)
        # the digest text: groups in order, A ids, '|', B ids; ids joined by ',', groups by ';'
        a_first = np.concatenate([[0], np.flatnonzero(a_cut) + 1])
        b_first = np.concatenate([[0], np.flatnonzero(b_cut) + 1])
        a_at = np.arange(len(a)) + b_first[np.cumsum(a_cut) - a_cut]
        b_at = np.arange(len(b)) + a_first[np.cumsum(b_cut) - b_cut + 1]
        ids = np.empty(len(a) + len(b), np.int64)
        ids[a_at], ids[b_at] = a, b + self.a_size
        width = self.d_len[ids]
        last = np.cumsum(width) - 1
        text = _gather(self.d_flat, self.d_off, width, ids)
        text[last[a_at[a_cut]]] = ord("|")
        text[last[b_at[b_cut]]] = ord(";")
        stops = last[np.cumsum((a_n + b_n)[docs]) - 1].tolist()
        text, begin = text.tobytes(), 0
        for i, stop in zip(docs.tolist(), stops):
            digests[i] = hashlib.sha256(text[begin:stop]).hexdigest()
            begin = stop + 1
        return link_doc, link_a, link_b, times

    def align_slowly(self, a_ids: list[int], b_ids: list[int]) -> tuple:
        """The same for sequences with empty tokens: every pair of tokens ending together is a link."""
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        cuts = np.intersect1d(a_end, b_end)
        a_hi, b_hi = np.searchsorted(a_end, cuts, "right"), np.searchsorted(b_end, cuts, "right")
        a_lo, b_lo = np.searchsorted(a_end, cuts, "left"), np.searchsorted(b_end, cuts, "left")
        links = Counter()
        for lo_a, hi_a, lo_b, hi_b in zip(a_lo.tolist(), a_hi.tolist(), b_lo.tolist(), b_hi.tolist()):
            for x in a_ids[lo_a:hi_a]:
                for y in b_ids[lo_b:hi_b]:
                    links[(x, y)] += 1
        groups, pa_, pb_ = [], 0, 0
        for ha, hb in zip(a_hi.tolist(), b_hi.tolist()):
            groups.append(",".join(map(str, a_ids[pa_:ha])) + "|" + ",".join(map(str, b_ids[pb_:hb])))
            pa_, pb_ = ha, hb
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        pairs = list(links.items())
        return (len(a_ids), len(b_ids), len(cuts), sum(links.values()), digest,
                [p[0][0] for p in pairs], [p[0][1] for p in pairs], [p[1] for p in pairs])

    def batch(self, texts: list[str]) -> list[pa.Array]:
        """The columns of DOC_SCHEMA behind doc_id."""
        a, a_n = self.merger.encode_flat([" " + t for t in texts])
        # a task has one core; threads of a pool would each keep memory of their own
        b_ids = self.b.encode(texts, num_threads=1)
        b_n = np.fromiter(map(len, b_ids), np.int64, len(b_ids))
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, int(b_n.sum()))
        *columns, (doc, *links) = self.align(texts, a.astype(np.int64), a_n, b, b_n)
        offsets = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
        return ([pa.array(c, t) for c, t in zip(columns, DOC_SCHEMA.types[1:])]
                + [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in links])


def _flat(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes


def _gather(flat: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The pieces of the given ids one after the other: one ragged gather."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return flat[np.repeat(offsets[ids] - (ends - sizes), sizes) + np.arange(total)]


def aligner(a_name: str, b_name: str) -> Aligner:
    key = (a_name, b_name)
    if key not in _aligners:
        _aligners[key] = Aligner(a_name, b_name)
    return _aligners[key]


def document_links(docs: DataFrame, a_name: str = A_TOKENIZER, b_name: str = B_TOKENIZER) -> DataFrame:
    """One row a document: its own figures and its links, with a document number fixed by a written table."""
    def run(batches):
        align = aligner(a_name, b_name)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            # only one slice of the batch is held as Python strings
            for begin, end in ranges(pc.binary_length(texts).fill_null(0).to_pylist(), SLICE_BYTES):
                columns = align.batch([t or "" for t in texts.slice(begin, end - begin).to_pylist()])
                yield pa.RecordBatch.from_arrays([ids.slice(begin, end - begin).cast(pa.int64()), *columns], schema=DOC_SCHEMA)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(run, DOC_DDL)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return staged(rows.withColumn("doc_no", F.monotonically_increasing_id()))


def pair_bitmaps(linked: DataFrame) -> DataFrame:
    """a, b, plane, bucket, card, bitmap: compressed document bitmaps built within each task."""
    ddl = "a int, b int, plane int, bucket bigint, card bigint, bitmap binary"

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(i).to_numpy() for i in range(4)))
                size += batch.num_rows
            if size >= FLUSH_LINKS:
                yield containers(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if held:
            yield containers(*(np.concatenate(x) for x in zip(*held)))

    return linked.mapInArrow(run, ddl)


def containers(doc: np.ndarray, a: np.ndarray, b: np.ndarray, m: np.ndarray):
    """One compressed container per (a, b, plane, bucket) of these links."""
    # each plane takes only the links it holds: most links have multiplicity one
    top = int(m.max()).bit_length() if len(m) else 0
    on = [np.arange(len(doc))] + [np.flatnonzero((m >> k) & 1) for k in range(top)]
    plane = np.repeat(np.arange(-1, top), [len(x) for x in on])
    on = np.concatenate(on)
    doc_, a_, b_ = doc[on], a[on], b[on]
    bucket, pos = doc_ >> BUCKET_BITS, (doc_ & ((1 << BUCKET_BITS) - 1)).astype(np.uint16)
    order = np.lexsort((pos, bucket, plane, b_, a_))
    a_, b_, plane, bucket, pos = a_[order], b_[order], plane[order], bucket[order], pos[order]
    new = np.ones(len(a_), bool)
    new[1:] = (a_[1:] != a_[:-1]) | (b_[1:] != b_[:-1]) | (plane[1:] != plane[:-1]) | (bucket[1:] != bucket[:-1])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(a_))
    maps, cards = [], []
    for s, e in zip(starts.tolist(), ends.tolist()):
        if e - s < ARRAY_LIMIT:
            maps.append(pos[s:e].astype("<u2").tobytes())
        else:
            bits = np.zeros(1 << BUCKET_BITS, bool)
            bits[pos[s:e]] = True
            maps.append(np.packbits(bits).tobytes())
        cards.append(popcount(maps[-1]))
    return pa.RecordBatch.from_arrays(
        [pa.array(a_[starts], pa.int32()), pa.array(b_[starts], pa.int32()), pa.array(plane[starts], pa.int32()),
         pa.array(bucket[starts], pa.int64()), pa.array(cards, pa.int64()), pa.array(maps, pa.binary())],
        schema=pa.schema([("a", pa.int32()), ("b", pa.int32()), ("plane", pa.int32()), ("bucket", pa.int64()),
                          ("card", pa.int64()), ("bitmap", pa.binary())]))


def popcount(bitmap: bytes) -> int:
    """Documents in a container: a 65536-bit map (8192 bytes), or fewer than 4096 sorted 16-bit positions."""
    if len(bitmap) == (1 << BUCKET_BITS) // 8:
        return int(np.unpackbits(np.frombuffer(bitmap, np.uint8)).sum())
    return len(bitmap) // 2


def postings(per_doc: DataFrame) -> DataFrame:
    """doc_no, a, b, m: each document's distinct links and how often it holds each."""
    z = F.explode(F.arrays_zip("link_a", "link_b", "link_m")).alias("l")
    return per_doc.select("doc_no", z).select("doc_no", F.col("l.link_a").alias("a"), F.col("l.link_b").alias("b"), F.col("l.link_m").alias("m"))


def pair_counts(bitmaps: DataFrame) -> DataFrame:
    """a, b, n_docs, count: popcounts of the planes, summed over buckets."""
    weight = F.expr("CASE WHEN plane >= 0 THEN shiftleft(CAST(1 AS BIGINT), plane) ELSE 0 END")
    return bitmaps.groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") < 0, F.col("card")).otherwise(0)).alias("n_docs"),
        F.sum(weight * F.col("card")).alias("count"))


def alignment(docs: DataFrame, a_name: str = A_TOKENIZER, b_name: str = B_TOKENIZER, salt: int = SALT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    per_doc = document_links(docs, a_name, b_name)
    links = postings(per_doc)
    index = staged(pair_bitmaps(links))
    counts = pair_counts(index)
    best_of_b = counts.groupBy("b").agg(F.max("count").alias("top"))
    scored = staged(counts.join(best_of_b, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best")))
    spread = scored.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    returned = links.withColumn("salt", F.pmod(F.col("doc_no"), F.lit(salt))).join(spread, ["a", "b", "salt"])
    per_doc_scores = returned.groupBy("doc_no").agg(
        F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).cast("bigint").alias("n_best"),
        F.sum(F.col("m") * F.col("count")).cast("bigint").alias("count_sum"))
    out = per_doc.join(per_doc_scores, "doc_no", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"), "groups_sha256")


def query(docs: DataFrame) -> DataFrame:
    return alignment(docs)
