"""Token ids as Huffman-coded blocks: encode, write, read back.

Every text becomes its token ids and an end id. Documents stand in ascending order of doc_id
(null first; equal ids by text hash, then text). The file format is three tables below one
folder:

- ``codebook`` (id, length): canonical Huffman code of the ids from their counts over all
  documents, no code longer than the limit. Codes follow from the lengths: ascending by
  (length, id). Ids that never occur have no code.
- ``blocks`` (shard, first, n_ids, doc_ids, lengths, checkpoints, payload): consecutive whole documents
  of one shard, about ``BLOCK_IDS`` ids a block (a longer document makes a longer block).
  ``payload`` holds the codes, highest bit first; ``checkpoints`` the number of bits of every run
  of ``CHECKPOINT`` ids, so a reader starts at any run and decodes all runs of a block side by
  side with one table look-up for each id. ``first`` is the position within the shard.
- ``shards`` (shard, start): position of a shard's first id among all ids.

Shards are ranges of doc_id, so no task holds more than its range, and positions across shards
come from one sum per shard. The driver sees one count per vocabulary entry.

Null text is encoded like the empty one: only the end id. Repeated rows are written each. Extra
columns are ignored. No rows give empty tables and no rows back.
"""

import os
import re
import uuid
import zlib

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retailoom.llm.common import TEXT_HASH, arrow_batch, mix, shared_folder, slices, staged, unstage, with_text_hash

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
BLOCK_IDS = 1 << 16
CHECKPOINT = 128
MAX_UNITS = 2_500_000
LONG_WORD = 1024
JOINED = 1000
SPACE_RUN = re.compile(r" (?:\s|\Z)")

_encoders: dict[str, "Encoder"] = {}


class UnitTable:
    """Token ids of words by the hash of their bytes: open addressing over numpy arrays.

    Holds up to ``MAX_UNITS`` words and those of one slice; 64-bit hashes of short words.
    """

    BITS = 23

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.rows = np.zeros(1 << self.BITS, np.int32)
        self.offsets, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it is not known."""
        found = np.full(len(hashes), -1, np.int64)
        left, at = np.arange(len(hashes)), (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(left):
            keys = self.keys[at]
            hit = keys == hashes[left]
            found[left[hit]] = self.rows[at[hit]]
            on = ~hit & (keys != 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.BITS) - 1)
        return found

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """Add distinct new hashes with their ids."""
        first = len(self.offsets)
        sizes = np.array([len(x) for x in ids], np.int64) // self.kind.itemsize
        self.offsets = np.concatenate([self.offsets, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), self.kind)])
        left, at = np.arange(len(hashes)), (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[left[free]]  # of several for one slot the last one stays
            self.rows[at[free]] = first + left[free]
            on = self.keys[at] != hashes[left]
            left, at = left[on], (at[on] + 1) & ((1 << self.BITS) - 1)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in turn, and where those of each row end."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        places = np.repeat(self.offsets[rows] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.ids[places], ends


class Encoder:
    """Ids of texts by the tokenizers library, looked up by space-separated units.

    The byte-level pre-tokenizer always cuts before a space that a visible character follows,
    so the ids of a text are those of its units in turn, and each unit goes to the library once.
    New units are encoded together as one text: only the first token of a unit begins with a space,
    which tells where each begins. A text in which white space follows a space, and everything for
    other kinds of tokenizers, goes to the library as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        if not os.path.isabs(path):
            import public_tokenizers
            path = public_tokenizers.path(path)
        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer
        self.by_unit = isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and pre.use_regex and self.tokenizer.normalizer is None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values(), default=0) + 1
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.begins = np.zeros(size, bool)  # tokens that begin with a space
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.units = UnitTable(self.kind)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of new words, each behind a space."""
        out = []
        for at in range(0, len(words), JOINED):
            part = words[at:at + JOINED]
            ids = np.frombuffer(self._encode([" " + " ".join(part)])[0], self.kind)
            begin = np.flatnonzero(self.begins[ids])
            if len(begin) == len(part):
                raw = ids.tobytes()
                cuts = (np.append(begin, len(ids)) * self.kind.itemsize).tolist()
                out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
            else:
                out += self._encode([" " + w for w in part])
        return out

    def _word_hashes(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each word's bytes, never 0: a polynomial from prefix sums, moved to its start.

        Such polynomials are weak for very long words; those are hashed one by one.
        """
        if len(self.powers) <= len(raw):
            odd = 0xD1342543DE82EF95
            n = len(raw) * 5 // 4 + 1
            self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (odd, pow(odd, -1, 1 << 64)))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[:len(raw)], out=sums[1:])
        hashes = mix((sums[end] - sums[begin]) * self.inverses[begin] + (end - begin).astype(np.uint64)) | np.uint64(1)
        for i in np.flatnonzero(end - begin > LONG_WORD).tolist():
            hashes[i] = xxhash.xxh64_intdigest(raw[begin[i]:end[i]].tobytes()) | 1
        return hashes

    def encode(self, texts: list[str]) -> list[bytes]:
        first, rest, counts = [], [], []
        for text in texts:
            if not self.by_unit or SPACE_RUN.search(text):
                head, tail = text, b""
            else:
                cut = text.find(" ")
                head, tail = (text, b"") if cut < 0 else (text[:cut], text[cut:].encode())
            first.append(head)
            rest.append(tail)
            counts.append(tail.count(b" "))
        heads = self._encode(first)
        buffer = b"".join(rest)
        raw = np.frombuffer(buffer, np.uint8)
        begin = np.flatnonzero(raw == 32) + 1
        end = np.append(begin[1:] - 1, len(raw))[:len(begin)]
        hashes = self._word_hashes(raw, begin, end)
        if len(self.units.offsets) > MAX_UNITS:
            self.units.clear()
        rows = self.units.find(hashes)
        unknown = np.flatnonzero(rows < 0)
        if len(unknown):
            new, at = np.unique(hashes[unknown], return_index=True)
            at = unknown[at]
            self.units.add(new, self._learn([buffer[a:b].decode() for a, b in zip(begin[at].tolist(), end[at].tolist())]))
            rows[unknown] = self.units.find(hashes[unknown])
        ids, ends = self.units.gather(rows)
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])] * self.kind.itemsize
        ids = ids.tobytes()
        return [head + ids[a:b] for head, a, b in zip(heads, cuts.tolist(), cuts[1:].tolist())]


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_ids(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Ids of every row in doc_id order: shard, at (position in the shard), doc_id, ids (bytes)."""
    ddl = "shard int, at bigint, doc_id bigint, ids binary"

    def run(batches):
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.kind).tobytes()
        shard, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, stop in slices(texts):
                ids = [x + end for x in encode.encode(texts[begin:stop])]
                sizes = np.array([len(x) // encode.kind.itemsize for x in ids], np.int64)
                places = at + np.concatenate([[0], np.cumsum(sizes)])
                yield arrow_batch(ddl, np.full(len(ids), shard), places[:-1], batch.column(0).slice(begin, stop - begin), ids)
                at = int(places[-1])

    rows = with_text_hash(docs).select(F.col("doc_id").cast("bigint"), "text", TEXT_HASH)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", TEXT_HASH, "text").select("doc_id", "text")
    return ordered.mapInArrow(run, ddl)


def id_counts(ids: DataFrame, kind: np.dtype) -> np.ndarray:
    """Occurrences of every id: summed in tasks, then by Spark; one number per vocabulary entry."""
    ddl = "id int, n bigint"

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                n = np.bincount(np.frombuffer(value, kind))
                if len(n) > len(total):
                    n[:len(total)] += total
                    total = n
                else:
                    total[:len(n)] += n
        used = np.flatnonzero(total)
        yield arrow_batch(ddl, used.astype(np.int32), total[used])

    rows = ids.select("ids").mapInArrow(run, ddl).groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids have no codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    row, levels = coins, []
    is_coin = np.ones(len(coins), bool)
    for _ in range(limit - 1):
        levels.append(is_coin)
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([coins, packages])
        by = np.argsort(both, kind="stable")
        row, is_coin = both[by], by < len(coins)
    levels.append(is_coin)
    take = 2 * len(order) - 2
    for is_coin in reversed(levels):
        chosen = int(is_coin[:take].sum())
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code of every id, ascending by (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - last
            last = int(lengths[i])
            codes[i] = code
            code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Bits of the codes of ids, highest first, and the bits of each run of CHECKPOINT ids."""
    sizes = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total = int(ends[-1]) if len(ids) else 0
    word = starts >> 5
    # every code lies in the 64 bits that begin at its 32-bit word
    shift = (64 - (starts & 31) - sizes).astype(np.uint64)
    firsts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(ids) else np.zeros(0, np.int64)
    sums = np.add.reduceat(codes[ids] << shift, firsts) if len(ids) else np.zeros(0, np.uint64)
    out = np.zeros((total + 31) // 32 + 2, np.uint64)
    out[word[firsts]] += sums >> np.uint64(32)
    out[word[firsts] + 1] += sums & np.uint64(0xFFFFFFFF)
    runs = np.add.reduceat(sizes, np.arange(0, len(ids), CHECKPOINT)) if len(ids) else sizes
    return out.astype(">u4").tobytes()[: (total + 7) // 8], runs.astype("<u4").tobytes()


class Decoder:
    """Look-up table over the next ``bits`` bits: id and code length."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(int(lengths.max(initial=0)), 1)
        self.ids, self.lengths = np.zeros(1 << self.bits, np.uint32), np.zeros(1 << self.bits, np.int64)
        codes = canonical_codes(lengths)
        used = np.lexsort((np.arange(len(lengths)), lengths))
        used = used[lengths[used] > 0]
        spans = np.int64(1) << (self.bits - lengths[used].astype(np.int64))
        at = int((codes[used[0]] << np.uint64(self.bits - int(lengths[used[0]])))) if len(used) else 0
        filled = np.repeat(used, spans)
        self.ids[at:at + len(filled)] = filled
        self.lengths[at:at + len(filled)] = lengths[filled]

    def decode(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """Ids of one block; all its runs advance together, one id a step."""
        raw = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
        windows = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        sizes = np.frombuffer(checkpoints, "<u4").astype(np.int64)
        at = np.cumsum(sizes) - sizes
        out = np.zeros((len(at), CHECKPOINT), np.uint32)
        rest = n - (len(at) - 1) * CHECKPOINT
        drop, mask = 32 - self.bits, (1 << self.bits) - 1
        for step in range(min(CHECKPOINT, n)):
            lanes = at if step < rest else at[:-1]
            code = (windows[lanes >> 3] >> (drop - (lanes & 7)).astype(np.uint32)) & mask
            out[:len(lanes), step] = self.ids[code]
            lanes += self.lengths[code]
        return out.reshape(-1)[:n]


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, limit: int | None = None) -> None:
    """Encode all rows and write the three tables below ``path``."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = encoder(tokenizer).kind
    ids = staged(token_ids(docs, tokenizer, end_id))
    counts = id_counts(ids, kind)
    lengths = code_lengths(counts, limit or max(16, int(np.count_nonzero(counts)).bit_length() + 1))
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    book = sc.broadcast((canonical_codes(lengths), lengths))  # bounded by the vocabulary
    ddl = "shard int, first bigint, n_ids bigint, doc_ids array<bigint>, lengths binary, checkpoints binary, payload binary"

    def run(batches):
        codes, sizes = book.value
        held: list[tuple] = []
        n = 0

        def block(n):
            parts = [np.frombuffer(r[3], kind) for r in held]
            payload, checkpoints = pack(np.concatenate(parts), codes, sizes)
            return arrow_batch(ddl, [held[0][0]], [held[0][1]], [n], [[r[2] for r in held]], [np.array([len(p) for p in parts], "<u4").tobytes()], [checkpoints], [payload])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (row[0] != held[0][0] or row[1] != held[0][1] + n or n >= BLOCK_IDS):
                    yield block(n)
                    held, n = [], 0
                held.append(row)
                n += len(row[3]) // kind.itemsize
        if held:
            yield block(n)

    ids.mapInArrow(run, ddl).write.parquet(f"{path}/blocks")
    unstage(ids)
    blocks = spark.read.parquet(f"{path}/blocks")
    per_shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    per_shard.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).write.parquet(f"{path}/shards")


def _decoded(spark: SparkSession, path: str, ddl: str, with_ids: bool) -> DataFrame:
    lengths = np.zeros(0, np.uint8)
    book = spark.read.parquet(f"{path}/codebook").collect()  # bounded by the vocabulary
    if book:
        lengths = np.zeros(max(r["id"] for r in book) + 1, np.uint8)
        lengths[[r["id"] for r in book]] = [r["length"] for r in book]
    shared = spark.sparkContext.broadcast(lengths)
    ddl_local = "shard int, " + ddl

    def run(batches):
        decoder = Decoder(shared.value)
        for batch in batches:
            for shard, first, doc_ids, sizes, checkpoints, payload in zip(*[c.to_pylist() for c in batch.columns]):
                sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
                ids = decoder.decode(payload, checkpoints, int(sizes.sum())).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                parts = [ids[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
                columns = [parts] if with_ids else [sizes, [zlib.crc32(p) for p in parts]]
                yield arrow_batch(ddl_local, np.full(len(sizes), shard), doc_ids, first + ends - sizes, *columns)

    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "first", "doc_ids", "lengths", "checkpoints", "payload")
    rows = blocks.mapInArrow(run, ddl_local)
    starts = spark.read.parquet(f"{path}/shards").withColumnRenamed("start", "before")
    names = [part.split()[0] for part in ddl.split(", ")]
    return rows.join(starts, "shard").withColumn("start", F.col("start") + F.col("before")).select(*names)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the written tables: doc_id, start (among all ids), ids (little-endian 32 bits)."""
    return _decoded(spark, path, "doc_id bigint, start bigint, ids binary", True)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and CRC-32 of the ids of every document, decoded from the tables."""
    return _decoded(spark, path, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", False)


def query(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return token_digest(spark, path)
