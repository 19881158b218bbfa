"""Token counts of whole texts by rank-synchronous merging of ragged numpy arrays.

The vocabulary and merge list of a byte-level BPE file (the ``tokenizers`` JSON format) are read
once a worker. A batch of texts is split as the library splits it: first on its added special
tokens (each such string is one token, the library's default), then by the pre-token pattern.
The distinct pre-tokens of a batch that are not known yet become one flat array of symbol ids
with a sequence number per symbol. Each round finds, for every sequence at once, the rank of each
adjacent pair, takes each sequence's lowest rank and merges all its occurrences (leftmost first,
never two overlapping), and drops the sequences that have no pair left. The count of a pre-token
is the number of its surviving symbols; a text's count is the sum over its pre-tokens.

Merges made later always have a higher rank than the pairs that made their parts, so taking
each sequence's lowest pair in every round is the library's order. Tests compare the counts with
the library's encoding.

Cases: a null text counts as empty (0 bytes, 0 tokens); an empty or white-space text is counted
like any other; very long texts are split whole, pre-tokens of any length are merged; repeated
rows and ids each give their own row; extra columns are ignored; no rows give no rows.
"""

import json
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailoom.llm.common import arrow_batch

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
# texts whose new pre-tokens are merged together
BATCH_TEXTS = 256
# fixed: the pre-token pattern of this byte-level vocabulary
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# entries a worker's pre-token cache holds before it starts anew
CACHE_WORDS = 500_000
# pre-tokens whose ids a worker keeps
ID_CACHE_WORDS = 300_000
NONE = np.iinfo(np.int64).max

_counters: dict[str, "PairMerger"] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    out, extra = {}, 0
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class PairMerger:
    """Merges of one vocabulary, looked up by a 32-bit pair key in sorted numpy arrays."""

    def __init__(self, path: str):
        if "/" not in path:
            import public_tokenizers
            path = public_tokenizers.path(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = np.array([vocab[s] for s in byte_symbols()], np.int64)
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        into = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.into = keys[order], order.astype(np.int64), into[order]
        specials = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.pattern = regex.compile(PRE_TOKENS)
        self.cache: dict[str, int] = {}
        self.forget_ids()

    def forget_ids(self) -> None:
        """No pre-token known by its ids: their row by name, and the ids of all rows in one array."""
        self.id_cache: dict[str, int] = {}
        self.id_flat, self.id_ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merged_counts(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token, all merged side by side."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        seq = np.repeat(np.arange(len(raw)), sizes)
        counts = sizes.copy()
        while len(sym) > 1:
            same = seq[1:] == seq[:-1]
            keys = (sym[:-1] << 20) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = same & (self.keys[at] == keys)
            rank = np.full(len(sym), NONE)
            rank[:-1][found] = self.ranks[at[found]]
            starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            live = best < NONE
            if not live.any():
                break
            hit = (rank < NONE) & (rank == np.repeat(best, np.diff(np.append(starts, len(sym)))))
            # within a run of overlapping hits only every other one, from the left, is merged
            before = np.concatenate([[False], hit[:-1]])
            run_start = hit & ~before
            run_id = np.cumsum(run_start)
            first_of_run = np.flatnonzero(run_start)
            place = np.arange(len(sym)) - first_of_run[np.maximum(run_id - 1, 0)]
            apply = hit & (place % 2 == 0)
            idx = np.flatnonzero(apply)
            sym = sym.copy()
            sym[idx] = self.into[at[idx]]
            keep = np.ones(len(sym), bool)
            keep[idx + 1] = False
            counts -= np.bincount(seq[idx], minlength=len(counts))
            # sequences without any pair are finished: drop them from the working arrays
            alive = np.repeat(live, np.diff(np.append(starts, len(sym))))
            keep &= alive
            sym, seq = sym[keep], seq[keep]
        return counts

    def merged_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pre-tokens in turn, the symbols that survive the same rounds; how many of each."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        seq = np.repeat(np.arange(len(raw)), sizes)
        done_sym, done_seq = [], []
        while len(sym):
            same = seq[1:] == seq[:-1]
            keys = (sym[:-1] << 20) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = same & (self.keys[at] == keys)
            rank = np.full(len(sym), NONE)
            rank[:-1][found] = self.ranks[at[found]]
            starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            spans = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best < NONE, spans)
            done_sym.append(sym[~live])
            done_seq.append(seq[~live])
            if not live.any():
                break
            hit = (rank < NONE) & (rank == np.repeat(best, spans))
            before = np.concatenate([[False], hit[:-1]])
            run_start = hit & ~before
            first_of_run = np.flatnonzero(run_start)
            place = np.arange(len(sym)) - first_of_run[np.maximum(np.cumsum(run_start) - 1, 0)]
            idx = np.flatnonzero(hit & (place % 2 == 0))
            sym = sym.copy()
            sym[idx] = self.into[at[idx]]
            keep = live.copy()
            keep[idx + 1] = False
            sym, seq = sym[keep], seq[keep]
        all_sym, all_seq = np.concatenate(done_sym or [sym[:0]]), np.concatenate(done_seq or [seq[:0]])
        order = np.argsort(all_seq, kind="stable")
        return all_sym[order].astype(np.int32), np.bincount(all_seq, minlength=len(raw))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn with special strings as plain text, and how many each text has."""
        words = [self.pattern.findall(t) for t in texts]
        flat = list(chain.from_iterable(words))
        new = list(set(flat).difference(self.id_cache))
        if len(self.id_cache) + len(new) > ID_CACHE_WORDS:
            self.forget_ids()
            new = list(set(flat))
        if new:
            ids, sizes = self.merged_ids(new)
            self.id_cache.update(zip(new, range(len(self.id_cache), len(self.id_cache) + len(new))))
            self.id_flat = np.concatenate([self.id_flat, ids])
            self.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum(sizes)])
        rows = np.fromiter(map(self.id_cache.__getitem__, flat), np.int64, len(flat))
        sizes = self.id_ends[rows + 1] - self.id_ends[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.id_flat[np.repeat(self.id_ends[rows] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum([len(ws) for ws in words], dtype=np.int64)])])

    def encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with special strings as plain text."""
        ids, sizes = self.encode_flat(texts)
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text of a batch; the new pre-tokens of the batch are merged together."""
        split = [self.specials.split(t) if self.specials else [t] for t in texts]
        words = [[w for part in parts for w in self.pattern.findall(part)] for parts in split]
        new = list({w: None for ws in words for w in ws if w not in self.cache})
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list({w: None for ws in words for w in ws})
        if new:
            self.cache.update(zip(new, self.merged_counts(new).tolist()))
        get = self.cache.__getitem__
        return [len(parts) - 1 + sum(map(get, ws)) for parts, ws in zip(split, words)]


def merger(path: str) -> PairMerger:
    """The merger of this worker process."""
    if path not in _counters:
        _counters[path] = PairMerger(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row; a map without shuffle."""
    ddl = "doc_id bigint, n_bytes bigint, n_tokens bigint"

    def run(batches):
        count = merger(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a in range(0, len(texts), BATCH_TEXTS):
                part = texts[a:a + BATCH_TEXTS]
                yield arrow_batch(ddl, batch.column(0).slice(a, len(part)), batch.column(2).slice(a, len(part)), count.counts(part))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    counted = rows.mapInArrow(run, ddl)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
