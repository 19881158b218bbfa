import random
from itertools import combinations

import xxhash
from retailoom.llm import simhash
from tests.llm.conftest import words


def brute_print(text):
    ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    runs = [" ".join(ws[i:i + 3]) for i in range(max(len(ws) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_query_equals_brute_force(docs, rows):
    prints = [(r[0], brute_print(r[1])) for r in rows]
    distinct = sorted({p for _, p in prints})
    root = roots(distinct, [(a, b) for a, b in combinations(distinct, 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    want = sorted([(i, f"{p:016x}", least.get(root[p])) for i, p in prints], key=repr)
    got = sorted([tuple(r) for r in simhash.query(docs).collect()], key=repr)
    assert got == want


def test_one_document_of_each_class_stays(docs, rows):
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.collect()]
    assert len(ids) == simhash.near_duplicates(docs).select("root").distinct().count()
    assert ids.count(7) == 2 and 200 in ids and 201 not in ids  # two texts share id 7


def test_blocks_lose_no_link_even_in_large_buckets(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base:
        for _ in range(20):
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                b ^= 1 << bit
            prints.add(b)
    prints = sorted(prints)
    for max_bits, bucket in ((2, 64), (2, 3), (3, 3)):
        want = roots(prints, [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= max_bits])
        frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
        linked = simhash.links(frame, max_bits, bucket).collect()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= max_bits for r in linked)
        got = roots(prints, [(r.a % (1 << 64), r.b % (1 << 64)) for r in linked])
        assert got == want
        classes = {r.fp % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.links(frame, max_bits, bucket)).collect()}
        groups = {}
        for p in prints:
            groups.setdefault(classes.get(p, p), set()).add(p)
        wanted = {}
        for p in prints:
            wanted.setdefault(want[p], set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_no_rows(no_docs):
    assert simhash.query(no_docs).count() == 0
    assert simhash.without_near_duplicates(no_docs).count() == 0
