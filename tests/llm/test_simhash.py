"""SimHash: fingerprints and components against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from hopwise.llm import components, simhash


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", "One", "one TWO", "É É é A a", "a b c d e f g a b c", "word " * 2000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def cluster(rng, n, flips):
    center = rng.getrandbits(64)
    out = {center}
    while len(out) < n:
        x = center
        for b in rng.sample(range(64), rng.randint(0, flips)):
            x ^= 1 << b
        out.add(x)
    return out


@pytest.mark.parametrize("node_rows", [1000, 7])
def test_links_equal_brute_force(spark, node_rows):
    rng = random.Random(3)
    values = sorted({rng.getrandbits(64) for _ in range(150)} | cluster(rng, 60, 4) | cluster(rng, 25, 2) | {0, 1, (1 << 64) - 1})
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    found = [(r["a"], r["b"]) for r in simhash.linked_fingerprints(frame, 3, node_rows).collect()]
    array = np.array(values, np.uint64)
    pairs = [(simhash.signed(values[i]), simhash.signed(values[int(j)])) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 3) if i < j]
    nodes = [simhash.signed(v) for v in values]
    assert groups(found, nodes) == groups(pairs, nodes)
    assert all((a ^ b) & ((1 << 64) - 1) for a, b in found)


def test_walk_finds_exactly_the_pairs():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, 80, dtype=np.uint64), np.uint64(1 << 40) ^ (np.uint64(1) << rng.integers(0, 20, 40).astype(np.uint64))]))
    i, j = simhash.walk(keys, np.zeros(len(keys), np.int64), 3)
    expected = {(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if bin(int(keys[a] ^ keys[b])).count("1") <= 3}
    assert Counter(zip(i.tolist(), j.tolist(), strict=True)) == Counter(dict.fromkeys(expected, 1))


def test_more_blocks_for_more_fingerprints():
    assert simhash.blocks_for(1000, 3) == (4, 1)
    assert simhash.blocks_for(10**9, 3) == (5, 2)
    masks = simhash.block_masks(5)
    assert sum(masks) == (1 << 64) - 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(5, 5), (100, 101)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert found == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_near_duplicates_edges(docs, empty):
    text = " ".join(f"w{k}" for k in range(400))
    near = text.replace("w399", "other")
    data = docs((5, text), (3, near), (9, text), (9, text), (None, text), (1, None), (2, ""), (7, "unlike all others in here")).withColumnRenamed("n_chars", "fp")
    rows = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(data).collect()]
    assert Counter(rows) == Counter([(5, 3), (3, 3), (9, 3), (9, 3), (None, 3), (1, 1), (2, 1), (7, 7)])
    kept = simhash.without_near_duplicates(data)
    assert kept.columns == data.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([3, None, 1, 7])
    again = simhash.without_near_duplicates(docs((4, text), (4, text), (8, "a b c")))
    assert sorted(r["doc_id"] for r in again.collect()) == [4, 8]
    assert simhash.near_duplicates(empty).count() == 0


def test_cut_again_widens_by_all_other_bits():
    widened = simhash.cut_again(0xFFFF << 48, 4)
    assert len(widened) == 4 and all(m & (0xFFFF << 48) == 0xFFFF << 48 for m in widened)
    rest = [m ^ (0xFFFF << 48) for m in widened]
    assert sum(rest) == (1 << 48) - 1 and all(a & b == 0 for a in rest for b in rest if a is not b)


def test_texts_of_one_id_are_judged_by_their_own_component(docs):
    one, two = (" ".join(f"{c}{k}" for k in range(300)) for c in "ab")
    kept = simhash.without_near_duplicates(docs((5, one), (3, one), (5, two), (8, two), (5, two), (None, one), (1, ""), (9, "x " * 200_000)))
    assert Counter((r["doc_id"], r["text"][:2]) for r in kept.collect()) == Counter([(3, "a0"), (5, "b0"), (None, "a0"), (1, ""), (9, "x ")])


@pytest.mark.parametrize("name", ["__id", "id", "key_id", "row", "fp", "root", "stays"])
def test_clashing_columns(docs, name):
    data = docs((1, "a b c"), (2, "a b c"), (2, "d e f"), (3, "g h i")).withColumnRenamed("n_chars", name)
    kept = simhash.without_near_duplicates(data)
    assert kept.columns == data.columns and sorted((r["doc_id"], r[name]) for r in kept.collect()) == [(1, 5), (2, 5), (3, 5)]
