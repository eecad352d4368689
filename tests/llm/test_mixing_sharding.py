"""Budgets and prefixes against plain Python; laws of the shards."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hopwise.llm import mixing, sharding

WEIGHTS = {"x": 3, "y": 1, "z": 0}
SOURCES = {"s1": 2}


def levels():
    return [mixing.Level("language", F.col("lang"), WEIGHTS), mixing.Level("origin", F.col("source"), SOURCES)]


def fill(given, children):
    """children: (name, capacity, weight); shares in whole tokens."""
    out, left = {}, sorted(children, key=lambda c: (c[1] / c[2], c[0]))
    while left:
        total = sum(c[2] for c in left)
        name, capacity, weight = left[0]
        if capacity * total <= given * weight:
            out[name] = capacity
            given -= capacity
            left.pop(0)
        else:
            return out | {n: given * w // total for n, _, w in left}
    return out


def plain(rows, total, epochs, seed):
    tokens, members = defaultdict(int), defaultdict(list)
    for doc_id, text, lang, source in rows:
        n = len((text or "").split())
        leaf = (lang or "", source or "")
        tokens[leaf] += n
        if n:
            members[leaf].append((doc_id, n, hashlib.md5((text or "").encode()).hexdigest()))
    leaves = {k: v for k, v in tokens.items() if v and WEIGHTS.get(k[0], 1)}
    wanted = sum(tokens.values()) if total is None else total
    langs = {k[0] for k in leaves}
    by_lang = fill(wanted, [(g, epochs * sum(v for k, v in leaves.items() if k[0] == g), WEIGHTS.get(g, 1)) for g in langs])
    out = Counter()
    for g in langs:
        for source, budget in fill(by_lang[g], [(k[1], epochs * v, SOURCES.get(k[1], 1)) for k, v in leaves.items() if k[0] == g]).items():
            full, left = divmod(budget, leaves[g, source])
            order = defaultdict(list)
            for doc_id, n, t in members[g, source]:
                order[hashlib.md5(":".join(str(x) for x in (seed, full, doc_id, t) if x is not None).encode()).hexdigest()].append((doc_id, n))
            total_n, last = 0, 0
            for place in sorted(order):
                total_n += sum(n for _, n in order[place])
                last = 1 if total_n <= left else 0
                for doc_id, _ in order[place]:
                    if full + last:
                        out[doc_id, full + last] += 1
    return out


def rows_of():
    rows = [(k, "w " * (k % 13), "xyq"[k % 3] if k % 5 else "z", f"s{k % 4}") for k in range(400)]
    rows += [(1000 + k, "hot text " * 3, "x", "s1") for k in range(600)]
    return rows + [(7, "twice", "x", "s2"), (7, "twice", "x", "s2"), (None, "no id", None, None), (8, None, "x", None)]


def test_selection_equals_plain(docs):
    rows = rows_of()
    data = docs(*rows).withColumnRenamed("n_chars", "budget")
    for total in (None, 500, 100_000, 0):
        taken, _ = mixing.selection(data, levels(), total=total, max_epochs=3, seed=17)
        expected = plain(rows, total, 3, 17)
        assert Counter((r["doc_id"], r["copies"]) for r in taken.collect()) == expected
    out = mixing.mixed(data, levels(), total=3000)
    assert out.columns == data.columns
    taken = Counter()
    for (doc_id, copies), n in plain(rows, 3000, 3, 17).items():
        taken[doc_id] += copies * n
    assert Counter(r["doc_id"] for r in out.collect()) == taken


def test_shortage_goes_to_siblings_first(docs):
    rows = [(1, "a " * 10, "x", "s1"), *((10 + k, "a " * 10, "x", "s2") for k in range(50)), *((100 + k, "b " * 10, "y", "s3") for k in range(50))]
    _, budgets = mixing.selection(docs(*rows), levels(), total=400, max_epochs=1)
    found = {r["origin"]: r["budget"] for r in budgets.collect()}
    assert found == {"s1": 10, "s2": 290, "s3": 100}  # of x's 300, s1 can't use its 200


def test_mixing_nothing(empty):
    assert mixing.selection(empty, levels())[0].count() == 0 and mixing.mixed(empty, levels()).count() == 0


def test_shards_are_even_gapless_and_whole(spark, docs):
    rows = [(k, f"text {k % 50}" if k % 3 else "the same") for k in range(1001)] + [(None, None), (5, "text"), (5, "text")]
    data = docs(*rows).withColumnRenamed("n_chars", "slot")
    out = sharding.shuffled(data, 7, bucket_bytes=200).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(7)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shuffled(data.repartition(3), 7, bucket_bytes=200).collect()
    unique = lambda rs: {(r["doc_id"], r["text"]): (r["shard"], r["slot"]) for r in rs if r["doc_id"] != 5}
    assert unique(out) == unique(again)  # the same wherever rows come from
    ids = [r["doc_id"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] is not None]
    assert sum(a < b for a, b in zip(ids, ids[1:], strict=False)) < 0.6 * len(ids)


def test_written_shards_and_few_rows(docs, empty):
    out = sharding.write_shards(docs((1, "a"), (2, "é")), 40).collect()
    assert {r["doc_id"]: zlib.crc32(r["text"].encode()) for r in out} == {1: zlib.crc32(b"a"), 2: zlib.crc32("é".encode())}
    assert sharding.shuffled(empty, 40).count() == 0


@pytest.mark.parametrize("name", ["rank", "n", "start", "bucket", "place", "hash", "row", "slot", "shard", "__hash", "__bucket"])
def test_shards_keep_columns_of_any_name(docs, name):
    rows = [(k, f"text {k}") for k in range(200)]
    out = sharding.shuffled(docs(*rows).withColumnRenamed("n_chars", name), 5, bucket_bytes=300, task_bytes=600)
    if name in ("slot", "shard"):
        assert out.columns == ["doc_id", "text", "lang", "source", "shard", "slot"]
    else:
        assert out.columns == ["doc_id", "text", "lang", "source", name, "shard", "slot"]
        assert {(r["doc_id"], r["text"], r[name]) for r in out.collect()} == {(k, t, len(t)) for k, t in rows}
    assert sorted((r["shard"], r["slot"]) for r in out.collect()) == [(s, k) for s in range(5) for k in range(40)]


def test_equal_id_and_text_are_told_apart_by_other_columns(docs):
    data = docs(*((1, "same", "en", f"s{k}") for k in range(50)), *((None, None, "en", f"s{k}") for k in range(50)))
    out = {r["source"] + str(r["doc_id"]): (r["shard"], r["slot"]) for r in sharding.shuffled(data, 4, bucket_bytes=100).collect()}
    again = {r["source"] + str(r["doc_id"]): (r["shard"], r["slot"]) for r in sharding.shuffled(data.repartition(7), 4, bucket_bytes=100).collect()}
    assert out == again and len(out) == 100


def test_a_very_long_text(docs):
    data = docs((1, "word " * 400_000), *((k, "a") for k in range(2, 30)))
    assert sharding.write_shards(data, 3, bucket_bytes=1000).count() == 29
    taken, _ = mixing.selection(data, levels())
    assert max(r["n_tokens"] for r in taken.collect()) == 400_000


def test_the_permutation_is_fisher_yates_of_each_bucket(docs):
    """Against plain Python: rows by bucket and hash, permuted by bucket, numbered through, cut into shards."""
    import numpy as np

    data = docs(*((k, f"text {k}") for k in range(300)))
    n_buckets, seed = 12, 29
    spread = F.xxhash64(F.lit(seed), *data.columns)
    hashed = data.select("doc_id", spread.alias("h"), F.xxhash64(F.lit(seed + 1), spread).alias("o")).collect()
    buckets = defaultdict(list)
    for r in hashed:
        buckets[r["h"] % n_buckets].append((r["o"], r["h"], r["doc_id"]))
    ranked, start = {}, 0
    for b in range(n_buckets):
        rows = sorted(buckets[b])
        for place, (_, _, doc_id) in zip(np.random.default_rng([seed, b]).permutation(len(rows)), rows, strict=True):
            ranked[start + int(place)] = doc_id
        start += len(rows)
    expected, n_shards = {}, 6
    for s in range(n_shards):
        for slot, rank in enumerate(range(s * 300 // n_shards, (s + 1) * 300 // n_shards)):
            expected[ranked[rank]] = (s, slot)
    size = sum(len(f"text {k}") + 16 for k in range(300))
    found = sharding.shuffled(data, n_shards, seed=seed, bucket_bytes=-(-size // 12)).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in found} == expected


@pytest.mark.parametrize("name", ["__at", "at", "leaf", "row", "full", "cut", "copies", "budget", "language", "key"])
def test_mixed_keeps_columns_of_any_name(docs, name):
    rows = [(k, f"text number {k}", "xy"[k % 2], f"s{k % 3}") for k in range(40)]
    out = mixing.mixed(docs(*rows).withColumnRenamed("n_chars", name), levels(), total=70)
    assert out.columns == ["doc_id", "text", "lang", "source", name]
    found = out.collect()
    assert found and all(r[name] == len(r["text"]) for r in found)
