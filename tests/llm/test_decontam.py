"""Decontamination: seeds are sensitive enough, stretches are the longest, overlaps are found and nothing else."""

import random
from itertools import combinations

import numpy as np
import pytest

from hopwise.llm import decontam

BENCH = "item_id long, text string"


@pytest.mark.parametrize(("length", "wrong"), [(13, 2), (15, 3), (20, 4)])
def test_masks_meet_every_substitution(length, wrong):
    for bad in combinations(range(length), wrong):
        assert any(all(p + o not in bad for o in mask) for mask in decontam.MASKS for p in range(length - mask[-1]))


@pytest.mark.parametrize("length", range(5, 13))
def test_short_seeds_meet_every_substitution(length):
    seeds = decontam.short_seeds(length)
    for wrong in range(length - decontam.least_equal(length) + 1):
        for bad in combinations(range(length), wrong):
            assert any(all(at + o not in bad for o in mask) for mask, at in seeds)


def test_masks_meet_stretches_of_any_length():
    """The least number of errors that blocks all masks, by length, is more than a stretch may have: from 13 tokens on."""
    span = max(m[-1] for m in decontam.MASKS) + 1
    least = {0: 0}  # errors needed, by which of the last span - 1 tokens are wrong
    for n in range(1, 201):
        then = {}
        for state, cost in least.items():
            for wrong in (0, 1):
                window = state << 1 | wrong  # bit k: the token k places back
                if any(n > m[-1] and all(not window >> (m[-1] - o) & 1 for o in m) for m in decontam.MASKS):
                    continue
                key = window & ((1 << (span - 1)) - 1)
                then[key] = min(then.get(key, n + 1), cost + wrong)
        least = then
        if n >= decontam.MIN_TOKENS:
            assert min(least.values()) > n - decontam.least_equal(n)


def test_longest_stretch_equals_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        equal = np.array([rng.random() < 0.7 for _ in range(rng.randrange(0, 25))], bool)
        best = max((b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if equal[a] and equal[b - 1] and equal[a:b].mean() >= 0.8 - 1e-12), default=0)
        a, b = decontam.longest_stretch(equal, 0.8)
        assert b - a == best
        if b > a:
            assert equal[a] and equal[b - 1] and equal[a:b].mean() >= 0.8 - 1e-12


def sentence(rng, n):
    return [f"t{rng.randrange(5000)}" for _ in range(n)]


def test_overlaps_are_found_and_clean_texts_left(spark, docs):
    rng = random.Random(4)
    items = [sentence(rng, n) for n in (20, 30, 6, 3)]
    near = list(items[1])
    for k in (4, 11, 17, 25):
        near[k] = "changed"
    rows = [
        (1, " ".join(sentence(rng, 50) + items[0] + sentence(rng, 50))),
        (2, ", ".join(w.upper() for w in near)),
        (3, " ".join(sentence(rng, 400))),
        (4, " ".join(items[0][:9] + sentence(rng, 100))),  # less than MIN_TOKENS of it
        (5, " ".join(items[2])),  # a whole short item
        (6, " ".join(items[3])),  # too short to tell
        (7, " ".join(items[0][:13])),
    ]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(9, None), (0, " ".join(items[0]))], BENCH)
    data = docs(*rows).withColumnRenamed("n_chars", "item_id")
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminations(data, bench).collect()}
    assert set(found) == {(1, 0), (2, 1), (5, 2), (7, 0)}
    assert (found[1, 0]["doc_start"], found[1, 0]["n_equal"]) == (50, 20)
    assert (found[2, 1]["n_tokens"], found[2, 1]["n_equal"]) == (30, 26)
    kept = decontam.without_contaminated(data, bench)
    assert kept.columns == data.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6]


def test_edges(spark, docs, empty):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o")], BENCH)
    data = docs((None, "a b c d e f g h i j k l m n o"), (1, None), (1, None), (2, ""), (3, "x " * 60_000 + "a b c d e f g h i j k l m n o"))
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in decontam.contaminations(data, bench).collect()) == [(0, 15), (3, 15)]
    assert decontam.contaminations(data, bench.limit(0)).count() == 0
    assert decontam.contaminations(empty, bench).count() == 0


def brute_force(texts, items):
    """(doc_id, item_id): n_equal of the best overlap, over every diagonal and stretch."""
    out = {}
    for doc_id, text in texts:
        for item_id, item in items:
            a, b, best = text.lower().split(), item.lower().split(), 0
            for diagonal in range(-len(b) + 1, len(a)):
                equal = [0 <= k + diagonal < len(a) and a[k + diagonal] == b[k] for k in range(len(b))]
                if len(b) < 13:
                    if 5 * sum(equal) >= 4 * len(b) and len(b) > 4:
                        best = max(best, sum(equal))
                    continue
                stretches = [(y - x, sum(equal[x:y])) for x in range(len(b)) for y in range(x + 13, len(b) + 1) if equal[x] and equal[y - 1] and 5 * sum(equal[x:y]) >= 4 * (y - x)]
                if stretches:
                    longest = max(stretches)[0]
                    best = max(best, next(sum(equal[x : x + longest]) for x in range(len(b) - longest + 1) if equal[x] and equal[x + longest - 1] and 5 * sum(equal[x : x + longest]) >= 4 * longest))
            if best:
                out[doc_id, item_id] = best
    return out


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 4000])
def test_whole_query_equals_brute_force(spark, docs, block_bytes):
    rng = random.Random(11)
    items = [(f"set-{n}-{k}", [f"t{rng.randrange(60)}" for _ in range(n)]) for n in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 17, 22, 27) for k in range(2)]
    rows = []
    for _, item in items:
        for wrong in range(5):
            copy = list(item)
            for k in rng.sample(range(len(copy)), min(wrong, len(copy))):
                copy[k] = "other"
            rows.append([f"t{rng.randrange(60)}" for _ in range(rng.randrange(30))] + copy + [f"t{rng.randrange(60)}" for _ in range(rng.randrange(30))])
    rows += [["t1"] * 40, [f"t{rng.randrange(60)}" for _ in range(200)]]
    items.append(("set-same", ["t1"] * 14))
    texts, named = [(k, " ".join(r)) for k, r in enumerate(rows)], [(k, " ".join(i)) for k, i in items]
    bench = spark.createDataFrame(named, "item_id string, text string")
    found = decontam.contaminations(docs(*texts), bench, block_bytes=block_bytes).collect()
    assert {(r["doc_id"], r["item_id"]): r["n_equal"] for r in found} == brute_force(texts, named)
    assert len(found) == len({(r["doc_id"], r["item_id"]) for r in found})
    kept = decontam.without_contaminated(docs(*texts), bench, block_bytes=block_bytes)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in texts} - {r["doc_id"] for r in found}


@pytest.mark.parametrize("name", ["row", "text2", "found", "item", "tokens", "o"])
def test_clashing_columns(spark, docs, name):
    data = docs((1, "a b c d e f g h i j k l m n o"), (2, "x")).withColumnRenamed("n_chars", name)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o", 7)], f"item_id long, text string, {name} int") if name != "item" else spark.createDataFrame([(1, "a b c d e f g h i j k l m n o")], BENCH)
    (row,) = decontam.without_contaminated(data, bench).collect()
    assert row["doc_id"] == 2 and row[name] == 1
    assert decontam.contaminations(data, bench).count() == 1


def test_weaker_settings_are_refused(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d e")], BENCH)
    with pytest.raises(ValueError, match="masks"):
        decontam.contaminations(docs((1, "a")), bench, similarity=0.5)
