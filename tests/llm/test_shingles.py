"""Near-duplicates by Jaccard similarity against all pairs."""

import random

import corpus_pipeline
import pytest
from hopwise.llm import shingles


def plain_set(text, words=5):
    tokens = (text or "").lower().split()
    return {tuple(tokens[k : k + words]) for k in range(len(tokens) - words + 1)} or ({tuple(tokens)} if tokens else set())


def brute(texts):
    """The smallest index that each text is linked to, over links of Jaccard >= 0.8."""
    made, root = [plain_set(t) for t in texts], list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if made[i] == made[j] or len(made[i] & made[j]) * 5 >= 4 * len(made[i] | made[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def corpus(seed, n=160):
    draw = random.Random(seed)
    line = " ".join(f"common{k}" for k in range(14))
    texts = []
    for _ in range(n):
        if texts and draw.random() < 0.6:
            words = draw.choice(texts).split()
            for _ in range(draw.randint(0, 4)):
                words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
        else:
            words = [f"w{draw.randrange(10**4)}" for _ in range(draw.choice([3, 8, 30, 60, 120]))]
        texts.append(" ".join(words) + (f" {line}" if draw.random() < 0.2 else ""))
    return [*texts, "", "   "]


@pytest.mark.parametrize("seed,bucket_rows", [(1, 1000), (2, 7)])
def test_components_equal_all_pairs(docs, seed, bucket_rows):
    texts = corpus(seed)
    found = shingles.near_duplicates(docs(*enumerate(texts)), bucket_rows=bucket_rows).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(brute(texts)))


def test_the_stage_drops_copies_beyond_three_bits(spark, docs):
    words = [f"w{(j * j * 31) % 9973}" for j in range(80)]
    near = [*words[:20], "changed", *words[21:]]  # 71 of 81 shingles are in both
    far = [*words[:20], "changed", *words[21:50], "twice", *words[51:]]  # 66 of 86: below 0.8
    left = corpus_pipeline.near_dedup(spark, docs((1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far[::-1]))), "")
    assert {r["doc_id"] for r in left.collect()} == {1, 3}


def test_edges(docs, empty):
    found = shingles.near_duplicates(docs((2, None), (2, ""), (None, "a b"), (3, "A  b"), (None, "only here"))).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in found), key=str) == sorted([(2, 2), (2, 2), (None, 3), (3, 3), (None, None)], key=str)
    assert shingles.near_duplicates(empty).count() == 0
