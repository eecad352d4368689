"""Quality rules: counts against plain Python, binomial tails, and cutoffs that keep good documents."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hopwise.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def plain(text):
    w = WORD.findall(text or "")
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \t\n", "a", "a b c a b c", "a a a a a", "x y z\nx y z\n\nq", "é#ß| tail\r\nx\x0bq", "a b c d a b c e b c d", " ".join(f"w{k % 700}" for k in range(20_000)), "q" * 200_000]


def test_counts(spark, docs):
    found = {r["doc_id"]: r for r in quality.verdicts(docs(*enumerate(TEXTS)), spark.createDataFrame([], LABELS)).collect()}
    for k, text in enumerate(TEXTS):
        r = found[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain(text)
        n, *_, repeated = plain(text)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)


def test_binomial_tail(spark):
    rows = [(0, 100, 0.01), (3, 1000, 0.01), (9, 50, 0.01), (40, 9000, 0.01), (0, 0, 0.01)]
    for k, n, p in rows:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p).alias("v")).first()["v"]
        if k >= n * p:
            assert got == 1.0
        else:
            exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
            assert got == pytest.approx(exact, rel=1e-9)


def prose(k, n=60):
    return " ".join(f"{'abcdefghij'[k % 10]}word{(k * 31 + j * j) % 997}" for j in range(n))


def test_cutoffs_reject_junk_and_keep_good(spark, docs):
    good = [(k, prose(k), "en") for k in range(3000)]
    junk = [(10_000 + k, prose(k).replace(" ", "### "), "en") for k in range(40)]
    few = [(20_000 + k, prose(k).replace(" ", "### "), "xx") for k in range(5)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(3000)] + [(10_000 + k, 0, 0) for k in range(20)], LABELS)
    data = docs(*good, *junk, *few)
    rows = quality.verdicts(data, labels).collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert sum(k < 3000 for k in kept) >= 0.98 * 3000
    assert not any(10_000 <= k < 20_000 for k in kept)
    assert all(20_000 + k in kept for k in range(5))  # a stratum without labels has no cutoffs
    passed = {r["doc_id"] for r in quality.accepted(data, labels).collect()}
    assert passed == kept


def test_without_labels_only_base_rules(spark, docs, empty):
    none = spark.createDataFrame([], LABELS)
    data = docs((1, prose(1)), (1, prose(1)), (None, prose(2)), (3, None), (4, "x", None)).withColumnRenamed("source", "n_words")
    assert sorted(r["kept"] for r in quality.verdicts(data, none).collect()) == [False, False, True, True, True]
    out = quality.accepted(data, none)
    assert out.columns == data.columns and out.count() == 3
    assert quality.verdicts(empty, none).count() == 0 and quality.accepted(empty, none).count() == 0


def plain_statistics(text):
    n, chars, symbols, dup, repeated = plain(text)
    lines = len([x for x in (text or "").split("\n") if WORD.search(x)])
    capitals = sum(c.isupper() for c in text)
    marks = len(re.findall(r"[^A-Za-z0-9\x20\x09-\x0D]", text))
    return (100 * symbols / n, 100 * capitals / chars, 100 * repeated / n, 100 * dup / lines, chars / n, 100 * marks / chars)


def tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def plain_verdicts(rows, good, alpha, delta):
    """(doc_id, text, lang): kept, by trying each ladder in order on the different good texts of a language."""
    base_ok = lambda t: len(WORD.findall(t)) >= 50 and 2 * plain(t)[4] <= plain(t)[0]
    trials = {}
    for doc_id, text, lang in rows:
        if doc_id in good and base_ok(text):
            trials.setdefault(lang, {})[text] = plain_statistics(text)
    rules, cutoffs = quality.RULES, {}
    for lang, texts in trials.items():
        for k, rule in enumerate(rules):
            for cutoff in rule.ladder:
                rejected = sum(s[k] > cutoff for s in texts.values())
                if rejected >= len(texts) * alpha / len(rules) or tail(rejected, len(texts), alpha / len(rules)) > delta / (len(trials) * len(rules)):
                    break
                cutoffs[lang, k] = cutoff
    return {d: base_ok(t) and all(s <= cutoffs.get((lang, k), math.inf) for k, s in enumerate(plain_statistics(t))) for d, t, lang in rows}


def test_verdicts_equal_plain(spark, docs):
    rng = random.Random(5)
    rows = []
    for k in range(900):
        words = [f"{rng.choice('abcdefghij')}{rng.randrange(997)}" for _ in range(rng.choice([40, 55, 70]))]
        for _ in range(rng.choice([0, 0, 1, 4, 30])):
            words[rng.randrange(len(words))] = rng.choice(["###", "LOUD", "a" * 40, "same same same", "!", "two\ntwo\ntwo"])
        rows.append((k, " ".join(words), rng.choice(["en", "de"])))
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(200)]  # copies are no trials of their own
    good = {k for k, _, _ in rows if rng.random() < 0.8}
    labels = spark.createDataFrame([(k, int(k in good), 0) for k, _, _ in rows], LABELS)
    found = {r["doc_id"]: r["kept"] for r in quality.verdicts(docs(*rows), labels, alpha=0.4, delta=0.2).collect()}
    expected = plain_verdicts(rows, good, 0.4, 0.2)
    assert found == expected
    assert {r[0] for r in rows if len(WORD.findall(r[1])) >= 50 and 2 * plain(r[1])[4] <= plain(r[1])[0]} != {k for k, x in expected.items() if x}
