"""Line dedup against all pairs."""

import random

import pytest

from hopwise.llm import line_dedup


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    s = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
    return p + s >= max(len(a), len(b)) - 1


def expected(rows, min_words=5):
    """(row, line) -> (row of the keeper, line, distance); rows in order."""
    lines = [((k, n), tuple(line.split())) for k, text in enumerate(rows) for n, line in enumerate((text or "").split("\n")) if line.split()]
    out = {}
    for i, (at, w) in enumerate(lines):
        for before, v in lines[:i]:
            if v == w or (len(v) >= min_words and len(w) >= min_words and distance_one(v, w)):
                first = next(a for a, x in lines if x == w)
                out[at] = (*before, 0 if before == first else 1)
                break
    return out


def found(frame):
    return {(r["doc_id"], r["line_no"]): (r["keeper_id"], r["keeper_line_no"], r["distance"]) for r in frame.collect()}


def test_equals_all_pairs(docs):
    rng = random.Random(6)
    rows = []
    for _ in range(40):
        lines = []
        for _ in range(5):
            n = rng.choice((2, 4, 5, 6, 9))
            words = [rng.choice("ab") for _ in range(n)] if rng.random() < 0.5 else [f"w{(n + k) % 12}" for k in range(n)]
            if rng.random() < 0.4:
                words[rng.randrange(n)] = rng.choice("xyz")
            if rng.random() < 0.3:
                words.insert(rng.randrange(n), "extra")
            lines.append(" ".join(words))
        rows.append("\n".join(lines))
    assert found(line_dedup.duplicates(docs(*enumerate(rows)))) == expected(rows)


def test_long_lines(docs):
    long = [f"w{k}" for k in range(300)]
    rows = [" ".join(long), " ".join(long[:150] + long[151:]), " ".join([*long[:77], "other", *long[78:]]), " ".join(long[2:])]
    assert found(line_dedup.duplicates(docs(*enumerate(rows)))) == expected(rows)


def test_edges(docs, empty):
    data = docs((1, None), (2, ""), (3, "one line here\n \none  line here"), (3, "one line here"), (None, "one line here\nanother")).withColumnRenamed("n_chars", "line_no")
    got = [(r["doc_id"], r["line_no"], r["keeper_id"], r["keeper_line_no"], r["distance"]) for r in line_dedup.duplicates(data).collect()]
    assert sorted(got, key=str) == sorted([(3, 2, 3, 0, 0), (3, 0, 3, 0, 0), (None, 0, 3, 0, 0)], key=str)
    out = line_dedup.deduplicated(data)
    assert out.columns == data.columns
    assert sorted((r["text"] for r in out.collect()), key=str) == sorted([None, "", "one line here\n ", "", "another"], key=str)
    assert line_dedup.duplicates(empty).count() == 0


@pytest.mark.parametrize("name", ["__gone", "gone", "row", "__row", "id", "line", "w"])
def test_deduplicated_keeps_columns_of_any_name(docs, name):
    data = docs((1, "one line of five words\nnext"), (2, "one line of five words"), (3, None)).withColumnRenamed("n_chars", name)
    out = line_dedup.deduplicated(data)
    assert out.columns == data.columns
    assert {(r["doc_id"], r["text"], r[name]) for r in out.collect()} == {(1, "one line of five words\nnext", 27), (2, "", 22), (3, None, 0)}
    assert line_dedup.duplicates(data).count() == 1


def test_all_gaps_separate_words(docs):
    rows = ["a b c d e\nf\tg h\x0bi j", "a\tb\x0bc\x0cd\re\n\t\r", "f g  h i j\n \n\x0c"]
    got = {(r["doc_id"], r["line_no"]) for r in line_dedup.duplicates(docs(*enumerate(rows))).collect()}
    assert got == {(1, 0), (2, 0)}
