"""PII: base patterns against their regular expressions, and disclosed terms."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hopwise.llm import pii

PATTERNS = [
    re.compile(x)
    for x in (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    )
]


def plain(text):
    out = []
    for rank, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))) % 10 == 0
            good = (
                rank == 0
                or (rank == 1 and all(int(p) <= 255 for p in m[0].split(".")))
                or (rank == 2 and 12 <= len(digits) <= 19 and luhn)
                or (rank == 3 and 9 <= len(digits) <= 15)
            )
            if good:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1.@+- (9_é\n", max_size=60))
def test_detect_equals_the_patterns(text):
    assert pii.detect(text) == plain(text)


@pytest.mark.parametrize("text", ["4111 1111 1111 1111", "x@y.z_d@e.f", "a@b.c@d.e", "256.1.1.1 1.2.3.4.5", "+49 (30) 123-4567", "007.1.2.3"])
def test_detect_cases(text):
    assert pii.detect(text) == plain(text)


def test_long_runs_take_linear_time():
    for unit in ("a", "1", "@", "+1", "1.", "a@"):
        pii.detect(unit * 100_000)


def test_terms_that_reveal_an_entity(spark, docs):
    filler = "plain words that many texts share without any meaning whatsoever here"
    about = [(k, f"{filler} zanzibar mail bob@example.org now {k} {'x' * k}") for k in range(1, 5)]
    others = [(k, f"{filler} mail now number {k} {'y' * (k % 7)}") for k in range(5, 60)]
    alone = [(60, f"{filler} zanzibar again")]
    rows = {r["doc_id"]: r for r in pii.digest(pii.scan(docs(*about, *others, *alone), disclosure=0.8)).collect()}
    assert rows[1]["n_email"] == 1
    assert all(rows[k]["n_term"] >= 1 for k in (1, 2, 3, 4, 60))  # the term goes wherever it occurs
    assert all(rows[k]["n_term"] == 0 for k in range(5, 60))
    start = alone[0][1].index("zanzibar")
    assert f"term:{start}:{start + 8}" in rows[60]["spans"]


def test_copies_of_one_text_reveal_nothing(docs):
    rows = pii.digest(pii.scan(docs(*((k, "secretive yodel mail a@b.cd") for k in range(6)), *((k, f"other {k}") for k in range(6, 40))))).collect()
    assert sum(r["n_term"] for r in rows) == 0


def test_terms_of_entities_seen_once(spark, docs):
    """A name in the texts of three addresses that occur nowhere else, at the production parameters."""
    about = docs(*((k, f"write to Zanzibari at {c}@example.org soon") for k, c in enumerate("abc")), (3, "write soon to Once at d@example.org"))
    others = spark.range(10, 70_000).selectExpr("id AS doc_id", "concat('write soon number ', id) AS text", "'en' AS lang", "'src0' AS source", "20L AS n_chars")
    rows = pii.digest(pii.scan(about.union(others))).filter("n_term > 0").collect()
    assert {(r["doc_id"], r["n_term"]) for r in rows} == {(0, 1), (1, 1), (2, 1)}
    assert all("term:9:18" in r["spans"] for r in rows)


def test_edges(docs, empty):
    rows = pii.digest(pii.scan(docs((1, None), (1, None), (None, "a@b.cd"), (2, ""), (3, "b c " * 50_000 + "a@b.cd")))).collect()
    assert len(rows) == 5 and sum(r["n_email"] for r in rows) == 2
    assert pii.digest(pii.scan(empty)).count() == 0


def test_clashing_columns_and_rewriting(docs):
    data = docs((1, "mail a@b.cd or 1.2.3.4"), (2, None)).withColumnRenamed("n_chars", "spans")
    rows = {r["doc_id"]: r["sanitised"] for r in pii.sanitised(data).collect()}
    assert rows == {1: "mail [EMAIL] or [IP]", 2: None}
    found = [{"start": 5, "end": 9, "disclosure": 1.0}, {"start": 10, "end": 14, "disclosure": 0.9}]
    assert pii.rewrite("word gone near x", [], found) == "word  [TERM] x"


def test_mentions_see_whole_words_however_long(docs):
    long = "x" * 500
    text = f"one {long} b c d e f g a@b.cd h 1.2.3.4 {long}é i j k l m n o"
    spans = pii.detect(text)
    first, second = pii.mentions(text, spans)
    assert first["around"].split() == ["one", long, "b", "c", "d", "e", "f", "g", "h", f"{long}é", "i", "j", "k", "l", "m", "n"]
    assert second["around"].split() == [long, "b", "c", "d", "e", "f", "g", "h", f"{long}é", "i", "j", "k", "l", "m", "n", "o"]
    assert [c["kind"] for c in first["classes"]] == ["email", "email domain"]


def test_merged_covers_what_spans_cover():
    rng = random.Random(3)
    for _ in range(200):
        spans = sorted((a, 0, a + rng.randrange(1, 9)) for a in (rng.randrange(40) for _ in range(8)))
        covered = {x for a, _, b in spans for x in range(a, b)}
        made = pii.merged(spans)
        assert {x for a, b in made for x in range(a, b)} == covered
        assert all(x[1] < y[0] for x, y in zip(made, made[1:], strict=False))


def plain_disclosures(texts, window=8, min_support=3, threshold=0.9, delta=0.05):
    """term: (disclosure, kind), by counting."""
    made = [pii.detect(t) for t in texts]
    near, held, n_c, n_t = defaultdict(set), Counter(), Counter(), Counter()
    copies = Counter(texts)
    lettered = lambda t: {w.lower() for w in re.findall(r"[^\W\d_]+", t) if len(w) > 2}
    for text, spans in zip(texts, made, strict=True):
        n_t.update(lettered(text))
        n_c.update({(c["kind"], c["hash"]) for m in pii.mentions(text, spans) for c in m["classes"]})
        for (a, _, b), m in zip(spans, pii.mentions(text, spans), strict=True):
            for c in m["classes"]:
                for w in lettered(m["around"]):
                    near[(c["kind"], c["hash"]), w].add(text)
    out = {}
    for (c, w), found in near.items():
        k, n_ct, n = len(found), sum(copies[t] for t in found), len(texts)
        share, base = n_ct / n_t[w], n_c[c] / n
        if k < min_support or base >= 1 or share <= base:
            continue
        distance = share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0)
        if k / share * distance >= math.log(len(near) / delta) and math.log2(share / base) / math.log2(1 / base) >= threshold:
            out[w] = max(out.get(w, (0, "")), (math.log2(share / base) / math.log2(1 / base), c[0]))
    return out


def corpus(seed):
    """Entities that occur once each, as in the sample tables; some domains and areas have words of their own."""
    rng = random.Random(seed)
    words = [hashlib.md5(str(k).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))[:6] for k in range(300)]
    texts = []
    for k in range(400):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 40))]
        if k % 20 == 0:
            text[2:2] = ["Acmé", f"user{k}@acme.example.com", "Zürich"]
        if k % 25 == 1:
            text[3:3] = ["frontdesk", f"+4930 55{k:05d}", "Zürich"]
        if k % 40 == 2:
            text.append(f"visit user{k}@mail.example.com")
        texts.append(" ".join(text))
    return texts + texts[:30] + ["a single hapaxes here@now.example.org"] * 5


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosures_equal_plain_counts(docs, seed):
    texts = corpus(seed)
    rows = {r["doc_id"]: r for r in pii.digest(pii.scan(docs(*enumerate(texts)))).collect()}
    expected = plain_disclosures(texts)
    assert {"acmé", "frontdesk"} <= set(expected) and "hapaxes" not in expected and "visit" in expected
    for k, text in enumerate(texts):
        taken = pii.merged(pii.detect(text))
        words = [m for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in expected and not any(a < m.end() and m.start() < b for a, b in taken)]
        told = [x.split(":") for x in rows[k]["terms"].split(",") if x]
        assert [(int(t[0]), int(t[1])) for t in told] == [(m.start(), m.end()) for m in words]
        for t, m in zip(told, words, strict=True):
            share, kind = expected[m[0].lower()]
            assert abs(float(t[2]) - share) < 1e-4 and t[4] == kind and t[3] == ("remove" if share >= pii.REMOVAL else "generalise")
        assert rows[k]["n_term"] == len(words)


def test_clean_documents_are_left_alone(docs):
    texts = corpus(3)
    rows = pii.digest(pii.scan(docs(*enumerate(texts)))).collect()
    assert not [r["doc_id"] for r in rows if r["n_term"] and not re.search("acmé|frontdesk|zürich|visit", texts[r["doc_id"]].lower())]


def test_generalised_terms_tell_what_they_reveal():
    found = [{"start": 0, "end": 4, "disclosure": 0.95, "reveals": "email domain"}, {"start": 5, "end": 9, "disclosure": 0.99, "reveals": "phone"}]
    assert pii.rewrite("acme desk x", [], found) == "[EMAIL DOMAIN TERM]  x"


@pytest.mark.parametrize("name", ["__text", "__id", "key", "row", "base", "found", "sanitised"])
def test_sanitised_keeps_columns_of_any_name(docs, name):
    data = docs((1, "mail a@b.cd"), (1, "mail a@b.cd"), (2, None)).withColumnRenamed("n_chars", name)
    out = pii.sanitised(data)
    assert out.columns == [c for c in data.columns if c != "sanitised"] + ["sanitised"]
    assert sorted(r["sanitised"] or "" for r in out.collect()) == ["", "mail [EMAIL]", "mail [EMAIL]"]


def test_letters_that_change_length_in_lower_case(docs):
    about = [(k, f"İstanbul mail u{k}@city.example.com end {k}") for k in range(8)]
    others = [(k, f"mail end number {k} {'y' * (k % 7)}") for k in range(8, 200)]
    rows = {r["doc_id"]: r for r in pii.digest(pii.scan(docs(*about, *others))).collect()}
    assert all("term:0:8" in rows[k]["spans"] for k in range(8))
