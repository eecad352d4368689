"""Secret scan: base kinds against their regular expressions, and verdicts by ownership."""

import random
import re

from pyspark.sql import functions as F

from hopwise.llm import secret_scan

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def plain(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secret_scan.KINDS[r]}:{a}:{b}" for a, r, b in sorted(spans))


def spans(frame):
    rows, _ = secret_scan.scan(frame, owner=F.col("source"), repository=F.col("lang"))
    return rows.collect()


def base(text_spans):
    return ",".join(s for s in text_spans.split(",") if not s.startswith("mixed"))


def test_base_spans_equal_the_patterns(docs):
    rng = random.Random(8)
    parts = ["password", "TOKEN", "api_key", "apikey", "secret", ":", "=", " ", '"', "'", "abcdefgh", "0123456789abcdef" * 2, "AKIA", "ABCD1234EFGH5678", "é", "\n", "x.y", "f"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    texts += ["password:token:abcdefgh1234", "secret=" + "a" * 50_000, "token=abcdefgh " * 900, "AKIAAKIA01234567", None, "", "a" * 100_000]
    for row in spans(docs(*enumerate(texts))):
        assert base(row["spans"]) == plain(texts[row["doc_id"]] or "")


def test_verdicts_by_owner(docs):
    common, own, mixed = "secret=hunterExample99", "secret=Zq81kLmn42pQrs", "Ab3dEf6hIj9lMn2pQr5tUv8x"
    data = docs(*((k, common, "en", f"s{k}") for k in range(4)), (10, own, "en", "s1"), (11, own, "de", "s1"), (12, "secret=aaaaaaaaaa", "en", "s2"), (13, f"see {mixed} there", "en", "s3"), (14, own + "x", None, None))
    rows = {r["doc_id"]: r for r in spans(data)}
    assert all(rows[k]["n_example"] == 1 and rows[k]["n_live"] == 0 for k in range(4))
    assert rows[10]["n_live"] == rows[11]["n_live"] == rows[14]["n_live"] == 1
    assert rows[12]["n_live"] == 0
    assert rows[13]["spans"] == "mixed:4:28"


def test_edges(docs, empty):
    data = docs((1, None), (1, "token=abcdefgh"), (1, "token=abcdefgh"), (None, "token=abcdefgh")).withColumnRenamed("n_chars", "spans")
    assert sorted(r["n_assign"] for r in spans(data)) == [0, 1, 1, 1]
    assert spans(empty) == []


def test_verdicts_by_owner_and_repository_equal_counts(docs):
    rng = random.Random(4)
    values = [f"Val{k}abcdefgh{k * 37}" for k in range(14)] + ["aaaaaaaaaaaa", "ababababab"]
    rows = [(k, f"secret={rng.choice(values[: 4 + k % 12])} and token={rng.choice(values)}", rng.choice(["en", "de", "fr", "es", "it"]), f"s{rng.choice([0, 0, 0, 0, 1, 2])}") for k in range(90)]
    rows += [(100 + k, f"secret=HouseSample{77}x", lang, "s5") for k, lang in enumerate(["en", "de", "fr", "es", "it"])]
    rows += [(120, "secret=aaaaaaaaab", "en", "s6"), (121, "secret=OnlyHere123z", "en", "s6")]
    rows += [(110 + k, "secret=BothSample99y", lang, owner) for k, (lang, owner) in enumerate([("en", "s1"), ("de", "s1"), ("fr", "s2"), ("es", "s2")])]
    owners, repos = {}, {}
    for _, text, lang, owner in rows:
        for m in ASSIGN.finditer(text):
            owners.setdefault(m[2], set()).add(owner)
            repos.setdefault(m[2], set()).add((owner, lang))

    def verdict(value):
        n, m = len(owners[value]), len(repos[value])
        if n >= 3 or (n > 1 and m >= 4):
            return "example"
        return "filler" if len(set(value)) < 7 else "live" if n == 1 and m < 4 else "house" if n == 1 else "shared"

    found = {r["doc_id"]: r for r in spans(docs(*rows))}
    for doc_id, text, _, _ in rows:
        told = [verdict(m[2]) for m in ASSIGN.finditer(text)]
        assert (found[doc_id]["n_live"], found[doc_id]["n_example"]) == (told.count("live"), told.count("example"))
    assert {"example", "filler", "live", "house"} <= {verdict(v) for v in owners}
