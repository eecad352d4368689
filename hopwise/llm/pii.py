"""Personal data: base patterns, and information-theoretic sanitisation of the terms around them.

Base entities (addresses, numbers) are found by patterns. An entity belongs to classes: itself, and what it is part of
(a mail domain, a network, a card's issuer, a phone's area). Over the whole corpus, a term's and a
class's co-occurrence (the term within a few words of one of its entities) gives their pointwise mutual
information. Its share of the class's information content, PMI(c; t) / IC(c), tells how much of the class
the term reveals: 1 if the term occurs nowhere else. Entities that occur once, the usual case, so still count
together for their class.

A pair of class and term is evidence if it comes in min_support different texts, and if so many could be chance only with
a probability under delta in any of the pairs scored (Bonferroni over a Chernoff bound of the binomial tail).
Terms that are evidence and reach the disclosure threshold with some class are sanitised wherever they
occur: removed if they reveal nearly all, else generalised to the kind of class that they reveal.

Counts are of rows; evidence is of different texts, so copies of one text don't reveal anything. Terms
are runs of letters, in lower case. Only hashes of entities are kept.

Defined cases: a null text counts as empty; a very long text is read whole, in time in proportion to its length but for
sorting; null and repeated ids, and repeated rows, are rows of their own; of classes that a term reveals
equally the last by name is given; of kinds that begin at one place all are spans, in the kinds' order, but no term
overlaps a base span; an empty table gives an empty result; other columns of docs are ignored, or passed through
by sanitised(), whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.llm import bits
from hopwise.llm.common import materialize, packed, ready_for_python, slices
from hopwise.llm.secret_scan import listed

KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WINDOW_WORDS = 8
MIN_SUPPORT = 3
CHANCE = 0.05
DISCLOSURE = 0.9
REMOVAL = 0.98

Span = tuple[int, int, int]  # start, rank of the kind, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain, found from each @ outwards, which takes linear time."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Base spans by start, then kind; matches that fail their kind's test are dropped."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in ADDRESS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def classes(rank: int, value: str) -> list[tuple[str, str]]:
    """(kind, name) of the classes that an entity belongs to, itself first."""
    if rank == 0:
        value = value.lower()
        return [("email", value), ("email domain", value.rpartition("@")[2])]
    if rank == 1:
        parts = [p.lstrip("0") or "0" for p in value.split(".")]
        return [("ip", ".".join(parts)), ("ip network", ".".join(parts[:3])), ("ip range", ".".join(parts[:2]))]
    digits = re.sub("[^0-9]", "", value)
    return [("card", digits), ("card issuer", digits[:6])] if rank == 2 else [("phone", digits), ("phone area", digits[:5])]


def mentions(text: str, spans: list[Span], window: int = WINDOW_WORDS) -> list[dict]:
    """For each base span, its entity's classes (kind and hash) and the words around it, base spans blanked out."""
    chars = list(text)
    for a, _, b in spans:
        chars[a:b] = " " * (b - a)
    found = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", "".join(chars))]
    starts, ends = [w[0] for w in found], [w[1] for w in found]
    out = []
    for a, rank, b in spans:
        left, right = bisect_right(ends, a), bisect_left(starts, b)
        around = found[max(0, left - window) : left] + found[right : right + window]
        named = [{"kind": k, "hash": hashlib.md5(f"{k}:{v}".encode()).hexdigest()} for k, v in classes(rank, text[a:b])]
        out.append({"classes": named, "around": " ".join(w for _, _, w in around)})
    return out


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
MENTIONS = pa.list_(pa.struct([("classes", pa.list_(pa.struct([("kind", pa.string()), ("hash", pa.string())]))), ("around", pa.string())]))
MENTIONS_DDL = "array<struct<classes:array<struct<kind:string,hash:string>>,around:string>>"


def base_spans(docs: DataFrame, keep: str, window: int) -> DataFrame:
    """__id, __text (the text's md5), spans and mentions for every row. docs: __id and __t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, spans, around = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                found = detect(text)
                keys.append(hashlib.md5(text.encode("utf-8")).hexdigest())
                spans.append([{"start": a, "rank": r, "end": b} for a, r, b in found])
                around.append(mentions(text, found, window) if found else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.string()), pa.array(spans, SPANS), pa.array(around, MENTIONS)], names=["__id", "__text", "spans", "mentions"]
            )

    return docs.mapInArrow(run, f"__id {keep}, __text string, spans array<struct<start:int,rank:int,end:int>>, mentions {MENTIONS_DDL}")


def tokens(text: Column) -> Column:
    """The different runs of letters of a text, of at least three."""
    return F.filter(F.array_distinct(F.split(text, r"[^\p{L}]+")), lambda t: F.char_length(t) > 2)


def terms(text: Column) -> Column:
    """The different terms of a text: its runs of letters in lower case."""
    return F.array_distinct(F.transform(tokens(text), F.lower))


def disclosures(docs: DataFrame, each: DataFrame, min_support: int, threshold: float, delta: float) -> DataFrame:
    """term, disclosure (the most with any class) and reveals (that class's kind) of terms that reach the threshold.

    docs: __t; each: as base_spans() gives it.
    """
    some = each.filter(F.size("mentions") > 0).select("__text", "mentions")
    near = some.select("__text", F.explode("mentions").alias("m")).select("__text", "m.around", F.explode("m.classes").alias("c"))
    by_text = near.select("__text", "c", F.explode(terms(F.col("around"))).alias("term")).distinct()
    held = some.select("__text", F.explode(F.array_distinct(F.flatten(F.transform("mentions", lambda m: m["classes"])))).alias("c"))
    copies = held.groupBy("c", "__text").agg(F.count("*").alias("copies"))
    by_class = copies.groupBy("c").agg(F.sum("copies").alias("n_c"))
    together = materialize(by_text.join(copies, ["c", "__text"]).groupBy("c", "term").agg(F.sum("copies").alias("n_ct"), F.count("*").alias("support")), "together")
    tests = together.count()
    pairs = materialize(together.filter(F.col("support") >= min_support).join(by_class, "c"), "pairs")
    wanted = materialize(pairs.select("term").distinct(), "wanted")
    if wanted.isEmpty():
        return wanted.select("term", F.lit(0.0).alias("disclosure"), F.lit("").alias("reveals"))
    words = docs.select(F.explode(terms(F.coalesce("__t", F.lit("")))).alias("term"))
    seen = bits.semi(words, wanted, "term").groupBy("term").agg(F.count("*").alias("n_t"))
    n = float(each.count())
    share, base = F.col("n_ct") / F.col("n_t"), F.col("n_c") / n
    distance = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    evidence = (share > base) & (F.col("support") / share * distance >= F.log(F.lit(tests / delta)))
    disclosure = F.log2(share / base) / F.log2(1 / base)
    scored = pairs.join(seen, "term").filter(F.col("n_c") < n).filter(evidence).withColumn("disclosure", disclosure).filter(F.col("disclosure") >= threshold)
    best = scored.groupBy("term").agg(F.max(F.struct("disclosure", F.col("c.kind").alias("reveals"))).alias("b"))
    return best.select("term", "b.*")


FOUND = "array<struct<start:int,rank:int,end:int,disclosure:double,reveals:string>>"


def term_spans(docs: DataFrame, revealing: DataFrame) -> DataFrame:
    """__text and found (spans of revealing terms), once for each different text. docs: __t.

    First the texts' revealing terms, as they are written, are found by a join, then only those texts are read for places.
    """
    key = F.md5(F.coalesce("__t", F.lit("")))
    words = docs.select(key.alias("__text"), F.explode(tokens(F.coalesce("__t", F.lit("")))).alias("written")).withColumn("term", F.lower("written"))
    joined = bits.semi(words, revealing, "term").join(revealing, "term")
    hits = materialize(joined.groupBy("__text").agg(F.collect_set(F.struct("written", "disclosure", "reveals")).alias("hits")), "hits")
    texts = bits.semi(docs.select(key.alias("__text"), "__t"), hits.select("__text"), "__text").groupBy("__text").agg(F.first("__t").alias("__t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letters = regex.compile(r"\p{L}+")
        kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("disclosure", pa.float64()), ("reveals", pa.string())]))
        for batch in slices(batches):
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                known, spans = {h["written"]: h for h in found}, []
                taken, k = merged(detect(text)), 0
                for m in letters.finditer(text):
                    if m[0] in known:
                        while k < len(taken) and taken[k][1] <= m.start():
                            k += 1
                        if k == len(taken) or m.end() <= taken[k][0]:
                            spans.append({"start": m.start(), "rank": 4, "end": m.end(), "disclosure": known[m[0]]["disclosure"], "reveals": known[m[0]]["reveals"]})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["__text", "found"])

    return texts.join(hits, "__text").select("__text", "__t", "hits").mapInArrow(run, f"__text string, found {FOUND}")


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The places that spans, sorted by start, cover: intervals apart from one another."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW_WORDS,
    min_support: int = MIN_SUPPORT,
    disclosure: float = DISCLOSURE,
    delta: float = CHANCE,
) -> DataFrame:
    """id, __text, base (spans) and found (terms' spans, with their disclosure and what they reveal) for every row."""
    ready_for_python(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__t"))
    each = materialize(base_spans(texts, docs.schema[id_col].dataType.simpleString(), window), "spans")
    revealing = materialize(disclosures(texts, each, min_support, disclosure, delta), "terms")
    none = F.array().cast(FOUND)
    rows = each.select(F.col("__id").alias(id_col), "__text", F.col("spans").alias("base"))
    if revealing.isEmpty():
        return rows.withColumn("found", none)
    found = materialize(term_spans(texts, revealing), "found")
    return rows.join(found, "__text", "left").select(*rows.columns, F.coalesce("found", none).alias("found"))


def digest(scanned: DataFrame, id_col: str = "doc_id", removal: float = REMOVAL) -> DataFrame:
    """Counts and span lists of what scan() found; terms: start:end:disclosure:action:what is revealed of each term."""
    plain = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    def told(s: Column) -> Column:
        action = F.when(s["disclosure"] >= removal, "remove").otherwise("generalise")
        return F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), F.round(s["disclosure"], 4).cast("string"), action, s["reveals"])

    return scanned.select(
        F.col(f"`{id_col}`"),
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"),
        listed(F.concat("base", plain), KINDS).alias("spans"),
        F.size("found").cast("long").alias("n_term"),
        F.array_join(F.transform("found", told), ",").alias("terms"),
    )


def rewrite(text: str, base: list[dict], found: list[dict], removal: float = REMOVAL) -> str:
    """The text with base spans as [KIND], and terms removed or as the kind that they reveal; overlapping spans are joined."""
    out, at = [], 0
    marked = [(s["start"], s["end"], f"[{KINDS[s['rank']].upper()}]") for s in base]
    general = lambda s: f"[{s['reveals']} term]".upper() if s.get("reveals") else "[TERM]"
    marked += [(s["start"], s["end"], "" if s["disclosure"] >= removal else general(s)) for s in found]
    for start, end, name in sorted(marked):
        if start >= at:
            out += [text[at:start], name]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, name: str = "sanitised", *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with a column of sanitised texts (null for null) in place of any of that name."""
    ready_for_python(docs.sparkSession)
    scanned = scan(docs, id_col=id_col, text_col=text_col, **how)
    spans = scanned.groupBy(F.col("__text").alias("key")).agg(F.first("base").alias("base"), F.first("found").alias("found"))

    @F.arrow_udf("string")
    def apply(text: pa.Array, base: pa.Array, found: pa.Array) -> pa.Array:
        rows = zip(text.to_pylist(), base.to_pylist(), found.to_pylist(), strict=True)
        return pa.array([None if t is None else rewrite(t, b or [], f or []) for t, b, f in rows], pa.string())

    kept = docs.drop(name)
    text = F.col(f"`{text_col}`").cast("string")
    whole = docs.select(packed(kept).alias("row"), text.alias("text"), F.md5(F.coalesce(text, F.lit(""))).alias("key"))
    return whole.join(spans, "key", "left").select("row.*", apply(F.col("text"), "base", "found").alias(name))
