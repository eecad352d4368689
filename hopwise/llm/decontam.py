"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over consecutive tokens with a few positions that count; the others are ignored, so a
substituted token there does no harm. Hashes of every mask at every position of a text are joined with
those of the benchmark; around each hit the two token sequences are compared along the hit's diagonal.

Tokens are runs of letters and digits, in lower case. An item of MIN_TOKENS tokens or more overlaps a text
that has a stretch of it, of MIN_TOKENS tokens at least, with 80 % equal tokens and equal ones at its ends: the
longest such stretch counts. A shorter item overlaps as a whole, if 80 % of its tokens are equal. Items
under five tokens are too short to tell and never match. The masks lose no overlap (tests/llm/test_decontam.py).

The benchmark is the query set. Its different token sequences go to the workers in blocks of at most
BLOCK_BYTES, each a pass over the texts of its own; a benchmark of a usual size is one block. Ids are joined
afterwards, so they may be of any type. The texts aren't shuffled.

Defined cases: a null or empty text has no tokens and overlaps nothing; very long texts are compared whole, by
themselves; null items match nothing; repeated items with different ids match each on their own, repeated
rows of an item once; of an item's equally good overlaps in a text (most equal tokens) the earliest counts;
repeated rows of a text are rows of their own; an empty benchmark or an empty table of texts gives an
empty result; docs may have columns of any name.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import materialize, packed, ready_for_python

MIN_TOKENS = 13
SHORTEST = 5
SIMILARITY = 0.8
#: Positions that count, for items of MIN_TOKENS tokens or more. Where so many tokens in a row have 80 % equal, one mask fits.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6))
#: Positions that count, for shorter items.
SHORT_WEIGHT = 3
BLOCK_BYTES = 32 << 20
BLOOM_BITS = 20
#: Tokens of texts, and hits, that are looked at together.
SLICE_TOKENS, SLICE_HITS = 500_000, 1_000_000

#: Odd multipliers of a seed's five tokens: successive odd multiples of the 64-bit golden ratio.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1 for k in range(5)], np.uint64)

OVERLAP = "array<struct<item:long,doc_start:int,item_start:int,n_tokens:int,n_equal:int>>"


def token_hashes(text: Column) -> Column:
    """A text's tokens, each as its 64-bit hash."""
    tokens = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(tokens, lambda t: F.xxhash64(t))


def seed_hashes(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """One hash for each position where the mask fits."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = tokens[mask[0] : mask[0] + n] * MULTIPLIERS[0]
    for k in range(1, len(mask)):
        total += tokens[mask[k] : mask[k] + n] * MULTIPLIERS[k]
    total ^= total >> np.uint64(29)
    return total * np.uint64(0xBF58476D1CE4E5B9)


def least_equal(n: int, similarity: float = SIMILARITY) -> int:
    """Equal tokens that n tokens need."""
    return int(np.ceil(n * similarity - 1e-9))


def short_seeds(n: int, similarity: float = SIMILARITY) -> list[tuple[tuple[int, ...], int]]:
    """(mask, position) pairs of which one is free of errors however an item of n tokens is substituted.

    Triples of positions are taken, runs first, as long as they escape some pattern of errors that the ones before don't.
    """
    kept = least_equal(n, similarity)
    missed = {frozenset(bad) for bad in combinations(range(n), n - kept)}
    seeds = []
    for places in sorted(combinations(range(n), min(SHORT_WEIGHT, kept)), key=lambda p: (p[-1] - p[0], p[1:] != tuple(range(p[0] + 1, p[-1] + 1)), p[0] % SHORT_WEIGHT, p)):
        escaped = {bad for bad in missed if not bad & set(places)}
        if escaped:
            seeds.append((tuple(p - places[0] for p in places), places[0]))
            missed -= escaped
    return seeds


class Benchmark:
    """Seed hashes of a block of items, sorted, with a bit table in front of them."""

    def __init__(self, keys: list[int], items: list[np.ndarray], similarity: float, min_tokens: int):
        self.keys, self.items = keys, items
        found: dict[tuple[int, ...], list[tuple[np.ndarray, int, np.ndarray]]] = {}
        for number, tokens in enumerate(items):
            if len(tokens) >= min_tokens:
                for mask in MASKS:
                    hashed = seed_hashes(tokens, mask)
                    found.setdefault(mask, []).append((hashed, number, np.arange(len(hashed))))
            else:
                for mask, at in short_seeds(len(tokens), similarity):
                    found.setdefault(mask, []).append((seed_hashes(tokens, mask)[at : at + 1], number, np.array([at])))
        self.tables = []
        for mask, parts in found.items():
            values = np.concatenate([h for h, _, _ in parts])
            owner = np.repeat([n for _, n, _ in parts], [len(h) for h, _, _ in parts])
            place = np.concatenate([p for _, _, p in parts])
            order = np.argsort(values, kind="stable")
            bits = np.zeros(1 << BLOOM_BITS, bool)
            bits[values >> np.uint64(64 - BLOOM_BITS)] = True
            self.tables.append((mask, values[order], owner[order], place[order], bits))

    def hits(self, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows (text, item, diagonal), distinct. tokens: of all texts, cut at bounds."""
        found = [np.zeros((0, 3), np.int64)]
        held = 0
        text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for mask, values, owner, place, bits in self.tables:
            hashed = seed_hashes(tokens, mask)
            at = np.flatnonzero(bits[hashed >> np.uint64(64 - BLOOM_BITS)])
            at = at[text_of[at] == text_of[at + mask[-1]]]
            left, right = np.searchsorted(values, hashed[at], "left"), np.searchsorted(values, hashed[at], "right")
            at, left, n = (x[right > left] for x in (at, left, right - left))
            upto = np.cumsum(n)
            start = 0
            while start < len(at):  # a repeated token has very many hits on few diagonals, so they are taken in parts
                stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SLICE_HITS, "right")))
                m = n[start:stop]
                where = np.repeat(at[start:stop], m)
                k = np.repeat(left[start:stop], m) + np.arange(len(where)) - np.repeat(np.cumsum(m) - m, m)
                texts = text_of[where]
                found.append(np.stack([texts, owner[k], where - bounds[texts] - place[k]], axis=1))
                held += len(where)
                if held > SLICE_HITS:
                    found = [np.unique(np.concatenate(found), axis=0)]
                    held = 0
                start = stop
        return np.unique(np.concatenate(found), axis=0)


def longest_stretch(equal: np.ndarray, similarity: float) -> tuple[int, int]:
    """(start, end) of the longest stretch with so large a share of equal tokens; the first of these."""
    n = len(equal)
    if not n:
        return 0, 0
    sums = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - similarity, -similarity))])
    # A stretch starts and ends with equal tokens, and its sum isn't negative: for each end, the first such start.
    least = np.minimum.accumulate(np.append(np.where(equal, sums[:-1], np.inf), np.inf))
    starts = np.searchsorted(-least, -(sums + 1e-9), "left")
    lengths = np.where(np.append(False, equal), np.arange(n + 1) - starts, 0)
    end = int(np.argmax(lengths))
    return (int(starts[end]), end) if lengths[end] > 0 else (0, 0)


def overlaps(text: np.ndarray, item: np.ndarray, diagonal: int, similarity: float, min_tokens: int) -> tuple[int, int, int, int] | None:
    """(doc_start, item_start, n_tokens, n_equal) along a diagonal, if there is an overlap."""
    a, b = max(0, -diagonal), max(0, -diagonal, min(len(item), len(text) - diagonal))
    equal = item[a:b] == text[a + diagonal : b + diagonal]
    if len(item) < min_tokens:
        n_equal = int(equal.sum())
        return (a + diagonal, a, len(item), n_equal) if n_equal >= least_equal(len(item), similarity) else None
    start, end = longest_stretch(equal, similarity)
    if end - start < min_tokens:
        return None
    return a + diagonal + start, a + start, end - start, int(equal[start:end].sum())


def scan(column: pa.Array, block: Benchmark, similarity: float, min_tokens: int) -> list[list[dict]]:
    """For each text of a column of token hashes, the best overlap with each item."""
    ends = column.offsets.to_numpy().astype(np.int64)
    tokens = column.values.to_numpy(zero_copy_only=False).view(np.uint64)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    out: list[list[dict]] = [[] for _ in range(len(column))]
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_TOKENS, "right")) - 1)
        some, bounds = tokens[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for text, item, diagonal in block.hits(some, bounds).tolist():
            found = overlaps(some[bounds[text] : bounds[text + 1]], block.items[item], diagonal, similarity, min_tokens)
            if found and ((text, item) not in best or (found[3], -found[0]) > (best[text, item][3], -best[text, item][0])):
                best[text, item] = found
        for (text, item), (doc_start, item_start, n, equal) in sorted(best.items()):
            out[first + text].append({"item": block.keys[item], "doc_start": doc_start, "item_start": item_start, "n_tokens": n, "n_equal": equal})
        first = last
    return out


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, item (the key of its tokens) and tokens of the items that can match."""
    tokens = token_hashes(F.col(f"`{text_col}`").cast("string"))
    named = benchmark.select(F.col(f"`{id_col}`").alias("item_id"), tokens.alias("tokens"))
    return named.filter((F.size("tokens") >= SHORTEST) & F.col("item_id").isNotNull()).select("item_id", F.xxhash64("tokens").alias("item"), "tokens")


def _blocks(items: DataFrame, similarity: float, min_tokens: int, block_bytes: int):
    """Blocks of the different items, each bounded in bytes; only one is on the driver at a time."""
    distinct = items.groupBy("item").agg(F.first("tokens").alias("tokens"))
    total = distinct.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0] * 8 * len(MASKS) * 3
    n_blocks = -(-total // block_bytes)
    for k in range(n_blocks):
        rows = distinct.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k).orderBy("item").collect()
        yield Benchmark([r["item"] for r in rows], [np.array(r["tokens"], np.int64).view(np.uint64) for r in rows], similarity, min_tokens), k + 1 == n_blocks


def _finder(shared, similarity: float, min_tokens: int):
    """The Arrow function that looks for a broadcast block in a column of token hashes."""
    kind = pa.list_(pa.struct([("item", pa.int64()), *((c, pa.int32()) for c in ("doc_start", "item_start", "n_tokens", "n_equal"))]))

    @F.arrow_udf(OVERLAP)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array(scan(texts, shared.value, similarity, min_tokens), kind)

    return find


def _passes(docs: DataFrame, items: DataFrame, similarity: float, min_tokens: int, block_bytes: int):
    """For each block: a function that marks rows (columns row and text) with found, and whether it is the last block."""
    if min_tokens < MIN_TOKENS or similarity < SIMILARITY:
        raise ValueError(f"the masks are complete from {MIN_TOKENS} tokens and a similarity of {SIMILARITY} on")
    ready_for_python(docs.sparkSession)
    for block, is_last in _blocks(items, similarity, min_tokens, block_bytes):
        find = _finder(docs.sparkSession.sparkContext.broadcast(block), similarity, min_tokens)
        yield (lambda rows, find=find: rows.withColumn("found", find(token_hashes(F.col("text"))))), is_last


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    min_tokens: int = MIN_TOKENS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each text and benchmark item that overlap: id, item_id, where, and how alike."""
    items = materialize(_items(benchmark, item_id_col, item_text_col), "items")
    texts = docs.select(F.col(f"`{id_col}`").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    parts = [texts.limit(0).select("row", F.explode(F.array().cast(OVERLAP)).alias("o")).select("row", "o.*")]
    for mark, _ in _passes(docs, items, similarity, min_tokens, block_bytes):
        parts.append(materialize(mark(texts).select("row", F.explode("found").alias("o")).select("row", "o.*"), "overlaps"))
    found = reduce(DataFrame.union, parts)
    named = found.join(items.select("item_id", "item").distinct(), "item")
    return named.select(
        F.col("row").alias(id_col), "item_id", "doc_start", "item_start", "n_tokens", "n_equal", F.round(F.col("n_equal") / F.col("n_tokens"), 6).alias("similarity")
    )


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    min_tokens: int = MIN_TOKENS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs without the rows whose text overlaps the benchmark."""
    rows = docs.select(packed(docs).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = materialize(_items(benchmark, item_id_col, item_text_col), "items")
    for mark, is_last in _passes(docs, items, similarity, min_tokens, block_bytes):
        left = mark(rows).filter(F.size("found") == 0).select("row", "text")
        rows = left if is_last else materialize(left, "left")
    return rows.select("row.*")
