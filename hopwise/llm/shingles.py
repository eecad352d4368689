"""Near-duplicates by exact Jaccard similarity of word shingles: SimHash tries, then a prefix join, each link checked.

SimHash fingerprints of the shingles are linked by the trie self-join of simhash.py, which finds close copies with
few comparisons. But a similarity of 0.8 is some ten differing bits of 64, far beyond the budget that tries
can carry, so a prefix join completes the links. Whatever proposes a pair, only the exact similarity links it.

A text is the set of its shingles' 63-bit hashes, in one order for all texts: hashes first that a sample
shows seldom. Two sets of at least the similarity share one of their first |x| - ceil(s |x|) + 1 members,
so sets meet by those, and no link is lost. A candidate must first pass a bound of its symmetric difference
by histograms of both sets, then the exact similarity of both whole sets, and only then counts for components.

First, besides the tries' pairs, each set meets the centre of its bucket and size, the one with the fewest members of
its own; the links found join the sets into components. Then sets of different components meet in pairs: within a component no more links are needed, so a large
group of near copies is not paired. Their meetings are counted, and the places in both prefixes bound the
similarity from above before anything larger than a pair moves. A bucket of very many sets is split into chunks that meet two at a time.

Defined cases: a text shorter than a shingle is one shingle; null, empty and wordless texts are copies of one
another; a very long text's whole set is compared; rows without an id get the component of their set but can't
name one; repeated ids and rows are rows of their own; an empty table gives an empty result; other columns of
docs are ignored, or passed through by without_near_duplicates(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.llm import bits
from hopwise.llm.common import materialize, ready_for_python, slices
from hopwise.llm.components import connected_components
from hopwise.llm.simhash import classes, kept_rows, linked_fingerprints, majority, shingle_hashes, signed

#: Sets of a bucket that one task pairs; a larger bucket is split into chunks of this size.
BUCKET_ROWS = 1000
#: One text in so many is counted for the order, and hashes in so many of these come last.
SAMPLED, OFTEN = 16, 8
LOG_BITS = 22
#: Meetings that a task puts together before it hands on their pairs.
PAIRS_HELD = 1_000_000
SIGN = np.uint64(1 << 63)
HISTOGRAM = 256
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int, often: np.ndarray | None = None) -> np.ndarray:
    """The sorted set of a text's shingles as longs; those of often's bits come after the others."""
    return as_set(shingle_hashes(text, words, 0), often)


def as_set(hashes: np.ndarray, often: np.ndarray | None = None) -> np.ndarray:
    values = hashes >> np.uint64(1)
    seldom = np.ones(len(values), bool) if often is None else ~often[values >> np.uint64(63 - LOG_BITS)]
    return np.unique(np.where(seldom, values | SIGN, values).view(np.int64))


def plain_key(members: np.ndarray) -> int:
    """What stands for a set: a hash of it, in any order."""
    import xxhash

    return signed(xxhash.xxh64_intdigest(np.sort(members.view(np.uint64) | SIGN).tobytes()) if len(members) else 0)


def share(similarity: float) -> tuple[int, int]:
    exact = Fraction(str(similarity))
    return exact.numerator, exact.denominator


def prefix_length(n: int, similarity: float) -> int:
    num, den = share(similarity)
    return n + num * -n // den + 1 if n else 0


def histogram(members: np.ndarray) -> bytes:
    """How many members fall into each of HISTOGRAM ranges of a hash, up to 255."""
    at = ((members.view(np.uint64) & ~SIGN) * SPREAD) >> np.uint64(56)
    return np.minimum(np.bincount(at.astype(np.int64), minlength=HISTOGRAM), 255).astype(np.uint8).tobytes()


def may_be_similar(nx: int, ny: int, hx: bytes, hy: bytes, similarity: float) -> bool:
    """False only if sets of nx and ny members with these histograms are below the similarity.

    Histograms show a part of the symmetric difference.
    """
    num, den = share(similarity)
    apart = np.abs(np.frombuffer(hx, np.uint8).astype(np.int16) - np.frombuffer(hy, np.uint8)).sum()
    return apart * (den + num) <= (den - num) * (nx + ny)


def is_similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    num, den = share(similarity)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common * den >= num * (len(x) + len(y) - common)


def lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column without nulls."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def often_seen(texts: DataFrame, words: int) -> np.ndarray:
    """Bits of the hashes that many texts of a sample hold: an order only, so a sample will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                values = shingle_set(text, words).view(np.uint64) ^ SIGN
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["h"])

    sample = texts.filter(F.pmod("__copy", F.lit(SAMPLED)) == 0).groupBy("__copy").agg(F.first("__t").alias("__t")).select("__t")
    counted = sample.mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= OFTEN)
    counted = materialize(counted.select("h", F.floor(F.log2("count")).alias("log")), "often")
    held, least = 0, 64
    for r in counted.groupBy("log").count().orderBy(F.desc("log")).collect():  # the most frequent ones that the table can tell apart
        held += r["count"]
        if held > 1 << (LOG_BITS - 3) and least < 64:
            break
        least = r["log"]
    often = counted.filter(F.col("log") >= least)
    at = often.select(F.shiftright("h", 63 - LOG_BITS).cast("int").alias("at"))  # as bits.table(), for Python to read
    filled = at.groupBy(F.shiftright("at", 5).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, at & 31)")).alias("w"))
    table = np.zeros((1 << (LOG_BITS - 5), 32), bool)
    for r in filled.collect():
        table[r["id"]] = r["w"] >> np.arange(32) & 1
    return table.reshape(-1)


def sets(texts: DataFrame, id_type: str, words: int, similarity: float) -> DataFrame:
    """__id, __copy, key (hash of the set), fp (SimHash), n (its members), histogram and prefix for every row. texts: __id, __copy, __t."""
    often = np.packbits(often_seen(texts, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(often).view(bool)
        for batch in slices(batches):
            hashed = [shingle_hashes(t.as_py(), words, 0) for t in batch.column(2)]
            prints = [signed(majority(h)) if len(h) else 0 for h in hashed]
            all_of = [as_set(h, table) for h in hashed]
            keys = np.array([plain_key(s) for s in all_of], np.int64)
            firsts = [s[: prefix_length(len(s), similarity)] for s in all_of]
            ends = pa.array(np.cumsum([0, *map(len, firsts)]), pa.int32())
            prefix = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *firsts])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys), pa.array(prints, pa.int64()), pa.array([len(s) for s in all_of], pa.int32()), pa.array([histogram(s) for s in all_of], pa.binary()), prefix],
                names=["__id", "__copy", "key", "fp", "n", "histogram", "prefix"],
            )

    return texts.select("__id", "__copy", "__t").mapInArrow(run, f"__id {id_type}, __copy long, key long, fp long, n int, histogram binary, prefix array<long>")


def trie_pairs(each: DataFrame, budget: int) -> DataFrame:
    """Pairs (a < b) of keys: each key with the least of its fingerprint, and the least ones of linked fingerprints."""
    by_key = each.groupBy("key").agg(F.first("fp").alias("fp"))
    least = materialize(by_key.groupBy("fp").agg(F.min("key").alias("least")), "prints")
    linked = linked_fingerprints(least.select("fp"), budget)
    first, second = least.select(F.col("fp").alias("a"), F.col("least").alias("x")), least.select(F.col("fp").alias("b"), F.col("least").alias("y"))
    near = linked.join(first, "a").join(second, "b").select("x", "y")
    same = by_key.join(least, "fp").select(F.col("least").alias("x"), F.col("key").alias("y"))
    return near.union(same).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def written(df: DataFrame, name: str) -> DataFrame:
    """materialize(), after which the shuffle files of df are given up: Spark drops them when the driver collects garbage."""
    made = materialize(df, name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return made


def checked(pairs: DataFrame, held: DataFrame, kind: str, test) -> DataFrame:
    """The pairs (a, b) that pass the test of both rows' columns, held being key and those."""
    names = [c for c in held.columns if c != "key"]

    def values(column: pa.Array) -> list:
        return lists(column) if pa.types.is_list(column.type) else column.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = [test(*x) for x in zip(*(values(c) for c in batch.columns[2:]), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    x, y = (held.select(F.col("key").alias(e), *(F.col(c).alias(f"{c}_{e}") for c in names)) for e in "ab")
    both = pairs.join(x, "a").join(y, "b").select("a", "b", *(f"{c}_{e}" for c in names for e in "ab"))
    return written(both.mapInArrow(run, "a long, b long"), kind)


def links(pairs: DataFrame, each: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys, all different, with at least the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([shingle_set(text, words)])], names=["key", "members"])

    def ends(of: DataFrame) -> DataFrame:
        return of.select(F.col("a").alias("key")).union(of.select(F.col("b").alias("key"))).distinct()

    met = bits.semi(each, ends(pairs), "key", exact=True).groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "histogram")))
    near = checked(pairs, written(met, "histograms"), "candidates", lambda *both: may_be_similar(*both, similarity))
    one = materialize(bits.semi(each.select("key", "__copy"), ends(near), "key", exact=True).groupBy("key").agg(F.min("__copy").alias("__copy")), "chosen")
    read = bits.semi(texts.select("__copy", "__t"), one.select("__copy"), "__copy", exact=True).groupBy("__copy").agg(F.first("__t").alias("__t"))
    whole = written(one.join(read, "__copy").select("key", "__t").mapInArrow(run, "key long, members array<long>"), "sets")
    return checked(near, whole, "links", lambda x, y: is_similar(x, y, similarity))


PAIR = pa.schema([(c, pa.int64()) for c in ("a", "b", "common", "ia", "ib", "na", "nb")])
PAIR_DDL = "a long, b long, common long, ia long, ib long, na long, nb long"


def pairs_of(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a < b) of different components and fitting sizes, from rows h, ci, cj, chunk, key, n, root, i, alone sorted by the first three.

    For each pair the members that meet here, and the last places of such members in both prefixes.
    """
    num, den = share(similarity)

    def made(found: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        first = np.flatnonzero(np.concatenate([[True], np.any(rows[1:, :2] != rows[:-1, :2], axis=1)]))
        common = np.diff(np.append(first, len(rows)))
        last = [np.maximum.reduceat(rows[:, c], first) for c in (2, 3)]
        columns = [rows[first, 0], rows[first, 1], common, *last, rows[first, 4], rows[first, 5]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=PAIR)

    def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = np.concatenate([[0], np.cumsum(np.any(rows[1:, :3] != rows[:-1, :3], axis=1))])
        _, ci, cj, chunk, key, n, root, place, alone = rows.T
        found, held, apart = [], 0, 1
        x = np.arange(len(rows) - 1)
        while len(x := x[x + apart < len(rows)]) and len(x := x[bucket[x] == bucket[x + apart]]):
            y = x + apart
            fits = (root[x] != root[y]) & may_fit(n[x], n[y], alone[x], alone[y], num, den)
            # Two of one chunk meet in one cell only: with the first chunk, and those of the first with the second.
            fits &= (chunk[x] != chunk[y]) | (ci[x] == cj[x]) | ((ci[x] == 0) & ((chunk[x] == cj[x]) | (cj[x] == 1)))
            p, q = x[fits], y[fits]
            p, q = np.where(key[p] < key[q], p, q), np.where(key[p] < key[q], q, p)
            if len(p):
                found.append(np.stack([key[p], key[q], place[p], place[q], n[p], n[q]], axis=1))
                held += len(p)
            if held > PAIRS_HELD:
                yield made(found)
                found, held = [], 0
            apart += 1
        if held:
            yield made(found)

    held = np.empty((0, 9), np.int64)
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        held = np.concatenate([held, rows])
        ends = np.flatnonzero(np.any(held[1:, :3] != held[:-1, :3], axis=1))
        if len(ends):
            yield from solve(held[: ends[-1] + 1])
            held = held[ends[-1] + 1 :]
    if len(held):
        yield from solve(held)


def may_fit(na, nb, alone_a, alone_b, num: int, den: int):
    """False only if sets of such sizes, with so many members that no other set has, are below the similarity num / den.

    Of arrays or columns. The least common part that the similarity asks for leaves room for so many others in each set, and
    a smaller set is no smaller than that share of the larger.
    """
    return (alone_a * (num + den) <= na * den - nb * num) & (alone_b * (num + den) <= nb * den - na * num) & (na * den >= nb * num) & (nb * den >= na * num)


def may_be_pair(similarity: float) -> Column:
    """False only for pairs below the similarity.

    Up to the last common member of two prefixes, all members are counted by its places; those that aren't common
    are in the symmetric difference, which the similarity bounds.
    """
    num, den = share(similarity)
    apart = F.col("ia") + F.col("ib") + 2 - 2 * F.col("common")
    return apart * (den + num) <= (F.col("na") + F.col("nb")) * (den - num)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, budget: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """id, key (of the set), component_id (smallest id reachable over links, itself included) and root for every row.

    budget: differing bits of the fingerprints that tries link, at first.
    """
    ready_for_python(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.xxhash64(text).alias("__copy"), text.alias("__t"))
    each = materialize(sets(texts, docs.schema[id_col].dataType.simpleString(), shingle_words, similarity), "each")
    rows = each.select("key", "n", F.size("prefix").alias("m"), F.posexplode("prefix").alias("i", "h"))
    buckets = rows.groupBy("h").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x < y").select("h")
    met = bits.semi(rows, written(buckets, "buckets"), "h", exact=True).distinct()
    met = written(met, "met")
    # What of a prefix no other set has is in the symmetric difference with any.
    held = met.groupBy("key").agg(F.count("*").alias("held"))
    shared = written(met.join(held, "key").select("h", "key", "n", "i", (F.col("m") - F.col("held")).alias("alone")), "shared")
    num, den = share(similarity)
    band = F.floor(F.log("n") / F.log(F.lit(1 / similarity)))
    # The centre of a bucket is the set with the least of its own: of copies, the one that is least changed.
    centres = shared.groupBy("h", band.alias("band")).agg(F.min(F.struct("alone", "key", "n")).alias("c"))
    fit = may_fit(F.col("n"), F.col("c.n"), F.col("alone"), F.col("c.alone"), num, den)
    stars = shared.withColumn("band", band).join(centres, ["h", "band"]).filter((F.col("c.key") != F.col("key")) & fit)
    stars = stars.select(F.least("c.key", "key").alias("a"), F.greatest("c.key", "key").alias("b")).distinct()
    first = links(written(stars.union(trie_pairs(each, budget)).distinct(), "stars"), each, texts, shingle_words, similarity)
    roots = written(connected_components(first), "first")
    placed = shared.join(roots, shared["key"] == roots["node"], "left").select("h", "key", "n", "i", "alone", F.coalesce("root", "key").alias("root"))
    mixed = placed.groupBy("h").agg(F.count("*").alias("m"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y")
    long = lambda c: F.lit(c).cast("long")
    chunks, own = F.ceil(F.col("m") / bucket_rows).cast("long"), F.pmod(F.xxhash64("key"), F.col("chunks"))
    cells = F.when(F.col("chunks") == 1, F.array(F.struct(long(0).alias("ci"), long(0).alias("cj")))).otherwise(
        F.transform(
            F.filter(F.sequence(long(0), F.col("chunks") - 1), lambda c: c != F.col("own")),
            lambda c: F.struct(F.least(c, F.col("own")).alias("ci"), F.greatest(c, F.col("own")).alias("cj")),
        )
    )
    dealt = (
        placed.join(mixed.select("h", "m"), "h")
        .withColumn("chunks", chunks)
        .withColumn("own", own)
        .select("h", "key", "n", "i", "alone", "root", "own", F.explode(cells).alias("cell"))
        .select("h", "cell.ci", "cell.cj", F.col("own").alias("chunk"), "key", F.col("n").cast("long").alias("n"), "root", F.col("i").cast("long").alias("i"), F.col("alone").cast("long").alias("alone"))
    )
    tasks = dealt.repartition("h", "ci", "cj").sortWithinPartitions("h", "ci", "cj")
    met = tasks.mapInArrow(lambda batches: pairs_of(batches, similarity), PAIR_DDL).groupBy("a", "b").agg(
        F.sum("common").alias("common"), *(F.max(c).alias(c) for c in ("ia", "ib", "na", "nb"))
    )
    pairs = written(met.filter(may_be_pair(similarity)).select("a", "b"), "pairs")
    second = links(pairs, each, texts, shingle_words, similarity)
    joined = connected_components(first.union(second))
    distinct = materialize(each.groupBy("key").agg(F.min("__id").alias("least")), "distinct")
    found = classes(each.select("__id", "key"), distinct, joined, "key")
    return found.select(F.col("__id").alias(id_col), "key", "component_id", "root")


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each component, as simhash.without_near_duplicates()."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    words = how.get("shingle_words", 5)

    @F.arrow_udf("long")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([plain_key(shingle_set(t.as_py(), words)) for t in texts], pa.int64())

    return kept_rows(docs, found.withColumnRenamed(id_col, "__id"), hashed, "key", id_col, text_col)
