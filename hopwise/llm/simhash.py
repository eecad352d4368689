"""SimHash near-duplicates: fingerprints, linked by a self-join of binary tries.

A fingerprint is a root-to-leaf path of 64 bits. Cut into more blocks than the error budget allows
differing bits, two linked fingerprints agree on some whole blocks; rotated so that those come first,
both hang below one node of that rotation's trie. A task gets whole such nodes and walks pairs of trie
nodes together, one bit a level, adding up differing bits and dropping a pair once it exceeds the
budget. A node with very many fingerprints is cut once more by the same rule: its other bits fall into one block
more than the budget, and linked fingerprints agree on one of them too. After REFINEMENTS such cuts, a node that is
still large is split into chunks, and each pair of chunks is a task's work of its own, so no task holds an
unbounded group. Tasks return spanning forests of the links they find (never all pairs of a group), and
components come from those.

Equal fingerprints are one leaf: copies are grouped before the join and never paired.

Defined cases: a null, empty or wordless text has fingerprint zero and is linked like any other; a very long
text is read whole; rows without an id get the component of their fingerprint but can't name one (component_id is
null if all its rows lack ids); repeated ids and rows are rows of their own; of equal ids and links the order
doesn't matter, as components are named by their smallest id; an empty table gives an empty result; other columns
of docs are ignored, or passed through by without_near_duplicates(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import materialize, packed, ready_for_python, slices
from hopwise.llm.components import connected_components

#: Fingerprints of a trie node that one task joins; a larger node is split into chunks of this size.
NODE_ROWS = 1000
#: How often a larger node is cut before it is split into chunks.
REFINEMENTS = 2
#: Pairs of leaves below the nodes that a task walks at a time, which bounds its memory.
WALK_PAIRS = 4_000_000
#: The bits set in each byte value.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)


def majority(values: np.ndarray) -> int:
    """The 64 bits that over half of the values, unsigned 64-bit integers, have set."""
    n, octets = len(values), values.astype(">u8").view(np.uint8).reshape(-1, 8)
    if n < 300:
        ones = np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def shingle_hashes(text: str | None, shingle_words: int, seed: int) -> np.ndarray:
    """XXH64 of a text's word shingles in order, repeats included; of the whole sequence where it is shorter."""
    import xxhash

    tokens = (text or "").encode("utf-8").lower().split()  # of bytes: both know ASCII alone
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < shingle_words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(shingle_words)), strict=False))
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(s, seed) for s in shingles), np.uint64)


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included, as an unsigned integer."""
    values = shingle_hashes(text, shingle_words, seed)
    return majority(values) if len(values) else 0


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """id and fp (the fingerprint's 64 bits as a long) for every row of docs."""
    ready_for_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [signed(fingerprint(t.as_py(), shingle_words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=[id_col, "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, fp long")


def blocks_for(n: int, budget: int) -> tuple[int, int]:
    """(blocks, agreeing): cut into so many blocks that, within the budget, so many agree at least.

    More agreeing blocks mean longer shared paths and smaller nodes, but more rotations; all find the
    same links. The step is taken where the mean node would exceed NODE_ROWS.
    """
    agreeing = 1
    while agreeing < 4 and n >> (64 * agreeing // (budget + agreeing)) > NODE_ROWS:
        agreeing += 1
    return budget + agreeing, agreeing


def block_masks(blocks: int) -> list[int]:
    """Masks of consecutive bits that cut 64 bits into blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << (64 - b) for a, b in zip(edges, edges[1:], strict=False)]


def walk(keys: np.ndarray, nodes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of the linked pairs that share a node.

    keys: unsigned 64-bit values, sorted within nodes; nodes: their sorted node numbers. Each node is
    the root of a trie; a trie node is a range of keys that agree on the bits so far.
    """
    starts = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
    ends = np.append(starts[1:], len(nodes))
    wide = ends - starts > 1
    lo_a, hi_a = starts[wide].astype(np.int64), ends[wide].astype(np.int64)
    lo_b, hi_b, off = lo_a, hi_a, np.zeros(len(lo_a), np.int8)
    found_i, found_j = [], []
    for bit in range(63, -1, -1):
        if not len(lo_a):
            break
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        mid_a = hi_a - (ones[hi_a] - ones[lo_a])
        mid_b = hi_b - (ones[hi_b] - ones[lo_b])
        twin = lo_a == lo_b  # the pair of a node with itself has the pair of its two children once
        cross = ~twin
        parts = [
            (lo_a, mid_a, lo_b, mid_b, off),
            (mid_a, hi_a, mid_b, hi_b, off),
            (lo_a, mid_a, mid_b, hi_b, off + 1),
            (mid_a[cross], hi_a[cross], lo_b[cross], mid_b[cross], off[cross] + 1),
        ]
        lo_a, hi_a, lo_b, hi_b, off = (np.concatenate(x) for x in zip(*parts, strict=True))
        alive = (off <= budget) & (hi_a > lo_a) & (hi_b > lo_b) & ~((lo_a == lo_b) & (hi_a - lo_a == 1))
        leaf = alive & (hi_a - lo_a == 1) & (hi_b - lo_b == 1)
        i, j = lo_a[leaf], lo_b[leaf]
        near = np.bitwise_count(keys[i] ^ keys[j]) <= budget  # all bits of two leaves at once
        found_i.append(i[near])
        found_j.append(j[near])
        alive &= ~leaf
        lo_a, hi_a, lo_b, hi_b, off = (x[alive] for x in (lo_a, hi_a, lo_b, hi_b, off))
    return np.concatenate([[], *found_i]).astype(np.int64), np.concatenate([[], *found_j]).astype(np.int64)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes, the smallest that the links (i, j) connect it to."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        np.minimum.at(label, before[i], least)
        np.minimum.at(label, before[j], least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _links(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Star-shaped links of each trie node, from rows sorted by node: columns node (struct-free), key, fp."""
    held: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        """rows: columns r, root, ci, cj, fp as int64."""
        change = np.any(rows[1:, :4] != rows[:-1, :4], axis=1)
        nodes = np.concatenate([[0], np.cumsum(change)])
        keys = rows[:, 4].view(np.uint64)
        order = np.lexsort((keys, nodes))
        keys, nodes = np.ascontiguousarray(keys[order]), nodes[order]
        bounds = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
        sizes = np.diff(np.append(bounds, len(nodes)))
        out_a, out_b, first = [], [], 0
        while first < len(bounds):
            last, pairs = first, 0
            while last < len(bounds) and (last == first or pairs + sizes[last] ** 2 <= WALK_PAIRS):
                pairs += int(sizes[last]) ** 2
                last += 1
            a, b = bounds[first], bounds[last] if last < len(bounds) else len(nodes)
            part = keys[a:b]
            i, j = walk(part, nodes[a:b], budget)
            label = forest(i, j, len(part))
            moved = np.flatnonzero(label != np.arange(len(part)))
            out_a.append(part[moved])
            out_b.append(part[label[moved]])
            first = last
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], names=["a", "b"]
        )

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        held.append(rows)
        ends = np.flatnonzero(np.any(rows[1:, :4] != rows[:-1, :4], axis=1))
        if len(held) > 1 and np.any(held[-2][-1, :4] != rows[0, :4]):
            whole, held = held[:-1], held[-1:]
            yield solve(np.concatenate(whole))
        if len(ends):
            cut = ends[-1] + 1
            whole, held = [*held[:-1], rows[:cut]], [rows[cut:]]
            yield solve(np.concatenate(whole))
    if held:
        yield solve(np.concatenate(held))


def cut_again(mask: int, parts: int) -> list[int]:
    """mask, widened by each of so many parts of the bits it leaves out."""
    free = [k for k in range(64) if not mask >> k & 1]
    edges = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << k for k in free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _roots(masks: list[list[tuple[int, int]]], of: Column) -> Column:
    """For an element of masks (by number), the nodes (r, root) of column fp; masks: lists of numbers and masks."""
    node = lambda r, m: F.struct(F.lit(r).cast("long").alias("r"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("root"))
    each = [F.array(*(node(r, m) for r, m in some)) for some in masks]
    return each[0] if len(each) == 1 else F.get(F.array(*each), of)


def _pairs_of_chunks(rows: DataFrame, heavy: DataFrame, node_rows: int) -> DataFrame:
    """r, root, ci, cj, fp: each node's chunks meet two at a time; the rows of one are in each of its pairs."""
    chunks = F.ceil(F.col("count") / node_rows).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    cells = F.transform(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: c != F.col("own")),
        lambda c: F.struct(F.least(c, F.col("own")).alias("ci"), F.greatest(c, F.col("own")).alias("cj")),
    )
    dealt = rows.join(heavy, ["r", "root"]).withColumn("chunks", chunks).withColumn("own", own).select("r", "root", "fp", F.explode(cells).alias("cell"))
    return dealt.select("r", "root", "cell.ci", "cell.cj", "fp")


def linked_fingerprints(values: DataFrame, budget: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) that connect every two of the distinct longs fp at budget or fewer differing bits."""
    ready_for_python(values.sparkSession)
    blocks, agreeing = blocks_for(values.count(), budget)
    masks = block_masks(blocks)
    level = list(enumerate(sum(masks[k] for k in chosen) for chosen in combinations(range(blocks), agreeing)))
    zero = F.lit(0).cast("long")
    rows = values.select("fp", F.explode(_roots([level], F.lit(0))).alias("at")).select("fp", "at.r", "at.root")
    parts = []
    for cuts in range(REFINEMENTS + 1):
        heavy = materialize(rows.groupBy("r", "root").count().filter(F.col("count") > node_rows), "heavy")
        if heavy.isEmpty():
            parts.append(rows.select("r", "root", zero.alias("ci"), zero.alias("cj"), "fp"))
            break
        parts.append(rows.join(heavy, ["r", "root"], "left_anti").select("r", "root", zero.alias("ci"), zero.alias("cj"), "fp"))
        if cuts == REFINEMENTS:
            parts.append(_pairs_of_chunks(rows, heavy, node_rows))
            break
        first, widened = level[0][0], [cut_again(m, budget + 1) for _, m in level]
        number = iter(range(level[-1][0] + 1, 1 << 30))
        below = [[(next(number), m) for m in some] for some in widened]
        nodes = _roots(below, (F.col("r") - first).cast("int"))
        rows = materialize(rows.join(heavy, ["r", "root"], "left_semi").select("fp", F.explode(nodes).alias("at")).select("fp", "at.r", "at.root"), "cut")
        level = [x for some in below for x in some]
    dealt = reduce(DataFrame.union, parts)
    tasks = dealt.repartition("r", "root", "ci", "cj").sortWithinPartitions("r", "root", "ci", "cj")
    return tasks.mapInArrow(lambda batches: _links(batches, budget), "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, budget: int = 3) -> DataFrame:
    """id, fp, component_id (smallest id reachable over links, itself included) and root (smallest such fp) for every row."""
    each = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words).toDF("__id", "fp"), "fingerprints")
    distinct = materialize(each.groupBy("fp").agg(F.min("__id").alias("least")), "distinct")
    return classes(each, distinct, connected_components(linked_fingerprints(distinct.select("fp"), budget)), "fp").select(F.col("__id").alias(id_col), "fp", "component_id", "root")


def classes(each: DataFrame, distinct: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """each's __id and key with component_id, the smallest id of its component, and root, the smallest key. distinct: key, least; roots: node, root."""
    linked = distinct.join(roots, distinct[key] == roots["node"]).select(key, "root", "least")
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("joint")), "least")
    joint = linked.join(least, "root").select(key, "joint", "root")
    # Written, so that the last join is of two plain tables, whose large partitions Spark can split.
    named = distinct.join(joint, key, "left").select(key, F.coalesce("joint", "least").alias("component_id"), F.coalesce("root", key).alias("root"))
    return each.select("__id", key).join(materialize(named, "classes"), key, "left").select("__id", key, "component_id", "root")


def hex64(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, budget: int = 3) -> DataFrame:
    """docs with one row of each component: of its smallest id; of that id's different texts there, one.

    Equal ids and texts are one row afterwards (any of them, if their other columns differ). Texts of one
    id that are in different components are judged each by its own. A row without an id stays.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, budget=budget)
    return kept_rows(docs, found.withColumnRenamed(id_col, "__id"), lambda text: _hashed(text, shingle_words), "fp", id_col, text_col)


def _hashed(text: Column, shingle_words: int) -> Column:
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([signed(fingerprint(t.as_py(), shingle_words)) for t in texts], pa.int64())

    return run(text)


def kept_rows(docs: DataFrame, found: DataFrame, hashed, key: str, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows that near-duplicates (__id, key and root, a row for each of docs) leave out.

    hashed: from a text to its key; only called for ids that come more than once.
    """
    # What is joined on a key or root is a plain table on either side and is written before it is grouped, as copies and
    # components may be large: Spark can split their partition then.
    rows = materialize(found, "components").filter(F.col("__id").isNotNull()).groupBy("__id", key).agg(F.count("*").alias("n"), F.min("root").alias("root"))
    rows = materialize(rows, "rows")
    first = materialize(rows.groupBy("root").agg(F.min(F.struct("__id", key)).alias("first")), "firsts")
    flagged = materialize(rows.join(first, "root").select("__id", key, "n", (F.struct("__id", key) == F.col("first")).alias("stays")), "flagged")
    by_id = flagged.groupBy("__id").agg(F.sum("n").alias("n"), F.max("stays").alias("stays"))
    special = materialize(by_id.filter("n > 1 or not stays").select(F.col("__id").alias("id"), "n"), "special")
    whole = docs.select(packed(docs).alias("row"), F.col(f"`{id_col}`").alias("key_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    once = whole.join(special, F.col("key_id") == F.col("id"), "left").filter(F.col("id").isNull()).select("row.*")
    repeated = special.filter("n > 1").select("id")
    if repeated.isEmpty():  # no repeated ids: docs needn't be read again for them
        return once
    texts = whole.join(repeated, F.col("key_id") == F.col("id")).select("row", "key_id", hashed(F.col("text")).alias("key"))
    stays = flagged.filter("stays").select(F.col("__id").alias("i"), F.col(key).alias("k"))
    left = texts.join(stays, (F.col("key_id") == F.col("i")) & (F.col("key") == F.col("k")), "left_semi")
    return once.union(left.dropDuplicates(["key_id", "key"]).select("row.*"))
