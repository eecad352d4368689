"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are sequences of words; the edit bound is one word inserted, deleted or replaced. A line is
dropped if an earlier line of the corpus (by id, then line number) is equal or, if both have min_words
words or more, within the bound; the earliest such line is named as its keeper, whether that itself
stays or not.

1. Lines become hashes; equal ones are grouped, and their earliest occurrence stands for them.
2. One edit leaves the first or the second half of a line as it was. Only lines that share a half with
   another one go on, which loses no pair.
3. Those emit their variants as hashed keys: the line itself, and the line without each one of its words.
   Equal variants without the word at the same place are a replacement; a variant equal to a whole line is an
   insertion. In either case a group's earliest line is within the bound of all it is given to, so groups are
   reduced to a minimum and never paired out.
4. Each line and its partner are compared word by word.

Only hashes are shuffled; the words of step 3's lines are read again behind a bit table of their places.

Defined cases: a null or empty text has no lines; a very long text's lines, and a very long line's words, are all
compared; lines without a word aren't considered; rows without an id come last; rows with equal ids and lines
are told apart by their place in the input, and one stays; of equally early partners none is preferred, as places
differ; an empty table gives an empty result; other columns of docs are ignored, or passed through by
deduplicated(), whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.llm import bits
from hopwise.llm.common import GAPS, WORD, let, materialize, packed

MIN_WORDS = 5
#: What separates words besides space and line feed.
OTHER_GAPS = "\t\x0b\x0c\r"


def _hash_pair(value: Column, *more: Column) -> Column:
    return F.struct(F.xxhash64(value, *more).alias("a"), F.xxhash64(F.lit("b"), value, *more).alias("b"))


def _raw_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id, line_no (from 0) and line."""
    return docs.select(F.col(f"`{id_col}`").alias("__id"), F.posexplode(F.split(F.col(f"`{text_col}`").cast("string"), "\n")).alias("line_no", "line"))


def _line_words() -> Column:
    """The words of column line. Most lines have no gaps but spaces, by which they are split without a regular expression."""
    odd = reduce(Column.__or__, (F.col("line").contains(gap) for gap in OTHER_GAPS))
    return F.array_remove(F.when(odd, F.split("line", GAPS)).otherwise(F.split("line", " ")), "")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id, line_no (from 0) and w, its words, for every line with a word."""
    # Told by the line, as a condition on its words would be moved in front of them and split it once more.
    return _raw_lines(docs, id_col, text_col).filter(F.col("line").rlike(WORD)).select("__id", "line_no", _line_words().alias("w"))


def _halves(w: Column, n: Column) -> Column:
    """Keys that two lines within the bound share at least one of: halves, by the shorter line's length."""

    def keys(m: Column) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        return [F.xxhash64(F.lit("l"), m, F.slice(w, F.lit(1), half)), F.xxhash64(F.lit("r"), m, F.slice(w, n - half + 1, half))]

    return F.array(*keys(n), *keys(n - 1))


def _prefix_xor(values: Column) -> Column:
    """For each element of an array of longs, the exclusive or of those before it; in blocks of the root of their number."""

    def of(v: Column) -> Column:
        fold = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))

        def blocked(block: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / block).cast("int") - 1), lambda b: fold(F.slice(v, b * block + 1, block)))

            def place(starts: Column) -> Column:
                at = lambda k: F.floor(k / block).cast("int")
                return F.transform(v, lambda _, k: F.get(starts, at(k)).bitwiseXOR(fold(F.slice(v, at(k) * block + 1, k % block))))

            return let(sums, lambda s: let(F.transform(s, lambda _, b: fold(F.slice(s, F.lit(1), b))), place))

        return let(F.greatest(F.lit(4), F.ceil(F.sqrt(F.size(v))).cast("int")), blocked)

    return let(values, of)


def _variant_hashes(w: Column, seed: int) -> Column:
    """Hashes of the line without its k-th word, for each k, then of the whole line.

    A sequence's hash is the exclusive or of its words' hashes by place, so a variant's is made of
    the words before the gap at their places and those after it one place to the left.
    """
    salt = F.lit(seed)
    placed = F.transform(w, lambda x, k: F.xxhash64(salt, k, x))
    moved = F.transform(w, lambda x, k: F.xxhash64(salt, k - 1, x))
    fold = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))

    def made(p: Column) -> Column:
        def with_moved(m: Column) -> Column:
            def with_prefixes(q: Column) -> Column:
                # after the k-th: all, without those up to and with it
                after = lambda x, k: q["all"].bitwiseXOR(F.get(q["m"], k)).bitwiseXOR(x)
                return F.concat(F.transform(m, lambda x, k: F.get(q["p"], k).bitwiseXOR(after(x, k))), F.array(fold(p)))

            return let(F.struct(_prefix_xor(p).alias("p"), _prefix_xor(m).alias("m"), fold(m).alias("all")), with_prefixes)

        return let(moved, with_moved)

    return let(placed, made)


def within_one(a: Column, b: Column) -> Column:
    """Whether two word sequences differ by at most one inserted, deleted or replaced word."""

    def common(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), False)
        return F.when(first == 0, F.least(F.size(x), F.size(y)).cast("long")).otherwise(first - 1)

    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1)


def duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each line to drop: id, line_no, keeper_id, keeper_line_no, distance (0 or 1), row.

    row_col: a column that numbers the rows of docs, if there is one.
    """
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    place = F.struct(key.isNull().alias("last"), key.alias("id"), row.alias("row"))
    found = lines_of(docs.select(place.alias("__at"), text.alias("__t")), "__at", "__t")
    at = F.struct(F.col("__id.last").alias("last"), F.col("__id.id").alias("id"), F.col("line_no").alias("line_no"), F.col("__id.row").alias("row"))
    n = F.size("w")
    near = F.when(n >= min_words, _halves(F.col("w"), n))
    lines = materialize(found.select(at.alias("at"), _hash_pair(F.col("w")).alias("h"), near.alias("halves")), "lines")
    distinct = materialize(lines.groupBy("h").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.any_value("halves").alias("halves")), "distinct")

    halves = distinct.filter("halves is not null").select("h", "first", F.posexplode("halves").alias("nth", "k"))
    shared = halves.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    left, right = F.max(F.col("nth") % 2 == 0).alias("left"), F.max(F.col("nth") % 2 == 1).alias("right")
    some = materialize(halves.join(shared, "k", "left_semi").groupBy("h", "first").agg(left, right), "survivors")
    # Their words are read again at their earliest place; other lines needn't be split into words for that.
    places = some.select(F.col("first.id").alias("__id"), F.col("first.line_no").alias("line_no"))
    again = bits.semi(_raw_lines(docs, id_col, text_col), places, "__id", "line_no").select("__id", "line_no", _line_words().alias("w"))
    here = F.col("__id").eqNullSafe(F.col("first.id")) & (F.col("line_no") == F.col("first.line_no"))
    joined = some.join(again.select("__id", "line_no", _hash_pair(F.col("w")).alias("h"), "w"), "h").filter(here)
    texts = materialize(joined.select("first", "h", "w", "left", "right").dropDuplicates(["h"]), "texts")

    # A line that shares its first half with another needs the variants without a later word only, and so on.
    n_words, gap, half = F.size("w"), F.col("gap"), F.floor((F.col("n") - 1) / 2)
    variants = texts.select("first", "left", "right", n_words.alias("n"), F.posexplode(F.arrays_zip(_variant_hashes(F.col("w"), 1).alias("a"), _variant_hashes(F.col("w"), 2).alias("b"))).alias("gap", "v"))
    variants = variants.filter((gap == F.col("n")) | (F.col("left") & (gap >= half)) | (F.col("right") & (gap < F.col("n") - half)))
    keyed = materialize(
        variants.select("first", (F.col("gap") == F.col("n")).alias("whole"), F.when(F.col("gap") < F.col("n"), F.col("gap")).alias("gap"), "v",
                        F.when(F.col("gap") < F.col("n"), F.col("n") - 1).otherwise(F.col("n")).alias("len")),
        "variants",
    )
    replaced = keyed.filter("not whole").groupBy("len", "v", "gap").agg(F.min("first").alias("least"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    by_variant = keyed.groupBy("len", "v").agg(F.min(F.when(F.col("whole"), F.col("first"))).alias("line"), F.min(F.when(~F.col("whole"), F.col("first"))).alias("longer")).filter("line is not null and longer is not null")
    offers = (
        keyed.filter("not whole").join(replaced, ["len", "v", "gap"]).select("first", F.col("least").alias("other"))
        .union(keyed.join(by_variant, ["len", "v"]).select("first", F.when(F.col("whole"), F.col("longer")).otherwise(F.col("line")).alias("other")))
        .filter(~F.col("first").eqNullSafe(F.col("other")))
        .distinct()
    )
    mine, theirs = texts.select("first", "h", "w"), texts.select(F.col("first").alias("other"), F.col("w").alias("w2"))
    checked = offers.join(mine, "first").join(theirs, "other").filter(within_one(F.col("w"), F.col("w2")))
    partners = checked.groupBy("h").agg(F.min("other").alias("partner"))

    keepers = materialize(
        distinct.join(partners, "h", "left").filter("n > 1 or partner < first").select("h", "first", F.least("first", "partner").alias("keeper")), "keepers"
    )
    dropped = lines.select("at", "h").join(keepers, "h").filter("keeper < at")
    return dropped.select(
        F.col("at.id").alias(id_col),
        F.col("at.line_no").alias("line_no"),
        F.col("keeper.id").alias("keeper_id"),
        F.col("keeper.line_no").alias("keeper_line_no"),
        F.when(F.col("keeper") == F.col("first"), 0).otherwise(1).alias("distance"),
        F.col("at.row").alias("row"),
    )


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the dropped lines taken out of their texts; a text that loses none stays as it is.

    docs is written to the shared folder first, so that its rows keep their numbers.
    """
    whole = docs.select(packed(docs).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    numbered = materialize(whole.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    gone = duplicates(numbered, id_col="id", text_col="text", row_col="__row", min_words=min_words)
    by_row = gone.groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    lines = F.split(F.col("text"), "\n")
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda k: F.get(lines, k)), "\n")
    joined = numbered.join(by_row, "__row", "left").select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"))
    return joined.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
