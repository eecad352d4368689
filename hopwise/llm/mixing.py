"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens flows down a tree (say domain, language, source). At each node it is shared among
the children by weight; a child that can't use its share is filled up and the rest is shared among its
siblings, and only what all of a node's children can't use is left to the node's own siblings. A leaf
can use its tokens once per epoch. Its budget takes whole epochs, then a prefix of the next epoch's
order, which is by a seeded hash of the row.

All arithmetic is on integers. The cut of a leaf's order is found through counts per range of hashes:
one row per leaf and range is shuffled, then the rows of each leaf's one range that holds the cut. No
task gets a whole leaf, and texts aren't shuffled at all.

Defined cases: a row without tokens (null, empty or wordless text) is never selected; a very long text is one row of
its tokens, taken whole or not at all, so a leaf's tokens may fall short of its budget by less than one row; null counts
as "" in a level; null and repeated ids are rows like others; repeated rows share a place in the order and are selected
together; ties in capacity for weight are taken by name; weights are whole numbers, a child without one has the
level's default, and one of weight 0 gets nothing; an empty table gives an empty result. selection() ignores other
columns, mixed() passes them through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopwise.llm.common import materialize, packed, words

#: Rows of a leaf that the range with its cut should hold; ranges are at most 2 ** 16 a leaf.
RANGE_ROWS = 256


@dataclass(frozen=True)
class Level:
    """A level of the tree: its name, the column with its values, and the weights among siblings."""

    name: str
    value: Column
    weights: dict[str, int] = field(default_factory=dict)
    default: int = 1

    def weight(self) -> Column:
        given = [x for name, w in self.weights.items() for x in (F.lit(name), F.lit(int(w)).cast("long"))]
        found = F.element_at(F.create_map(*given), F.col(self.name)) if given else F.lit(None).cast("long")
        return F.coalesce(found, F.lit(int(self.default)).cast("long"))


def fill(nodes: DataFrame, parents: list[str], child: str) -> DataFrame:
    """nodes with budget: the parent's (column given) shared among children by weight, up to capacity.

    Children are taken by rising capacity for their weight; while one can be filled, what it leaves is
    shared among the rest, and the others then share in proportion. Fractions of a token are dropped.
    """
    order = W.partitionBy(*parents).orderBy(F.col("capacity") / F.col("weight"), child)
    wide = "cast({} as decimal(19,0))".format
    ranked = (
        nodes.withColumn("place", F.row_number().over(order))
        .withColumn("before", F.coalesce(F.sum("capacity").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("full", F.expr(f"{wide('capacity')} * {wide('rest')} <= {wide('given - before')} * {wide('weight')}"))
    )
    level = F.min(F.when(~F.col("full"), F.struct("place", "before", "rest"))).over(W.partitionBy(*parents))
    share = F.expr(f"cast({wide('given - level.before')} * {wide('weight')} div {wide('level.rest')} as bigint)")
    return (
        ranked.withColumn("level", level)
        .withColumn("budget", F.when(F.col("level").isNull() | (F.col("place") < F.col("level.place")), F.col("capacity")).otherwise(share))
        .drop("place", "before", "rest", "full", "level")
    )


def leaf_budgets(leaves: DataFrame, levels: list[Level], total: int | None, max_epochs: int) -> DataFrame:
    """The levels' names, tokens and budget for each leaf. leaves: the names and tokens.

    total: tokens wanted; None stands for as many as there are.
    """
    names = [x.name for x in levels]
    weighted = leaves.filter("tokens > 0")
    for x in levels:
        weighted = weighted.filter(x.weight() > 0)
    wanted = total if total is not None else leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    above = None
    for k, x in enumerate(levels):
        parents = names[:k]
        nodes = weighted.groupBy(*names[: k + 1]).agg(F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("capacity", F.col("tokens") * max_epochs).withColumn("weight", x.weight())
        nodes = nodes.withColumn("given", F.lit(wanted).cast("long")) if above is None else nodes.join(above, parents)
        filled = fill(nodes, parents or ["given"], x.name)
        above = filled.select(*names[: k + 1], F.col("budget").alias("given"))
    return filled.select(*names, "tokens", "budget")


def place(seed: int, epoch: Column, *identity: Column) -> Column:
    """A row's place in the order of an epoch: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), *(c.cast("string") for c in identity)))


def selection(
    docs: DataFrame,
    levels: list[Level],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
    total: int | None = None,
    max_epochs: int = 3,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(rows, budgets): each row's id, levels, n_tokens and copies; each leaf's tokens, budget, full, cut.

    copies is how often the row is taken: full (whole epochs), and once more if its place in the epoch
    after them is at or before cut.
    """
    names = [x.name for x in levels]
    counted = tokens if tokens is not None else F.size(words(F.col(text_col).cast("string")))
    rows = materialize(
        docs.select(
            F.col(f"`{id_col}`").alias("__id"),
            *(F.coalesce(x.value.cast("string"), F.lit("")).alias(x.name) for x in levels),
            counted.cast("long").alias("n_tokens"),
            F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__text"),
        ),
        "mixing",
    )
    leaves = materialize(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    budgets = materialize(
        leaf_budgets(leaves, levels, total, max_epochs)
        .withColumn("full", F.expr("cast(budget div tokens as int)"))
        .withColumn("left", F.expr("budget - full * tokens")),
        "budgets",
    )
    most = leaves.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]
    step = max(1, 65_536 >> max(0, (most // RANGE_ROWS)).bit_length())  # hashes a range
    at = place(seed, F.col("full"), F.col("__id"), F.col("__text"))
    placed = (
        rows.filter("n_tokens > 0")
        .join(budgets.filter("left > 0").select(*names, "full", "left"), names)
        .withColumn("place", at)
        .withColumn("range", F.expr(f"cast(conv(substr(place, 1, 4), 16, 10) as int) div {step}"))
    )
    by_leaf = W.partitionBy(*names).orderBy("range")
    ranges = (
        placed.groupBy(*names, "range", "left")
        .agg(F.sum("n_tokens").alias("inside"))
        .withColumn("upto", F.sum("inside").over(by_leaf))
        .filter("upto > left")
        .withColumn("nth", F.row_number().over(by_leaf))
        .filter("nth = 1")
        .select(*names, "range", (F.col("upto") - F.col("inside")).alias("before"))
    )
    inside = (
        placed.join(ranges, [*names, "range"])
        .withColumn("upto", F.col("before") + F.sum("n_tokens").over(W.partitionBy(*names).orderBy("place")))
        .filter("upto <= left")
        .groupBy(*names)
        .agg(F.max("place").alias("last"))
    )
    start = F.lower(F.lpad(F.hex((F.col("range") * step).cast("long")), 4, "0"))  # sorts before all places of the range
    cuts = ranges.join(inside, names, "left").select(*names, F.coalesce("last", start).alias("cut"))
    ready = materialize(budgets.join(cuts, names, "left").select(*names, "tokens", "budget", "full", F.coalesce("cut", F.lit("")).alias("cut")), "cuts")
    taken = (
        rows.filter("n_tokens > 0")
        .join(ready.filter("budget > 0").select(*names, "full", "cut"), names)
        .withColumn("copies", F.col("full") + (at <= F.col("cut")).cast("int"))
        .filter("copies > 0")
        .select(F.col("__id").alias(id_col), *names, "n_tokens", "copies")
    )
    return taken, ready


def mixed(docs: DataFrame, levels: list[Level], *, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, **how) -> DataFrame:
    """The rows of docs, each as often as it is taken."""
    _, ready = selection(docs, levels, id_col=id_col, text_col=text_col, seed=seed, **how)
    names = [x.name for x in levels]
    leaf = F.struct(*(F.coalesce(x.value.cast("string"), F.lit("")).alias(x.name) for x in levels))
    cuts = ready.filter("budget > 0").select(F.struct(*names).alias("leaf"), "full", "cut")
    text = F.col(f"`{text_col}`").cast("string")
    taken_from = docs.select(
        packed(docs).alias("row"), leaf.alias("at"), F.col(f"`{id_col}`").alias("key"), F.md5(F.coalesce(text, F.lit(""))).alias("text"), (F.size(words(text)) > 0).alias("some")
    )
    joined = taken_from.filter("some").join(cuts, F.col("at") == F.col("leaf"))
    copies = F.col("full") + (place(seed, F.col("full"), F.col("key"), F.col("text")) <= F.col("cut")).cast("int")
    return joined.withColumn("copies", copies).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
