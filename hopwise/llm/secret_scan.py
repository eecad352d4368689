"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found per text by patterns. Their values' hashes (values are never stored) are counted
over the corpus by distinct owners and repositories. A value's verdict:

* example: min_owners owners or more have it, or it is in min_repos repositories of more than one owner;
* filler: it has under seven different characters;
* live: one owner has it, in under min_repos repositories;
* house: one owner has it in min_repos repositories or more, a sample the owner copies around;
* shared: anything else, two owners' in few repositories.

Besides the base kinds, long mixed tokens are candidates too; of these only the live ones become spans.

Positions come from splitting a text by a pattern and adding up the lengths of gaps and matches.

Defined cases: a null text counts as empty; a very long text is read whole, in near-linear time; null owners
and repositories are one owner and one repository; null and repeated ids are rows of their own, and repeated rows
count as uses, not as owners; of kinds that begin at one place all are spans, in the kinds' order; an
empty table gives an empty result; other columns of docs are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import let, materialize

#: What a base candidate of each kind looks like, and its least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters and more; a shorter run has no longer part
HEX = r"[0-9a-f]{32,}"
ASSIGN_MIN = 8
#: A token of mixed characters that no base kind explains.
MIXED = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "mixed")

SPAN = "struct<start:int,rank:int,end:int,value:string>"


def before(lengths: Column) -> Column:
    """For each element of an array of ints, the sum of those before it; in blocks, so in near-linear time."""
    block = 256

    def of(values: Column) -> Column:
        n_blocks = F.ceil(F.size(values) / block).cast("int")
        total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
        sums = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: total(F.slice(values, b * block + 1, block)))

        def with_sums(s: Column) -> Column:
            starts = F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))

            def place(t: Column) -> Column:
                return F.transform(
                    values,
                    lambda _, k: F.get(t, F.floor(k / block).cast("int"))
                    + total(F.slice(values, F.floor(k / block).cast("int") * block + 1, k % block)),
                )

            return let(starts, place)

        return let(sums, with_sums)

    return let(lengths, of)


def spans_of(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Array of SPAN: the matches of pattern, leftmost first, that have a group of so many characters.

    value is that group; start and end are those of the whole match, in code points, end exclusive.
    """

    def read(parts: Column) -> Column:
        steps = F.transform(parts["hits"], lambda h, k: F.char_length(F.get(parts["gaps"], k)) + F.char_length(h))

        def zipped(starts: Column) -> Column:
            return F.transform(
                parts["hits"],
                lambda h, k: F.struct(
                    (F.get(starts, k) + F.char_length(F.get(parts["gaps"], k))).alias("start"),
                    F.lit(rank).alias("rank"),
                    (F.get(starts, k) + F.char_length(F.get(parts["gaps"], k)) + F.char_length(h)).alias("end"),
                    F.get(parts["values"], k).alias("value"),
                ),
            )

        return F.filter(let(before(steps), zipped), lambda s: F.char_length(s["value"]) >= least)

    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
    )
    return F.when(text.rlike(pattern), let(parts, read)).otherwise(F.array().cast(f"array<{SPAN}>"))


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def candidates(docs: DataFrame, keep: list[Column], text_col: str) -> DataFrame:
    """keep, base (spans of the base kinds) and mixed (other long tokens) for every row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    loose = f"(?:{ASSIGN}|{MIXED})"
    tokens = F.filter(
        spans_of(F.col("__text"), loose, 3),
        lambda s: ~s["value"].rlike(f"^(?:{ASSIGN})")
        & ~s["value"].rlike(f"{ACCESS}|{HEX}")
        & s["value"].rlike("[0-9]")
        & s["value"].rlike("[A-Z]")
        & s["value"].rlike("[a-z]"),
    )
    return docs.select(*keep, text.alias("__text")).select(
        *(F.col(c) for c in ("__id", "__owner", "__repo")),
        spans_of(F.col("__text"), ASSIGN, 0, 1, ASSIGN_MIN).alias("assign"),
        spans_of(F.col("__text"), ACCESS, 1).alias("access"),
        spans_of(F.col("__text"), HEX, 2).alias("hex"),
        tokens.alias("mixed"),
    )


def ownership(found: DataFrame, min_owners: int, min_repos: int) -> DataFrame:
    """hash, owners, repos, uses and verdict of each candidate value. found: hash, filler, __owner, __repo."""
    by_repo = found.groupBy("hash", "__owner", "__repo").agg(F.count("*").alias("uses"), F.max("filler").alias("filler"))
    by_owner = by_repo.groupBy("hash", "__owner").agg(F.count("*").alias("repos"), F.sum("uses").alias("uses"), F.max("filler").alias("filler"))
    owners, repos = F.col("owners"), F.col("repos")
    verdict = (
        F.when((owners >= min_owners) | ((owners > 1) & (repos >= min_repos)), "example")
        .when(F.col("filler"), "filler")
        .when((owners == 1) & (repos < min_repos), "live")
        .when(owners == 1, "house")
        .otherwise("shared")
    )
    summed = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("uses").alias("uses"), F.max("filler").alias("filler"))
    return summed.withColumn("verdict", verdict)


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    min_owners: int = 3,
    min_repos: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(rows, values).

    rows: id, n_assign, n_access, n_hex, base_sha256, spans (base and live mixed ones), n_live,
    n_example and live (the spans whose value is live) for every row. values: what is known of each
    candidate value, by hash.
    """
    nothing = F.lit(None).cast("string")
    keep = [F.col(f"`{id_col}`").alias("__id"), F.coalesce(owner if owner is not None else nothing, F.lit("")).alias("__owner"), F.coalesce(repository if repository is not None else nothing, F.lit("")).alias("__repo")]
    safe = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.md5(s["value"]).alias("hash"), (F.size(F.array_distinct(F.split(s["value"], ""))) < 7).alias("filler"))
    each = materialize(
        candidates(docs, keep, text_col).select(
            F.monotonically_increasing_id().alias("__row"),
            *("__id", "__owner", "__repo"),
            *(F.size(c).cast("long").alias(f"n_{c}") for c in KINDS[:3]),
            F.transform(F.concat(*KINDS), safe).alias("found"),
        ),
        "candidates",
    )
    found = each.select("__row", "__owner", "__repo", F.explode("found").alias("f")).select("__row", "__owner", "__repo", "f.*")
    values = materialize(ownership(found, min_owners, min_repos), "values")
    judged = found.join(values.select("hash", "verdict"), "hash").select("__row", F.struct("start", "rank", "end").alias("span"), "verdict")
    by_row = judged.groupBy("__row").agg(
        F.collect_list(F.when(F.col("verdict") == "live", F.col("span"))).alias("live"),
        F.count(F.when(F.col("verdict") == "example", 1)).alias("n_example"),
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    base = F.transform(F.filter("found", lambda s: s["rank"] < 3), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    live = F.coalesce("live", none)
    rows = each.join(by_row, "__row", "left").select(
        F.col("__id").alias(id_col),
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.concat(base, F.filter(live, lambda s: s["rank"] == 3))).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
        listed(live).alias("live"),
    )
    return rows, values
