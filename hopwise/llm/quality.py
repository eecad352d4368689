"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule compares one statistic of a text with a cutoff from a fixed ladder, lenient to strict. The
different texts of the labelled documents that are good and pass the base rules are the holdout, one trial each
however many copies there are. For every stratum and rule, cutoffs are tried from lenient to strict, and the strictest before the first failure is selected: a
cutoff fails unless the exact binomial tail P(Bin(n, alpha / rules) <= rejected) is at most
delta / (strata * rules), strata being those with a holdout. Trying the ladder in its fixed order needs no further correction; the rest is
Bonferroni's, over strata and rules. So with probability 1 - delta, in every stratum at once, the
selected cutoffs together reject at most the share alpha of good documents. A stratum with too few
labels gets no cutoff, and its documents are only subject to the base rules.

Near copies in the holdout still count as trials of their own; where labelled documents were drawn with near copies, the
bound holds for that draw only.

Defined cases: a null or wordless text has no words and fails the base rules; a very long text is counted whole; a
statistic at its cutoff passes, as only larger ones fail; a null stratum is a stratum of its own; a document without
a label is no part of the holdout; of several labels of an id the worst counts, and a text is good if an id with it is;
repeated ids and rows are judged each on its own; an empty holdout selects nothing; an empty table gives an empty
result. Columns of docs other than those named are ignored, or passed through by accepted(), whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hopwise.llm.common import GAPS, let, materialize, packed, words

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """Rejects a text whose statistic is above the selected cutoff; ladder goes from lenient to strict."""

    name: str
    statistic: str
    ladder: tuple[float, ...]


#: Statistics are per cent, but mean_word is in characters. Ladders don't depend on data.
RULES = (
    Rule("symbols", "100 * n_symbols / nullif(n_words, 0)", tuple(range(300, 0, -4))),
    Rule("capitals", "100 * n_capitals / nullif(word_chars, 0)", tuple(range(100, 4, -2))),
    Rule("repeats", "100 * n_repeat_words / nullif(n_words, 0)", tuple(range(50, 0, -1))),
    Rule("duplicate_lines", "100 * n_dup_lines / nullif(n_lines, 0)", tuple(range(100, 0, -2))),
    Rule("long_words", "word_chars / nullif(n_words, 0)", tuple(range(200, 20, -10)) + tuple(range(20, 6, -1))),
    Rule("marks", "100 * n_marks / nullif(word_chars, 0)", tuple(range(100, 2, -2))),
)


def _covered(hits: Column) -> Column:
    """Words that 3-word windows cover, from the windows' sorted positions."""
    return F.aggregate(
        F.transform(hits, lambda at, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), at - F.get(hits, k - 1)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )


def _recurring(hashes: Column) -> Column:
    """Sorted positions of the elements that an array of longs has more than once."""
    pairs = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

    def equal_neighbours(s: Column) -> Column:
        def is_twin(x: Column, k: Column) -> Column:
            before, after = F.get(s, k - 1)["h"], F.get(s, k + 1)["h"]
            return ((k > 0) & (x["h"] == before)) | F.coalesce(x["h"] == after, F.lit(False))

        return F.sort_array(F.transform(F.filter(s, is_twin), lambda x: x["k"]))

    return let(pairs, equal_neighbours)


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep and the counts that the rules use, for every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    prepared = docs.select(*keep, text.alias("__text")).withColumn("__words", words(F.col("__text")))
    hashed = prepared.withColumn(
        "__windows",
        F.when(
            F.size("__words") > 2,
            F.slice(
                F.transform("__words", lambda w, k: F.xxhash64(w, F.get("__words", k + 1), F.get("__words", k + 2))),
                F.lit(1),
                F.size("__words") - 2,
            ),
        ).otherwise(F.array().cast("array<long>")),
    )
    repeated = F.when(
        F.size(F.array_distinct("__windows")) < F.size("__windows"), let(_recurring(F.col("__windows")), _covered)
    ).otherwise(F.lit(0))
    lines = F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    listed = hashed.withColumn("__lines", lines)

    def only(pattern: str) -> Column:
        return F.length(F.regexp_replace("__text", pattern, "")).cast("long")

    return listed.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        only(GAPS).alias("word_chars"),
        only(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        only(r"[^\p{Lu}]+").alias("n_capitals"),
        only(r"[\p{L}\p{N}\x20\x09-\x0D]+").alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """Of x >= 1, by Stirling's series ten steps up; right to about 1e-13 of its size."""
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    rise = sum((F.log(x + k) for k in range(1, 10)), F.log(x))
    return series - rise


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), from the largest term down; 1 from the mean on, where no cutoff can pass.

    Below the mean, terms shrink at least geometrically away from k; those beyond 40 deviations are
    under 1e-300.
    """
    k, n = k.cast("double"), n.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(40 * F.sqrt(n)) + 50).cast("int")
    zero = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i + 1) / (n - k + i) * ((1 - p) / p)
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

    total = F.when(steps >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), zero, add, lambda acc: acc["sum"])).otherwise(F.lit(1.0))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def select_cutoffs(holdout: DataFrame, n_strata: int, stratum: str, alpha: float, delta: float, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """stratum, rule (its number), cutoff, n, rejected for each stratum and rule with a cutoff that passes.

    holdout: statistics of good documents. Only counts per stratum, rule and step of the ladder are
    shuffled; n_strata is the number of strata corrected for.
    """
    ladders = F.array(*(F.array(*(F.lit(float(c)) for c in rule.ladder)) for rule in rules))
    values = holdout.select(
        F.col(stratum).alias("stratum"),
        F.posexplode(F.array(*(F.expr(rule.statistic).cast("double") for rule in rules))).alias("rule", "value"),
    )
    cutoffs = F.get(ladders, F.col("rule"))
    counted = (
        values.withColumn("step", F.size(F.filter(cutoffs, lambda c: c >= F.col("value"))))  # the first that rejects it
        .groupBy("stratum", "rule", "step")
        .agg(F.count("*").alias("rows"))
        .groupBy("stratum", "rule")
        .agg(F.sum("rows").alias("n"), F.collect_list(F.struct("step", "rows")).alias("steps"))
    )
    rejected = F.aggregate(
        F.filter("steps", lambda s: s["step"] <= F.col("i")), F.lit(0).cast("long"), lambda total, s: total + s["rows"]
    )
    share, level = alpha / len(rules), delta / (max(1, n_strata) * len(rules))
    tried = (
        counted.select("*", F.posexplode(cutoffs).alias("i", "cutoff"))
        .withColumn("rejected", rejected)
        .withColumn("passes", (binomial_tail(F.col("rejected"), F.col("n"), share) <= level).cast("int"))
        .withColumn("open", F.min("passes").over(W.partitionBy("stratum", "rule").orderBy("i")))
        .filter("open = 1")
    )
    best = tried.groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "n", "rejected"), "i").alias("b"))
    return best.select("stratum", "rule", "b.*")


def failed_rules(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules whose selected cutoff (column cutoffs, by rule number) the statistics exceed."""
    return F.array_compact(
        F.array(*(F.when(F.expr(rule.statistic) > F.element_at("cutoffs", F.lit(k)), F.lit(rule.name)) for k, rule in enumerate(rules)))
    )


def good_documents(labels: DataFrame, id_col: str) -> DataFrame:
    """Ids that are labelled good, by all of their labels."""
    by_id = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("quality"))
    return by_id.filter("quality = 1").select("__id")


def holdout_of(counts: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """The statistics of each different text of a stratum that is labelled good and passes the base rules."""
    good = counts.filter(~base_failed()).join(good_documents(labels, id_col), "__id", "left_semi")
    return materialize(good.dropDuplicates(["stratum", "__copy"]), "holdout")


def _named(id_col: str, stratum: str, text_col: str) -> list[Column]:
    text = F.col(f"`{text_col}`")
    return [F.col(f"`{id_col}`").alias("__id"), F.col(f"`{stratum}`").alias("stratum"), F.xxhash64(text.cast("string")).alias("__copy"), text.alias("__t")]


def cutoff_maps(holdout: DataFrame, alpha: float, delta: float, rules: tuple[Rule, ...]) -> DataFrame:
    """s and cutoffs (a map by rule number) for each stratum with a cutoff; small, written to the shared folder."""
    n_strata = holdout.select("stratum").distinct().count()
    cutoffs = select_cutoffs(holdout, n_strata, "stratum", alpha, delta, rules)
    entries = F.map_from_entries(F.collect_list(F.struct("rule", "cutoff")))
    return materialize(cutoffs.groupBy(F.col("stratum").alias("s")).agg(entries.alias("cutoffs")), "cutoffs")


def verdicts(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum: str = "lang",
    alpha: float = 0.02,
    delta: float = 0.05,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """id, the counts, base_failed, kept, stratum and failed_rules for every row of docs.

    labels: id and quality (1: good). A document with several labels is good if all say so.
    """
    named = docs.select(*_named(id_col, stratum, text_col))
    counts = materialize(statistics(named, ["__id", "stratum", "__copy"], "__t"), "statistics")
    by_stratum = cutoff_maps(holdout_of(counts, labels, id_col), alpha, delta, rules)
    judged = counts.join(by_stratum, F.col("stratum").eqNullSafe(F.col("s")), "left")
    return (
        judged.withColumn("base_failed", base_failed())
        .withColumn("failed_rules", failed_rules(rules))
        .select(
            F.col("__id").alias(id_col),
            *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
            (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
            F.col("stratum"),
            F.concat_ws(",", "failed_rules").alias("failed_rules"),
        )
    )


def accepted(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum: str = "lang",
    alpha: float = 0.02,
    delta: float = 0.05,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """The rows of docs that are kept.

    Rows and their statistics are written once, so that texts are neither counted twice nor joined with
    labels or verdicts.
    """
    named = docs.select(packed(docs).alias("__row"), *_named(id_col, stratum, text_col))
    counted = materialize(statistics(named, ["__row", "__id", "stratum", "__copy"], "__t"), "counted")
    by_stratum = cutoff_maps(holdout_of(counted.drop("__row"), labels, id_col), alpha, delta, rules)
    judged = counted.join(by_stratum, F.col("stratum").eqNullSafe(F.col("s")), "left")
    return judged.filter(~base_failed() & (F.size(failed_rules(rules)) == 0)).select("__row.*")
