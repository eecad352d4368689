"""The category taxonomy of places, label histograms, and their similarity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_CATEGORIES = 17
#: Each category's code prefixes. One of four characters must equal the whole code.
PREFIXES = {
    0: ("1",),
    1: ("2",),
    2: ("2800", "72", "75"),
    3: ("4", "7100", "7103"),
    4: ("5", "6"),
    5: ("70", "7101", "7102"),
    6: ("7180", "74", "94", "9600", "9700", "A880"),
    7: ("73", "9080", "9180", "92", "93", "95"),
    8: ("76", "AF"),
    9: ("7700", "A900"),
    10: ("78", "A080", "A2", "A3", "A4", "A600", "AB"),
    11: ("808A", "808B", "9800", "BB", "BF"),
    12: ("8",),
    13: ("A1",),
    14: ("A70",),
    15: ("A980", "A983", "AA"),
    16: ("A982",),
}


def category_dim(spark: SparkSession) -> DataFrame:
    """category_id, prefix, is_exact."""
    return spark.createDataFrame([(k, p, len(p) == 4) for k, ps in PREFIXES.items() for p in ps], "category_id int, prefix string, is_exact boolean")


def category_id(code: Column) -> Column:
    """The last category that a code matches; null for none."""
    found = F.lit(None).cast("int")
    for k in range(N_CATEGORIES):
        match = F.lit(False)
        for p in PREFIXES[k]:
            match = match | ((code == p) if len(p) == 4 else code.startswith(p))
        found = F.when(match, F.lit(k)).otherwise(found)
    return found


def label_histogram(ids: Column) -> Column:
    """Dense histogram of an array of category ids, of sum 1."""
    n = F.size(F.filter(ids, lambda x: x.isNotNull()))
    return F.transform(F.sequence(F.lit(0), F.lit(N_CATEGORIES - 1)), lambda k: F.size(F.filter(ids, lambda x: x == k)) / n)


def jaccard(a: Column, b: Column) -> Column:
    """Generalised Jaccard similarity of two histograms; 0 if one is null."""
    add = lambda t, x: t + x
    low = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), add)
    high = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x, y)), F.lit(0.0), add)
    return F.coalesce(F.try_divide(low, high), F.lit(0.0))


def place_weight(histogram: Column, original: Column, epsilon: float) -> Column:
    """exp(epsilon * (1 - similarity) / 2): more for places unlike the original."""
    return F.exp(epsilon * (1 - jaccard(histogram, original)) / 2)


def max_weight(epsilon: float) -> float:
    return math.exp(epsilon / 2)


def distribution_label(histogram: Column) -> Column:
    """Index of the largest entry, the first of equals."""
    return F.array_position(histogram, F.array_max(histogram)).cast("int") - 1


def equal_distributions(a: Column, b: Column) -> Column:
    """Whether two histograms are equal entry by entry; false if one is null."""
    return F.coalesce(a == b, F.lit(False))


def distribution_text(histogram: Column) -> Column:
    """The entries with five decimals (0 for none), comma-joined, and the label; zeros for null."""
    entries = F.transform(histogram, lambda x: F.when(x > 0, F.format_string("%.5f", x)).otherwise("0"))
    return F.coalesce(
        F.concat(F.array_join(entries, ","), F.lit(","), distribution_label(histogram).cast("string")), F.lit(",".join("0" * (N_CATEGORIES + 1)))
    )


def codes_by_category(places: DataFrame) -> DataFrame:
    """category_id, codes (the prefixes, and the codes seen at places), n_places. A category's places are place_categories()."""
    dim = category_dim(places.sparkSession).select("category_id", F.col("prefix").alias("code"), F.lit(None).cast("long").alias("poi_id"))
    seen = place_categories(places).select("category_id", "code", "poi_id")
    return dim.union(seen).groupBy("category_id").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.countDistinct("poi_id").alias("n_places"))


def place_categories(places: DataFrame) -> DataFrame:
    """category_id, code, poi_id: the places of each category, one row for each label. places: poi_id, categories."""
    return places.select("poi_id", F.explode("categories").alias("c")).select("c.category_id", "c.code", "poi_id")
