"""Lookups in the grid of places: within a disc, nearest, k nearest, and label histograms around a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopwise.functions import geo
from hopwise.functions.category import N_CATEGORIES
from hopwise.plans.lineage import cut

MAX_RINGS = 5
#: Bins of a level are so many times as wide as those of the level below.
LEVEL_FACTOR = 4
#: Rows of a key that meet in one task.
BLOCK = 2000


def within(points: DataFrame, pois: DataFrame, radius: str = "radius", keys: tuple[str, ...] = ("point_key",)) -> DataFrame:
    """keys, poi_id, dist, categories of the places within each point's radius. points: keys, lng, lat, radius."""
    cells = points.withColumn("cell", F.explode(geo.cells_of_circle("lng", "lat", radius)))
    asked = cells.select(*keys, F.col("lng").alias("x"), F.col("lat").alias("y"), F.col(radius).alias("__r"), F.col("cell.row").alias("cell_row"), F.col("cell.col").alias("cell_col"))
    met = asked.join(pois, ["cell_row", "cell_col"]).withColumn("dist", geo.haversine("x", "y", "lng", "lat"))
    return met.filter("dist <= __r").select(*keys, "poi_id", "dist", "categories")


def _in_rings(points: DataFrame, pois: DataFrame, key: str, rings: int) -> DataFrame:
    row, col = geo.cell_row("lat"), geo.cell_col("lng")
    around = geo.rings(row, col, rings)
    asked = points.select(key, F.col("lng").alias("x"), F.col("lat").alias("y"), F.explode(around).alias("c"))
    met = asked.select(key, "x", "y", "c.ring", F.col("c.row").alias("cell_row"), F.col("c.col").alias("cell_col")).join(pois, ["cell_row", "cell_col"])
    return met.withColumn("dist", geo.haversine("x", "y", "lng", "lat"))


def nearest(points: DataFrame, pois: DataFrame, key: str, exact: bool = False) -> DataFrame:
    """key, poi_id, dist, ring: the nearest place of the first ring of cells that has any.

    exact: of one further ring too, which can hold a nearer place.
    """
    met = _in_rings(points, pois, key, MAX_RINGS)
    if exact:
        first = F.min("ring").over(W.partitionBy(key))
        met = met.withColumn("first", first).filter("ring <= first + 1")
        best = F.min(F.struct("dist", "poi_id", "ring"))
    else:
        best = F.min(F.struct("ring", "dist", "poi_id"))
    return met.groupBy(key).agg(best.alias("b")).select(key, "b.poi_id", "b.dist", "b.ring")


def k_nearest(points: DataFrame, pois: DataFrame, key: str, k: int = N_CATEGORIES, max_km: float = 2.0, rings: int = MAX_RINGS) -> DataFrame:
    """key, rank, poi_id, dist, categories of the k nearest places within max_km and so many rings."""
    met = _in_rings(points, pois, key, rings).filter(F.col("dist") <= max_km)
    ranked = met.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("dist", "poi_id")))
    return ranked.filter(F.col("rank") <= k).select(key, "rank", "poi_id", "dist", "categories")


def distributions(neighbours: DataFrame, key: str, by_distance: bool = False) -> DataFrame:
    """key, distribution: the categories of places around a point; each place adds 1, shared by its labels.

    by_distance: each adds the inverse of its distance, 0 being taken as the least distance above it, 1 at most.
    """
    if by_distance:
        least = F.least(F.min(F.when(F.col("dist") > 0, F.col("dist"))).over(W.partitionBy(key)), F.lit(1.0))
        near = F.when(F.col("dist") > 0, F.col("dist")).otherwise(F.coalesce(least, F.lit(1.0)))
        neighbours = neighbours.withColumn("__w", 1 / near)
    else:
        neighbours = neighbours.withColumn("__w", F.lit(1.0))
    each = neighbours.select(key, (F.col("__w") / F.size("categories")).alias("w"), F.explode("categories").alias("c"))
    summed = each.groupBy(key).agg(*(F.sum(F.when(F.col("c.category_id") == k, F.col("w")).otherwise(0.0)).alias(f"c{k}") for k in range(N_CATEGORIES)), F.sum("w").alias("all"))
    return summed.select(key, F.array(*(F.col(f"c{k}") / F.col("all") for k in range(N_CATEGORIES))).alias("distribution"))


def _met(q: DataFrame, p: DataFrame, groups: list[tuple[list[tuple[str, str]], float, float]]) -> DataFrame:
    """Pairs of rows of q and p (named q_.. and p_..) whose spans may overlap on every axis, each pair once.

    groups: (axes, least bin, reach): axes, (from, to) columns without the prefix, that have a level together; reach widens q.
    A row's level is the lowest whose bins are as wide as its spans, so it touches two of them an axis. A pair meets at
    the higher level of both, in the bin where its overlap begins: mode 0 at q's level, mode 1 at p's, if that is higher. A key's
    rows are dealt into blocks of BLOCK, which meet two at a time, so that no task takes a frequent key whole.
    """
    partitions = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = lambda n, a, reach: F.col(f"{n}_{a[0]}") - (reach if n == "q" else 0)
    high = lambda n, a, reach: F.col(f"{n}_{a[1]}") + (reach if n == "q" else 0)
    extent = lambda n, axes, reach: F.greatest(*(high(n, a, reach) - low(n, a, reach) for a in axes), F.lit(0))
    most = [x.agg(*(F.max(extent(n, axes, reach)) for axes, _, reach in groups)).first() for n, x in (("q", q), ("p", p))]
    every, keys, once = [], [], []
    for g, (axes, least, reach) in enumerate(groups):
        longest = max((r[g] for r in most if r[g] is not None), default=0)
        sizes = [least]
        while sizes[-1] < longest:
            sizes.append(sizes[-1] * LEVEL_FACTOR)
        every.append(sizes)
        keys += [f"__g{g}_{k}" for k in ("mode", "lvl", *(f"b{i}" for i in range(len(axes))))]
        size = F.get(F.array(*(F.lit(float(w)) for w in sizes)), F.col(f"__g{g}_lvl"))
        once += [F.col(f"__g{g}_b{i}") == F.floor(F.greatest(low("q", a, reach), low("p", a, reach)) / size) for i, a in enumerate(axes)]

    def entries(n: str, g: int) -> Column:
        """The bins (mode, lvl, b0 ..) of a row in a group of axes."""
        axes, _, reach = groups[g]
        levels = F.array(*(F.struct(F.lit(k).alias("lvl"), F.lit(float(w)).alias("w")) for k, w in enumerate(every[g])))
        own = F.least(F.size(F.filter(levels, lambda v: v["w"] < extent(n, axes, reach))), F.lit(len(every[g]) - 1))
        above = {("q", 0): lambda v: v["lvl"] == own, ("q", 1): lambda v: v["lvl"] > own, ("p", 0): lambda v: v["lvl"] >= own, ("p", 1): lambda v: v["lvl"] == own}

        def bins(mode: int) -> Column:
            def at(v, *b):
                return F.struct(F.lit(mode).alias("mode"), v["lvl"].alias("lvl"), *(c.alias(f"b{i}") for i, c in enumerate(b)))

            line = lambda v, a: F.sequence(F.floor(low(n, a, reach) / v["w"]), F.floor(high(n, a, reach) / v["w"]))
            one = lambda v: F.transform(line(v, axes[0]), lambda b: at(v, b))
            two = lambda v: F.flatten(F.transform(line(v, axes[0]), lambda b: F.transform(line(v, axes[-1]), lambda c: at(v, b, c))))
            return F.flatten(F.transform(F.filter(levels, above[n, mode]), one if len(axes) == 1 else two))

        return F.concat(bins(0), bins(1))

    def dealt(x: DataFrame, n: str) -> DataFrame:
        for g in range(len(groups)):
            own_keys = [k for k in keys if k.startswith(f"__g{g}_")]
            x = x.withColumn("__e", F.explode(entries(n, g))).select("*", *(F.col(f"__e.{k.removeprefix(f'__g{g}_')}").alias(k) for k in own_keys)).drop("__e")
        return x

    left, right = dealt(q, "q"), dealt(p, "p")
    counts = left.groupBy(keys).agg(F.count("*").alias("__q")).join(right.groupBy(keys).agg(F.count("*").alias("__p")), keys)
    blocks = {f"__n{n}": F.ceil(F.col(f"__{n}") / BLOCK).cast("int") for n in "qp"}
    frequent = F.broadcast(counts.withColumns(blocks).filter("__nq * __np > 1").select(*keys, "__nq", "__np"))

    def blocked(x: DataFrame, n: str, m: str) -> DataFrame:
        known = x.join(frequent, keys, "left").withColumns({f"__n{k}": F.coalesce(f"__n{k}", F.lit(1)) for k in "qp"})
        mine = known.withColumn(f"__{n}", F.pmod(F.xxhash64(f"{n}_trip"), F.col(f"__n{n}")))
        return mine.withColumn(f"__{m}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"__n{m}").cast("long") - 1))).drop("__nq", "__np").repartition(partitions, *keys, "__q", "__p")

    met = blocked(left, "q", "p").hint("shuffle_hash").join(blocked(right, "p", "q").hint("shuffle_hash"), [*keys, "__q", "__p"])
    for c in once:
        met = met.filter(c)
    return met.drop(*keys, "__q", "__p")


def _sides(q: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trips as _met() takes them, checkpointed, as they are read several times."""
    boxes = ("min_lng", "min_lat", "max_lng", "max_lat")
    return tuple(cut(x.select(F.col("trip_id").alias(f"{n}_trip"), F.col("t_start").alias(f"{n}_s"), F.col("t_end").alias(f"{n}_e"), *(F.col(f"mbr.{c}").alias(f"{n}_{c}") for c in boxes))) for x, n in ((q, "q"), (p, "p")))


def _tests(d_km: float) -> tuple[Column, Column, tuple, tuple]:
    """Whether trips are together in time, and in space; and the groups for _met() that find all that are."""
    day, size = 86_400, max(geo.degrees_for(d_km) if d_km else 0.0, 0.05)
    a, b = (geo.box(*(F.col(f"{n}_{c}") for c in ("min_lng", "min_lat", "max_lng", "max_lat"))) for n in "qp")
    time = (F.col("q_s") <= F.col("p_e")) & (F.col("p_s") <= F.col("q_e"))
    space = geo.intersects(a, b) | (geo.box_distance(a, b) <= d_km)
    return time, space, ([("s", "e")], day, 0), ([("min_lng", "max_lng"), ("min_lat", "max_lat")], size, size)


def trip_pairs(q: DataFrame, p: DataFrame, d_km: float) -> DataFrame:
    """q_trip, p_trip, in_time, in_space of trips that may be in contact: those not apart in both.

    That is a weak filter, which most pairs of long trips pass, so tracing doesn't use it; candidate_pairs() is the
    strict one. Pairs come from two equi-joins: those together in time, and those together in space alone. q and p: as trips() gives them.
    """
    q, p = _sides(q, p)
    time, space, in_time, in_space = _tests(d_km)
    other = F.col("q_trip") != F.col("p_trip")
    by_time = _met(q, p, [in_time]).filter(other & time).select("q_trip", "p_trip", F.lit(True).alias("in_time"), space.alias("in_space"))
    by_space = _met(q, p, [in_space]).filter(other & ~time).filter(space).select("q_trip", "p_trip", F.lit(False).alias("in_time"), F.lit(True).alias("in_space"))
    return by_time.union(by_space)


def candidate_pairs(q: DataFrame, p: DataFrame, d_km: float) -> DataFrame:
    """q_trip, p_trip of trips that are together in time and in space, joined on both at once."""
    q, p = _sides(q, p)
    time, space, in_time, in_space = _tests(d_km)
    return _met(q, p, [in_time, in_space]).filter((F.col("q_trip") != F.col("p_trip")) & time).filter(space).select("q_trip", "p_trip")
